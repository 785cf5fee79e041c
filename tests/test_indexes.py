"""The metric index against comparing every pair, the stored trie against the completion of all prefixes."""

import random

import pytest
from pyspark.sql import functions as F

from lexiflow.operators import complete, complete_index, metric, similarity
from lexiflow.sources.tables import scratch


def vocabulary(spark, n=300, seed=1):
    rng = random.Random(seed)
    words = {"".join(rng.choice("abcdé'") for _ in range(rng.choice([1, 2, 3, 5, 8, 12]))) for _ in range(n)}
    return spark.createDataFrame([(w, rng.choice([1, 2, 2, 5, 40, 300])) for w in sorted(words)], "word string, freq long")


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_metric_search_equals_every_pair(spark):
    words = vocabulary(spark).unionByName(spark.createDataFrame([(None, 1), ("", 1), ("x" * 60, 1)], "word string, freq long"))
    rng = random.Random(2)
    probes = spark.createDataFrame([("".join(rng.choice("abcde") for _ in range(rng.randrange(0, 11))),) for _ in range(40)] + [(None,), ("x" * 58,), ("x" * 58,)], "typed string")
    with scratch():
        index = metric.build_index(words)
        assert index.pivots[0] == "" and len(index.pivots) == metric.PIVOTS
        fine = probes.filter("typed is not null")
        for k in (0, 1, 3, 4):
            assert rows(metric.range_search(probes, index, k)) == rows(similarity.similarity_join(fine, words.filter("word is not null"), k, "scan"))
        assert metric.range_search(probes, index, -1).count() == 0
        one = metric.compared(probes, index, 2).first()
        assert one.pairs == 40 * index.table.count() + index.table.count() - (40 - fine.filter("length(typed) < 11").distinct().count()) * index.table.count() and one.measured < one.pairs / 2
        empty = metric.build_index(words.limit(0))
        assert metric.range_search(probes, empty, 3).count() == 0


@pytest.mark.parametrize("k", [1, 5])
def test_trie_search_equals_all_prefixes(spark, tmp_path, k):
    words = vocabulary(spark, seed=3)
    prefixes = spark.createDataFrame([(p,) for p in ["a", "ab", "abc", "é", "'", " B ", "", "zz", "dé'", "cab", "ca", "ac", "cc"]], "prefix string")
    with scratch():
        index = complete_index.build_completion_index(words, str(tmp_path / "trie"))
        got = complete_index.complete_from_index(prefixes, words, index, k)
        want = complete.complete(prefixes, words, k=k).select("prefix", "word", "freq", "is_contraction", "rank")
        assert rows(got) == rows(want) and got.count() >= 10
        nodes = index.nodes()
        below = {r.node: r for r in nodes.collect()}
        every = words.collect()
        assert all(n.best == max(w.freq for w in every if w.word.startswith(p)) for p, n in below.items()) and len(below) == len({w.word[:i] for w in every for i in range(1, len(w.word) + 1)})


def test_search_reads_only_the_folders_of_its_letters(spark, tmp_path):
    words = vocabulary(spark, seed=4)
    with scratch():
        index = complete_index.build_completion_index(words, str(tmp_path / "trie"))
        one = index.nodes().filter(F.col("lead").isin(["c61"]))
        assert 0 < len(one.inputFiles()) < len(index.nodes().inputFiles())
        plan = complete_index.best_words(spark.createDataFrame([("ab",)], "prefix string"), index, 3)
        assert plan.count() == 3


def test_metric_search_of_few_edits_measures_few_pairs(spark):
    """Words of nearly the same distances to all pivots, which pivots cannot tell apart, meet only on what deletions leave; F3."""
    rng = random.Random(6)
    made = lambda n: ["".join(rng.choice("abcdefgh") for _ in range(12)) for _ in range(n)]
    words, typed = made(300), made(20)
    typed += [w[:3] + "z" + w[4:9] + w[10:] for w in words[:10]]
    with scratch():
        index = metric.build_index(spark.createDataFrame([(w,) for w in words], "word string"))
        found = metric.range_search(spark.createDataFrame([(t,) for t in typed], "typed string"), index, 3)
        assert rows(found) == rows(similarity.similarity_join(spark.createDataFrame([(t,) for t in typed], "typed string"), index.table, 3, "scan"))
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert "rest" in plan and "own_d0" not in plan
