"""The quality classifier: exact votes, held-out accuracy, odd rows."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa

from lexiflow.llm import quality_knn as K

GOOD, BAD = "the and of with tion ing er that".split(), "zz qx $$ ## !!".split()


def text(rng, words, n):
    return " ".join("".join(rng.choice(words) for _ in range(rng.randrange(1, 4))) for _ in range(n))


def tables(spark, n=300, seed=4):
    rng = random.Random(seed)
    docs = [(i, text(rng, GOOD if i % 3 else BAD, rng.randrange(5, 80)), "x", 7.0) for i in range(n)]
    labels = [(i, int(i % 3 > 0), 0) for i in range(n)]
    return docs, labels, spark.createDataFrame(docs, "doc_id long, text string, score string, predicted double").repartition(4), spark.createDataFrame(labels, "doc_id long, quality int, toxic int").repartition(2)


def test_held_out_accuracy_and_odd_rows(spark):
    docs, labels, d, l = tables(spark)
    odd = [(1000, None, "x", 7.0), (1001, "", "x", 7.0), (1002, " \n", "x", 7.0), (None, "the and", "x", 7.0), (5, docs[5][1], "y", 8.0), (1003, "é" * 200_000, "x", 7.0), (1004, "$$ ## " * 100_000, "x", 7.0)]
    d = d.unionByName(spark.createDataFrame(odd, d.schema))
    l = l.unionByName(spark.createDataFrame([(None, 1, 0), (3, None, 0), (7, 5, 0), (2000, 1, 1), (4, 1, 0)], l.schema))
    model = K.learn_quality(d, l.filter("doc_id is null or doc_id % 4 <> 2"))
    rows = K.score_quality(d, model).collect()
    assert len(rows) == len(docs) + len(odd) and {*rows[0].asDict()} == {"doc_id", "text", "score", "predicted"}
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in rows)
    by = {r["doc_id"]: r for r in rows if r["doc_id"] is not None and r["doc_id"] < 1000}
    assert np.mean([by[i]["predicted"] == y for i, y, _ in labels if i % 4 == 2]) > 0.97
    same = [r["score"] for r in rows if r["doc_id"] in (1000, 1001)]
    assert same[0] == same[1] == model.labels.mean() and next(r for r in rows if r["doc_id"] == 1004)["predicted"] == 0
    assert sorted(r["score"] for r in rows) == sorted(r["score"] for r in K.score_quality(d.repartition(7), K.learn_quality(d.repartition(5), l.filter("doc_id is null or doc_id % 4 <> 2"))).collect())


def test_terms_equal_a_plain_count():
    texts = ["aB 1!", None, "the the  The\n", "x", "é é\t9", ""]
    got = K.term_counts(pa.array(texts))
    for t, row in zip(texts, got, strict=True):
        kinds = [int(K._CLASS[b]) for b in (t or "").encode()]
        pairs = Counter(a * K.CLASSES + b for a, b in zip(kinds, kinds[1:], strict=False))
        words = (t or "").split()
        again = sum(a == b for a, b in zip(words, words[1:], strict=False))
        assert {int(k): int(row[k]) for k in np.flatnonzero(row[: K.PAIRS])} == pairs
        assert row[K.PAIRS : K.PAIRS + K.WORDS].sum() == len(words) and (row[-2], row[-1]) == (again, len(words) - again)


def test_votes_equal_a_plain_loop():
    rng = np.random.default_rng(3)
    counts = rng.poisson(0.02, (60, K.TERMS)).astype(np.float32)
    counts[7] = counts[3]  # ties
    weights, labels = np.ones(K.TERMS, np.float32), rng.integers(0, 2, 60)
    model = K.fit(counts, labels, weights, dimensions=10, neighbours=5)
    asked = rng.poisson(0.02, (20, K.TERMS)).astype(np.float32)
    for place, got in zip(model.place(asked), model.scores(asked), strict=True):
        near = sorted(((round(float(place @ v), 5), -i) for i, v in enumerate(model.vectors)), reverse=True)[:5]
        votes = [(max(c, 0) ** 4 + 1e-9, labels[-i]) for c, i in near]
        assert abs(got - sum(v * y for v, y in votes) / sum(v for v, _ in votes)) < 1e-3


def test_without_labels_and_empty(spark):
    _, _, d, l = tables(spark, 20)
    none = K.learn_quality(d, l.limit(0))
    assert {r["score"] for r in K.score_quality(d, none).collect()} == {0.5}
    assert K.score_quality(d.limit(0), K.learn_quality(d.limit(0), l)).count() == 0
