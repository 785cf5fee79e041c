"""The dictionary as of each word's time, and table functions in SQL."""

import random
from datetime import datetime, timedelta

import pytest

from lexiflow.functions import tables
from lexiflow.operators import temporal
from lexiflow.operators.vocab_build import affix_rules, expand_affixes

START = datetime(2024, 1, 1)


def history(rng, n=300):
    uses = [(rng.randrange(3), rng.choice(["the", "cat", "zzq", "Foo "]), i, rng.randrange(200)) for i in range(n)]
    edits = [(rng.randrange(3), rng.choice(["the", "CAT", "zzq", "foo"]), rng.choice(["add", "remove", "other"]), rng.randrange(200)) for _ in range(60)]
    return uses, edits


def brute(uses, edits, words):
    out = []
    for user, word, seq, at in uses:
        clean = (word or "").strip().lower()
        past = [(e[3], e[2] == "remove", e[2]) for e in edits if e[0] == user and e[1].strip().lower() == clean and e[3] <= at and e[2] != "other"]
        out.append((user, seq, bool(clean) and (max(past)[2] == "add" if past else clean in words)))
    return sorted(out, key=str)


@pytest.mark.parametrize("run", [7, temporal.RUN])
def test_words_are_judged_as_of_their_time(spark, run):
    uses, edits = history(random.Random(run))
    uses += [(1, None, 900, 5), (1, " ", 901, 5), (None, "the", 902, 5), (None, "zzq", 903, 5)]
    words = spark.createDataFrame([("the", 5), ("cat", 1)], "word string, freq long")
    u, e = spark.createDataFrame(uses, "user_id long, word string, seq long, at long"), spark.createDataFrame(edits, "user_id long, word string, op string, at long")
    got = temporal.known_as_of(u, words, e, run).select("user_id", "seq", "known")
    assert sorted(map(tuple, got.collect()), key=str) == brute(uses, edits, {"the", "cat"})
    spans = temporal.validity(e).collect()
    assert spans and all(r.valid_to is None or r.valid_from < r.valid_to for r in spans)
    assert temporal.known_as_of(u, words, e.limit(0), run).filter("known").count() == sum((w or "").strip().lower() in ("the", "cat") for _, w, *_ in uses)


def test_the_dictionary_on_a_stream(spark, tmp_path):
    rng = random.Random(4)
    uses, edits = history(rng, 80)
    words = spark.createDataFrame([("the", 5), ("cat", 1)], "word string, freq long")
    at = lambda s: START + timedelta(seconds=s)
    streams = []
    for name, rows, schema in (("u", [(*r[:3], at(r[3])) for r in uses] , "user_id long, word string, seq long, ts timestamp"), ("e", [(*r[:3], at(r[3])) for r in edits], "user_id long, word string, op string, ts timestamp")):
        rng.shuffle(rows)
        end = [(-1, "the", 0 if name == "u" else "add", at(10**6))]
        for i, part in enumerate((rows[::2], rows[1::2], end)):
            spark.createDataFrame(part, schema).coalesce(1).write.parquet(str(tmp_path / f"{name}/{i}"))
        streams.append(spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / name)))
    out = temporal.known_stream(streams[0], words, streams[1], delay="1 hour")
    q = out.writeStream.format("memory").queryName("known_out").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(280)
    assert q.exception() is None
    got = sorted(((r.user_id, r.seq, r.known) for r in spark.table("known_out").filter("user_id >= 0").collect()), key=str)
    assert got == brute(uses, edits, {"the", "cat"})


AFF = "SFX S Y 2\nSFX S y ies [^aeiou]y\nSFX S 0 s [^y]\nPFX U Y 1\nPFX U 0 un .\n"


def test_affix_forms_in_sql(spark):
    tables.register(spark)
    entries = [("city", "S"), ("Do", "SU"), ("cat", None), (None, "S"), ("x", "QQ")]
    df = spark.createDataFrame(entries, "word string, flags string")
    got = spark.sql("SELECT entry, form FROM affix_forms(TABLE(SELECT word, flags FROM {df}), {aff})".replace("{aff}", "'" + AFF.replace("\n", "\\n") + "'"), df=df)
    found, rules = {tuple(r) for r in got.collect()}, affix_rules(spark, AFF)
    assert {f for _, f in found} == {r.word for r in expand_affixes(df, rules).collect()}
    assert found == {("city", "city"), ("city", "cities"), ("Do", "do"), ("Do", "dos"), ("Do", "undo"), ("Do", "undos"), ("cat", "cat"), ("x", "x")}
    assert [tuple(r) for r in rules.orderBy("flag", "strip").collect()] == sorted((tuple(r.values()) for r in tables.affix_rows(AFF)), key=lambda r: (r[0], r[3]))


def test_any_score_ranks_completions_in_sql(spark):
    tables.register(spark)
    rows = [("a", "ab", 5), ("a", "ac", 9), ("a", "aa", 5), ("b", "bb", 1), ("a", None, 3), ("b", "bc", None)]
    df = spark.createDataFrame(rows, "prefix string, word string, freq long")
    ask = lambda score, k: sorted(tuple(r) for r in spark.sql(f"SELECT prefix, word, rank FROM ranked_completions(TABLE(SELECT *, CAST({score} AS DOUBLE) AS score FROM {{df}}) PARTITION BY (prefix), {k})", df=df).collect())
    assert ask("freq", 2) == [("a", "aa", 2), ("a", "ac", 1), ("b", "bb", 1)]
    assert ask("-length(word) - freq", 5) == [("a", "aa", 1), ("a", "ab", 2), ("a", "ac", 3), ("b", "bb", 1)]
    assert ask("freq", 0) == []
