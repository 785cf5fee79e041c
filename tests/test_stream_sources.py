"""Key source, replacement sink and the log of learned counts: restarts, repeats, rollback."""

import json
import random
from collections import Counter
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from lexiflow.functions import text as X
from lexiflow.operators.learn import learn_deltas
from lexiflow.sources import keystrokes as K
from lexiflow.sources.learned_log import LearnedLog, learn_to_log
from lexiflow.streaming import tracker as T


def line(user, seq, ch=None, **more):
    return json.dumps({"user_id": user, "seq": seq, "ts": 1_704_067_200_000_000 + seq * 100_000, "ch": ch, **more}) + "\n"


def typed(text, users=(1, 2), first=0):
    return "".join(line(u, first + i, c, key=c.upper()) if c != "^" else line(u, first + i, kind="click", x=3, y=4) for u in users for i, c in enumerate(text))


def test_ranges_cut_lines_once(tmp_path):
    rng = random.Random(1)
    lines = [b"x" * rng.choice([0, 1, 5, 70_000]) for _ in range(60)]
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub/a.json").write_bytes(b"".join(x + b"\n" for x in lines) + b"not ended")
    (tmp_path / "_hidden").write_text("x\n")
    end = K._sizes(str(tmp_path))
    assert end == {"sub/a.json": sum(len(x) + 1 for x in lines)}
    start = len(lines[0]) + len(lines[1]) + 2
    for size in (3, 1000, 65_537, 1 << 30) if len(lines) < 100 else ():
        if size == 3:
            small = {"sub/a.json": start + sum(len(x) + 1 for x in lines[2:5])}
            got = [x for p in K._cut({"sub/a.json": start}, small, 50) for x in K._lines(str(tmp_path), p, start)]
            assert got == lines[2:5]
            continue
        for begin, want in ((0, lines), (start, lines[2:])):
            assert [x for p in K._cut({"sub/a.json": begin}, end, size) for x in K._lines(str(tmp_path), p, begin)] == want


def test_keys_feed_the_tracker_across_restarts(spark, tmp_path):
    K.register(spark)
    (tmp_path / "in").mkdir()
    a, b = tmp_path / "in/a.json", tmp_path / "in/b.json"
    first, second = typed("good mor", users=(1,)), typed("ning ^a day. ", users=(1,), first=8)
    cut = len(second) // 2
    a.write_text(first + second[:cut])  # the last line is not ended
    b.write_text(typed("it's ok ", users=(2,)) + line(2, 8, "q", injected=True))

    def go():
        raw = spark.readStream.format("keystrokes").option("path", str(tmp_path / "in")).option("partBytes", 97).load()
        q = T.track_stream(T.key_events(raw)).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination(200)
        assert q.exception() is None
        return sorted((r.user_id, r.seq, r.word, r.previous_word) for r in spark.read.parquet(str(tmp_path / "out")).collect())

    assert [r[2] for r in go()] == ["good", "morning", "it's", "ok"]
    with a.open("a") as f:
        f.write(second[cut:])
    (tmp_path / "in/c.json").write_text(typed("new file ", users=(3,)))
    got = go()
    batch = spark.read.format("keystrokes").load(str(tmp_path / "in"))
    assert batch.count() == len((a.read_text() + b.read_text()).splitlines()) + 9 and batch.filter("kind = 'click' and x = 3").count() == 1
    want = sorted((r.user_id, r.seq, r.word, r.previous_word) for r in T.track_batch(T.key_events(batch)).collect())
    assert got == want and [r[2:] for r in got if r[0] == 1] == [("good", None), ("morning", "good"), ("a", None), ("day", "a")]
    a.write_text("no record\n" * 400)
    with pytest.raises(Exception, match="is no record"):
        spark.read.format("keystrokes").load(str(tmp_path / "in")).collect()
    assert spark.read.format("keystrokes").option("badLines", "skip").load(str(tmp_path / "in")).count() == 18


def test_replacements_are_written_once_and_end_at_a_rejected_key(spark, tmp_path):
    K.register(spark)
    asked = [(1, 1, "teh", "the"), (1, 2, "helo", "hel☃lo"), (1, 3, "x", ""), (1, 4, "same", "same"), (1, 5, None, "new"), (1, 6, "a" * 101, "b")]
    spark.createDataFrame(asked, "user_id long, seq long, typed string, wanted string").write.parquet(str(tmp_path / "in/a"))
    out = str(tmp_path / "out")

    def go(cp):
        stream = spark.readStream.schema("user_id long, seq long, typed string, wanted string").option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
        q = stream.writeStream.format("replacements").option("path", out).option("query", "fix").option("rejects", "☃").option("checkpointLocation", str(tmp_path / cp)).trigger(availableNow=True).start()
        q.awaitTermination(200)
        assert q.exception() is None
        return sorted((r.seq, r.ok, r["keys"], r.sent, r.expected) for r in K.read_replacements(spark, out).collect())

    want = [(1, True, "<<he", 8, 8), (2, False, "<", 2, 8), (3, False, "", 0, 0), (4, True, "", 0, 0), (5, True, "new", 6, 6), (6, False, "", 0, 0)]
    assert go("cp") == want
    assert go("other") == want  # the same batch of the same query, run again without its checkpoint
    (entry,) = (tmp_path / "out/log").glob("*.json")
    assert {f"data/{f.name}" for f in (tmp_path / "out/data").iterdir()} == set(json.loads(entry.read_text()))
    plans = spark.createDataFrame(asked, "u long, seq long, typed string, wanted string").select("seq", X.replacement_keys(F.col("typed"), F.col("wanted")).alias("k")).collect()
    for r in plans:
        result, keys = K.replacement_events(*asked[r.seq - 1][2:])
        assert (result["ok"], result["deleted"], result["typed"], result["expected"]) == (r.k.ok, r.k.deleted, r.k.typed, r.k.expected) and result["sent"] == 2 * len(keys)


def tables(spark, rows):
    words = spark.createDataFrame([r for r in rows if len(r) == 2], "word string, cnt long")
    return words, spark.createDataFrame([r for r in rows if len(r) == 3], "first string, second string, cnt long")


def held(log, at=None):
    return Counter({tuple(r)[:-1]: r.cnt for part in log.totals(at) for r in part.collect()})


def test_log_of_learned_counts(spark, tmp_path):
    log, other = (LearnedLog(spark, f"file://{tmp_path}/log", merge_every=3) for _ in range(2))
    assert held(log) == {} and log.vacuum() == 0
    rng, want, at = random.Random(3), Counter(), {}
    for i in range(7):
        rows = list({k: (*k, rng.randrange(1, 9)) for k in [(rng.choice("abc"),) if rng.random() < 0.5 else (rng.choice("ab"), rng.choice("ab")) for _ in range(6)]}.values())
        assert (log if i % 2 else other).append(*tables(spark, rows), f"b{i}")
        assert not log.append(*tables(spark, rows), f"b{i}")  # again: nothing
        want.update({r[:-1]: r[-1] for r in rows})
        at[i] = (log.state().version, Counter(want))
    assert held(log) == want and sorted(n for _, n in log.state().tables) == [0, 1, 1]
    assert held(log, at[2][0]) == at[2][1]
    back = log.rollback(at[4][0])
    assert held(log) == at[4][1] and "b5" not in log.state().batches and log.append(*tables(spark, [("new", 1)]), "b5")
    assert held(log) == at[4][1] + Counter({("new",): 1})
    log.reset()
    assert held(log) == {} and not log.append(*tables(spark, [("a", 1)]), "b1")
    log.rollback(back)
    log.merge(everything=True)
    assert held(log) == at[4][1] and len(log.state().tables) == 1 and log.vacuum() > 0 and held(log) == at[4][1]
    with pytest.raises(ValueError):
        log.rollback(10_000)
    assert not log._put(1, {"op": "reset"})  # an entry's number is taken once


def test_learning_survives_kills(spark, tmp_path):
    """The query is killed between the change of the log and Spark's own note of it, on every batch; the counts are those of one batch run."""
    words = spark.createDataFrame([("good", 50000), ("day", 10), ("all", 7)], "word string, freq long")
    users = spark.createDataFrame([], "word string")
    schema = "word string, previous_word string"
    parts = [[("Good", None), ("day", "good")], [("day", "good"), ("all", "day"), ("dya", "good")], [("all", None)]]
    for i, part in enumerate(parts):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))

    class Dying(LearnedLog):
        def append(self, words, pairs, batch):
            if super().append(words, pairs, batch):
                raise RuntimeError("killed")
            return False

    log, runs = Dying(spark, str(tmp_path / "log")), 0
    while True:
        stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        q = learn_to_log(stream, words, users, log, str(tmp_path / "cp"))
        runs += 1
        try:
            q.processAllAvailable()
            break
        except Exception as error:
            assert "killed" in str(error) and runs < 6
        finally:
            q.stop()
    every = spark.createDataFrame([r for p in parts for r in p], "word string, previous string")
    want = Counter({tuple(r)[:-1]: r.cnt for part in learn_deltas(every, words, users) for r in part.collect()})
    assert held(log) == want and runs == 4


def test_rows_of_the_source_without_spark(tmp_path):
    (tmp_path / "a.json").write_text('{"user_id": 1, "seq": 2, "ts": 1000000, "ch": "a"}\n\n{"user_id": 2, "kind": "click", "x": 1, "y": 2}\n')
    reader = K._BatchReader({"path": str(tmp_path)})
    got = [r for p in reader.partitions() for r in reader.read(p)]
    assert [r[:4] for r in got] == [(1, 2, datetime.fromisoformat("1970-01-01T00:00:01+00:00"), "key"), (2, None, None, "click")]
