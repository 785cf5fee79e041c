"""Streams in any order of arrival against their batch counterparts."""

import random
from collections import defaultdict
from datetime import datetime, timedelta

import pytest

from lexiflow.streaming import ordered as O
from lexiflow.streaming import sessions as Z
from lexiflow.streaming import tracker as T

START = datetime(2024, 1, 1)
LATER = START + timedelta(days=2)


def arrive(spark, tmp_path, frame, files=4, seed=3):
    """A stream of the rows of frame, shuffled over files that are read one at a time; a last one moves the watermark on."""
    rows = [tuple(r) for r in frame.collect()]
    random.Random(seed).shuffle(rows)
    for i in range(files):
        spark.createDataFrame(rows[i::files], frame.schema).coalesce(1).write.parquet(str(tmp_path / f"in/{i:03d}"))
    end = tuple(-1 if f.name == "user_id" else LATER if f.name == "ts" else 0 if f.name == "seq" else "key" if f.name == "kind" else None for f in frame.schema)
    spark.createDataFrame([end], frame.schema).write.parquet(str(tmp_path / "in/999"))
    return spark.readStream.schema(frame.schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))


def finish(spark, tmp_path, stream, name):
    q = stream.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / f"cp-{name}")).trigger(availableNow=True).start()
    q.awaitTermination(280)
    assert q.exception() is None
    return sorted((tuple(r) for r in spark.table(name).filter("user_id >= 0").collect()), key=str)


def typing(rng, users=3, n=120, kinds=("click", "window", "dismiss", "caret_moved", "backspace"), most=4.0):
    out = []
    for u in range(users):
        at = 0.0
        for i in range(n):
            at += rng.choice([0.1, 0.5, 2.4999, 2.5, rng.random() * most])
            odd = rng.random() < 0.12
            out.append((u, i, START + timedelta(microseconds=int(at * 1e6)), rng.choice(kinds) if odd else "key", None if odd else rng.choice("abcd'  .,1")))
    return out


def brute_sessions(rows, gap=2_500_000):
    by, out = defaultdict(list), []
    for u, seq, ts, kind, _ in rows:
        by[u].append((ts, seq, kind))
    for u, some in by.items():
        live = None
        for ts, _, kind in sorted(some):
            if live and ts - live[1] >= timedelta(microseconds=gap):
                out.append((u, *live, "idle", live[1] + timedelta(microseconds=gap)))
                live = None
            if kind == "key":
                live = (live[0], ts, live[2] + 1) if live else (ts, ts, 1)
            elif kind in Z.ENDS and live:
                out.append((u, *live, kind, ts))
                live = None
        if live:
            out.append((u, *live, "idle", live[1] + timedelta(microseconds=gap)))
    return sorted(out, key=str)


@pytest.mark.parametrize("run_seconds", [5, 3600])
def test_sessions_end_by_events_and_silence(spark, run_seconds):
    rows = typing(random.Random(1), users=4, n=200)
    rows += [(9, 0, START, "click", None), (9, 1, START, "key", "a"), (9, 2, START, "key", "b"), (9, 3, START, "dismiss", None), (9, 4, START, "click", None), (None, 1, START, "key", "a"), (8, 1, None, "key", "a"), (7, 1, START, None, None)]
    frame = spark.createDataFrame(rows, T.EVENTS)
    want = brute_sessions([r for r in rows if r[0] is not None and r[2] is not None])
    got = sorted((tuple(r) for r in Z.event_sessions(frame, run_seconds=run_seconds).collect()), key=str)
    assert got == want and {r[4] for r in got} == {*Z.ENDS, "idle"} and (9, START, START, 2, "dismiss", START) in got
    assert Z.event_sessions(frame.limit(0)).count() == 0


def test_session_stream_equals_batch(spark, tmp_path):
    frame = spark.createDataFrame(typing(random.Random(2)), T.EVENTS)
    stream = O.session_stream(arrive(spark, tmp_path, frame), delay="1 hour")
    assert finish(spark, tmp_path, stream, "sessions_out") == sorted((tuple(r) for r in Z.event_sessions(frame).collect()), key=str)


def test_tracker_takes_events_in_any_order(spark, tmp_path):
    frame = spark.createDataFrame(typing(random.Random(4)), T.EVENTS)
    got = finish(spark, tmp_path, O.track_ordered(arrive(spark, tmp_path, frame), delay="1 hour"), "words_out")
    assert got == sorted((tuple(r) for r in T.track_batch(frame).collect()), key=str) and len(got) > 20


def quiet_events(spark, seed):
    rng = random.Random(seed)
    rows = [(*r, rng.choice([True, False, None, None, None, None, None, None])) for r in typing(rng, n=150)]
    return spark.createDataFrame(rows, T.EVENTS + ", quiet boolean")


def gated(rows):
    """The words that a tracker finishes which is reset by each change of the mode and sees nothing in it."""
    by, out = defaultdict(list), []
    for r in rows:
        by[r.user_id].append(r)
    for u, some in by.items():
        tracker, quiet = T.Tracker(), False
        for r in sorted(some, key=lambda r: r.seq):
            now = quiet if r.quiet is None else r.quiet
            if now != quiet:
                tracker.reset()
            quiet = now
            if not quiet and (done := tracker.event(r.kind, r.ch)):
                out.append((u, r.seq, *done[:4]))
    return sorted(out, key=str)


@pytest.mark.parametrize("run", [7, 4096])
def test_quiet_gate_resets_the_tracker(spark, run):
    frame = quiet_events(spark, 5)
    got = T.track_batch(Z.quiet_gate(frame, run=run)).select("user_id", "seq", "word", "previous_word", "separator", "start_was_known")
    assert sorted((tuple(r) for r in got.collect()), key=str) == gated(frame.collect())


def test_quiet_stream_equals_batch(spark, tmp_path):
    frame = quiet_events(spark, 6)
    got = finish(spark, tmp_path, O.track_ordered(arrive(spark, tmp_path, frame), delay="1 hour"), "quiet_out")
    assert got == sorted((tuple(r) for r in T.track_batch(Z.quiet_gate(frame)).collect()), key=str) and len(got) > 10


def test_users_who_went_away_begin_anew(spark, tmp_path):
    at = lambda s: START + timedelta(seconds=s)
    rows = [(1, 0, at(0), "key", "a"), (1, 1, at(1), "key", "b"), (1, 2, at(100), "key", "c"), (1, 3, at(101), "key", " ")]
    frame = spark.createDataFrame(rows, T.EVENTS)
    assert [r[2] for r in finish(spark, tmp_path, O.track_ordered(arrive(spark, tmp_path, frame), delay="1 hour", forget_after=30.0), "away_out")] == ["c"]


def test_text_before_of_two_streams(spark, tmp_path):
    rng = random.Random(7)
    made = [r for r in typing(rng, users=2, n=60) if r[3] == "key"]
    events = spark.createDataFrame(made, T.EVENTS)
    readings = [(rng.randrange(2), START + timedelta(milliseconds=rng.randrange(60_000)), "some text here"[: rng.randrange(15)], rng.choice([None, 0, 3, 99, -1]), rng.choice([None, 10, 150, 151])) for _ in range(80)]
    readings += [(made[5][0], made[5][2], "same time", 4, 1)]
    readings = [*{(r[0], r[1]): r for r in readings}.values()]
    carets = spark.createDataFrame(readings, "user_id long, ts timestamp, text string, caret int, took_ms int")
    (tmp_path / "a").mkdir(), (tmp_path / "b").mkdir()
    stream = O.text_before_stream(arrive(spark, tmp_path / "a", events), arrive(spark, tmp_path / "b", carets, seed=9), delay="1 hour")
    got = finish(spark, tmp_path, stream.select("user_id", "seq", "before"), "before_out")
    want = T.with_text_before(events, carets).select("user_id", "seq", "before").collect()
    assert got == sorted(map(tuple, want), key=str) and len({b for *_, b in got}) > 5


def test_late_readings_change_nothing(spark, tmp_path):
    at = lambda s: START + timedelta(seconds=s)
    reading = "user_id long, ts timestamp, text string, caret int, took_ms int"
    events = [[(1, 0, at(10), "key", "a")], [(1, 1, at(100), "key", "b")], [(-1, 2, at(101), "key", "c")], [(-1, 2, at(102), "key", "c")], [(-1, 3, LATER, "key", "d")]]
    carets = [[(1, at(5), "early", 5, 1)], [(1, at(90), "mid", 3, 1)], [(-1, at(95), "other", 3, 1)], [(1, at(9), "too late", 8, 1), (1, at(99), "in time", 7, 1)], [(-1, LATER, None, None, None)]]
    streams = []
    for name, parts, schema in (("e", events, T.EVENTS), ("c", carets, reading)):
        for i, part in enumerate(parts):
            spark.createDataFrame(part, schema).coalesce(1).write.parquet(str(tmp_path / f"{name}/{i}"))
        streams.append(spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / name)))
    got = finish(spark, tmp_path, O.text_before_stream(*streams, delay="20 seconds").select("user_id", "seq", "before"), "late_out")
    assert got == [(1, 0, "early"), (1, 1, "in time")]


def test_stale_results_never_appear(spark, tmp_path):
    schema = "user_id long, version long, result string"
    parts = [[(1, 3, "c"), (1, 2, "b"), (2, 1, "x")], [(1, 1, "a"), (1, 3, "again"), (2, None, "none")], [(1, 5, "e"), (1, 4, "d"), (2, 2, "y"), (3, 0, "z")]]
    for i, part in enumerate(parts):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = finish(spark, tmp_path, O.latest_stream(stream, "user_id", forget_after=3600.0), "latest_out")
    assert got == [(1, 3, "c"), (1, 5, "e"), (2, 1, "x"), (2, 2, "y"), (3, 0, "z")]
