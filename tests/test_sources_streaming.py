import random
from datetime import datetime, timedelta

import pytest

from lexiflow.sources import files as S
from lexiflow.streaming import tracker as T


def put(tmp_path, name, text):
    (tmp_path / name).write_text(text, encoding="utf-8")
    return str(tmp_path / name)


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_count_files(spark, tmp_path):
    assert rows(S.read_words(spark, put(tmp_path, "w", "the 100\n\n  \n# c\nbroken notanumber\ncat 50\nmany 10 x\nzero 0\nTab\t7\n"))) == [("broken", 1), ("cat", 50), ("many", 1), ("tab", 7), ("the", 100)]
    assert rows(S.read_bigrams(spark, put(tmp_path, "b", "the cat 10\nlonely\n\nthe dog 5\n"))) == [("the", "cat", 10), ("the", "dog", 5)]
    assert rows(S.read_user_words(spark, put(tmp_path, "u", "Qadees\nseecs\n\nnustian\n#x\n"))) == [("#x",), ("nustian",), ("qadees",), ("seecs",)]
    assert rows(S.read_user_words(spark, str(tmp_path / "none"))) == []
    with pytest.raises(FileNotFoundError):
        S.read_words(spark, str(tmp_path / "none"))


def test_learned_round_trip(spark, tmp_path):
    w, p = S.read_learned(spark, put(tmp_path, "l", "W hello 7\nP hello there 3\nbad\nW hello 9\nW x y\nP a b -2\n"))
    assert rows(w) == [("hello", 9)] and rows(p) == [("a", "b", -2), ("hello", "there", 3)]
    S.write_learned(w, p, str(tmp_path / "out"))
    again = S.read_learned(spark, str(tmp_path / "out"))
    assert rows(again[0]) == rows(w) and rows(again[1]) == rows(p)
    S.write_words(spark.createDataFrame([("b", 1), ("a", 1), ("c", 5)], "word string, freq long"), str(tmp_path / "words"))
    assert [r.value for r in spark.read.text(str(tmp_path / "words")).collect()] == ["c 5", "a 1", "b 1"]


def test_corpus_files(spark, tmp_path):
    assert rows(S.read_web_counts(spark, put(tmp_path, "c", "The\t10\nthe\t12\nbad\tx\none\ta\tb\n"))) == [("the", 12)]
    assert rows(S.read_web_pairs(spark, put(tmp_path, "p", "of the\t5\nof the\t5\nlonely\t3\n"))) == [("of", "the", 5), ("of", "the", 5)]
    assert rows(S.read_misspellings(spark, put(tmp_path, "m", "teh->the\nteh->ten\nabc->a, b\nx1->x\n"))) == [("teh", "the")]
    assert rows(S.read_dictionary_entries(spark, put(tmp_path, "d", "3\ncat/S\ndog\nrude/S!\n"))) == [("cat", "S"), ("dog", "")]
    assert rows(S.read_wordlist(spark, put(tmp_path, "l", "# c\nkubernetes docker\nxii ot\n"))) == [("docker",), ("kubernetes",)]
    (tmp_path / "latin").write_bytes("caf\xe9 \x93x".encode("latin-1"))
    assert S.read_decoded(spark, str(tmp_path / "latin")).first().text == "café “x"


def test_settings():
    s = S.parse_settings("autocorrect=false\nSuggestionCount=99\nnope=1\nlearning=maybe\n")
    assert not s.autocorrect and s.suggestion_count == 10 and s.learning and S.parse_settings(S.format_settings(s)) == s


def feed(keys, tracker=None):
    tracker = tracker or T.Tracker()
    return tracker, [out for c in keys if (out := tracker.character(c))]


def test_tracker():
    t, _ = feed("good mor")
    assert (t.current, t.previous) == ("mor", "good") and feed("GOOD ")[0].previous == "good" and feed("hello. ")[0].previous is None and feed("hello, ")[0].previous == "hello" and feed("abc1")[0].current == ""
    t, _ = feed("hello ")
    assert t.backspace() is False and t.previous is None and not t.start_known
    assert [x[:3] for x in feed("good morning ")[1]] == [("good", None, " "), ("morning", "good", " ")] and len(feed("hi   ")[1]) == 1
    assert [x[3] for x in feed("ab cd ")[1]] == [False, True]
    t, _ = feed("a")
    stale = t.version
    t.character("b")
    assert not t.confirm_start(stale) and t.confirm_start(t.version) and t.start_known
    t, _ = feed("teh ")
    t.correct_last("the")
    assert t.previous == "the" and feed("x ", t)[1][0][4]["typed"] == "the"


def events(spark, text, users=2):
    start = datetime(2024, 1, 1)
    made = [(u, i, start + timedelta(milliseconds=100 * i), "click" if c == "^" else "key", c) for u in range(users) for i, c in enumerate(text)]
    random.Random(1).shuffle(made)
    return spark.createDataFrame(made, T.EVENTS)


def test_batch_and_stream_agree(spark, tmp_path):
    frame = events(spark, "Good morning. I am^ here, now 12 it's ok ")
    want = sorted(map(tuple, T.track_batch(frame).collect()))
    assert [w[2] for w in want if w[0] == 0] == ["Good", "morning", "I", "here", "now", "it's", "ok"]
    for part, path in ((frame.filter("seq < 20"), "a"), (frame.filter("seq >= 20"), "b")):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in" / path))
    stream = spark.readStream.schema(T.EVENTS).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = T.track_stream(stream).writeStream.format("memory").queryName("finished").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(240)
    assert sorted(map(tuple, spark.table("finished").collect())) == want


def test_sessions_and_gate(spark):
    start = datetime(2024, 1, 1)
    frame = spark.createDataFrame([(1, start + timedelta(seconds=s)) for s in (0, 2, 4.5, 10)], "user_id long, ts timestamp")
    assert sorted(r.n_events for r in T.typing_sessions(frame).collect()) == [1, 1, 2]
    assert [r.live for r in T.is_live(frame).orderBy("ts").collect()] == [False, True, False, False]
    assert rows(T.latest(spark.createDataFrame([("a", 1), ("a", 3), ("b", 2)], "k string, version int"), "k")) == [("a", 3), ("b", 2)]
    quiet = spark.createDataFrame([(1, 1, None), (1, 2, True), (1, 3, None), (1, 4, False)], "user_id long, seq long, quiet boolean")
    assert [r.seq for r in T.quiet_filter(quiet).orderBy("seq").collect()] == [1, 4]
    gate, out = T.HoldGate(), []
    assert not gate.try_hold(0)
    gate.begin(), gate.begin()
    assert sum(gate.try_hold(i) for i in range(10)) == 8
    gate.end(out.append)
    assert out == []
    gate.end(out.append)
    assert out == list(range(8))


def test_entry_without_llm():
    import subprocess
    import sys
    from pathlib import Path

    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    for gone in ("lexiflow.llm", "corpus_pipeline"):
        code = f"import sys; sys.modules['{gone}'] = None; import __spark_entry__ as e; q = e.queries(); assert len(q) > 55 and not any(k == 'pipeline' or k.startswith('op1_') for k in q) and set(e.oracle_sql()) <= set(q)"
        subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).resolve().parents[1], check=True)


def test_spans_of_many_events(spark, monkeypatch):
    frame = events(spark, "ab cd^ ef gh^^ ij. kl mn " * 4)
    want = sorted(map(tuple, T.track_batch(frame).collect()))
    monkeypatch.setattr(T, "SPAN_RUN", 7)
    assert sorted(map(tuple, T.track_batch(frame).collect())) == want and len(want) > 20


def test_repository_and_dictionary(spark, tmp_path):
    put(tmp_path, "words.txt", "the 100\nThe 5\ncat 50\n")
    put(tmp_path, "bigrams.txt", "the cat 10\nthe cat 2\n")
    kept, held = S.TextRepository(spark, str(tmp_path)), S.Dictionary()
    assert not held.is_loaded
    held.load(kept)
    assert rows(held.words) == [("cat", 50), ("the", 105)] and rows(held.bigrams) == [("the", "cat", 12)] and held.is_loaded
    with pytest.raises(FileNotFoundError):
        held.load(S.TextRepository(spark, str(tmp_path / "none")))
    assert held.is_loaded
    kept.save_user_words(spark.createDataFrame([("zeta",), (" Alpha ",), ("",)], "word string"))
    assert rows(kept.user_words()) == [("alpha",), ("zeta",)]
    kept.save_learned(spark.createDataFrame([("cat", 25)], "word string, cnt long"), spark.createDataFrame([("the", "cat", 25)], PAIRS))
    assert rows(kept.learned()[1]) == [("the", "cat", 25)]
    S.write_bigrams(held.bigrams, str(tmp_path / "pairs"))
    assert [r.value for r in spark.read.text(str(tmp_path / "pairs")).collect()] == ["the cat 12"]
    assert rows(S.read_valid_words(spark, put(tmp_path, "v", "One two\n two THREE \n"))) == [("one",), ("three",), ("two",)]
    held.reset()
    assert not held.is_loaded


PAIRS = "first string, second string, cnt long"


def test_diagnostics(spark, tmp_path):
    one = spark.createDataFrame([(datetime(2024, 5, 1, 12), "", 2, 3, 10, 10)], "ts timestamp, app string, deleted int, typed int, sent int, expected int")
    path = str(tmp_path / "log")
    S.append_diagnostics(one, path, enabled=False)
    assert not (tmp_path / "log").exists()
    for _ in range(2):
        S.append_diagnostics(one, path)
    assert [r.value for r in spark.read.text(path).collect()] == ["2024-05-01 12:00:00  app=unknown  delete=2  type=3  sent=10/10"] * 2
    S.append_diagnostics(one, path, most=10)
    assert spark.read.text(path).count() == 1


def test_key_events_and_text_before(spark):
    ts = datetime(2024, 1, 1)
    raw = [(1, 0, ts, "A", "a", False, False, False), (1, 1, ts, "V", "v", True, False, False), (1, 2, ts, "Back", None, None, None, None), (1, 3, ts, "Z", "z", False, False, True), (1, 4, ts, "F1", None, False, False, False), (1, 5, ts, "Left", None, False, False, False), (1, 6, ts, "X", "\x01", False, False, False), (1, 7, ts, "Enter", "\r", False, False, False)]
    got = T.key_events(spark.createDataFrame(raw, "user_id long, seq long, ts timestamp, key string, ch string, ctrl boolean, alt boolean, injected boolean"))
    assert [(r.seq, r.kind, r.ch) for r in got.orderBy("seq").collect()] == [(0, "key", "a"), (1, "caret_moved", None), (2, "backspace", None), (5, "caret_moved", None), (7, "accept_key", None)]
    at = lambda s: ts + timedelta(seconds=s)
    ev = spark.createDataFrame([(1, 0, at(0), "key", "a"), (1, 1, at(2), "key", "b"), (1, 2, at(4), "key", "c"), (2, 3, at(9), "key", "d")], T.EVENTS)
    carets = spark.createDataFrame([(1, at(1), "hello", 3, 10), (1, at(3), "hello", None, 10), (2, at(8), "slow", 2, 200)], "user_id long, ts timestamp, text string, caret int, took_ms int")
    assert [(r.seq, r.before) for r in T.with_text_before(ev, carets).orderBy("seq").collect()] == [(0, None), (1, "hel"), (2, None), (3, None)]


def test_idle_users_are_closed_by_a_timer(spark, tmp_path):
    import time

    start = datetime(2024, 1, 1)
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema(T.EVENTS).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    spark.createDataFrame([(u, 0, start, "key", "a") for u in (1, 2)], T.EVENTS).coalesce(1).write.parquet(str(tmp_path / "in" / "a"))
    q = T.live_changes(stream, gap=1.0).writeStream.format("memory").queryName("live").option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="1 second").start()
    try:
        for _ in range(60):
            time.sleep(1)
            if spark.table("live").count() >= 4:
                break
        assert sorted(map(tuple, spark.table("live").collect())) == [(1, False), (1, True), (2, False), (2, True)]
    finally:
        q.stop()


def test_learning_from_a_stream(spark, tmp_path):
    words = spark.createDataFrame([("good", 50000), ("day", 10)], "word string, freq long")
    users, got = spark.createDataFrame([], "word string"), []
    frame = spark.createDataFrame([("Good", None), ("day", "good"), ("dya", "good")], "word string, previous_word string")
    frame.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(frame.schema).parquet(str(tmp_path / "in"))
    q = T.learn_from_stream(stream, words, users, lambda w, p, i: got.extend(map(tuple, [*w.collect(), *p.collect()])), str(tmp_path / "cp"))
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    assert sorted(got, key=str) == [("day", 50), ("good", "day", 50), ("good", 50)]
