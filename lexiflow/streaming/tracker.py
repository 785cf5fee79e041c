"""Key events to finished words: a state machine per user, in batch and in Structured Streaming; typing sessions."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import asdict, dataclass

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.constants import IDLE_SECONDS, TEXT_WAIT_MS
from ..functions.text import before_caret

EVENTS = "user_id long, seq long, ts timestamp, kind string, ch string"
FINISHED = "user_id long, seq long, word string, previous_word string, separator string, start_was_known boolean, link struct<typed:string,separator:string,start_known:boolean,before:string>"


#: Places of seq in which the resets of a user are counted together.
SPAN_RUN = 4096


@dataclass
class Tracker:
    """State of one user: the word being typed, the context before it, the last finished word with its own context, whether the
    current word's first letter was seen, and a version that every change raises."""

    current: str = ""
    previous: str | None = None
    last_finished: dict | None = None
    start_known: bool = False
    version: int = 0

    def character(self, c: str) -> tuple | None:
        """A typed character; gives (word, previous, separator, start known, link) when it finishes a word."""
        if c == "'" or c.isalpha():
            self.current += c
            self.version += 1
        elif c.isdigit():
            self.clear()
        else:
            return self._finish(c)
        return None

    def _finish(self, separator: str) -> tuple | None:
        out = None
        if self.current:
            out = (self.current, self.previous, separator, self.start_known, self.last_finished)
            self.last_finished = {"typed": self.current, "separator": separator, "start_known": self.start_known, "before": self.previous}
            self.previous = self.current.lower()
        else:
            self.last_finished = None
        self.current, self.start_known = "", True
        self.version += 1
        if separator in ".?!":
            self.previous = self.last_finished = None
        return out

    def clear(self) -> None:
        """Drops the word being typed, but not the context before it."""
        if self.current:
            self.current, self.start_known = "", True
            self.version += 1
        self.last_finished = None

    def backspace(self) -> bool:
        if not self.current:
            self.reset()
            return False
        self.current = self.current[:-1]
        self.version += 1
        return True

    def reset(self) -> None:
        self.current, self.previous, self.last_finished, self.start_known = "", None, None, False
        self.version += 1

    def accept(self, word: str) -> None:
        before, self.current, self.start_known = self.previous, "", True
        self.previous = word.lower() if word.strip() else None
        self.last_finished = {"typed": word, "separator": " ", "start_known": True, "before": before} if self.previous else None
        self.version += 1

    def correct_last(self, word: str) -> None:
        self.current, self.start_known = "", True
        self.version += 1
        if self.last_finished is not None and word.strip():
            self.previous = word.lower()
            self.last_finished = self.last_finished | {"typed": word, "start_known": True}

    def confirm_start(self, version: int) -> bool:
        """Marks the start as seen unless something has changed since `version` was read."""
        self.start_known = self.start_known or version == self.version
        return version == self.version

    def event(self, kind: str, ch: str | None) -> tuple | None:
        if kind == "key":
            return self.character(ch) if ch and ch >= " " else None
        if kind == "backspace":
            self.backspace()
        elif kind in ("caret_moved", "click", "window"):
            self.reset()
        elif kind == "accept":
            self.accept(ch or "")
        elif kind == "correct":
            self.correct_last(ch or "")
        return None


def _drive(state: Tracker, user: int, frame: pd.DataFrame) -> pd.DataFrame:
    rows = [(user, s, *out) for s, k, c in zip(frame["seq"], frame["kind"], frame["ch"], strict=True) if (out := state.event(k, c if isinstance(c, str) else None))]
    return pd.DataFrame(rows, columns=["user_id", "seq", "word", "previous_word", "separator", "start_was_known", "link"])


def track_batch(events: DataFrame) -> DataFrame:
    """Finished words of a bounded set of events. A user's events between two resets are independent, so the groups are these spans; they are
    numbered in two levels, over runs of SPAN_RUN places of seq and within them, so that a user with many events is not gathered in one task."""
    cut = F.col("kind").isin("caret_moved", "click", "window").cast("int")
    rows = events.withColumn("run", F.floor(F.col("seq") / SPAN_RUN))
    upto = lambda w, last: w.rowsBetween(Window.unboundedPreceding, last)
    before = F.coalesce(F.sum("cuts").over(upto(Window.partitionBy("user_id").orderBy("run"), -1)), F.lit(0))
    runs = rows.groupBy("user_id", "run").agg(F.sum(cut).alias("cuts")).select("user_id", "run", before.alias("before"))
    inner = F.sum(cut).over(upto(Window.partitionBy("user_id", "run").orderBy("seq"), 0))
    spans = rows.withColumn("inner", inner).join(runs, ["user_id", "run"]).withColumn("span", F.col("before") + F.col("inner"))
    ordered = spans.select("user_id", "span", "seq", "kind", "ch").repartition("user_id", "span").sortWithinPartitions("user_id", "span", "seq")
    return ordered.mapInArrow(_drive_spans, FINISHED)


def _drive_spans(batches):
    """Finished words of rows that come span by span, in order: many spans pass through one call, and only a tracker is held."""
    import pyarrow as pa

    link = pa.struct([("typed", pa.string()), ("separator", pa.string()), ("start_known", pa.bool_()), ("before", pa.string())])
    shape = pa.schema([("user_id", pa.int64()), ("seq", pa.int64()), ("word", pa.string()), ("previous_word", pa.string()), ("separator", pa.string()), ("start_was_known", pa.bool_()), ("link", link)])
    now, tracker = None, Tracker()
    for batch in batches:
        out = []
        for user, span, seq, kind, ch in zip(*(batch.column(c).to_pylist() for c in ("user_id", "span", "seq", "kind", "ch")), strict=True):
            if (user, span) != now:
                now, tracker = (user, span), Tracker()
            if done := tracker.event(kind, ch):
                out.append((user, seq, *done))
        if out:
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), shape, strict=True)], schema=shape)


def track_stream(events: DataFrame, forget_after: float | None = None) -> DataFrame:
    """Finished words of a stream of events, in append mode; the events of one user must come in order from batch to batch. A user's state
    is dropped after `forget_after` seconds (of processing time) without events, if that is given."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def step(key, frames: Iterator[pd.DataFrame], state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        tracker = Tracker(**json.loads(state.get[0])) if state.exists else Tracker()
        parts = [frame[["seq", "kind", "ch"]] for frame in frames]  # a user's events of one micro-batch
        out = _drive(tracker, int(key[0]), pd.concat(parts).sort_values("seq")) if parts else None
        if out is not None and len(out):
            yield out
        state.update((json.dumps(asdict(tracker)),))
        if forget_after is not None:
            state.setTimeoutDuration(int(forget_after * 1000))

    timeout = GroupStateTimeout.NoTimeout if forget_after is None else GroupStateTimeout.ProcessingTimeTimeout
    return events.groupBy("user_id").applyInPandasWithState(step, FINISHED, "state string", "append", timeout)


def live_changes(events: DataFrame, gap: float = IDLE_SECONDS) -> DataFrame:
    """(user_id, live) of a stream of events, in append mode: true when a user begins to type, false once no event has come for the gap.
    A timer closes what is idle, so no further event is needed, and drops the state."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def step(key, frames: Iterator[pd.DataFrame], state: GroupState):
        began = not state.hasTimedOut and not state.exists
        if state.hasTimedOut:
            state.remove()
        else:
            for _ in frames:
                pass
            state.update((True,))
            state.setTimeoutDuration(int(gap * 1000))
        if began or not state.exists:
            yield pd.DataFrame({"user_id": [int(key[0])], "live": [began]})

    return events.groupBy("user_id").applyInPandasWithState(step, "user_id long, live boolean", "live boolean", "append", GroupStateTimeout.ProcessingTimeTimeout)


#: What keys other than letters do. Enter accepts, what moves the caret drops the word.
KEY_KINDS = {"Up": "move_up", "Down": "move_down", "Escape": "dismiss", "Enter": "accept_key", "Back": "backspace"} | dict.fromkeys(("Tab", "Left", "Right", "Home", "End", "PageUp", "PageDown", "Delete"), "caret_moved")


def key_events(raw: DataFrame) -> DataFrame:
    """EVENTS from raw key presses (user_id, seq, ts, key, ch, ctrl, alt, injected), batch or stream: keys that the program sent itself are
    left out, named keys get their kind, with Ctrl or Alt held anything else moves the caret, and control characters type nothing. With a
    column kind (as of the source `keystrokes`), rows of kind `click` are clicks."""
    kinds = F.create_map(*(F.lit(x) for pair in KEY_KINDS.items() for x in pair))
    held = F.coalesce("ctrl", F.lit(False)) | F.coalesce("alt", F.lit(False))
    kind = F.coalesce(F.element_at(kinds, F.coalesce("key", F.lit(""))), F.when(held, "caret_moved").otherwise("key"))
    if "kind" in raw.columns:
        kind = F.when(F.col("kind") == "click", "click").otherwise(kind)
    own = raw.filter(~F.coalesce("injected", F.lit(False))).withColumn("kind", kind)
    typed = own.withColumn("ch", F.when(F.col("kind") == "key", F.col("ch")))
    return typed.filter((F.col("kind") != "key") | typed["ch"].rlike(r"\A[^\p{Cc}]")).select("user_id", "seq", "ts", "kind", "ch")


def with_text_before(events: DataFrame, carets: DataFrame, wait_ms: int = TEXT_WAIT_MS) -> DataFrame:
    """The events with `before`: the text before the caret as of the last of the user's readings (user_id, ts, text, caret, took_ms) up to the
    event; null without one, with a selection (a null caret), or if it took longer than `wait_ms`. Two streams meet in the order of their times."""
    if events.isStreaming:
        from .ordered import text_before_stream

        return text_before_stream(events, carets, wait_ms=wait_ms)
    readings = carets.select("user_id", F.col("ts").alias("__ts"), F.struct("text", "caret", "took_ms").alias("__read"))
    both = events.select("*", F.col("ts").alias("__ts")).unionByName(readings, allowMissingColumns=True)
    order = Window.partitionBy("user_id").orderBy("__ts", F.col("__read").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    joined = both.withColumn("__last", F.last("__read", ignorenulls=True).over(order)).filter("__read is null")
    joined = joined.select(*events.columns, *(F.col(f"__last.{c}").alias(f"__{c}") for c in ("text", "caret", "took_ms")))
    fine = F.col("__caret").isNotNull() & (F.coalesce("__took_ms", F.lit(0)) <= wait_ms)
    return joined.withColumn("before", F.when(fine, before_caret(F.col("__text"), F.col("__caret")))).drop("__text", "__caret", "__took_ms")


def typing_sessions(events: DataFrame, gap: float = IDLE_SECONDS, key: str = "user_id", ts: str = "ts", keep: str = "true") -> DataFrame:
    """Sessions of events that follow within the gap, strictly; `keep` says which events hold a session open."""
    held = events.filter(F.expr(keep)).withColumn("__ts", F.col(ts))
    if not events.isStreaming:
        # Strictly shorter gaps only: an event exactly one gap later opens a new session.
        wide = f"{int(gap * 1_000_000) - 1} microseconds"
    else:
        held, wide = held.withWatermark("__ts", "10 seconds"), f"{int(gap * 1_000_000) - 1} microseconds"
    made = held.groupBy(key, F.session_window("__ts", wide).alias("w")).agg(F.count("*").alias("n_events"), F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"))
    return made.select(key, "n_events", "first_ts", "last_ts")


def is_live(events: DataFrame, gap: float = IDLE_SECONDS, key: str = "user_id", ts: str = "ts") -> DataFrame:
    """Events with live: whether the one before came less than the gap ago."""
    before = F.lag(ts).over(Window.partitionBy(key).orderBy(ts))
    return events.withColumn("live", F.coalesce((F.unix_micros(F.col(ts)) - F.unix_micros(before)) < int(gap * 1_000_000), F.lit(False)))


def latest(rows: DataFrame, key: str, version: str = "version") -> DataFrame:
    """Drops stale work: the row with the highest version of each key."""
    every = F.struct(*rows.columns)
    return rows.groupBy(key).agg(F.max_by(every, version).alias("r")).select("r.*")


def quiet_filter(events: DataFrame, key: str = "user_id") -> DataFrame:
    """Events outside quiet mode; `quiet` is true, false or null (unknown: the last known state goes on, first not quiet)."""
    known = F.last("quiet", ignorenulls=True).over(Window.partitionBy(key).orderBy("seq").rowsBetween(Window.unboundedPreceding, 0))
    return events.withColumn("quiet_now", F.coalesce(known, F.lit(False))).filter(~F.col("quiet_now")).drop("quiet_now")


class HoldGate:
    """Holds up to `most` keys while work is under way, nested; the last end gives them back in order."""

    def __init__(self, most: int = 8):
        self.most, self.depth, self.held = most, 0, []

    def begin(self) -> None:
        self.depth += 1

    def try_hold(self, key) -> bool:
        if not self.depth or len(self.held) >= self.most:
            return False
        self.held.append(key)
        return True

    def end(self, replay) -> None:
        """Replays in rounds until nothing is left; an error drops the rest."""
        if self.depth > 1:
            self.depth -= 1
            return
        try:
            while self.held:
                now, self.held = self.held, []
                for key in now:
                    replay(key)
        except BaseException:
            self.held = []
            raise
        finally:
            self.depth = 0


def learn_from_stream(finished: DataFrame, words: DataFrame, user_words: DataFrame, sink, checkpoint: str):
    """Starts a query that passes each micro-batch's learned words and pairs to sink(words, pairs, batch_id)."""
    from ..operators.learn import learn_deltas

    def batch(frame: DataFrame, batch_id: int) -> None:
        sink(*learn_deltas(frame.select("word", F.col("previous_word").alias("previous")), words, user_words), batch_id)

    return finished.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).start()
