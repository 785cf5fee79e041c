"""Stateful operators that see each key's rows in order, however they arrive: trackers, sessions, lookups, latest results.

A processor holds a key's rows until the watermark has passed them; an event-time timer then hands on what is due, by time and place. So
within the watermark's delay the order of arrival changes nothing, and streams give the rows of their batch counterparts. What is
later than the delay Spark drops, and the newest rows wait until newer ones (of any key, and of a kind that the operator takes) have moved
the watermark on. State lives in
Spark's state store: restarts go on from it, and each processor says when a key's state goes.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from ..functions.constants import IDLE_SECONDS, TEXT_WAIT_MS
from .sessions import ENDS, KEYS, SESSION
from .tracker import FINISHED, Tracker


class InOrder(StatefulProcessor):
    """Hands a key's rows to step() in order. fields names what is kept of a row; the first two are its time in microseconds and its place."""

    fields: str

    def init(self, handle) -> None:
        self.handle, self.names = handle, [f.split()[0] for f in self.fields.split(", ")]
        self.waiting = handle.getListState("waiting", self.fields)
        self.begin(handle)

    def begin(self, handle) -> None:
        """Declares more state."""

    def step(self, key: tuple, due: list[Row], watermark: int) -> Iterator[Row]:
        """Takes the rows that are due, in order; the watermark is in microseconds."""
        raise NotImplementedError

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        new = [tuple(r[c] for c in self.names) for r in rows]
        if new:
            self.waiting.appendList(new)
            self.wake(min(r[0] for r in new))
        return iter(())

    def wake(self, micros: int) -> None:
        """A timer for the first watermark that has passed a time."""
        self.handle.registerTimer(-(-micros // 1000))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        held = sorted((Row(*self.names)(*r) for r in self.waiting.get()), key=lambda r: (r[0], r[1]))
        due, rest = [r for r in held if r[0] <= now], [r for r in held if r[0] > now]
        if due:
            if rest:
                self.waiting.put([tuple(r) for r in rest])
                self.wake(rest[0][0])
            else:
                self.waiting.clear()
        yield from self.step(key, due, now)


def _run(rows: DataFrame, key: str | list[str], ts: str, delay: str, processor: InOrder, schema: str) -> DataFrame:
    keys = [key] if isinstance(key, str) else key
    timed = rows.dropna(subset=[*keys, ts]).withColumn("at", F.unix_micros(F.col(ts).cast("timestamp"))).withWatermark(ts, delay)
    return timed.groupBy(*keys).transformWithState(processor, schema, "Append", "EventTime")


class TrackWords(InOrder):
    """The word tracker with a privacy gate. The word being typed, the context before it and the gate are three variables of a key's state;
    after `forget` microseconds of event time without events all of it goes."""

    fields = "at long, seq long, kind string, ch string, quiet boolean"

    def __init__(self, forget: int | None):
        self.forget = forget

    def begin(self, handle) -> None:
        self.word = handle.getValueState("word", "current string, start_known boolean, version long, last_at long")
        self.context = handle.getValueState("context", "previous string, typed string, separator string, start_known boolean, before string")
        self.gate = handle.getValueState("gate", "quiet boolean")

    def _load(self) -> tuple[Tracker, bool, int]:
        word = self.word.get() if self.word.exists() else ("", False, 0, 0)
        context = self.context.get() if self.context.exists() else (None,) * 5
        last = None if context[1] is None else dict(zip(("typed", "separator", "start_known", "before"), context[1:], strict=True))
        return Tracker(word[0], context[0], last, word[1], word[2]), bool(self.gate.exists() and self.gate.get()[0]), word[3]

    def step(self, key, due, watermark) -> Iterator[Row]:
        tracker, quiet, last_at = self._load()
        if self.forget is not None and last_at and watermark >= last_at + self.forget and (not due or due[0].at >= last_at + self.forget):
            tracker, quiet, last_at = Tracker(), False, 0
            for state in (self.word, self.context, self.gate):
                state.clear()
        for r in due:
            if self.forget is not None and last_at and r.at >= last_at + self.forget:
                tracker, quiet = Tracker(), False
            last_at = r.at
            if r.quiet is not None and r.quiet != quiet:
                quiet = r.quiet
                tracker.reset()
                if quiet:
                    continue
            if not quiet and (out := tracker.event(r.kind, r.ch)):
                link = out[4] and Row(**{k: out[4][k] for k in ("typed", "separator", "start_known", "before")})
                yield Row(user_id=key[0], seq=r.seq, word=out[0], previous_word=out[1], separator=out[2], start_was_known=out[3], link=link)
        if due:
            last = tracker.last_finished or {}
            self.word.update((tracker.current, tracker.start_known, tracker.version, last_at))
            self.context.update((tracker.previous, *(last.get(k) for k in ("typed", "separator", "start_known", "before"))))
            self.gate.update((quiet,))
            if self.forget is not None:
                self.wake(last_at + self.forget)


def track_ordered(events: DataFrame, delay: str = "10 seconds", forget_after: float | None = None, key: str = "user_id", ts: str = "ts") -> DataFrame:
    """Finished words of a stream of EVENTS, in append mode, as track_batch gives them (after quiet_gate, if there is a column `quiet`), in
    whatever order the events come within the delay; a user's events go by time and seq. A user who has sent nothing for `forget_after`
    seconds of event time begins anew, and their state goes."""
    with_quiet = events if "quiet" in events.columns else events.withColumn("quiet", F.lit(None).cast("boolean"))
    rows = with_quiet.select(F.col(key).cast("long").alias("user_id"), ts, "seq", "kind", "ch", "quiet")
    return _run(rows, "user_id", ts, delay, TrackWords(None if forget_after is None else int(forget_after * 1_000_000)), FINISHED)


class Sessions(InOrder):
    """Sessions that end by an event, or by a timer once the gap has passed."""

    fields = "at long, seq long, ending string"

    def __init__(self, gap: int):
        self.gap = gap

    def begin(self, handle) -> None:
        self.live = handle.getValueState("live", "first long, last long, n long")

    def step(self, key, due, watermark) -> Iterator[Row]:
        from datetime import UTC, datetime, timedelta

        time = lambda micros: datetime(1970, 1, 1, tzinfo=UTC) + timedelta(microseconds=micros)
        row = lambda live, by, at: Row(user_id=key[0], first_ts=time(live[0]), last_ts=time(live[1]), n_events=live[2], ended_by=by, ended_at=time(at))
        live = tuple(self.live.get()) if self.live.exists() else None
        for r in due:
            if live and r.at - live[1] >= self.gap:
                yield row(live, "idle", live[1] + self.gap)
                live = None
            if r.ending is None:
                live = (live[0], r.at, live[2] + 1) if live else (r.at, r.at, 1)
            elif live:
                yield row(live, r.ending, r.at)
                live = None
        if live and watermark >= live[1] + self.gap:
            yield row(live, "idle", live[1] + self.gap)
            live = None
        if live:
            self.live.update(live)
            self.wake(live[1] + self.gap)
        elif self.live.exists():
            self.live.clear()


def session_stream(events: DataFrame, gap: float = IDLE_SECONDS, delay: str = "10 seconds", key: str = "user_id", ts: str = "ts", tie: str = "seq", keep: str = KEYS, kind: str = "kind", ends: tuple[str, ...] = ENDS) -> DataFrame:
    """The rows of event_sessions for a stream, in append mode: a session is given out when an event ends it or the gap has passed. Between
    sessions a user has no state."""
    ending = F.coalesce(F.col(kind).isin(*ends), F.lit(False))
    rows = events.filter(ending | F.coalesce(F.expr(keep), F.lit(False)))
    rows = rows.select(F.col(key).cast("long").alias("user_id"), ts, F.col(tie).cast("long").alias("seq"), F.when(ending, F.col(kind)).alias("ending"))
    return _run(rows, "user_id", ts, delay, Sessions(int(gap * 1_000_000)), SESSION)


class LastReading(InOrder):
    """An as-of join of two streams: each event gets the last reading up to its time. Of the readings passed, a key keeps one."""

    fields = "at long, place long, seq long, kind string, ch string, text string, caret int, took_ms int"

    def __init__(self, wait_ms: int):
        self.wait_ms = wait_ms

    def begin(self, handle) -> None:
        self.last = handle.getValueState("last", "text string, caret int, took_ms int")

    def step(self, key, due, watermark) -> Iterator[Row]:
        from datetime import UTC, datetime, timedelta

        last, changed = (tuple(self.last.get()) if self.last.exists() else (None, None, None)), False
        for r in due:
            if r.seq is None:
                last, changed = (r.text, r.caret, r.took_ms), True
                continue
            fine = last[0] is not None and last[1] is not None and (last[2] or 0) <= self.wait_ms
            before = last[0][: max(0, last[1])] if fine else None
            yield Row(user_id=key[0], seq=r.seq, ts=datetime(1970, 1, 1, tzinfo=UTC) + timedelta(microseconds=r.at), kind=r.kind, ch=r.ch, before=before)
        if changed:
            self.last.update(last)


def text_before_stream(events: DataFrame, carets: DataFrame, delay: str = "10 seconds", wait_ms: int = TEXT_WAIT_MS) -> DataFrame:
    """A stream of EVENTS with `before`, from a stream of readings (user_id, ts, text, caret, took_ms): the rows of with_text_before. A reading
    at an event's own time counts; one that comes later than the delay is dropped, and the event keeps the reading before it."""
    blank = lambda *names: [F.lit(None).cast(t).alias(n) for n, t in names]
    own = events.select("user_id", "ts", (F.col("seq") + 1).alias("place"), "seq", "kind", "ch", *blank(("text", "string"), ("caret", "int"), ("took_ms", "int")))
    readings = carets.select("user_id", "ts", F.lit(-1).cast("long").alias("place"), *blank(("seq", "long"), ("kind", "string"), ("ch", "string")), "text", F.col("caret").cast("int"), F.col("took_ms").cast("int"))
    return _run(own.union(readings), "user_id", "ts", delay, LastReading(wait_ms), "user_id long, seq long, ts timestamp, kind string, ch string, before string")


class NewerOnly(StatefulProcessor):
    """Passes on a key's rows whose version is above all before; the version goes when it has not changed for a time."""

    def __init__(self, key: str, version: str, names: list[str], ttl: int | None):
        self.key, self.version, self.names, self.ttl = key, version, names, ttl

    def init(self, handle) -> None:
        self.highest = handle.getValueState("highest", "version long", self.ttl)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        best, highest = None, self.highest.get()[0] if self.highest.exists() else None
        for r in rows:
            if r[self.version] is not None and (highest is None or r[self.version] > highest):
                best, highest = r, r[self.version]
        if best is not None:
            self.highest.update((highest,))
            yield Row(**{n: best[n] for n in self.names})


def latest_stream(rows: DataFrame, key: str, version: str = "version", forget_after: float | None = None) -> DataFrame:
    """The newest result of each key in each micro-batch, in append mode, if it is newer than all before: what is stale never appears.
    Versions are whole numbers; of equal ones the first stays; null ones take no part. A key's version goes after `forget_after`
    seconds (of processing time) without a newer one; then any version is new again."""
    ttl = None if forget_after is None else int(forget_after * 1000)
    processor = NewerOnly(key, version, rows.columns, ttl)
    return rows.groupBy(key).transformWithState(processor, rows.schema, "Append", "ProcessingTime")
