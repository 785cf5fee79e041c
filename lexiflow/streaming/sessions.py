"""Typing sessions that end by an event or by silence, of a bounded set of events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.constants import IDLE_SECONDS

#: Kinds of events that end a session at once, and of those that keep it going.
ENDS = ("dismiss", "caret_moved", "click", "window")
KEYS = "kind = 'key'"
SESSION = "user_id long, first_ts timestamp, last_ts timestamp, n_events long, ended_by string, ended_at timestamp"
#: Seconds of a run, in which the events of a user are ordered together.
RUN_SECONDS = 3600


def _upto(w, last: int):
    return w.rowsBetween(Window.unboundedPreceding, last)


def previous_row(rows: DataFrame, key: str, run: Column, order: list[str], what: Column, name: str) -> DataFrame:
    """rows with `name`: what the row before has, by the order within the key. A key's rows are ordered in two levels, over runs (which follow
    the order) and within them, so that a key with most rows is not gathered in one task."""
    rows = rows.withColumn("__run", run).withColumn("__what", what)
    place = F.struct(*order)
    runs = rows.groupBy(key, "__run").agg(F.max_by("__what", place).alias("__what"))
    runs = runs.select(key, "__run", F.lag("__what").over(Window.partitionBy(key).orderBy("__run")).alias("__before"))
    inner = F.lag("__what").over(Window.partitionBy(key, "__run").orderBy(*order))
    return rows.withColumn("__inner", inner).join(runs, [key, "__run"]).withColumn(name, F.coalesce("__inner", "__before")).drop("__what", "__inner", "__before")


def running_count(rows: DataFrame, key: str, order: list[str], flag: Column, name: str) -> DataFrame:
    """rows (of previous_row) with `name`: how many rows up to this one, within the key, have the flag; in the same two levels."""
    rows = rows.withColumn("__flag", flag.cast("long"))
    runs = rows.groupBy(key, "__run").agg(F.sum("__flag").alias("__n"))
    runs = runs.select(key, "__run", F.coalesce(F.sum("__n").over(_upto(Window.partitionBy(key).orderBy("__run"), -1)), F.lit(0)).alias("__before"))
    inner = F.sum("__flag").over(_upto(Window.partitionBy(key, "__run").orderBy(*order), 0))
    return rows.withColumn("__inner", inner).join(runs, [key, "__run"]).withColumn(name, F.col("__inner") + F.col("__before")).drop("__flag", "__inner", "__before")


def event_sessions(events: DataFrame, gap: float = IDLE_SECONDS, key: str = "user_id", ts: str = "ts", tie: str = "seq", keep: str = KEYS, kind: str = "kind", ends: tuple[str, ...] = ENDS, run_seconds: float = RUN_SECONDS) -> DataFrame:
    """(key, first_ts, last_ts, n_events, ended_by, ended_at): a session begins with an event that `keep` (SQL) holds of and goes on while the
    next such event follows in less than the gap. An event whose kind is one of `ends` ends it at once; ended_by is its kind, or
    `idle`, a gap after the last event. Ends without a live session do nothing; other events neither. Equal times go by `tie`. An event that
    would both keep and end ends. Null keys, times or kinds take no part."""
    ending = F.col(kind).isin(*ends)
    micros = int(gap * 1_000_000)
    rows = events.filter(F.col(key).isNotNull() & F.col(ts).isNotNull()).withColumn("__end", F.coalesce(ending, F.lit(False)))
    rows = rows.filter(F.col("__end") | F.coalesce(F.expr(keep), F.lit(False))).select(key, F.col(ts).alias("__ts"), F.unix_micros(F.col(ts).cast("timestamp")).alias("__at"), F.col(tie).alias("__tie"), F.when(F.col("__end"), F.col(kind)).alias("__kind"))
    order = ["__at", "__tie"]
    rows = previous_row(rows, key, F.floor(F.col("__at") / F.lit(int(run_seconds * 1_000_000))), order, F.struct("__at", "__kind"), "__last")
    live = F.col("__last").isNotNull() & F.col("__last.__kind").isNull() & (F.col("__at") - F.col("__last.__at") < micros)
    rows = rows.withColumn("__live", F.coalesce(live, F.lit(False)))
    rows = running_count(rows, key, order, F.col("__kind").isNull() & ~F.col("__live"), "__n").filter("__kind is null or __live")
    typed = F.when(F.col("__kind").isNull(), F.col("__ts"))
    made = rows.groupBy(key, "__n").agg(F.min(typed).alias("first_ts"), F.max(typed).alias("last_ts"), F.count(typed).alias("n_events"), F.max("__kind").alias("by"), F.max(F.when(F.col("__kind").isNotNull(), F.col("__ts"))).alias("at"))
    idle = F.timestamp_micros(F.unix_micros(F.col("last_ts").cast("timestamp")) + micros)
    at = F.when(F.col("by").isNotNull(), F.col("at").cast("timestamp")).otherwise(idle).cast(events.schema[ts].dataType)
    return made.select(key, "first_ts", "last_ts", "n_events", F.coalesce("by", F.lit("idle")).alias("ended_by"), at.alias("ended_at"))


def quiet_gate(events: DataFrame, key: str = "user_id", order: str = "seq", run: int = 4096) -> DataFrame:
    """The events outside quiet mode, as they go to a tracker. `quiet` is true, false or null (unknown: the last known state goes on, first not
    quiet). The event that turns quiet mode on is not passed on but becomes a change of window, which resets the tracker; as nothing
    passes until the mode goes off, that is all a tracker needs to know. Runs are of `run` places of the order."""
    rows = events.filter(F.col(key).isNotNull()).withColumn("__run", F.floor(F.col(order) / run))
    last = lambda c, w: F.last(c, ignorenulls=True).over(w)
    runs = rows.groupBy(key, "__run").agg(F.max_by("quiet", F.when(F.col("quiet").isNotNull(), F.col(order))).alias("__known"))
    runs = runs.select(key, "__run", last("__known", _upto(Window.partitionBy(key).orderBy("__run"), -1)).alias("__before"))
    own = Window.partitionBy(key, "__run").orderBy(order)
    carried = lambda c: F.coalesce(c, F.col("__before"), F.lit(False))
    rows = rows.withColumn("__now", last("quiet", _upto(own, 0))).withColumn("__then", last("quiet", _upto(own, -1))).join(runs, [key, "__run"])
    rows = rows.withColumn("__now", carried(F.col("__now"))).withColumn("__then", carried(F.col("__then"))).filter("not __now or not __then")
    on = F.col("__now") & ~F.col("__then")
    return rows.select(*(F.when(on, F.lit("window") if c == "kind" else F.lit(None)).otherwise(F.col(c)).alias(c) if c in ("kind", "ch") else c for c in events.columns if c != "quiet"))
