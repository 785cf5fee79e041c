"""The live dictionary over time: each word is judged by what the user's dictionary held when it was typed."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F

from ..functions.text import norm
from ..streaming.ordered import InOrder, _run

#: Places of the order in which a user's edits and uses of a word are ordered together.
RUN = 1 << 20


def validity(edits: DataFrame) -> DataFrame:
    """(user_id, word, held, valid_from, valid_to) of edits (user_id, word, op, at): `add` and `remove` hold until the word's next edit by the
    same user, the last one for ever (a null valid_to). Of edits at one time removing wins. Other operations and null words are left out."""
    own = edits.filter("op in ('add', 'remove')").select("user_id", norm(F.col("word")).alias("word"), "at", (F.col("op") == "add").alias("held"))
    own = own.filter("word != '' and at is not null").groupBy("user_id", "word", "at").agg(F.bool_and("held").alias("held"))
    until = F.lead("at").over(Window.partitionBy("user_id", "word").orderBy("at"))
    return own.select("user_id", "word", "held", F.col("at").alias("valid_from"), until.alias("valid_to"))


def known_as_of(uses: DataFrame, words: DataFrame, edits: DataFrame, run: int = RUN) -> DataFrame:
    """uses (user_id, word, at and others) with known: what the last of the user's edits of the word before or at its time says, or without
    one whether the vocabulary has it. `at` is a whole number, such as microseconds. A use without a user knows the vocabulary
    only; a null or blank word is not known. Edits and uses of a word meet in two levels, over runs of `run` places and within them."""
    base = words.select(norm(F.col("word")).alias("__word"), F.lit(True).alias("__base")).distinct()
    rows = uses.withColumn("__word", norm(F.col("word"))).join(base, "__word", "left").withColumn("__own", F.struct(*uses.columns))
    asked = rows.select(F.struct("user_id", "__word").alias("__key"), "at", F.lit(None).cast("boolean").alias("__held"), "__own", F.coalesce("__base", F.lit(False)).alias("__base"))
    marks = validity(edits).select(F.struct("user_id", F.col("word").alias("__word")).alias("__key"), F.col("valid_from").alias("at"), F.col("held").alias("__held"), F.lit(None).cast(asked.schema["__own"].dataType).alias("__own"), F.lit(False).alias("__base"))
    both = asked.union(marks).withColumn("__run", F.coalesce(F.floor(F.col("at") / run), F.lit(0)))
    last = lambda c, w, to: F.last(c, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, to))
    runs = both.filter("__held is not null").groupBy("__key", "__run").agg(F.max_by("__held", "at").alias("__held"))
    every = both.select("__key", "__run").distinct().join(runs, ["__key", "__run"], "left")
    every = every.select("__key", "__run", last("__held", Window.partitionBy("__key").orderBy("__run"), -1).alias("__before"))
    inner = last("__held", Window.partitionBy("__key", "__run").orderBy("at", F.col("__held").isNull()), 0)
    judged = both.withColumn("__inner", inner).filter("__own is not null").join(every, ["__key", "__run"], "left")
    known = F.coalesce("__inner", "__before", "__base") & (F.coalesce(F.col("__key.__word"), F.lit("")) != "")
    return judged.select("__own.*", known.alias("known"))


class LastEdit(InOrder):
    """The last edit of a user's word; uses take it as it is at their time."""

    fields = "at long, place long, seq long, base boolean, held boolean"

    def begin(self, handle) -> None:
        self.last = handle.getValueState("last", "held boolean, at long")

    def step(self, key, due, watermark) -> Iterator[Row]:
        held, when = tuple(self.last.get()) if self.last.exists() else (None, None)
        changed = False
        for r in due:
            if r.held is None:
                yield Row(user_id=key[0], word=key[1], seq=r.seq, known=bool(r.base if held is None else held))
            else:
                held, when, changed = r.held and (held is not False or when != r.at), r.at, True
        if changed:
            self.last.update((held, when))


def known_stream(uses: DataFrame, words: DataFrame, edits: DataFrame, delay: str = "10 seconds") -> DataFrame:
    """(user_id, word, seq, known) for a stream of uses (user_id, word, seq, ts) and a stream of edits (user_id, word, op, ts), in any order
    within the delay, as known_as_of gives them. The vocabulary is a table, joined as each batch comes. State is one edit for each word
    that a user has edited."""
    base = words.select(norm(F.col("word")).alias("word"), F.lit(True).alias("base")).distinct()
    asked = uses.select("user_id", norm(F.col("word")).alias("word"), "ts", "seq").filter("word != ''").join(base, "word", "left")
    asked = asked.select("user_id", "word", "ts", (F.col("seq") + 1).alias("place"), "seq", F.coalesce("base", F.lit(False)).alias("base"), F.lit(None).cast("boolean").alias("held"))
    marks = edits.filter("op in ('add', 'remove')").select("user_id", norm(F.col("word")).alias("word"), "ts", F.lit(-1).cast("long").alias("place"), F.lit(None).cast("long").alias("seq"), F.lit(False).alias("base"), (F.col("op") == "add").alias("held"))
    rows = asked.union(marks.filter("word != ''"))
    return _run(rows, ["user_id", "word"], "ts", delay, LastEdit(), "user_id long, word string, seq long, known boolean")
