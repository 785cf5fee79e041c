"""Prefix completion: contractions first, then prefix matches above a floor, ranked by a pluggable score."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.constants import COMPLETION_RATIO, CONTEXT_WEIGHT, POPULARITY_WEIGHT, TOP_K
from ..functions.text import norm, numbers
from .ngram import bigram_totals, ratio


def frequency_score(freq: Column, cnt: Column, total_after: Column, total: Column) -> Column:
    return freq.cast("double")


def context_score(freq: Column, cnt: Column, total_after: Column, total: Column) -> Column:
    popularity = ratio(freq, total)
    return F.when(total_after > 0, CONTEXT_WEIGHT * ratio(cnt, total_after) + POPULARITY_WEIGHT * popularity).otherwise(popularity)


def with_context(rows: DataFrame, words: DataFrame, bigrams: DataFrame | None, previous: str = "previous", word: str = "word") -> DataFrame:
    """Adds cnt (of the pair), total_after (of the previous word) and total (of all words); 0 where unknown."""
    if bigrams is None:
        rows = rows.withColumns({"cnt": F.lit(0).cast("long"), "total_after": F.lit(0).cast("long")})
    else:
        pairs = bigrams.select(F.col("first").alias(previous), F.col("second").alias(word), "cnt")
        after = bigram_totals(bigrams).select(F.col("first").alias(previous), F.col("total").alias("total_after"))
        rows = rows.join(pairs, [previous, word], "left").join(after, previous, "left").fillna(0, ["cnt", "total_after"])
    return rows.crossJoin(F.broadcast(words.agg(F.coalesce(F.sum("freq"), F.lit(0)).alias("total"))))  # one row


def _matches(prefixes: DataFrame, words: DataFrame) -> DataFrame:
    """Words that begin with each prefix: every word gives its own prefixes of the lengths asked for, and an equi-join follows."""
    lengths = prefixes.agg(F.max(F.length("prefix")).alias("n"))
    own = words.crossJoin(F.broadcast(lengths)).select("word", "freq", F.explode(numbers(1, F.least(F.length("word"), F.col("n")))).alias("i"))
    return prefixes.join(own.select("word", "freq", F.left("word", F.col("i")).alias("prefix")), "prefix")


def prefix_matches(prefixes: DataFrame, words: DataFrame) -> DataFrame:
    """(prefix, word, freq) of all words that begin with each distinct prefix, itself included; an empty prefix matches every word."""
    asked = prefixes.select(norm(F.col("prefix")).alias("prefix")).distinct()
    found = _matches(asked.filter("prefix != ''"), words.select("word", "freq")).select("prefix", "word", "freq")
    every = words.select("word", "freq").crossJoin(F.broadcast(asked.filter("prefix = ''")))  # one row at most
    return found.unionByName(every.select("prefix", "word", "freq"))


def has_prefix(prefixes: DataFrame, words: DataFrame) -> DataFrame:
    """(prefix, found) for each distinct prefix: whether some word begins with it. Always so for the empty one."""
    asked = prefixes.select(norm(F.col("prefix")).alias("prefix")).distinct()
    some = _matches(asked.filter("prefix != ''"), words.select("word", "freq")).select("prefix").distinct().withColumn("found", F.lit(True))
    return asked.join(some, "prefix", "left").select("prefix", ((F.col("prefix") == "") | F.col("found").isNotNull()).alias("found"))


def contractions(prefixes: DataFrame, words: DataFrame) -> DataFrame:
    """Words that begin with the prefix once an apostrophe is put inside it (from two letters, none typed)."""
    bare = prefixes.filter((F.length("prefix") >= 2) & (F.instr("prefix", "'") == 0))
    at = bare.select("prefix", F.explode(numbers(1, F.length("prefix") - 1)).alias("i"))
    typed = at.select(F.col("prefix").alias("asked"), F.concat(F.left("prefix", F.col("i")), F.lit("'"), F.col("prefix").substr(F.col("i") + 1, F.length("prefix"))).alias("prefix"))
    return _matches(typed.select("prefix").distinct(), words).join(typed, "prefix").select(F.col("asked").alias("prefix"), "word", "freq").distinct()


def completion_floor(words: DataFrame) -> DataFrame:
    return words.select("word", F.expr(f"freq div {COMPLETION_RATIO}").alias("floor"))


def _contenders(asked: DataFrame, both: DataFrame, words: DataFrame, bigrams: DataFrame, k: int) -> DataFrame:
    """What can be among the k best of each (prefix, previous) by context_score, with cnt, total_after and total: the words that follow `previous`,
    and of the others, which stand in the order of their frequency whatever comes before, the first k of the prefix. A pair with a negative
    count puts a word behind the others, so as many more are kept as a word has of those."""
    total = words.agg(F.coalesce(F.sum("freq"), F.lit(0)).alias("total"))
    behind = bigrams.filter("cnt < 0").groupBy("first").agg(F.count("*").alias("n")).agg(F.coalesce(F.max("n"), F.lit(0)).alias("behind"))
    both = both.crossJoin(F.broadcast(total))  # one row
    order = Window.partitionBy("prefix", "src").orderBy(ratio(F.col("freq"), F.col("total")).desc(), "word")
    common = both.withColumn("r", F.row_number().over(order)).crossJoin(F.broadcast(behind)).filter(F.col("r") <= k + F.col("behind"))
    lengths = asked.agg(F.collect_set(F.length("prefix")).alias("lengths"))  # as many as a prefix may have
    pairs = bigrams.crossJoin(F.broadcast(lengths)).select(F.col("first").alias("previous"), F.col("second").alias("word"), "cnt", F.explode(F.filter("lengths", lambda n: n <= F.length("second"))).alias("n"))
    pairs = pairs.select("previous", F.expr("left(word, n)").alias("prefix"), "word", "cnt")
    after = asked.join(pairs, ["previous", "prefix"]).join(both.filter("src = 1"), ["prefix", "word"])
    forms = asked.join(both.filter("src = 0"), "prefix").join(bigrams.select(F.col("first").alias("previous"), F.col("second").alias("word"), "cnt"), ["previous", "word"])
    names = ["prefix", "previous", "word", "freq", "src", "total"]
    rows = asked.join(common, "prefix").select(*names, F.lit(0).cast("long").alias("cnt")).union(after.select(*names, "cnt")).union(forms.select(*names, "cnt")).groupBy(*names).agg(F.sum("cnt").alias("cnt"))
    totals = bigram_totals(bigrams).select(F.col("first").alias("previous"), F.col("total").alias("total_after"))
    return rows.join(totals, "previous", "left").fillna(0, ["total_after"])


def complete(probes: DataFrame, words: DataFrame, bigrams: DataFrame | None = None, k: int = TOP_K, score: Callable[..., Column] | None = None) -> DataFrame:
    """(prefix, previous, word, freq, is_contraction, score, rank) for each distinct (prefix, previous); a blank prefix has none."""
    score = score or (frequency_score if bigrams is None else context_score)
    previous = norm(F.col("previous")) if "previous" in probes.columns else F.lit("")
    asked = probes.select(norm(F.col("prefix")).alias("prefix"), previous.alias("previous")).filter("prefix != ''").distinct()
    prefixes = asked.select("prefix").distinct()
    floor = completion_floor(words).withColumnRenamed("word", "prefix")
    plain = _matches(prefixes, words).join(floor, "prefix", "left").filter(F.col("freq") >= F.coalesce("floor", F.lit(0)))
    short = Window.partitionBy("prefix").orderBy(F.desc("freq"), "word")
    short_forms = contractions(prefixes, words).withColumn("r", F.row_number().over(short)).filter(F.col("r") <= k).drop("r")
    both = plain.select("prefix", "word", "freq", F.lit(1).alias("src")).unionByName(short_forms.withColumn("src", F.lit(0)))
    if bigrams is not None and score is context_score:
        rows = _contenders(asked, both, words, bigrams, k)
    else:
        rows = with_context(asked.join(both, "prefix"), words, bigrams)
    rows = rows.withColumn("score", score(F.col("freq"), F.col("cnt"), F.col("total_after"), F.col("total")))
    order = Window.partitionBy("prefix", "previous").orderBy("src", F.when(F.col("src") == 0, F.col("freq").cast("double")).otherwise(F.col("score")).desc(), "word")
    ranked = rows.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= k)
    return ranked.select("prefix", "previous", "word", "freq", (F.col("src") == 0).alias("is_contraction"), "score", "rank")
