"""Real-word confusions, judged from both neighbours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions.text import norm
from .ngram import bigram_totals, ratio


def confusions(spark: SparkSession) -> DataFrame:
    rows = [p for a, b in C.CONFUSION_SETS for p in ((a, b), (b, a))]
    return spark.createDataFrame(rows, "word string, alternative string")


def _side_ratio(alt: Column, typed: Column) -> Column:
    free = F.when(alt <= 0, F.lit(1.0)).otherwise(F.lit(C.MAX_SIDE_RATIO))
    return F.when(typed <= 0, free).otherwise(F.greatest(F.lit(1 / C.MAX_SIDE_RATIO), F.least(F.lit(C.MAX_SIDE_RATIO), F.try_divide(alt, typed))))


def check_real_words(probes: DataFrame, words: DataFrame, bigrams: DataFrame, learned_pairs: DataFrame | None = None, enabled: bool = True) -> DataFrame:
    """For each distinct (before, word, after): changed, corrected, advantage and the reason.

    A chance is 0.9 times the pair's share among its first word's pairs, without what was learned, plus 0.1 times the second word's share of all words; totals
    keep what was learned. An alternative needs an unlearned pair on either side and an advantage of 8 or more.
    """
    spark = probes.sparkSession
    ask = probes.select("before", "word", "after").distinct().withColumns({"b": norm(F.col("before")), "a": norm(F.col("after")), "low": F.lower(F.coalesce("word", F.lit("")))})
    options = F.broadcast(confusions(spark).withColumnRenamed("word", "low"))  # a fixed table
    mixed = [w for pair in C.CONFUSION_SETS for w in pair]
    net = bigrams.filter(F.col("first").isin(mixed) | F.col("second").isin(mixed))  # no other pair is ever looked up
    if learned_pairs is not None:
        net = net.join(learned_pairs.select("first", "second", F.col("cnt").alias("l")), ["first", "second"], "left").withColumn("cnt", F.col("cnt") - F.coalesce("l", F.lit(0)))
    net = net.select("first", "second", F.greatest(F.lit(0), F.col("cnt")).alias("n"))
    plain = ask.join(options.select("low").distinct(), "low", "left_anti")  # what nobody mixes up needs no lookups
    rows = ask.join(options, "low").crossJoin(F.broadcast(words.agg(F.coalesce(F.sum("freq"), F.lit(0)).alias("all"))))

    def pair(df: DataFrame, first: str, second: str, name: str) -> DataFrame:
        return df.join(net.select(F.col("first").alias(first), F.col("second").alias(second), F.col("n").alias(name)), [first, second], "left").fillna(0, [name])

    def value(df: DataFrame, source: DataFrame, key: str, what: str, column: str, name: str) -> DataFrame:
        return df.join(source.select(F.col(key).alias(column), F.col(what).alias(name)), column, "left").fillna(0, [name])

    totals = bigram_totals(bigrams)
    for first, second, name in (("b", "low", "n_bt"), ("b", "alternative", "n_ba"), ("low", "a", "n_ta"), ("alternative", "a", "n_aa")):
        rows = pair(rows, first, second, name)
    for column, name in (("b", "t_b"), ("low", "t_low"), ("alternative", "t_alt")):
        rows = value(rows, totals, "first", "total", column, name)
    for column, name in (("low", "f_low"), ("alternative", "f_alt"), ("a", "f_a")):
        rows = value(rows, words, "word", "freq", column, name)
    c = F.col
    share = lambda f: ratio(c(f), c("all"))

    def chance(n: str, total: str, f: str) -> Column:
        return F.when(c(total) > 0, C.PAIR_WEIGHT * ratio(c(n), c(total)) + (1 - C.PAIR_WEIGHT) * share(f)).otherwise(share(f))

    left = _side_ratio(chance("n_ba", "t_b", "f_alt"), chance("n_bt", "t_b", "f_low"))
    right = _side_ratio(chance("n_aa", "t_alt", "f_a"), chance("n_ta", "t_low", "f_a"))
    rows = rows.withColumns({"evidence": (c("n_ba") > 0) | (c("n_aa") > 0), "advantage": left * F.when(c("a") != "", right).otherwise(F.lit(1.0))})
    order = Window.partitionBy("before", "word", "after").orderBy(F.desc("evidence"), F.desc("advantage"), "alternative")
    best = rows.withColumn("r", F.row_number().over(order)).filter("r = 1")
    off = F.lit("real word fixing is off")
    reason = off if not enabled else (
        F.when((c("b") == "") & (c("a") == ""), "nothing around it to go on")
        .when(~c("evidence"), "no alternative fits better")
        .when(c("advantage") < C.REQUIRED_RATIO, "what was typed fits well enough")
        .otherwise("corrected")
    )
    changed = c("reason") == "corrected"
    judged = best.withColumn("reason", reason).select("before", "word", "after", changed.alias("changed"), F.when(changed, c("alternative")).otherwise(c("word")).alias("corrected"), F.when(c("evidence"), c("advantage")).alias("advantage"), "reason")
    kept = plain.select("before", "word", "after", F.lit(False).alias("changed"), F.col("word").alias("corrected"), F.lit(None).cast("double").alias("advantage"), (off if not enabled else F.lit("not a word people mix up")).alias("reason"))
    return judged.unionByName(kept)
