"""Next-word prediction: followers by count, else the most frequent words."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.constants import TOP_K
from ..functions.text import norm
from .ngram import bigram_probabilities, most_frequent


def top_followers(bigrams: DataFrame, k: int = TOP_K) -> DataFrame:
    """(first, second, cnt, rank) of the k most frequent followers with a positive count; ties by word."""
    order = Window.partitionBy("first").orderBy(F.desc("cnt"), "second")
    return bigrams.filter("cnt > 0").withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= k)


def predict_next(probes: DataFrame, words: DataFrame, bigrams: DataFrame, k: int = TOP_K, column: str = "previous") -> DataFrame:
    """(previous, word, cnt, rank, is_fallback) for each distinct previous word. The fallback has k rows, so it is broadcast."""
    asked = probes.select(norm(F.col(column)).alias("previous")).distinct()
    known = asked.join(top_followers(bigrams, k), asked["previous"] == F.col("first")).select("previous", F.col("second").alias("word"), "cnt", "rank", F.lit(False).alias("is_fallback"))
    without = asked.join(bigrams.filter("cnt > 0").select(F.col("first").alias("previous")).distinct(), "previous", "left_anti")
    common = most_frequent(words, k).select("word", F.col("freq").alias("cnt"))
    common = common.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("cnt"), "word")).cast("long"))
    return known.unionByName(without.crossJoin(F.broadcast(common)).withColumn("is_fallback", F.lit(True)))


def predict_next_words(probes: DataFrame, words: DataFrame, bigrams: DataFrame, k: int = TOP_K, column: str = "previous") -> DataFrame:
    """(previous, words): only the predicted words, best first."""
    found = predict_next(probes, words, bigrams, k, column)
    ranked = F.array_sort(F.collect_list(F.struct("rank", "word")))  # k rows a probe
    return found.groupBy("previous").agg(F.transform(ranked, lambda r: r["word"]).alias("words"))


def has_context(probes: DataFrame, bigrams: DataFrame, column: str = "previous") -> DataFrame:
    """The probes with has_context: whether a word has ever followed."""
    after = bigrams.filter("cnt > 0").select(F.col("first").alias("__first")).distinct()
    return probes.join(after, norm(F.col(column)) == F.col("__first"), "left").withColumn("has_context", F.col("__first").isNotNull()).drop("__first")


def next_probability(pairs: DataFrame, bigrams: DataFrame) -> DataFrame:
    """(previous, next) pairs with the probability that the one follows the other; 0 for what has not been seen."""
    shares = bigram_probabilities(bigrams).select(F.col("first").alias("__first"), F.col("second").alias("__second"), "probability")
    joined = pairs.join(shares, (norm(F.col("previous")) == F.col("__first")) & (norm(F.col("next")) == F.col("__second")), "left")
    return joined.withColumn("probability", F.coalesce("probability", F.lit(0.0))).drop("__first", "__second")
