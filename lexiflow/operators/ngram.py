"""Vocabulary and bigram statistics. Words are (word, freq), bigrams (first, second, cnt)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import norm, sentence_words

#: The bitmap of chosen pairs has 16 bits for each, but no more than 2^FILTER_BITS (16 MB).
FILTER_BITS = 27


def count_words(docs: DataFrame, text_col: str = "text") -> DataFrame:
    per = docs.select(F.explode(F.flatten(sentence_words(F.col(text_col)))).alias("word"))
    return per.groupBy("word").agg(F.count("*").alias("freq"))


def neighbours(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(first, second, cnt = 1) for each place of two neighbours within a sentence; pairs are made inside each row."""
    per = docs.select(F.explode(sentence_words(F.col(text_col))).alias("w")).filter(F.size("w") > 1)
    pairs = per.select(F.explode(F.arrays_zip(F.slice("w", F.lit(1), F.size("w") - 1).alias("first"), F.slice("w", F.lit(2), F.size("w") - 1).alias("second"))).alias("p"))
    return pairs.select("p.first", "p.second", F.lit(1).cast("long").alias("cnt"))


def count_bigrams(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Pairs of neighbours with their counts; only partial counts are shuffled."""
    return neighbours(docs, text_col).groupBy("first", "second").agg(F.count("*").alias("cnt"))


def _bitmap(hashes: DataFrame, bits: int) -> DataFrame:
    """One row (bits): slices of 1,024 longs, in which each hash's upper `bits` bits are a place that is set."""
    at = F.shiftrightunsigned("hash", 64 - bits)
    held = hashes.select(F.shiftright(at, 6).alias("place"), F.expr(f"shiftleft(1L, cast(shiftrightunsigned(hash, {64 - bits}) & 63 as int))").alias("held"))
    every = hashes.sparkSession.range(1 << bits - 6).select(F.col("id").alias("place"), F.lit(0).cast("long").alias("held"))
    longs = held.unionByName(every).groupBy("place").agg(F.bit_or("held").alias("held"))
    in_order = lambda column: F.transform(F.array_sort(F.collect_list(F.struct("place", column))), lambda x: x[column])
    slices = longs.groupBy(F.shiftright("place", 10).alias("slice")).agg(in_order("held").alias("slice_bits"))
    return slices.select(F.col("slice").alias("place"), "slice_bits").agg(in_order("slice_bits").alias("bits"))


def count_chosen(bigrams: DataFrame, chosen: DataFrame) -> DataFrame:
    """(first, second, cnt) of the pairs that `chosen` (first, second) has; all others of a first word are one row without a second, so totals stay
    right. Rows of a pair add up, so bigrams need not be counted before.

    What is not chosen is found by a bitmap of the chosen pairs' hashes, broadcast as one row (16 MB at most), so only few pairs are shuffled;
    pairs that share a place with a chosen one keep their row."""
    hashed = F.xxhash64("first", "second").alias("hash")
    hashes = chosen.select(hashed)
    bits = min(FILTER_BITS, max(16, (16 * hashes.count()).bit_length()))
    rows = bigrams.select("first", "second", "cnt", F.shiftrightunsigned(hashed, 64 - bits).alias("at")).crossJoin(F.broadcast(_bitmap(hashes, bits)))
    held = F.expr("shiftrightunsigned(get(get(bits, cast(shiftright(at, 16) as int)), cast(shiftright(at, 6) & 1023 as int)), cast(at & 63 as int)) & 1")
    return rows.select("first", F.when(held == 1, F.col("second")).alias("second"), "cnt").groupBy("first", "second").agg(F.sum("cnt").alias("cnt"))


def insert_words(words: DataFrame, more: DataFrame) -> DataFrame:
    """Adds counts per normalised word; empty keys are dropped."""
    both = words.select("word", "freq").unionByName(more.select(norm(F.col("word")).alias("word"), F.col("freq").cast("long").alias("freq")))
    return both.filter("word != ''").groupBy("word").agg(F.sum("freq").alias("freq"))


def set_frequencies(words: DataFrame, exact: DataFrame) -> DataFrame:
    """Exact values replace or create words."""
    new = exact.select(norm(F.col("word")).alias("word"), F.col("freq").cast("long").alias("freq")).filter("word != ''").dropDuplicates(["word"])
    return words.select("word", "freq").join(new, "word", "left_anti").unionByName(new)


def remove_words(words: DataFrame, gone: DataFrame) -> DataFrame:
    return words.join(gone.select(norm(F.col("word")).alias("word")), "word", "left_anti")


def vocab_stats(words: DataFrame) -> DataFrame:
    total = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return words.agg(F.count("*").alias("word_count"), total(F.sum("freq")).alias("total_freq"), total(F.max("freq")).alias("max_freq"))


def bigram_totals(bigrams: DataFrame) -> DataFrame:
    return bigrams.groupBy("first").agg(F.sum("cnt").alias("total"))


def ratio(part: Column, whole: Column) -> Column:
    """part / whole, 0 where the whole is not positive."""
    return F.when(whole > 0, part.cast("double") / whole).otherwise(F.lit(0.0))


def bigram_probabilities(bigrams: DataFrame) -> DataFrame:
    return bigrams.join(bigram_totals(bigrams), "first").select("first", "second", "cnt", "total", ratio(F.col("cnt"), F.col("total")).alias("probability"))


def lookup(probes: DataFrame, words: DataFrame, column: str = "word") -> DataFrame:
    """The probes with freq (0 if unknown) and known."""
    keys = words.select(F.col("word").alias("__key"), F.col("freq"))
    return probes.join(keys, norm(F.col(column)) == F.col("__key"), "left").withColumns({"known": F.col("__key").isNotNull(), "freq": F.coalesce("freq", F.lit(0))}).drop("__key")


def most_frequent(words: DataFrame, k: int) -> DataFrame:
    return words.orderBy(F.desc("freq"), "word").limit(max(0, k))
