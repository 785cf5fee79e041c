"""Building a cleaned vocabulary and its pairs from raw counts: one DAG of filters, anti-joins and a trim."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions.text import clean, deletions, is_one_edit_away, strip_wrapper
from ..sources.tables import once

WORD = r"[a-z]+(?:'[a-z]+)*"


def keep_word(word: Column, count: Column) -> Column:
    """Whether a word may enter; a null count skips the rule for three letters."""
    fine = ~word.isin(C.BROKEN_CONTRACTIONS + C.DIALECT) & ~word.rlike(r"^[ivx]{2,}\z")
    three = (F.length(word) != 3) | count.isNull() | (count >= C.MIN_COUNT_THREE_LETTERS) | word.isin(C.MODERN + list(C.INFORMAL) + C.EVERYDAY_SHORT)
    by_length = F.when(F.length(word) == 1, word.isin(C.ONE_LETTER)).when(F.length(word) == 2, word.isin(C.TWO_LETTER)).otherwise(fine & three)
    return (F.length(word) <= C.MAX_WORD_LENGTH) & word.rlike(rf"^{WORD}\z") & by_length


def scaled(raw: Column, biggest: Column) -> Column:
    """max(1, raw scaled so that the biggest gets TOP_COUNT), halves to even."""
    return F.greatest(F.lit(1), F.bround(raw * (C.TOP_COUNT / biggest)).cast("long"))


def filter_vocabulary(web: DataFrame, valid: DataFrame, expanded: DataFrame | None = None, blocked: Iterable[str] = ()) -> DataFrame:
    """(word, freq) of web counts (word, raw) that a source knows, scaled; blocked adds to the unwanted words."""
    known = valid.select("word")
    if expanded is not None:
        known = known.union(expanded.select("word"))
    known = known.union(web.sparkSession.createDataFrame([(w,) for w in C.MODERN + list(C.INFORMAL)], "word string")).distinct()
    top = F.broadcast(web.agg(F.max("raw").alias("biggest")))  # one row
    rows = web.join(known, "word", "left_semi").filter(~F.col("word").isin(C.UNWANTED + list(blocked))).crossJoin(top)
    return rows.select("word", scaled(F.col("raw"), F.col("biggest")).alias("freq")).filter(keep_word(F.col("word"), F.col("freq")))


def drop_misspellings(words: DataFrame, exempt: DataFrame | None = None) -> DataFrame:
    """Rare words of five letters or more go if one edit away from a word at least 50 times as frequent; exempt ones stay.

    Words that are one edit apart share one of the words that a deletion leaves of them, so they meet there, n + 1 strings a word.
    """
    rare = words.filter((F.col("freq") <= C.MISSPELLING_MAX_COUNT) & (F.length("word") >= C.MISSPELLING_MIN_LENGTH))
    if exempt is not None:
        rare = rare.join(exempt.select("word"), "word", "left_anti")
    bad = rare.select(F.col("word").alias("bad"), F.col("freq").alias("n"), F.explode(deletions(F.col("word"), 1)).alias("rest"))
    often = words.filter(F.col("freq") >= C.MISSPELLING_RATIO)
    good = often.select("word", "freq", F.explode(deletions(F.col("word"), 1)).alias("rest"))
    met = bad.join(good, "rest").filter(F.col("freq") >= C.MISSPELLING_RATIO * F.col("n"))
    gone = met.filter(is_one_edit_away(F.col("bad"), F.col("word"))).select(F.col("bad").alias("word")).distinct()
    return words.join(gone, "word", "left_anti")


def drop_known_misspellings(words: DataFrame, misspellings: DataFrame) -> DataFrame:
    """Rare words of the list (bad, good) go if their correction is at least 50 times as frequent."""
    good = words.select(F.col("word").alias("good"), F.col("freq").alias("good_freq"))
    listed = misspellings.join(words.select(F.col("word").alias("bad"), "freq"), "bad").join(good, "good")
    gone = listed.filter((F.col("freq") <= C.MISSPELLING_MAX_COUNT) & (F.col("good_freq") >= C.MISSPELLING_RATIO * F.col("freq"))).select(F.col("bad").alias("word")).distinct()
    return words.join(gone, "word", "left_anti")


def raise_to(words: DataFrame, listed: DataFrame) -> DataFrame:
    """Upserts listed words (word, freq) at the greater of both counts."""
    return words.select("word", "freq").union(listed.select("word", F.col("freq").cast("long"))).groupBy("word").agg(F.max("freq").alias("freq"))


def insert_new(words: DataFrame, more: DataFrame) -> DataFrame:
    return words.select("word", "freq").union(more.select("word", F.col("freq").cast("long")).join(words, "word", "left_anti"))


def contractions_of(books: DataFrame, text_col: str = "text") -> DataFrame:
    """(word, freq) of words with an apostrophe, of at most 20 letters, that the books hold three times or more."""
    parts = books.select(F.explode(F.split(clean(strip_wrapper(F.col(text_col))), r"[.!?;:\n]")).alias("s"))
    words = parts.select(F.explode(F.regexp_extract_all("s", F.lit(f"({WORD})"), 1)).alias("word")).filter(F.length("word") <= C.MAX_WORD_LENGTH)
    return words.filter(F.contains("word", F.lit("'"))).groupBy("word").agg(F.count("*").alias("freq")).filter("freq >= 3")


def trim(words: DataFrame, protected: DataFrame, most: int = C.MAX_WORDS) -> DataFrame:
    """Leaves out the rarest unprotected words (by count, then word) beyond `most`.

    The boundary is found from the counts of each frequency, and within that of the boundary from those of each beginning of three letters,
    so only the words of one frequency and beginning are ever ranked. The vocabulary is computed once and stored.
    """
    words = once(words, "vocabulary")
    free = once(words.join(protected.select("word").distinct(), "word", "left_anti"), "unprotected")
    excess = words.agg(F.greatest(F.lit(0), F.count("*") - most).alias("excess"))
    upto = Window.orderBy("freq").rowsBetween(Window.unboundedPreceding, -1)
    levels = free.groupBy("freq").agg(F.count("*").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(upto), F.lit(0)))
    levels = levels.crossJoin(F.broadcast(excess)).select("freq", (F.col("excess") - F.col("before")).alias("room"), "n").filter("room > 0")
    all_gone = free.join(levels.filter("room >= n"), "freq", "left_semi").select("word")
    edge = free.join(levels.filter("room < n").drop("n"), "freq").withColumn("lead", F.left("word", F.lit(3)))
    leads = edge.groupBy("lead").agg(F.count("*").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(upto.orderBy("lead")), F.lit(0)))
    edge = edge.join(leads, "lead").filter("before < room")
    rank = F.row_number().over(Window.partitionBy("lead").orderBy("word"))
    some_gone = edge.filter("before + n > room").withColumn("r", rank).filter("before + r <= room").select("word")
    return words.join(all_gone.union(edge.filter("before + n <= room").select("word")).union(some_gone), "word", "left_anti")


def scale_pairs(pairs: DataFrame, words: DataFrame) -> DataFrame:
    """(first, second, cnt) of raw pairs whose words are both in the vocabulary, scaled by the biggest that stays."""
    keys = words.select("word")
    both = pairs.join(keys.withColumnRenamed("word", "first"), "first", "left_semi").join(keys.withColumnRenamed("word", "second"), "second", "left_semi")
    return both.crossJoin(F.broadcast(both.agg(F.max("raw").alias("biggest")))).select("first", "second", scaled(F.col("raw"), F.col("biggest")).alias("cnt"))


RULE = "flag string, suffix boolean, crosses boolean, strip string, add string, condition string"


def affix_rules(spark: SparkSession, text: str) -> DataFrame:
    """RULE rows of an .aff text. A flag's header says its kind and whether it crosses with the other kind; of several headers the last
    counts, with the rules below it. `0` is nothing, what follows `/` is left out, and a rule without a condition always applies."""
    lines = spark.createDataFrame(list(enumerate(text.splitlines())), "line long, value string").filter(F.col("value").rlike("^[PS]FX "))
    t, n = F.split(F.trim("value"), r"\s+"), F.size("t")
    at = lambda i: F.get("t", F.lit(i))
    rows = lines.select("line", t.alias("t")).withColumn("head", (n == 4) & at(2).isin("Y", "N") & at(3).rlike(r"^\d+\z"))
    heads = rows.filter("head").groupBy(at(1).alias("flag")).agg(F.max_by(F.struct((at(0) == "SFX").alias("suffix"), (at(2) == "Y").alias("crosses")), "line").alias("kind"), F.max("line").alias("since"))
    told = lambda i: F.when(at(i) == "0", "").otherwise(F.split(at(i), "/")[0])
    body = rows.filter((n >= 4) & ~F.col("head")).select("line", at(1).alias("flag"), told(2).alias("strip"), told(3).alias("add"), F.coalesce(at(4), F.lit(".")).alias("condition"))
    return body.join(heads, "flag").filter("line > since").select("flag", "kind.suffix", "kind.crosses", "strip", "add", "condition")


def expand_affixes(entries: DataFrame, rules: DataFrame) -> DataFrame:
    """(word) distinct lower-cased forms of entries (word, flags) under RULE rows: the words themselves, with a suffix, with a prefix, and with
    both where both cross. Flags without a rule and null flags do nothing; null words have no form."""
    own = entries.select("word", F.coalesce("flags", F.lit("")).alias("flags")).filter("word is not null")
    flagged = own.select("word", "flags", F.explode(F.array_distinct(F.split("flags", ""))).alias("flag")).join(rules, "flag")
    fits = F.endswith("word", F.col("strip")) & F.rlike("word", F.concat(F.lit("(?:"), "condition", F.lit(")$")))
    ended = flagged.filter("suffix").filter(fits).select("flags", F.concat(F.left("word", F.length("word") - F.length("strip")), "add").alias("word"), "crosses")
    crossing = ended.filter("crosses").select("word", F.explode(F.array_distinct(F.split("flags", ""))).alias("flag")).join(rules.filter("crosses"), "flag")
    stems = flagged.select("word", "suffix", "strip", "add", "condition").union(crossing.select("word", "suffix", "strip", "add", "condition")).filter("not suffix")
    begun = stems.filter(F.rlike("word", F.concat(F.lit("^(?:"), "condition", F.lit(")")))).select(F.concat("add", F.col("word").substr(F.length("strip") + 1, F.length("word"))).alias("word"))
    return own.select("word").union(ended.select("word")).union(begun).select(F.lower("word").alias("word")).distinct()


def build_vocabulary(web: DataFrame, valid: DataFrame, expanded: DataFrame, misspellings: DataFrame, books: DataFrame, listed: DataFrame, most: int = C.MAX_WORDS, blocked: Iterable[str] = ()) -> DataFrame:
    """The whole build: filter, drop misspellings twice, add informal words, contractions and listed words, trim."""
    informal = web.sparkSession.createDataFrame(list(C.INFORMAL.items()), "word string, freq long")
    words = drop_known_misspellings(drop_misspellings(filter_vocabulary(web, valid, expanded, blocked), expanded), misspellings)
    words = insert_new(raise_to(words, informal), contractions_of(books))
    words = raise_to(words, listed.select("word", F.lit(C.LISTED_COUNT).alias("freq"))).filter(~F.col("word").isin(list(blocked) or [""]))
    return trim(words, informal.select("word").union(listed.select("word")), most)
