"""Spelling corrections and the autocorrect decision with its reasons."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions.text import apostrophe_insertions, double_letter_edits, is_completion_of, letter_swaps, match_capitalization, max_distance, norm, slip_rank
from ..sources.tables import once
from .complete import context_score, with_context
from .ngram import count_chosen
from .similarity import similarity_join


def misspelled(probes: DataFrame, words: DataFrame, column: str = "word") -> DataFrame:
    """Probes whose normalised word is not empty and not in the vocabulary."""
    return probes.filter(norm(F.col(column)) != "").join(words.select(F.col("word").alias("__key")), norm(F.col(column)) == F.col("__key"), "left_anti")


def should_mark(probes: DataFrame, words: DataFrame, ignored: DataFrame, column: str = "word") -> DataFrame:
    """Misspelled probes without a digit that the session does not ignore."""
    skip = ignored.select(norm(F.col("word")).alias("__skip")).distinct()
    return misspelled(probes, words, column).filter(~F.col(column).rlike(r"\d")).join(skip, norm(F.col(column)) == F.col("__skip"), "left_anti")


def find_corrections(typed: DataFrame, words: DataFrame, k: int = C.TOP_K, strategy: str = "deletes") -> DataFrame:
    """(typed, word, distance, freq, flags, slip_rank, rank) of the k best corrections of each distinct unknown word.

    The vocabulary is computed once and stored, and so are the words asked for; neither is ever broadcast, as a stored table takes many times
    its size in the driver. Distance is the Levenshtein distance up to 1 (four letters or fewer) or 2, but 1 for a swap of neighbours or a missing apostrophe.
    """
    vocabulary = once(words, "vocabulary").select("word", "freq").hint("merge")
    asked = once(misspelled(typed.select(norm(F.col("typed")).alias("typed")).distinct(), vocabulary, "typed"), "asked")
    near = similarity_join(asked, vocabulary, C.LONG_DISTANCE, strategy).filter(F.col("distance") <= max_distance(F.col("typed")))
    swaps = asked.select("typed", F.explode(letter_swaps(F.col("typed"))).alias("word"), F.lit(1).alias("distance"))
    marks = asked.select("typed", F.explode(apostrophe_insertions(F.col("typed"))).alias("word"), F.lit(1).alias("distance"))
    least = near.unionByName(swaps).unionByName(marks).groupBy("typed", "word").agg(F.min("distance").alias("distance"))
    t, w = F.col("typed"), F.col("word")
    longer = lambda n: (F.col("distance") == 1) & (F.length(w) == F.length(t) + n)  # noqa: E731  else the edits need not be listed
    flagged = least.join(vocabulary, "word").withColumns({
        "is_missing_apostrophe": longer(1) & F.array_contains(apostrophe_insertions(t), w),
        "is_double_letter_fix": (longer(1) | longer(-1)) & F.array_contains(double_letter_edits(t), w),
        "is_letter_swap": longer(0) & F.array_contains(letter_swaps(t), w),
        "is_completion": is_completion_of(t, w),
    })
    ranked = flagged.withColumn("slip_rank", slip_rank(*(F.col(c) for c in ("is_missing_apostrophe", "is_double_letter_fix", "is_letter_swap", "is_completion"))))
    order = Window.partitionBy("typed").orderBy("distance", "slip_rank", F.desc("freq"), "word")
    return ranked.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= k)


def autocorrect(probes: DataFrame, words: DataFrame, bigrams: DataFrame | None = None, user_words: DataFrame | None = None, enabled: bool = True, fix_messy_words: bool = True, strategy: str = "deletes") -> DataFrame:
    """Decisions for distinct (typed, is_sentence_start, previous): changed, corrected and the reason, in a fixed order of rules.

    Context counts where bigrams are given, the previous word has followers and the best candidate is not a missing apostrophe; the
    candidates are the 20 best, then ranked again by distance, score and word. Bigrams may hold a pair in several rows, whose counts add up.
    """
    words = once(words, "vocabulary")
    have = set(probes.columns)
    ask = probes.select("typed", F.coalesce(F.col("is_sentence_start"), F.lit(False)).alias("is_sentence_start") if "is_sentence_start" in have else F.lit(False).alias("is_sentence_start"), F.col("previous") if "previous" in have else F.lit(None).cast("string").alias("previous")).distinct()
    ask = once(ask.withColumns({"low": norm(F.col("typed")), "prev": norm(F.col("previous"))}), "probes")
    cands = once(find_corrections(ask.select("typed"), words, C.CONTEXT_CANDIDATES, strategy).withColumnRenamed("typed", "low"), "candidates")
    first = F.max((F.col("rank") == 1) & F.col("is_missing_apostrophe")).over(Window.partitionBy("low"))
    rows = ask.select("low", "prev").distinct().join(cands.withColumn("first_is_mark", first).hint("merge"), "low")
    if bigrams is not None:
        chosen = rows.filter((F.col("prev") != "") & ~F.col("first_is_mark")).select(F.col("prev").alias("first"), F.col("word").alias("second"))
        bigrams = once(count_chosen(bigrams, chosen), "pairs").hint("merge")
    rows = with_context(rows, words, bigrams, "prev")
    score = context_score(F.col("freq"), F.col("cnt"), F.col("total_after"), F.col("total")) * F.element_at(F.array(*map(F.lit, C.SLIP_WEIGHTS)), F.col("slip_rank") + 1)
    rows = rows.withColumns({"ctx": (F.col("prev") != "") & (F.col("total_after") > 0) & ~F.col("first_is_mark"), "score": score})
    key = F.struct(F.when(F.col("ctx"), F.col("distance")).otherwise(F.col("rank").cast("int")).alias("k1"), F.when(F.col("ctx"), -F.col("score")).otherwise(F.lit(0.0)).alias("k2"), "word", "distance", "slip_rank", "freq", "score")
    top = rows.groupBy("low", "prev").agg(F.first("ctx").alias("ctx"), F.array_sort(F.collect_list(key)).alias("c"))  # at most 20 candidates
    best, runner = F.get("c", F.lit(0)), F.get("c", F.lit(1))
    margin = F.when(best["distance"] <= 1, C.MARGIN_ONE).otherwise(C.MARGIN_TWO)
    plain = (best["slip_rank"] < runner["slip_rank"]) | (runner["freq"] <= 0) | (best["freq"] >= margin * runner["freq"])
    weighed = (runner["score"] <= 0) | (best["score"] >= margin * runner["score"])
    clear = runner.isNull() | (runner["distance"] > best["distance"]) | F.when(F.col("ctx"), weighed).otherwise(plain)
    known = words.select(F.col("word").alias("low"), F.lit(True).alias("known"))
    judged = ask.join(known.hint("merge"), "low", "left").join(top.hint("merge"), ["low", "prev"], "left")
    if user_words is None:
        judged = judged.withColumn("mine", F.lit(False))
    else:
        judged = judged.join(user_words.select(norm(F.col("word")).alias("low"), F.lit(True).alias("mine")).distinct(), "low", "left")
    reason = F.lit("autocorrect is off") if not enabled else (
        F.when(F.col("low") == "", "not a word")
        .when(F.col("typed").rlike(r"\d"), "has a digit in it")
        .when(F.col("mine"), "you added this word")
        .when(F.col("known"), "already a real word")
        .when(~F.col("is_sentence_start") & F.col("typed").rlike(r"(?U)^\s*\p{Lu}"), "looks like a name")
        .when(best.isNull(), "no close word found")
        .when(best["distance"] > C.MAX_DISTANCE, "closest word is too far away")
        .when((best["distance"] == 2) & F.lit(not fix_messy_words), "too messy to fix on its own")
        .when((best["distance"] == 2) & (F.length("low") < C.MIN_TWO_MISTAKES), "too short to guess at two mistakes")
        .when(~clear, "two words are too close to call")
        .otherwise("corrected")
    )
    done = judged.withColumn("reason", reason).withColumn("changed", F.col("reason") == "corrected")
    return done.select("typed", "is_sentence_start", "previous", "changed", F.when(F.col("changed"), match_capitalization(F.col("typed"), best["word"])).otherwise(F.col("typed")).alias("corrected"), "reason")


def score_cases(cases: DataFrame, decisions: DataFrame) -> DataFrame:
    """Counts of a golden set (typed, previous, expected): right, wrong, missed fixes and kept words."""
    made = decisions.select(F.col("typed").alias("__t"), F.col("previous").alias("__p"), "corrected")
    joined = cases.join(made, (F.col("typed") == F.col("__t")) & F.col("previous").eqNullSafe(F.col("__p")))
    typo, changed, right = F.col("typed") != F.col("expected"), F.col("corrected") != F.col("typed"), F.col("corrected") == F.col("expected")
    return joined.agg(F.count_if(typo & right).alias("right"), F.count_if(changed & ~right).alias("wrong"), F.count_if(typo & ~changed).alias("missed"), F.count_if(~typo & ~changed).alias("kept"))
