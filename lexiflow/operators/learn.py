"""Learning from use: deltas, their application and undoing, user words. Base tables stay as they are; what was learned is kept apart."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions.text import norm
from .rules import is_allowed_word


def weight(words: DataFrame) -> DataFrame:
    """One row: what one use of a word adds."""
    return words.agg(F.greatest(F.lit(C.MIN_LEARN_WEIGHT), F.expr(f"coalesce(max(freq), 0) div {C.LEARN_DIVISOR}")).cast("long").alias("weight"))


def learnable(uses: DataFrame, words: DataFrame, user_words: DataFrame, column: str) -> DataFrame:
    known = words.select("word").union(user_words.select(norm(F.col("word")).alias("word"))).distinct().withColumnRenamed("word", "__known")
    return uses.join(known, norm(F.col(column)) == F.col("__known"), "left").withColumn(f"{column}_ok", F.col("__known").isNotNull() & ~F.coalesce(F.col(column), F.lit("")).rlike(r"\d")).drop("__known")


def learn_deltas(uses: DataFrame, words: DataFrame, user_words: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(word, cnt) and (first, second, cnt) that a batch of uses (word, previous) adds."""
    rows = learnable(learnable(uses, words, user_words, "word"), words, user_words, "previous").crossJoin(F.broadcast(weight(words)))
    good = rows.filter("word_ok")
    learned_words = good.groupBy(norm(F.col("word")).alias("word")).agg(F.sum("weight").alias("cnt"))
    pairs = good.filter("previous_ok").groupBy(norm(F.col("previous")).alias("first"), norm(F.col("word")).alias("second")).agg(F.sum("weight").alias("cnt"))
    return learned_words, pairs


def record_pairs(pairs: DataFrame, words: DataFrame, user_words: DataFrame) -> DataFrame:
    """(first, second, cnt) that pairs (previous, word) add on their own, without the counts of single words; both must be learnable."""
    return learn_deltas(pairs, words, user_words)[1]


def learned_counts(probes: DataFrame, learned: DataFrame, column: str = "word") -> DataFrame:
    """The probes with learned: what has been learned about the word, 0 if nothing."""
    keys = learned.select(F.col("word").alias("__key"), F.col("cnt").alias("learned"))
    return probes.join(keys, norm(F.col(column)) == F.col("__key"), "left").withColumn("learned", F.coalesce("learned", F.lit(0))).drop("__key")


def learned_pair_counts(probes: DataFrame, learned: DataFrame) -> DataFrame:
    """The probes (previous, word) with learned: what has been learned about the pair, 0 if nothing."""
    keys = learned.select(F.col("first").alias("__first"), F.col("second").alias("__second"), F.col("cnt").alias("learned"))
    joined = probes.join(keys, (norm(F.col("previous")) == F.col("__first")) & (norm(F.col("word")) == F.col("__second")), "left")
    return joined.withColumn("learned", F.coalesce("learned", F.lit(0))).drop("__first", "__second")


def apply_learned(words: DataFrame, learned: DataFrame) -> DataFrame:
    """Counts with what was learned; unknown learned words are added."""
    return words.select("word", "freq").union(learned.select("word", F.col("cnt").alias("freq"))).groupBy("word").agg(F.sum("freq").alias("freq"))


def apply_learned_pairs(bigrams: DataFrame, learned: DataFrame) -> DataFrame:
    return bigrams.select("first", "second", "cnt").union(learned.select("first", "second", "cnt")).groupBy("first", "second").agg(F.sum("cnt").alias("cnt"))


def undo_learned(words: DataFrame, learned: DataFrame) -> DataFrame:
    """Counts without what was learned, never below 0; words stay."""
    return words.join(learned.select("word", "cnt"), "word", "left").select("word", F.greatest(F.lit(0), F.col("freq") - F.coalesce("cnt", F.lit(0))).alias("freq"))


def allowed_user_words(words: DataFrame) -> DataFrame:
    clean = norm(F.col("word"))
    return words.select(clean.alias("word")).filter(F.col("word").rlike(r"^[\p{L}']+\z")).distinct()


def merge_user_words(words: DataFrame, user_words: DataFrame) -> DataFrame:
    """The vocabulary with the user's new words at a fixed frequency; known ones keep theirs."""
    new = allowed_user_words(user_words).join(words, "word", "left_anti")
    return words.select("word", "freq").union(new.select("word", F.lit(C.USER_WORD_FREQ).cast("long")))


def _keys(words: DataFrame) -> DataFrame:
    return words.select(norm(F.col("word")).alias("word")).filter("word != ''").distinct()


def add_user_words(user_words: DataFrame, more: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The list with more words, and (word, added) of each distinct one asked for: false where it is not made of letters or was there."""
    have = _keys(user_words)
    asked = more.select(norm(F.col("word")).alias("word")).distinct().join(have.withColumn("__have", F.lit(True)), "word", "left")
    told = asked.select("word", (is_allowed_word(F.col("word")) & F.col("__have").isNull()).alias("added"))
    return have.union(told.filter("added").select("word")), told


def remove_user_words(user_words: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The list without some words, and (word, removed) of each distinct one asked for."""
    have, asked = _keys(user_words), gone.select(norm(F.col("word")).alias("word")).distinct()
    told = asked.join(have.withColumn("__have", F.lit(True)), "word", "left").select("word", F.col("__have").isNotNull().alias("removed"))
    return have.join(asked, "word", "left_anti"), told


def is_user_word(probes: DataFrame, user_words: DataFrame, column: str = "word") -> DataFrame:
    """The probes with mine: whether the user has added the word."""
    have = _keys(user_words).withColumnRenamed("word", "__mine")
    return probes.join(have, norm(F.col(column)) == F.col("__mine"), "left").withColumn("mine", F.col("__mine").isNotNull()).drop("__mine")


def all_user_words(user_words: DataFrame) -> DataFrame:
    """The list in the order of its characters."""
    return _keys(user_words).orderBy("word")


def live_vocabulary(words: DataFrame, user_words: DataFrame, removed: DataFrame) -> DataFrame:
    """What is looked up while a session runs: base and user words without those the user has removed, even if the base has them; a
    new session starts from the base again."""
    return merge_user_words(words, user_words).join(_keys(removed), "word", "left_anti")
