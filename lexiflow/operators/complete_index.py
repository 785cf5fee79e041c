"""A stored trie for completion: each node knows the highest count below it, and the k best are searched best first.

A node is a row: its beginning, the one a letter shorter, its depth, the count of the word that ends there, and the highest count at or
below it. Nodes are stored by their first letters, sorted by depth, so a search reads the folders of its probes' letters only. All probes
are searched together, a letter at a time: of what a probe has found and what is still open, only the k best counts are kept (with all
that tie with the last), as each open node holds a word with its count, so nothing beyond can be among the k best.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.constants import COMPLETION_RATIO, TOP_K
from ..functions.text import norm, numbers
from ..sources.tables import once

#: First letters that name a folder, and probes' leads up to which the folders are named in the plan.
LEAD, NAMED = 1, 500
NODE = "parent string, depth int, freq long, best long, node string, lead string"


@dataclass
class CompletionIndex:
    """A trie in a folder."""

    spark: SparkSession
    path: str

    def nodes(self) -> DataFrame:
        return self.spark.read.schema(NODE).parquet(self.path)


def build_completion_index(words: DataFrame, path: str) -> CompletionIndex:
    """Writes the trie of (word, freq), each word once; null and empty words take no part. Lead folders are named by code points, so that
    any letter may begin a word."""
    own = words.filter("word is not null and word != ''").select("word", F.col("freq").cast("long"))
    cut = own.select("word", "freq", F.explode(numbers(1, F.length("word"))).alias("depth")).withColumn("node", F.left("word", F.col("depth")))
    nodes = cut.groupBy("node", "depth").agg(F.max("freq").alias("best"), F.max(F.when(F.length("word") == F.col("depth"), F.col("freq"))).alias("freq"))
    nodes = nodes.select(F.left("node", F.col("depth") - 1).alias("parent"), F.col("depth").cast("int").alias("depth"), "freq", "best", "node", _lead(F.col("node")).alias("lead"))
    nodes.repartition("lead").sortWithinPartitions("lead", "depth", "parent").write.partitionBy("lead").parquet(path)
    return CompletionIndex(words.sparkSession, path)


def _lead(text):
    return F.concat(F.lit("c"), F.hex(F.encode(F.left(text, F.lit(LEAD)), "UTF-8")))


def best_words(prefixes: DataFrame, index: CompletionIndex, k: int = TOP_K, most_depth: int | None = None) -> DataFrame:
    """(prefix, word, freq, rank) of the k words with the highest counts that begin with each distinct prefix, itself included; equal counts go
    to the smaller word. Prefixes are normalised; an empty one has none."""
    asked = once(prefixes.select(norm(F.col("prefix")).alias("prefix")).filter("prefix != ''").distinct().withColumn("lead", _lead(F.col("prefix"))), "prefixes")
    leads = [r["lead"] for r in asked.select("lead").distinct().limit(NAMED + 1).collect()]
    nodes = index.nodes()
    if len(leads) <= NAMED:
        nodes = nodes.filter(F.col("lead").isin(leads)) if leads else nodes.limit(0)
    deepest = most_depth or nodes.agg(F.max("depth").alias("n")).first()["n"] or 0
    open_ = nodes.join(asked.withColumnRenamed("prefix", "node"), ["lead", "node"]).select(F.col("node").alias("prefix"), "node", "depth", "freq", "best", "lead")
    first = asked.agg(F.min(F.length("prefix")).alias("n")).first()["n"] or deepest
    found, waiting = None, once(open_, "open-nodes")
    order = Window.partitionBy("prefix").orderBy(F.desc("bound"))
    for depth in range(first, deepest + 1):
        here = waiting.filter(F.col("depth") == depth)
        ended = here.filter("freq is not null").select("prefix", F.col("node").alias("word"), "freq", F.lit(None).cast("int").alias("depth"), F.col("freq").alias("bound"), "lead")
        below = here.select("prefix", F.col("node").alias("parent"), "lead").join(nodes.filter(F.col("depth") == depth + 1), ["lead", "parent"])
        below = below.select("prefix", "node", "depth", "freq", "best", "lead")
        later = waiting.filter(F.col("depth") > depth).union(below)
        both = later.select("prefix", F.col("node").alias("word"), "freq", "depth", F.col("best").alias("bound"), "lead").union(ended)
        both = both if found is None else both.union(found)
        kept = once(both.withColumn("r", F.rank().over(order)).filter(F.col("r") <= k).drop("r"), "best-so-far")
        found = kept.filter("depth is null")
        waiting = kept.filter("depth is not null").select("prefix", F.col("word").alias("node"), "depth", "freq", F.col("bound").alias("best"), "lead")
        if waiting.isEmpty():
            break
    if found is None:
        return index.spark.createDataFrame([], "prefix string, word string, freq long, rank long")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("prefix").orderBy(F.desc("freq"), "word")).cast("long"))
    return ranked.filter(F.col("rank") <= k).select("prefix", "word", "freq", "rank")


def complete_from_index(probes: DataFrame, words: DataFrame, index: CompletionIndex, k: int = TOP_K) -> DataFrame:
    """(prefix, word, freq, is_contraction, rank) for each distinct prefix: the rows of complete() without context. Contractions come first, then
    words above the floor of the prefix's own count."""
    asked = once(probes.select(norm(F.col("prefix")).alias("prefix")).filter("prefix != ''").distinct(), "asked")
    bare = asked.filter((F.length("prefix") >= 2) & (F.instr("prefix", "'") == 0))
    at = bare.select(F.col("prefix").alias("asked"), F.explode(numbers(1, F.length("prefix") - 1)).alias("i"))
    typed = once(at.select("asked", F.concat(F.left("asked", F.col("i")), F.lit("'"), F.col("asked").substr(F.col("i") + 1, F.length("asked"))).alias("prefix")), "typed")
    all_best = once(best_words(asked.union(typed.select("prefix")), index, k), "best-words")
    short = all_best.join(typed, "prefix").select(F.col("asked").alias("prefix"), "word", "freq").distinct()
    floor = words.select(F.col("word").alias("prefix"), F.expr(f"freq div {COMPLETION_RATIO}").alias("floor"))
    plain = all_best.join(asked, "prefix", "left_semi").join(floor, "prefix", "left").filter(F.col("freq") >= F.coalesce("floor", F.lit(0)))
    both = short.withColumn("src", F.lit(0)).union(plain.select("prefix", "word", "freq", F.lit(1)))
    order = Window.partitionBy("prefix").orderBy("src", F.desc("freq"), "word")
    return both.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= k).select("prefix", "word", "freq", (F.col("src") == 0).alias("is_contraction"), "rank")
