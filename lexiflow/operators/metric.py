"""Range search by edit distance for any k: a pivot index pruned by the triangle inequality.

Each word is kept with its distances to a few pivots, of which the first is the empty word, so that distance is the length. Two words within
k differ by at most k in each. Words with the same first distances make a cell; a probe is sent only to cells that all three
may allow, there the distances to the other pivots are compared, and the edit distance itself is taken only of what is left. Nothing
depends on k but the number of cells, where deletions of k letters would grow with the k-th power of the length.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import once
from .similarity import similarity_join

#: Words that pivots are chosen from, and how many distances make a cell.
SAMPLE, CELL = 512, 3
PIVOTS = 8
#: Edits up to which words meet on what deletions leave: that prunes more than pivots, but its cost grows with the k-th power of the length.
FEW = 3


@dataclass
class MetricIndex:
    """pivots and the stored table: word, and its distances d0, d1, ... to them."""

    pivots: list[str]
    table: DataFrame

    def columns(self) -> list[str]:
        return [f"d{i}" for i in range(len(self.pivots))]


def _distances(word: Column, pivots: list[str]) -> list[Column]:
    return [F.length(word) if p == "" else F.levenshtein(word, F.lit(p)) for p in pivots]


def choose_pivots(words: DataFrame, n: int = PIVOTS, sample: int = SAMPLE) -> list[str]:
    """The empty word and words far apart: each next one is the word of a bounded sample with the largest distance to its nearest pivot."""
    some = once(words.select("word").distinct().orderBy(F.xxhash64("word"), "word").limit(sample), "pivot-sample")
    pivots = [""]
    while len(pivots) < n:
        nearest = F.array_min(F.array(*_distances(F.col("word"), pivots)))
        best = some.filter(~F.col("word").isin(pivots)).orderBy(nearest.desc(), "word").first()
        if best is None:
            break
        pivots.append(best["word"])
    return pivots


def build_index(words: DataFrame, n_pivots: int = PIVOTS, pivots: list[str] | None = None) -> MetricIndex:
    """The index of the distinct words, which any number of searches may use. Null words take no part."""
    own = words.select("word").filter("word is not null").distinct()
    pivots = pivots or choose_pivots(own, max(CELL, n_pivots))
    index = MetricIndex(pivots, own)
    table = own.select("word", *(d.alias(n) for d, n in zip(_distances(F.col("word"), pivots), index.columns(), strict=True)))
    index.table = once(table.repartition(*index.columns()[:CELL]).sortWithinPartitions(*index.columns()), "metric-index")
    return index


def _candidates(probes: DataFrame, index: MetricIndex, k: int) -> DataFrame:
    names = index.columns()
    cell, far = names[:CELL], names[CELL:]
    near = lambda some: reduce(lambda x, y: x & y, (F.abs(F.col(c) - F.col(f"own_{c}")) <= k for c in some), F.lit(True))
    asked = probes.select("typed").filter("typed is not null").distinct()
    asked = once(asked.select("typed", *(d.alias(f"own_{n}") for d, n in zip(_distances(F.col("typed"), index.pivots), names, strict=True))), "metric-probes")
    cells = index.table.select(*cell).distinct()
    # Probes with the same first distances go to the same cells, so these are found for each distinct one.
    own = [f"own_{c}" for c in cell]
    kinds = asked.select(*own).distinct().withColumn(cell[0], F.explode(F.sequence(F.col(own[0]) - k, F.col(own[0]) + k)))
    routes = kinds.join(cells, cell[0]).filter(near(cell[1:])).select(*own, *cell)
    return asked.join(routes, own).join(index.table, cell).filter(near(far)).select("typed", "word")


def range_search(probes: DataFrame, index: MetricIndex, k: int) -> DataFrame:
    """(typed, word, distance) of all words within k of each distinct probe, as similarity_join gives them. A negative k finds nothing."""
    if k < 0:
        return probes.select("typed", F.lit("").alias("word"), F.lit(0).alias("distance")).limit(0)
    if k <= FEW:
        return similarity_join(probes.filter("typed is not null"), index.table, k)
    return _candidates(probes, index, k).withColumn("distance", F.levenshtein("typed", "word", k)).filter("distance >= 0")


def compared(probes: DataFrame, index: MetricIndex, k: int) -> DataFrame:
    """One row: how many pairs a search measures, and how many there are."""
    asked = probes.select("typed").filter("typed is not null").distinct().agg(F.count("*").alias("asked"))
    every = index.table.agg(F.count("*").alias("words"))
    measured = _candidates(probes, index, k).agg(F.count("*").alias("measured"))
    return measured.crossJoin(asked).crossJoin(every).select("measured", (F.col("asked") * F.col("words")).alias("pairs"))  # one row each
