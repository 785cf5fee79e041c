"""Similarity joins by Levenshtein distance, which Catalyst would run as a nested loop."""

from __future__ import annotations

import secrets
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import numbers
from ..sources.tables import once

#: Letters beyond which a word is met by its pieces instead of what deletions leave, whose number grows with the length.
LONG = 24
#: The bitmap that words' rests must pass has 16 bits for each rest of a probe, but no more than 2^MOST_BITS (64 MB), cut into 64 KB for the way.
MOST_BITS, SLICE_BITS = 29, 19
#: Hashes that a task holds at once.
HASHES = 1 << 19
#: Pairs up to which every one may be compared.
SCAN_PAIRS = 100_000_000


def _pieces(word: Column, length: Column, k: int, shifts: range) -> Column:
    """(length, number, piece) for the k + 1 pieces of a word of this length, cut from `word` at shifted places."""

    def one(i: int, shift: int) -> Column:
        start, stop = F.floor(length * i / (k + 1)).cast("int") + shift, F.floor(length * (i + 1) / (k + 1)).cast("int") + shift
        piece = F.struct(length.alias("length"), F.lit(i).alias("number"), word.substr(start + 1, stop - start).alias("piece"))
        return F.when((start >= 0) & (stop <= F.length(word)), piece)

    return F.array_compact(F.array(*(one(i, s) for i in range(k + 1) for s in shifts)))


def _long_pairs(left: DataFrame, right: DataFrame, k: int) -> DataFrame:
    """Pairs of long words: of k + 1 pieces of one, k edits leave at least one whole, moved by at most k places."""
    a = left.filter(F.length("typed") > LONG).select("typed", F.explode(_pieces(F.col("typed"), F.length("typed"), k, range(1))).alias("rest"))
    near = right.filter(F.length("word") > LONG - k).select("word", F.explode(F.sequence(F.length("word") - k, F.length("word") + k)).alias("n")).filter(F.col("n") > LONG)
    b = near.select("word", F.explode(_pieces(F.col("word"), F.col("n"), k, range(-k, k + 1))).alias("rest"))
    return a.hint("merge").join(b, "rest").select("typed", "word")


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _rest_hashes(words: list[str], k: int, secret: tuple[int, int]):
    """Blocks of (place of the word, letters gone, hash) for the distinct rests of each word after up to k deletions.

    A hash is a sum over the letters of a secret number for the letter, times a secret odd number to the power of its place. A deletion moves
    what follows by one place, so any rest's hash comes from the running sums of its word."""
    codes = np.frombuffer("".join(words).encode("utf-32-le"), "<u4").astype(np.uint64)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    begin = np.cumsum(lengths) - lengths
    base, back = np.uint64(secret[0]), np.uint64(pow(secret[0], -1, 1 << 64))
    for n in np.unique(lengths).tolist():
        powers = np.full(n, base, np.uint64)
        powers[:1] = 1
        powers = np.cumprod(powers, dtype=np.uint64)
        for gone in range(min(k, n) + 1):
            cuts = list(combinations(range(n), gone))
            cuts = np.array(cuts, np.int64).reshape(len(cuts), gone)
            same = np.flatnonzero(lengths == n)
            step = max(1, HASHES // len(cuts))
            for at in (same[i : i + step] for i in range(0, len(same), step)):
                sums = np.zeros((len(at), n + 1), np.uint64)
                np.cumsum(_mix(codes[begin[at][:, None] + np.arange(n)] + np.uint64(secret[1])) * powers, axis=1, out=sums[:, 1:])
                found, shift = np.zeros((len(at), len(cuts)), np.uint64), np.ones(1, np.uint64)
                for part in range(gone + 1):
                    start = cuts[:, part - 1] + 1 if part else np.zeros(len(cuts), np.int64)
                    stop = cuts[:, part] if part < gone else np.full(len(cuts), n)
                    found += (sums[:, stop] - sums[:, start]) * shift
                    shift *= back
                found = np.sort(_mix(found), axis=1)
                new = np.ones(found.shape, bool)
                new[:, 1:] = found[:, 1:] != found[:, :-1]
                row, column = np.nonzero(new)
                yield at[row], gone, found[row, column]


def _rests(k: int, secret: tuple[int, int], passing=None, bits: int = 0):
    """(rest, gone, word) of a batch's words; with a bitmap, only those whose rest it holds."""

    def run(batches):
        for batch in batches:
            words = batch.column(0)
            for row, gone, found in _rest_hashes(words.to_pylist(), k, secret):
                if passing is not None:
                    at = found >> np.uint64(64 - bits)
                    held = (passing.value[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
                    row, found = row[held], found[held]
                if len(row):
                    yield pa.record_batch([pa.array(found.view(np.int64)), pa.array(np.full(len(row), gone, np.int8)), words.take(pa.array(row))], names=["rest", "gone", "word"])

    return run


def _bitmap(key, table):
    held = np.zeros(1 << SLICE_BITS, bool)
    held[table.column("at").to_numpy() & ((1 << SLICE_BITS) - 1)] = True
    return pa.table({"slice": pa.array([key[0].as_py()], pa.int64()), "bits": pa.array([np.packbits(held, bitorder="little").tobytes()], pa.binary())})


def _met(left: DataFrame, right: DataFrame, k: int) -> DataFrame:
    """(typed, word) within k, for typed (stored) and word of such lengths that all their deletions can be listed.

    Rests are 64-bit hashes. Those of words leave their task only if a bitmap of the probes' rests has them. Pairs are measured where they
    meet, and given out only from rests that lose no more letters than their distance, as each of them has one."""
    spark, secret = left.sparkSession, (secrets.randbits(64) | 1, secrets.randbits(63))
    schema = "rest long, gone byte, {} string"
    a = left.mapInArrow(_rests(k, secret), schema.format("word")).withColumnRenamed("word", "typed")
    bits = min(MOST_BITS, max(SLICE_BITS, (16 * a.count()).bit_length()))
    marks = a.select(F.shiftrightunsigned("rest", 64 - bits).alias("at")).withColumn("slice", F.shiftright("at", SLICE_BITS))
    passing = np.zeros(1 << bits - 3, np.uint8)
    for r in marks.groupBy("slice").applyInArrow(_bitmap, "slice long, bits binary").toLocalIterator():  # 64 MB at most
        passing[r["slice"] << SLICE_BITS - 3 :][: 1 << SLICE_BITS - 3] = np.frombuffer(r["bits"], np.uint8)
    b = right.mapInArrow(_rests(k, secret, spark.sparkContext.broadcast(passing), bits), schema.format("word")).withColumnRenamed("gone", "lost")
    # A broadcast of either side would be chosen by the size of the words, not of their rests.
    near = a.hint("merge").join(b, "rest").filter(F.abs(F.length("typed") - F.length("word")) <= k)
    measured = near.withColumn("distance", F.levenshtein("typed", "word", k))
    return measured.filter((F.col("distance") >= 0) & (F.greatest("gone", "lost") <= F.col("distance"))).select("typed", "word")


def similarity_join(probes: DataFrame, words: DataFrame, k: int, strategy: str = "deletes") -> DataFrame:
    """(typed, word, distance) with distance <= k, for distinct probes (typed) and words (word).

    "scan" compares every pair, a yardstick that refuses more than SCAN_PAIRS. "length" joins on word length and compares. "deletes" joins on hashes of what is
    left after up to k deletions, which any two strings within k share, and compares only those; for words beyond LONG letters, on one of
    k + 1 pieces.
    """
    # A fixed number of partitions: both sides are small until deletions multiply them, so they must not be gathered in few tasks before.
    n = int(probes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    left, right = probes.select("typed").repartition(n, "typed").distinct(), words.select("word").repartition(n, "word").distinct()
    if k < 0:
        return left.crossJoin(right).select("typed", "word", F.lit(0).alias("distance")).limit(0)
    if strategy == "scan":
        if (many := left.count() * right.count()) > SCAN_PAIRS:
            raise ValueError(f"{many} pairs are too many to scan")
        pairs = left.crossJoin(right)
    elif strategy == "length":
        lengths = F.explode(numbers(0, F.length("typed") + k)).alias("n")
        near = left.select("typed", lengths).filter(F.col("n") >= F.length("typed") - k)
        pairs = near.join(right.withColumn("n", F.length("word")), "n")
    elif strategy == "deletes":
        left = once(left, "probes")  # read three times
        short = _met(left.filter(F.length("typed") <= LONG).repartition(n), right.filter(F.length("word") <= LONG + k), k)
        far = _long_pairs(left, right, k).filter(F.levenshtein("typed", "word", k) >= 0)
        pairs = short.union(far).distinct()
    else:
        raise ValueError(f"unknown strategy {strategy}")
    return pairs.select("typed", "word", F.levenshtein("typed", "word", k).alias("distance")).filter("distance >= 0")
