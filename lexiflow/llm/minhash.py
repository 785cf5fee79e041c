"""Near-duplicate groups: SuperMinHash signatures, banding, exact verification, union-find.

Documents with equal shingle sets are collapsed first. A signature has one slot for each of m places of a random permutation;
element e puts j + r into the j-th place of its own permutation, so one step fills as many slots as a document has elements and
most documents stop after one or two steps. Bands of four slots are grouped; the number of bands follows from the similarity
so that a pair at the threshold misses all of them with a probability below 1e-7.

In a band group every member is compared with the smallest id (the hub). Groups whose members are then all in one component are
done. The others are joined to families; in a family, each member outside the largest component is compared with all members, as no
other pair can still matter. That is done in blocks of bounded bytes with an index from shingles to members, and only links that
join two components of a block leave it. So no link is lost to a hub that does not resemble both of its ends, and no pairs of a
group are written out. Comparisons are made on full shingle sets, as 64-bit hashes under a secret of the call: two given shingles share
one with a probability below 2^-57, whoever chose them.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, chunks_by_bytes, frugal, light, stored, whole
from .components import connected_components
from .textscan import SPACED, U, fresh_secret, hasher, mix, scan

ROWS = 4
MISS = 1e-7
FEATURES = "__lf_id long, n_shingles long, set_print binary, bands array<long>"


def bands_for(percent: int) -> int:
    """Bands of four slots so that a pair at the threshold is missed with a probability below MISS."""
    bands = math.ceil(math.log(MISS) / math.log(1 - (percent / 100) ** ROWS)) if 0 < percent < 100 else 1
    if percent <= 0 or bands * ROWS >= 1 << 16:
        raise ValueError(f"a similarity of {percent} percent needs too many slots")
    return bands


def shingle_sets(column: pa.Array, size: int, secret: bytes) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text (A-Z lower-cased, words between ASCII white space)."""
    found = scan(column, SPACED)
    one = hasher(secret, fold=True)
    words, n = one.words(found.data, found.starts, found.ends), found.counts
    many = np.where(n >= size, n - size + 1, np.minimum(n, 1))
    cuts = np.concatenate(([0], np.cumsum(many)))
    doc = np.repeat(np.arange(len(n)), many)
    at = found.first[:-1][doc] + np.arange(cuts[-1]) - cuts[:-1][doc]
    runs, length = np.empty(len(at), np.uint64), np.minimum(n[doc], size)
    for some in range(1, size + 1):  # a text of fewer words is one run
        here = length == some
        if here.any():
            runs[here] = one.runs(words, at[here], some)
    return [np.unique(runs[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def superminhash(sets: list[np.ndarray], m: int) -> np.ndarray:
    """Signatures, one row of m slots a set; a slot holds step << 48 | random, and only equality of slots matters."""
    sizes = np.array([len(s) for s in sets], np.int64)
    slots = np.full((len(sets), m), np.iinfo(np.uint64).max)
    state = mix((np.concatenate(sets) if len(sets) else np.zeros(0, np.uint64)) ^ U(0x5DEECE66D1234567))
    doc, order = np.repeat(np.arange(len(sets)), sizes), None
    for step in range(m):
        if not len(doc):
            break
        value = (U(step) << U(48)) | (mix(state + U((2 * step + 1) * 0x9E3779B97F4A7C15 % 2**64)) >> U(16))
        pick = step + (mix(state + U((2 * step + 2) * 0x9E3779B97F4A7C15 % 2**64)) % U(m - step)).astype(np.int64)
        if order is None:
            slot = pick
        else:
            rows = np.arange(len(doc))
            slot = order[rows, pick].astype(np.int64)
            order[rows, pick] = order[:, step]
        np.minimum.at(slots.reshape(-1), doc * m + slot, value)
        open_ = (slots >= (U(step + 1) << U(48))).any(axis=1)  # later steps only bring larger values
        stay = open_[doc]
        if order is None:
            order = np.tile(np.arange(m, dtype=np.uint16), (int(stay.sum()), 1))
            order[np.arange(len(order)), slot[stay]] = 0
        else:
            order = order[stay]
        doc, state = doc[stay], state[stay]
    return slots


def _features(id_col: str, text: str, size: int, bands: int, secret: bytes):
    def run(batches):
        for batch in chunks_by_bytes(batches, text, 2 << 20):
            sets = shingle_sets(batch.column(text), size, secret)
            slots = superminhash(sets, bands * ROWS)
            keys = np.zeros((len(sets), bands), np.uint64)
            for r in range(ROWS):
                keys = mix(keys * U(0x9E3779B97F4A7C15) + slots[:, r::ROWS])
            keys = mix(keys + np.arange(1, bands + 1, dtype=np.uint64) * U(0xD1B54A32D192ED03)).view(np.int64)
            prints = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1) * bands, pa.int32()), pa.array(keys.reshape(-1)))
            yield pa.record_batch([batch.column(id_col).cast(pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array(prints, pa.binary()), lists], names=["__lf_id", "n_shingles", "set_print", "bands"])

    return run


def _sets(id_col: str, text: str, size: int, secret: bytes):
    def run(batches):
        for batch in chunks_by_bytes(batches, text, 2 << 20):
            blobs = [s.tobytes() for s in shingle_sets(batch.column(text), size, secret)]
            yield pa.record_batch([batch.column(id_col).cast(pa.int64()), pa.array(blobs, pa.binary())], names=["node", "shingles"])

    return run


def _verify(percent: int):
    def run(batches):
        for batch in batches:
            keep = []
            for a, b in zip(batch.column("a_set"), batch.column("b_set"), strict=True):
                x, y = np.frombuffer(a.as_buffer(), np.uint64), np.frombuffer(b.as_buffer(), np.uint64)
                if len(x) > len(y):
                    x, y = y, x
                both = 0
                if 100 * len(x) >= percent * len(y):
                    place = np.searchsorted(y, x)
                    both = int((y[np.minimum(place, len(y) - 1)] == x).sum())
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.record_batch([batch.column("node").filter(pa.array(keep, pa.bool_())), batch.column("other").filter(pa.array(keep, pa.bool_()))], names=["node", "other"])

    return run


FAMILY_MB, REST_MB = 24, 6


def _links_in_block(percent: int):
    """Links between the block's rest (members outside the family's largest component) and all its members, one a pair of components."""

    def run(key, table):
        ids, labels, rest = (table.column(c).to_numpy() for c in ("node", "label", "rest"))
        sets = [np.frombuffer(b.as_buffer(), np.uint64) for b in table.column("shingles")]
        every = np.flatnonzero(~rest)
        sizes = np.array([len(sets[i]) for i in every], np.int64)
        flat, owner = (np.concatenate([sets[i] for i in every]) if len(every) else np.zeros(0, np.uint64)), np.repeat(np.arange(len(every)), sizes)
        order = np.argsort(flat, kind="stable")
        flat, owner, out = flat[order], owner[order], []
        root = {x: x for x in labels.tolist()}

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = x = root[root[x]]
            return x

        for r in np.flatnonzero(rest).tolist():
            lo, hi = np.searchsorted(flat, sets[r]), np.searchsorted(flat, sets[r], "right")
            many = hi - lo
            at = np.repeat(lo - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
            both = np.bincount(owner[at], minlength=len(every))
            for m in every[100 * both >= percent * (len(sets[r]) + sizes - both)].tolist():
                a, b = find(int(labels[r])), find(int(labels[m]))
                if a != b:
                    root[max(a, b)] = min(a, b)
                    out.append((int(ids[r]), int(ids[m])))
        return pa.table({"node": pa.array([max(x) for x in out], pa.int64()), "other": pa.array([min(x) for x in out], pa.int64())})

    return run


def _labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    return rows.join(labels, "node", "left").withColumn("label", F.coalesce("component", "node")).drop("component")


def _rest_of_families(members: DataFrame, labels: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links that hubs have not shown, from the band groups (key, node) that are not yet in one component."""
    open_ = _labelled(members, labels).groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("n"), F.min("node").alias("hub"))
    open_ = open_.filter("lo < hi and n > 2").select("key", "hub")  # the one pair of a group of two has been compared
    families = stored(connected_components(members.join(open_, "key").select("node", F.col("hub").alias("other"))), "families")
    named = stored(_labelled(families.withColumnRenamed("component", "family"), labels), "families")
    largest = named.groupBy("family", "label").agg(F.count("*").alias("n")).groupBy("family").agg(F.max_by("label", F.struct("n", -F.col("label"))).alias("main"))
    rows = named.join(largest, "family").join(sets, "node").withColumn("rest", F.col("label") != F.col("main"))
    mb = F.octet_length("shingles") / 1e6
    blocks = rows.groupBy("family").agg(F.ceil(F.sum(mb) / FAMILY_MB).cast("int").alias("n_all"), F.ceil(F.sum(F.when(F.col("rest"), mb)) / REST_MB).cast("int").alias("n_rest"))
    rows = rows.join(blocks.filter("n_rest > 0"), "family")
    mine = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    side = rows.select("family", "node", "label", "shingles", F.lit(False).alias("rest"), mine("n_all").alias("a"), every("n_rest").alias("b"))
    rest = rows.filter("rest").select("family", "node", "label", "shingles", "rest", every("n_all").alias("a"), mine("n_rest").alias("b"))
    return side.unionByName(rest).groupBy("family", "a", "b").applyInArrow(_links_in_block(percent), "node long, other long")


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_shingles, component_id (smallest id reachable by links) and kept (it is that smallest id).

    Documents link when 100 * intersection >= percent * union of their distinct shingles of `shingle` words. A text of fewer
    words is one shingle; without words or null it has none and links with nothing. Ids are unique; rows that repeat an id share
    one result each; a null id gets a null component and is kept. An empty table gives no rows. Other columns are ignored.
    """
    bounded_batches(docs.sparkSession)
    part = docs.select(F.col(id_col).cast("long").alias("__lf_id"), F.col(text_col).alias("__lf_text"))
    bands, secret = bands_for(percent), fresh_secret()
    feats = stored(part.mapInArrow(frugal(_features("__lf_id", "__lf_text", shingle, bands, secret)), FEATURES), "features")
    usable = feats.filter("n_shingles > 0 and __lf_id is not null")
    reps = usable.groupBy("set_print").agg(F.min("__lf_id").alias("rep"))
    nodes = usable.join(reps.select(F.col("rep").alias("__lf_id")).distinct(), "__lf_id", "left_semi").dropDuplicates(["__lf_id"])
    keyed = nodes.select(F.explode("bands").alias("key"), F.col("__lf_id").alias("node"))
    shared = keyed.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key")
    members = stored(keyed.join(shared, "key").select("key", "node"), "bands")
    chosen = part.join(light(members.select(F.col("node").alias("__lf_id")).distinct(), "chosen"), "__lf_id", "left_semi")
    sets = stored(chosen.mapInArrow(frugal(_sets("__lf_id", "__lf_text", shingle, secret)), "node long, shingles binary").dropDuplicates(["node"]), "sets")

    hubs = members.groupBy("key").agg(F.min("node").alias("hub"))
    pairs = members.join(hubs, "key").filter("node != hub").select("node", F.col("hub").alias("other")).distinct()
    full = pairs.join(sets.select("node", F.col("shingles").alias("a_set")), "node").join(sets.select(F.col("node").alias("other"), F.col("shingles").alias("b_set")), "other")
    shown = stored(full.mapInArrow(frugal(_verify(percent)), "node long, other long"), "verified")
    labels = stored(connected_components(shown), "labels")
    more = stored(_rest_of_families(members, labels, sets, percent), "more-links")  # one Python worker a task, not two in a row
    labels = connected_components(labels.select("node", F.col("component").alias("other")).union(more))
    of_rep = reps.join(labels.withColumnRenamed("node", "rep"), "rep", "left").select("set_print", F.coalesce("component", "rep").alias("component"))
    linked = usable.join(of_rep, "set_print").select("__lf_id", "n_shingles", F.col("component").alias("component_id"))
    alone = feats.filter("n_shingles = 0 or __lf_id is null").select("__lf_id", "n_shingles", F.col("__lf_id").alias("component_id"))
    kept = F.coalesce(F.col("__lf_id") == F.col("component_id"), F.lit(True))
    return linked.union(alone).select(F.col("__lf_id").alias(id_col), "n_shingles", "component_id", kept.alias("kept"))
