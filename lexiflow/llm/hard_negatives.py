"""Hard negatives: integer inner products taken bit-plane by bit-plane, most significant first.

A component x becomes the integer floor(scale * x). A candidate's integers, shifted to be non-negative, are cut into bit-planes. After
some planes the score of a pair is known up to an interval: what is missing lies between the lower bits all zero and all one, on the
anchor's negative and positive components. A pair is dropped as soon as its interval cannot reach what is asked for: the least of the
best positives that are certain, or the score window of a positive and the best negatives that are certain in it. What is left after
the last plane is exact.

Anchors and candidates meet in blocks of bounded bytes, each block of anchors with each block of candidates, so nothing grows with the
table in one task; a block's best rows leave it, and the best of all blocks are ranked. Labels are not keys of the blocks, so neither
one label with most rows nor very many labels matter.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, frugal_group, light, stored

#: Bytes of integers of a block of candidates and of anchors.
CANDIDATE_BYTES, ANCHOR_BYTES = 16 << 20, 2 << 20
#: Candidates whose intervals are held at once for a block of anchors, and pairs that are finished one by one.
STEP, PAIRS = 2048, 1 << 16
FAR = np.int64(2) ** 62


def _matrix(column: pa.ChunkedArray, dims: int) -> np.ndarray:
    """Rows of integers, zeros behind those of a shorter row."""
    arr = column.combine_chunks()
    flat, sizes = arr.flatten().to_numpy(zero_copy_only=False), np.diff(arr.offsets.to_numpy())
    if (sizes == dims).all():
        return flat.reshape(-1, dims).astype(np.int64)
    out = np.zeros((len(sizes), dims), np.int64)
    out[np.arange(dims) < sizes[:, None]] = flat
    return out


def _kth(values: np.ndarray, ok: np.ndarray, k: int) -> np.ndarray:
    """For each row the k-th largest of the values that are ok, or nearly minus infinity."""
    if values.shape[1] < k:
        return np.full(len(values), -FAR)
    return np.partition(np.where(ok, values, -FAR), values.shape[1] - k, axis=1)[:, values.shape[1] - k]


def sliced_products(anchors: np.ndarray, rows: np.ndarray, bits: int, alive: np.ndarray, judge) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, row, score) of the pairs that judge(lo, hi, alive) leaves after each plane; integers are below 2**bits in size."""
    exact = np.float32 if anchors.shape[1] << bits < 1 << 24 else np.float64
    left, shifted, columns = anchors.astype(exact), rows + (1 << bits), np.arange(len(rows))
    above, below = np.maximum(anchors, 0).sum(1)[:, None], np.minimum(anchors, 0).sum(1)[:, None]
    known = np.repeat(-(anchors.sum(1) << bits)[:, None], len(rows), 1)
    for plane in range(bits, -1, -1):
        known += (left @ ((shifted >> plane) & 1).astype(exact).T).astype(np.int64) << plane
        rest = (1 << plane) - 1
        alive = judge(known + rest * below, known + rest * above, alive)
        stay = alive.any(0)
        if not stay.all():
            alive, known, shifted, columns = alive[:, stay], known[:, stay], shifted[stay], columns[stay]
        if plane and alive.sum() * 8 < alive.size:
            break
    a, c = np.nonzero(alive)
    score = known[a, c]
    for at in range(0, len(a), PAIRS if plane else max(len(a), 1)):  # few pairs are left: their lower planes one pair at a time
        some = slice(at, at + PAIRS)
        for low in range(plane - 1, -1, -1):
            score[some] += np.einsum("ij,ij->i", anchors[a[some]], (shifted[c[some]] >> low) & 1) << low
    return a, columns[c], score


def _best(group: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k first rows of each group: higher scores first, then smaller ids."""
    order = np.lexsort((ids, -score, group))
    g = group[order]
    first = np.searchsorted(g, g)
    return order[np.arange(len(g)) - first < k]


def _positives(dims: int, bits: int, k: int):
    def run(key, left, right):
        ids, labels, a = left.column("vec_id").to_numpy(), left.column("label").to_numpy(), _matrix(left.column("v"), dims)
        row_ids, row_labels, v = right.column("vec_id").to_numpy(), right.column("label").to_numpy(), _matrix(right.column("v"), dims)
        out = []
        for label in np.intersect1d(labels, row_labels):
            mine, theirs = np.flatnonzero(labels == label), np.flatnonzero(row_labels == label)
            least, held = np.full(len(mine), -FAR), [np.zeros((3, 0), np.int64)]

            def judge(lo, hi, alive, least=least):
                np.maximum(least, _kth(lo, alive, k), out=least)
                return alive & (hi >= least[:, None])

            for at in range(0, len(theirs), STEP):
                part = theirs[at : at + STEP]
                x, c, score = sliced_products(a[mine], v[part], bits, ids[mine][:, None] != row_ids[part], judge)
                held = [np.concatenate((held[0], np.stack((x, row_ids[part][c], score))), axis=1)]
                held = [held[0][:, _best(held[0][0], held[0][2], held[0][1], k)]]
            out.append(np.stack((ids[mine][held[0][0]], held[0][1], held[0][2])))
        got = np.concatenate(out, axis=1) if out else np.zeros((3, 0), np.int64)
        return pa.table({"anchor_id": got[0], "positive_id": got[1], "positive_score": got[2]})

    return run


def _negatives(dims: int, bits: int, k: int, share: tuple[int, int], most: int):
    def run(key, left, right):
        ids, labels, a = left.column("vec_id").to_numpy(), left.column("label").to_numpy(), _matrix(left.column("v"), dims)
        row_ids, row_labels, v = right.column("vec_id").to_numpy(), right.column("label").to_numpy(), _matrix(right.column("v"), dims)
        positives = np.full((len(ids), most, 2), FAR)
        lists = left.column("positives").to_pylist()
        low, high = np.full((most, len(ids)), FAR), np.full((most, len(ids)), -FAR)
        for i, some in enumerate(lists):
            for j, p in enumerate(some):
                positives[i, j] = p["positive_id"], p["positive_score"]
                low[j, i], high[j, i] = -(-share[0] * p["positive_score"] // 100), share[1] * p["positive_score"] // 100
        least, held = low.copy(), np.zeros((4, 0), np.int64)

        def judge(lo, hi, alive):
            some = np.zeros_like(alive)
            for j in range(most):
                sure = alive & (lo >= low[j][:, None]) & (hi <= high[j][:, None])
                if sure.any():
                    np.maximum(least[j], _kth(lo, sure, k), out=least[j])
                some |= (hi >= least[j][:, None]) & (lo <= high[j][:, None])
            return alive & some

        for at in range(0, len(row_ids), STEP):
            part = slice(at, at + STEP)
            x, c, score = sliced_products(a, v[part], bits, labels[:, None] != row_labels[part], judge)
            new = [held]
            for j in range(most):
                ok = (score >= low[j][x]) & (score <= high[j][x])
                new.append(np.stack((x[ok] * most + j, row_ids[part][c[ok]], score[ok], x[ok])))
            held = np.concatenate(new, axis=1)
            held = held[:, _best(held[0], held[2], held[1], k)]
        of = positives[held[3], held[0] % most]
        return pa.table({"anchor_id": ids[held[3]], "positive_id": of[:, 0], "positive_score": of[:, 1], "negative_id": held[1], "negative_score": held[2]})

    return run


def _ranked(rows: DataFrame, keys: list[str], name: str, k: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc(f"{name}_score"), f"{name}_id")
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def hard_negatives(
    vectors: DataFrame, is_anchor: str = "vec_id % 100 = 0", label: str = "label", id_col: str = "vec_id", vec_col: str = "embedding",
    scale: int = 256, n_positives: int = 5, n_negatives: int = 10, share: tuple[int, int] = (30, 90),
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): for the anchors and each of their n_positives best rows of
    the same label, the n_negatives best rows of another label whose score is between share[0] and share[1] percent of the positive's.

    `is_anchor` and `label` are SQL over the table. Scores are integer inner products of floor(scale * x), higher first, ties by smaller id.
    Rows with a null id, label or vector, or with a null or non-finite component, take no part. Of rows that repeat an id the one with the
    smallest label and then vector does. A shorter vector counts as followed by zeros; an empty one has scores of 0. An anchor without
    positives, or a positive without such rows, gives none, and so does an empty table. Scores that might not fit a long are an error.
    Other columns are ignored.

    Every anchor meets every row, so the work is anchors times rows; each block of anchors (ANCHOR_BYTES) is sent once to each block of rows
    (CANDIDATE_BYTES) and the other way round.
    """
    spark = vectors.sparkSession
    bounded_batches(spark)
    fine = F.forall(F.col(vec_col), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    whole = lambda x: F.floor(F.lit(float(scale)) * x.cast("double"))
    rows = vectors.filter(F.col(id_col).isNotNull() & F.col(vec_col).isNotNull()).filter(F.coalesce(fine, F.lit(False)))
    rows = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.expr(label).cast("long").alias("label"), F.coalesce(F.expr(is_anchor), F.lit(False)).alias("anchor"), F.transform(vec_col, whole).alias("v")).filter("label is not null")
    sizes = rows.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("dims"), F.max(F.array_max(F.transform("v", F.abs))).alias("size"), F.count_if("anchor").alias("anchors")).first()
    dims, bits = max(sizes["dims"] or 0, 1), max(int(sizes["size"] or 0), 1).bit_length()
    if dims << 2 * bits + 2 >= 1 << 62:
        raise ValueError("components are too large for scores of 64 bits")
    rows = rows.withColumn("v", F.col("v").cast("array<int>" if bits < 31 else "array<long>"))
    again = stored(rows.groupBy("vec_id").agg(F.count("*").alias("n")).filter("n > 1").select("vec_id"), "repeats")
    if again.count():
        first = rows.join(again, "vec_id", "left_semi").groupBy("vec_id").agg(F.min(F.struct("label", "v", "anchor")).alias("r")).select("vec_id", "r.label", "r.anchor", "r.v")
        rows = rows.join(light(again, "repeats"), "vec_id", "left_anti").unionByName(first)
    width = dims * (4 if bits < 31 else 8)
    n_rows = max(-(-sizes["n"] * width // CANDIDATE_BYTES), int(spark.conf.get("spark.sql.shuffle.partitions")))
    n_anchors = max(-(-sizes["anchors"] * width // ANCHOR_BYTES), 1)
    part = lambda n, salt: F.pmod(F.xxhash64("vec_id", F.lit(salt)), F.lit(n)).cast("int")
    rows = stored(rows.withColumn("row_block", part(n_rows, 1)), "vectors")
    to_all = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    there = rows.select("vec_id", "label", "v", "row_block", to_all(n_anchors).alias("anchor_block")).groupBy("anchor_block", "row_block")
    anchors = rows.filter("anchor").select("vec_id", "label", "v", part(n_anchors, 2).alias("anchor_block"))
    sent = anchors.withColumn("row_block", to_all(n_rows))
    found = sent.groupBy("anchor_block", "row_block").cogroup(there).applyInArrow(frugal_group(_positives(dims, bits, n_positives)), "anchor_id long, positive_id long, positive_score long")
    best = _ranked(found, ["anchor_id"], "positive", n_positives).groupBy("anchor_id").agg(F.collect_list(F.struct("positive_id", "positive_score")).alias("positives"))
    known = stored(anchors.join(best.withColumnRenamed("anchor_id", "vec_id"), "vec_id"), "anchors").withColumn("row_block", to_all(n_rows))
    schema = "anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long"
    found = known.groupBy("anchor_block", "row_block").cogroup(there).applyInArrow(frugal_group(_negatives(dims, bits, n_negatives, share, n_positives)), schema)
    return _ranked(found, ["anchor_id", "positive_id"], "negative", n_negatives).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
