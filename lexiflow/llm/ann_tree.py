"""Approximate nearest neighbours by a hierarchical k-means tree with best-bin-first search.

The tree is fitted in two steps, so that it grows with the table: its upper part on a bounded sample of all vectors, the part below
each of its leaves by a task, on a bounded sample of that leaf's vectors. Every vector is indexed. Equal vectors are indexed once, with
their smallest ids, as many as any query can need. A query walks the tree best bin first, by the inner product with the centroids, and
visits leaves until it has seen enough vectors. How many that is comes from a calibration: for a bounded sample of queries, all vectors are
searched by brute force, and the number is widened until the leaves visited hold the aimed share of them.

How early the walk comes to a leaf is one number (its key), so what a query visits is known from its least key. Vectors lie in stored blocks
of neighbouring leaves, queries in blocks of their own; each block of queries meets each block of vectors, and a query is multiplied with the
leaves it visits only. So a query is shuffled once, whatever the number of leaves it visits.
"""

from __future__ import annotations

import io

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, frugal, frugal_group, light, stored, whole

SAMPLE, LEAF_SAMPLE = 20_000, 4_096
CALIBRATION = 64
BRANCH = 8
#: Vectors of a leaf that is small enough. UPPER and LOWER bound the leaves of the upper part and of what is grown below each of them.
LEAF, UPPER, LOWER = 64, 512, 128
#: Bytes of the centroids that are sent to all tasks, and of the sample that the driver holds: wider vectors get fewer leaves and rows.
TREE_BYTES, SAMPLE_BYTES = 64 << 20, 64 << 20
#: Bytes of the vectors of a block, and rows of a block of queries: at most QUERY_ROWS, and so many more blocks that they hold LEAST_ROWS.
BLOCK_BYTES, QUERY_ROWS, LEAST_ROWS = 4 << 20, 1 << 14, 1 << 11
#: Parts of the index that a block of queries meets in tasks of their own; each gives out the best of every query.
PARTS = 4
#: Pairs of a query (in the mean) and of all that a task holds before it keeps the best of them, and numbers that it makes at once.
HELD_EACH, HELD_ROWS, NUMBERS = 64, 1 << 20, 1 << 22


def _nearest(rows: np.ndarray, centers: np.ndarray) -> np.ndarray:
    return np.argmin((centers**2).sum(axis=1) - 2 * (rows @ centers.T), axis=1)


class KMeansTree:
    """Nodes as arrays: the children of node i are first[i] .. first[i] + many[i]; a leaf has none and a number in leaf_of."""

    def __init__(self, sample: np.ndarray, leaf_rows: int, seed: int = 7):
        rng, centers, self.first, self.many, at = np.random.default_rng(seed), [np.zeros(sample.shape[1])], [0], [0], 0
        rows = [sample]
        while at < len(rows):  # breadth first, so that children stand together
            groups = self._split(rows[at], rng) if len(rows[at]) > leaf_rows else []
            if len(groups) > 1:
                self.first[at], self.many[at] = len(rows), len(groups)
                for center, part in groups:
                    centers.append(center)
                    rows.append(part)
                    self.first.append(0)
                    self.many.append(0)
            rows[at], at = rows[at][:0], at + 1
        self.matrix, self.first, self.many = np.array(centers, np.float32), np.array(self.first), np.array(self.many)
        self._number()

    def _number(self) -> None:
        self.leaf_of = np.where(self.many == 0, np.cumsum(self.many == 0) - 1, -1)
        self.leaves = int((self.many == 0).sum())
        self.node_of, self.parent = np.flatnonzero(self.many == 0), np.zeros(len(self.many), np.int64)
        inner = np.flatnonzero(self.many)
        self.parent[self._kids(inner)] = np.repeat(inner, self.many[inner])

    def _kids(self, nodes: np.ndarray) -> np.ndarray:
        many = self.many[nodes]
        return np.repeat(self.first[nodes] - (np.cumsum(many) - many), many) + np.arange(many.sum())

    @staticmethod
    def _split(rows: np.ndarray, rng) -> list[tuple[np.ndarray, np.ndarray]]:
        centers = rows[rng.choice(len(rows), min(BRANCH, len(rows)), replace=False)]
        for _ in range(8):
            near = _nearest(rows, centers)
            centers = np.array([rows[near == k].mean(axis=0) if (near == k).any() else centers[k] for k in range(len(centers))])
        near = _nearest(rows, centers)
        return [(centers[k], rows[near == k]) for k in range(len(centers)) if (near == k).any()]

    def grafted(self, below: dict[int, KMeansTree]) -> KMeansTree:
        """This tree with others in the place of its leaves (by number); their roots' centroids are those of the leaves."""
        out = object.__new__(KMeansTree)
        matrix, first, many, n = [self.matrix], [self.first.copy()], [self.many.copy()], len(self.many)
        node_of = np.flatnonzero(self.many == 0)
        for leaf, tree in sorted(below.items()):
            if tree.many[0]:
                first[0][node_of[leaf]], many[0][node_of[leaf]] = n, tree.many[0]
                matrix.append(tree.matrix[1:])
                first.append(tree.first[1:] - 1 + n)
                many.append(tree.many[1:])
                n += len(tree.many) - 1
        out.matrix, out.first, out.many = np.concatenate(matrix), np.concatenate(first), np.concatenate(many)
        out._number()
        return out

    def dump(self) -> bytes:
        held = io.BytesIO()
        np.savez(held, matrix=self.matrix, first=self.first, many=self.many)
        return held.getvalue()

    @classmethod
    def load(cls, data: bytes) -> KMeansTree:
        out, held = object.__new__(cls), np.load(io.BytesIO(data))
        out.matrix, out.first, out.many = held["matrix"], held["first"], held["many"]
        out._number()
        return out

    def assign(self, rows: np.ndarray) -> np.ndarray:
        """Leaf of each row, by descent to the nearest centroid."""
        out, todo = np.zeros(len(rows), np.int64), [(0, np.arange(len(rows)))]
        while todo:
            node, at = todo.pop()
            if not self.many[node]:
                out[at] = self.leaf_of[node]
                continue
            kids = np.arange(self.first[node], self.first[node] + self.many[node])
            near = _nearest(rows[at], self.matrix[kids])
            todo += [(kid, at[near == k]) for k, kid in enumerate(kids.tolist()) if (near == k).any()]
        return out

    def keys(self, rows: np.ndarray, leaves: np.ndarray | None = None) -> np.ndarray:
        """(leaves, rows): how early a best-first walk for each row comes to these leaves (all), larger is earlier: the least inner product
        with the centroid of a branch on the way that is not its node's best."""
        wanted = self.node_of if leaves is None else self.node_of[leaves]
        inner, up = np.zeros(len(self.many), bool), wanted
        while len(up := np.unique(self.parent[up[up > 0]])):
            inner[up] = True
        place = np.full(len(self.many), -1)
        place[wanted] = np.arange(len(wanted))
        out, at, key = np.full((len(wanted), len(rows)), np.inf, np.float32), np.zeros(1, np.int64), np.full((1, len(rows)), np.inf, np.float32)
        while inner[at].any():
            at, key = at[inner[at]], key[inner[at]]
            kids, many = self._kids(at), self.many[at]
            dots = (self.matrix[kids].astype(np.float64) @ rows.T.astype(np.float64)).astype(np.float32)
            best, above = np.maximum.reduceat(dots, np.cumsum(many) - many, axis=0), np.repeat(key, many, axis=0)
            at, key = kids, np.where(dots == np.repeat(best, many, axis=0), above, np.minimum(above, dots))
            mine = place[kids] >= 0
            out[place[kids[mine]]] = key[mine]
        return out

    def least_keys(self, rows: np.ndarray, sizes: np.ndarray, enough: float) -> np.ndarray:
        """For each row the least key of the leaves it must visit to see `enough` indexed vectors; it visits all leaves of that key."""
        out, step = [np.zeros(0, np.float32)], max(1, NUMBERS // len(self.many))
        for a in range(0, len(rows), step):
            key = np.ascontiguousarray(self.keys(rows[a : a + step]).T)
            order = np.argsort(-key, axis=1)
            last = np.minimum((np.cumsum(sizes[order], axis=1) < enough).sum(axis=1), key.shape[1] - 1)
            out.append(key[np.arange(len(key)), order[np.arange(len(key)), last]])
        return np.concatenate(out)

    def visit(self, query: np.ndarray, sizes: np.ndarray, enough: float) -> list[int]:
        """Leaves in best-bin-first order until `enough` indexed vectors have been seen; of equal keys all."""
        key = self.keys(query[None])[:, 0]
        order = np.argsort(-key, kind="stable")
        return order[key[order] >= self.least_keys(query[None], sizes, enough)[0]].tolist()


def exact_scores(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Inner products of row pairs in double precision, the same for equal rows wherever they stand."""
    return (queries.astype(np.float64) * rows).sum(axis=1)


def _matrix(column) -> np.ndarray:
    """Vectors of equal length without nulls, one a row, in their own precision."""
    column = whole(column)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)


def _vectors(rows: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * rows.shape[1], pa.int32()), pa.array(rows.reshape(-1)))


def _assign(tree):
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                leaf = tree.value.assign(_matrix(batch.column("vector")))
                yield pa.record_batch([pa.array(leaf)], names=["leaf"])

    return run


def _sizes(groups: DataFrame, tree, leaves: int) -> np.ndarray:
    """How many vectors each leaf has."""
    sizes = np.zeros(leaves)
    for row in groups.select("vector").mapInArrow(frugal(_assign(tree)), "leaf long").groupBy("leaf").count().collect():  # one row a leaf
        sizes[row["leaf"]] = row["count"]
    return sizes


def _taken(tree, sizes):
    """Vectors of the large leaves with their leaf and its size; where there are more than LEAF_SAMPLE, those with small hashes, a few too many."""
    share = np.minimum(1.0, (LEAF_SAMPLE + 8 * LEAF_SAMPLE**0.5) / np.maximum(sizes, 1)) * (sizes > 2 * LEAF)

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                leaf = tree.value.assign(_matrix(batch.column("vector")))
                at = batch.column("hash").to_numpy() / 2.0**64 + 0.5
                some = pa.array(np.flatnonzero((at <= share[leaf]) & (share[leaf] > 0)))
                out = batch.take(some)
                leaf = leaf[some.to_numpy()]
                yield pa.record_batch([pa.array(leaf), pa.array(sizes[leaf].astype(np.int64)), *(out.column(c) for c in ("hash", "group_id", "vector"))], names=["leaf", "size", "hash", "group_id", "vector"])

    return run


def bounds(dims: int) -> tuple[int, int, int]:
    """(rows of the sample, leaves of the upper part, leaves grown below each) for vectors of this many dimensions."""
    nodes = TREE_BYTES // (4 * dims)
    upper = max(BRANCH, min(UPPER, nodes // BRANCH))
    return max(2 * LEAF, min(SAMPLE, SAMPLE_BYTES // (8 * dims))), upper, max(1, min(LOWER, nodes // (2 * upper)))


def _fit_below(key, table):
    """What is grown below one leaf: leaves of about LEAF vectors, in number bounded by the share of the sample and of the bytes."""
    rows, size = _matrix(table.column("vector")), table.column("size")[0].as_py()
    tree = KMeansTree(rows, max(LEAF * len(rows) / size, 2 * len(rows) / bounds(rows.shape[1])[2], 1))
    return pa.table({"leaf": pa.array([key[0].as_py()], pa.int64()), "data": pa.array([tree.dump()], pa.binary())})


def _blocks(sizes: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """(first block, blocks) of each leaf, for blocks of about `rows` vectors: neighbouring leaves share one, a larger leaf is cut into several."""
    many = np.maximum(1, np.ceil(sizes / rows)).astype(np.int64)
    load = np.where(many > 1, rows, sizes)  # a leaf of several blocks shares none
    first, block, held = np.zeros(len(sizes), np.int64), 0, 0.0
    for leaf, n in enumerate(load.tolist()):
        if held and (held + n > rows or many[leaf] > 1):
            block, held = block + 1, 0.0
        first[leaf], held = block, held + n
        if many[leaf] > 1:
            block, held = block + int(many[leaf]), 0.0
    return first, many


def _place(tree, first: np.ndarray, many: np.ndarray):
    """(block, leaf, group_id, vector) of all vectors."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                leaf = tree.value.assign(_matrix(batch.column("vector")))
                block = first[leaf] + batch.column("hash").to_numpy() % many[leaf]
                yield pa.record_batch([pa.array(block), pa.array(leaf), batch.column("group_id"), batch.column("vector")], names=["block", "leaf", "group_id", "vector"])

    return run


BLOCK = "leaves binary, ids binary, matrix binary"


def _pack_block(key, table):
    """Vectors of one block as one row, in the order of their leaves: the leaf of each, ids and a matrix."""
    leaf = table.column("leaf").to_numpy()
    by = np.argsort(leaf, kind="stable")
    return pa.table({"leaves": pa.array([leaf[by].tobytes()], pa.binary()), "ids": pa.array([table.column("group_id").to_numpy()[by].tobytes()], pa.binary()), "matrix": pa.array([_matrix(table.column("vector"))[by].tobytes()], pa.binary())})


def _least(tree, sizes, enough: float):
    """Queries with the least key of what they visit."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                least = tree.value.least_keys(_matrix(batch.column("vector")), sizes, enough)
                yield pa.record_batch([batch.column("query_id"), batch.column("vector"), pa.array(least)], names=["query_id", "vector", "least"])

    return run


def _pack_queries(most: int):
    """Queries of a partition as rows of at most `most` each, in the order of their ids."""

    def run(batches):
        if not (batches := [b for b in batches if b.num_rows]):
            return
        table = pa.Table.from_batches(batches).sort_by("query_id")
        for a in range(0, table.num_rows, most):
            part = table.slice(a, most)
            parts = part.column("query_id").to_numpy(), _matrix(part.column("vector")), part.column("least").to_numpy()
            yield pa.record_batch([pa.array([x.tobytes()], pa.binary()) for x in parts], names=["q_ids", "q_matrix", "least"])

    return run


def _top(rows: list[np.ndarray], k: int) -> list[np.ndarray]:
    """Of (query, vector, score) columns the k best of each query; ties to the smaller vector."""
    by = np.lexsort((rows[1], -rows[2], rows[0]))
    query = rows[0][by]
    new = np.ones(len(by), bool)
    new[1:] = query[1:] != query[:-1]
    begin = np.flatnonzero(new)
    place = np.arange(len(by)) - np.repeat(begin, np.diff(np.append(begin, len(by))))
    return [x[by[place < k]] for x in rows]


def _norms(rows: np.ndarray) -> np.ndarray:
    return np.sqrt(np.square(rows, dtype=np.float64).sum(axis=1))


def _meet(q: np.ndarray, v: np.ndarray, floor: np.ndarray, unit: float, room: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the pairs whose exact score may reach the query's floor: products in the precision of q, with room for its rounding."""
    least = floor - room - np.abs(np.where(np.isfinite(floor), floor, 0)) * unit
    return np.divmod(np.flatnonzero(q @ v.T >= least.astype(q.dtype)[:, None]), len(v))


def _score(k: int, kind: str, tree):
    """The k + 1 best vectors of each query among those of the leaves it visits. A task raises each query's floor to the least of its best so far."""

    def run(batches):
        held, n, floors = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)], 0, {}
        fresh: list[list[np.ndarray]] = []

        def keep():
            nonlocal held, n
            held = _top([np.concatenate(x) for x in zip(held, *fresh, strict=True)], k + 1)
            fresh.clear()
            n, last = 0, np.flatnonzero(np.append(held[0][1:] != held[0][:-1], True)) if len(held[0]) else np.zeros(0, np.int64)
            full = last[np.diff(last, prepend=-1) == k + 1]
            for ids, floor, _ in floors.values():
                at = np.searchsorted(ids, held[0][full])
                mine = (at < len(ids)) & (ids[np.minimum(at, len(ids) - 1)] == held[0][full])
                floor[at[mine]] = held[2][full][mine]

        for batch in batches:
            for one in batch.to_pylist():
                qi, vi, leaf = (np.frombuffer(one[c], np.int64) for c in ("q_ids", "ids", "leaves"))
                q, v = np.frombuffer(one["q_matrix"], kind).reshape(len(qi), -1), np.frombuffer(one["matrix"], kind).reshape(len(vi), -1)
                _, floor, size = floors.setdefault(int(qi[0]), (qi, np.full(len(qi), -np.inf), _norms(q)))
                # Single precision tells most pairs apart, unless its range may be left.
                size, narrow = size * (most := _norms(v).max()), kind == "f4" and size.max() * most < 1e37
                unit, tiny = (1.2e-7, 1e-37) if narrow else (2.3e-16, 1e-300)
                room, (fast, other) = (q.shape[1] + 16) * (size * unit + tiny), (x if narrow else x.astype(np.float64) for x in (q, v))
                enough = min(HELD_ROWS, HELD_EACH * len(q))
                some, begin = np.unique(leaf, return_index=True)
                visits = np.concatenate([tree.value.keys(q[a : a + 2048], some) for a in range(0, len(q), 2048)], axis=1) >= np.frombuffer(one["least"], np.float32)
                for rows, a, b in zip(visits, begin.tolist(), np.append(begin[1:], len(leaf)).tolist(), strict=True):
                    rows = np.flatnonzero(rows)
                    if not len(rows):
                        continue
                    step = max(1, NUMBERS // len(rows))
                    for c in range(a, b, step):
                        x, y = _meet(fast[rows], other[c : min(b, c + step)], floor[rows], unit, room[rows])
                        for d in range(0, len(x), max(1, NUMBERS // q.shape[1])):
                            i, j = rows[x[d : d + max(1, NUMBERS // q.shape[1])]], c + y[d : d + max(1, NUMBERS // q.shape[1])]
                            fresh.append([qi[i], vi[j], exact_scores(q[i], v[j])])
                            n += len(i)
                            if n > enough:
                                keep()
        if fresh:
            keep()
        yield pa.record_batch([pa.array(x) for x in held], names=["query_id", "group_id", "score"])

    return run


def _brute(queries, k: int, kind: str):
    """Per task: for each calibration query the leaves of its k best among the task's vectors (a running merge, so memory is bounded)."""

    def run(batches):
        q_ids, q = queries.value
        best, leaves = np.full((len(q), k), -np.inf), np.full((len(q), k), -1)
        for batch in batches:
            for one in batch.to_pylist():
                ids, leaf = np.frombuffer(one["ids"], np.int64), np.frombuffer(one["leaves"], np.int64)
                score = q @ np.frombuffer(one["matrix"], kind).reshape(len(ids), -1).astype(np.float64).T
                score[np.equal.outer(q_ids, ids)] = -np.inf
                score, here = np.concatenate((best, score), axis=1), np.concatenate((leaves, np.broadcast_to(leaf, score.shape)), axis=1)
                top = np.argsort(-score, axis=1, kind="stable")[:, :k]
                best, leaves = np.take_along_axis(score, top, 1), np.take_along_axis(here, top, 1)
        a, b = np.nonzero(best > -np.inf)
        yield pa.record_batch([pa.array(q_ids[a]), pa.array(best[a, b]), pa.array(leaves[a, b])], names=["query_id", "score", "leaf"])

    return run


def grow_tree(groups: DataFrame, kind: str, dims: int) -> KMeansTree:
    """A tree over all vectors of groups (group_id, vector): the upper part here, from a sample of at most SAMPLE, what stands below its leaves by
    tasks, from at most LEAF_SAMPLE vectors of each. Trees are grafted while the centroids fit into TREE_BYTES; a leaf without one stays whole."""
    spark = groups.sparkSession
    most, wide, _ = bounds(dims)
    hashed = groups.select("group_id", "vector", F.xxhash64("group_id").alias("hash"))
    # Only hashes that can be among the smallest are ordered.
    share = (most + 8 * most**0.5 + 64) / max(groups.count(), 1)
    small = hashed if share >= 1 else hashed.filter(F.col("hash") <= int((share - 0.5) * 2.0**64))
    sample = small.orderBy("hash", "group_id").limit(most).select("vector").toArrow()  # at most SAMPLE rows and SAMPLE_BYTES
    rows = _matrix(sample.column("vector"))
    upper = KMeansTree(rows, max(LEAF, 2 * len(rows) / wide))
    sent = spark.sparkContext.broadcast(upper)
    sizes = _sizes(groups, sent, upper.leaves)
    order = F.row_number().over(Window.partitionBy("leaf").orderBy("hash", "group_id"))
    taken = hashed.mapInArrow(frugal(_taken(sent, sizes)), f"leaf long, size long, hash long, group_id long, vector array<{kind}>")
    below = taken.withColumn("r", order).filter(F.col("r") <= LEAF_SAMPLE).select("leaf", "size", "vector").groupBy("leaf").applyInArrow(frugal_group(_fit_below), "leaf long, data binary").collect()  # a tree a leaf
    trees, room = {}, TREE_BYTES - upper.matrix.nbytes
    for r in sorted(below, key=lambda r: r["leaf"]):
        tree = KMeansTree.load(r["data"])
        if (room := room - tree.matrix.nbytes) < 0:
            break
        trees[r["leaf"]] = tree
    return upper.grafted(trees)


def nearest_neighbours(vectors: DataFrame, k: int = 20, every: int = 20, recall: float = 0.95, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """For every vector whose id is divisible by `every`: its k nearest others found (query_id, rank from 1, vec_id, score), by the largest
    inner product, ties to the smaller id.

    Vectors that are null, zero, of another length than most (the longest of equally frequent lengths), or hold null or
    non-finite components take no part, nor do null ids; an id that is repeated counts once, with its smallest vector. Bounds: the tree is fitted on at
    most SAMPLE vectors and LEAF_SAMPLE of each upper leaf, and calibrated on at most CALIBRATION queries; every vector is indexed. An
    empty table gives no rows; other columns are ignored.

    The centroids that all tasks hold take at most TREE_BYTES, whatever the dimensions. How much of the table each query sees follows from
    the calibration alone: where vectors lie so evenly that half of them must be seen for the aimed recall, the work is half of
    queries times vectors. A lower `recall` makes it less.
    """
    spark = vectors.sparkSession
    bounded_batches(spark)
    vec = F.col(vector_col)
    kind = "float" if vectors.schema[vector_col].dataType.simpleString() == "array<float>" else "double"
    sound = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf"))) & F.exists(vec, lambda x: x != 0)
    usable = vectors.filter(F.col(id_col).isNotNull() & vec.isNotNull()).filter(sound).select(F.col(id_col).cast("long").alias("vec_id"), vec.cast(f"array<{kind}>").alias("vector"))
    lengths = usable.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    if lengths is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    usable = usable.filter(F.size("vector") == lengths["n"])
    again = stored(usable.groupBy("vec_id").agg(F.count("*").alias("n")).filter("n > 1").select("vec_id"), "repeats")
    if again.count():
        first = stored(usable.join(again, "vec_id", "left_semi").groupBy("vec_id").agg(F.min("vector").alias("vector")), "firsts")
        usable = usable.join(light(again, "repeats"), "vec_id", "left_anti").unionByName(first)
    # Only ids and hashes of all vectors are shuffled to find those that may be equal. Of equal vectors, a query can return k, or k + 1 when
    # one of them is the query itself.
    usable = usable.withColumn("print", F.xxhash64("vector"))
    prints = stored(usable.groupBy("print").agg(F.count("*").alias("n")).filter("n > 1").select("print"), "prints")
    groups, copies = usable.select(F.col("vec_id").alias("group_id"), "vector"), None
    if prints.count():
        prints, alike = light(prints, "prints"), Window.partitionBy("print", "vector").orderBy("vec_id")
        members = usable.join(prints, "print", "left_semi").withColumn("r", F.row_number().over(alike)).filter(F.col("r") <= k + 1).withColumn("group_id", F.first("vec_id").over(alike))
        members = stored(members.select("group_id", "vec_id", "r", F.when(F.col("r") == 1, F.col("vector")).alias("vector")), "members")
        groups = usable.join(prints, "print", "left_anti").select(F.col("vec_id").alias("group_id"), "vector").unionByName(members.filter("r = 1").select("group_id", "vector"))
        copies = members.filter("r > 1").select("group_id", "vec_id")
    tree = grow_tree(groups, kind, lengths["n"])
    sent, letter = spark.sparkContext.broadcast(tree), "f4" if kind == "float" else "f8"
    sizes = _sizes(groups, sent, tree.leaves)
    first, many = _blocks(sizes, max(1, BLOCK_BYTES // (lengths["n"] * int(letter[1]))))
    placed = groups.withColumn("hash", F.xxhash64("group_id")).mapInArrow(frugal(_place(sent, first, many)), f"block long, leaf long, group_id long, vector array<{kind}>")
    indexed = stored(placed.groupBy("block").applyInArrow(frugal_group(_pack_block), BLOCK), "blocks")
    queries = usable.filter(F.pmod("vec_id", F.lit(every)) == 0).select(F.col("vec_id").alias("query_id"), "vector")
    enough = _calibrated(tree, sizes, indexed, queries, k, recall, letter)
    near = _candidates(indexed, queries, sent, sizes, enough, k, lengths["n"], letter)
    found = near.withColumnRenamed("group_id", "vec_id")
    if copies is not None:
        found = found.unionByName(near.join(copies, "group_id").select("query_id", "vec_id", "score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.filter("vec_id != query_id").withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _candidates(indexed: DataFrame, queries: DataFrame, tree, sizes: np.ndarray, enough: float, k: int, dims: int, kind: str) -> DataFrame:
    """(query_id, group_id, score): each query's k + 1 best distinct vectors (one may be its own) among those it visits, stored."""
    spark = queries.sparkSession
    n, most = queries.count(), max(1, min(QUERY_ROWS, BLOCK_BYTES // (dims * int(kind[1])), HELD_ROWS // (2 * k + 2)))
    parts = max(-(-n // most), min(n // LEAST_ROWS, int(spark.conf.get("spark.sql.shuffle.partitions"))), 1)
    asked = queries.mapInArrow(frugal(_least(tree, sizes, enough)), f"query_id long, vector array<{'float' if kind == 'f4' else 'double'}>, least float").repartition(parts)
    asked = asked.mapInArrow(frugal(_pack_queries(most)), "q_ids binary, q_matrix binary, least binary")
    # A broadcast would send all queries through the driver; so each part of the index meets each part of the queries.
    met = indexed.coalesce(PARTS).hint("shuffle_replicate_nl").crossJoin(asked)
    scored = met.mapInArrow(frugal(_score(k, kind, tree)), "query_id long, group_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "group_id"))
    return stored(scored.withColumn("r", rank).filter(F.col("r") <= k + 1).drop("r"), "near")


def _calibrated(tree: KMeansTree, sizes: np.ndarray, indexed: DataFrame, queries: DataFrame, k: int, recall: float, kind: str) -> float:
    """How many vectors a query must see so that a sample of queries finds the share `recall` of its true neighbours: widened leaf by leaf."""
    trial = queries.orderBy(F.xxhash64("query_id"), "query_id").limit(CALIBRATION).toArrow()  # at most CALIBRATION rows
    total, enough = float(sizes.sum()), 4.0 * k
    if not trial.num_rows:
        return enough
    ids, rows = trial.column("query_id").to_numpy(), _matrix(trial.column("vector")).astype(np.float64)
    sent = queries.sparkSession.sparkContext.broadcast((ids, rows))
    best = indexed.mapInArrow(frugal(_brute(sent, k, kind)), "query_id long, score double, leaf long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "leaf"))
    truth: dict[int, list[int]] = {}
    for r in best.withColumn("r", rank).filter(F.col("r") <= k).collect():  # at most CALIBRATION * k rows
        truth.setdefault(r["query_id"], []).append(r["leaf"])
    need, shares = [], []  # vectors seen before a true neighbour's leaf, and its share of its query's result
    for q, row in zip(ids.tolist(), rows, strict=True):
        key = tree.keys(row[None])[:, 0]
        order = np.argsort(-key, kind="stable")
        before = np.append(0.0, np.cumsum(sizes[order]))[np.searchsorted(-key[order], -key[order])]  # by leaves of larger keys
        seen = dict(zip(order.tolist(), before.tolist(), strict=True))
        need += [seen[leaf] for leaf in truth.get(q, [])]
        shares += [1 / len(truth[q])] * len(truth.get(q, []))
    while enough < total and sum(s for n, s in zip(need, shares, strict=True) if n < enough) < recall * len(truth):
        enough = min(total, enough * 1.05)
    return enough
