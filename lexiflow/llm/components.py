"""Connected components of a link table: union-find in partitions, and alternating star contraction between them while links are many."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, frugal, stored

LINKS = "node long, other long"
#: Links that one task joins in the end; more are contracted first, by all tasks.
LOCAL_LINKS = 500_000


def union_find(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All ids of the links a - b, and the smallest id reachable from each. Roots are hooked to smaller ones and paths halved, for all links at once."""
    ids, place = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y, root = place[: len(a)], place[len(a) :], np.arange(len(ids))
    while True:
        u, v = root[x], root[y]
        apart = u != v
        if not apart.any():
            return ids, ids[root]
        x, y, u, v = x[apart], y[apart], u[apart], v[apart]
        np.minimum.at(root, np.maximum(u, v), np.minimum(u, v))
        while (root[root] != root).any():
            root = root[root]


def _local(batches, roots: bool):
    """The links of one partition as a star around the smallest id of each tree, with or without rows of the roots themselves."""
    parts = [(batch.column(0).to_numpy(), batch.column(1).to_numpy()) for batch in batches]
    if parts:
        ids, root = union_find(*(np.concatenate(x) for x in zip(*parts, strict=True)))
        if not roots:
            ids, root = ids[ids != root], root[ids != root]
        for i in range(0, len(ids), 100_000):
            yield pa.record_batch([pa.array(ids[i : i + 100_000]), pa.array(root[i : i + 100_000])], names=["node", "other"])


def _local_forest(batches):
    return _local(batches, False)


def _local_components(batches):
    return _local(batches, True)


def _least(links: DataFrame) -> DataFrame:
    """The smallest smaller neighbour of each node. It is stored, so that a join with it has an exchange of its own on either side, which
    Spark can split where a hub's links make one partition large."""
    return stored(links.groupBy("node").agg(F.min("other").alias("m")), "least")


def _large_star(links: DataFrame) -> DataFrame:
    """Each node's larger neighbours move to the smallest id among it and its neighbours (links have node > other)."""
    least = _least(links)
    hubs = least.withColumnRenamed("node", "other")
    out = stored(links.join(hubs, "other", "left").select("node", F.coalesce("m", "other").alias("other")).distinct(), "links")
    forget(links, least)
    return out


def _small_star(links: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours move to the smallest of them."""
    least = _least(links)
    moved = links.join(least, "node").select(F.col("other").alias("node"), F.col("m").alias("other")).filter("node != other")
    out = stored(moved.union(least.select("node", F.col("m").alias("other"))).distinct(), "links")
    forget(links, least)
    return out


def connected_components(links: DataFrame) -> DataFrame:
    """(node, component) for every id that occurs in links (node, other); component is the smallest id reachable.

    Links may repeat, point either way or to themselves; none gives no rows. Up to LOCAL_LINKS stars are joined in one task; more are
    contracted in rounds until they are so few or stay as they are. Work is proportional to the links in each of the logarithmically many rounds; hubs are reduced by partial minima, their links are joined in partitions that Spark can split, nothing is
    collected.
    """
    ordered = links.select(F.greatest("node", "other").alias("node"), F.least("node", "other").alias("other")).filter("node != other")
    now = stored(ordered.mapInArrow(frugal(_local_forest), LINKS), "links")
    print_of = lambda df: tuple(df.agg(F.count("*"), F.sum(F.xxhash64("node", "other").cast("decimal(38,0)"))).first())
    before = print_of(now)
    while before[0] > LOCAL_LINKS:
        now = _small_star(_large_star(now))
        after = print_of(now)
        if after == before:
            break
        before = after
    else:
        return now.coalesce(1).mapInArrow(frugal(_local_components), LINKS).withColumnRenamed("other", "component")  # LOCAL_LINKS at most
    return now.select("node", F.col("other").alias("component")).union(now.select(F.col("other"), F.col("other")).distinct())
