"""The conversation trie against plain dictionaries, with many blocks, hot beginnings and repeated conversations."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from lexiflow.llm import conversation_trie as T

SCHEMA = "conv_id long, turn long, role string, text string, depth int, l string"


def mark(role, text):
    return hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()[:32]


def brute(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, mark(role or "", text or ""), (role or "", text or "")))
    own = {c: [t[-1] for t in sorted(v, key=lambda t: t[:3])] for c, v in own.items()}
    ends, members = defaultdict(list), defaultdict(list)
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (c % 100 if c >= 0 else -(-c % 100))
        made = own.get(base, [])[:h] + turns[h:]
        ends[tuple(made)].append(c)
        for d in range(len(made) + 1):
            members[tuple(made[:d])].append(c)
    children = defaultdict(int)
    for p in members:
        if p:
            children[p[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += p not in children
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1]) if p else 0
    digest = lambda ids: hashlib.sha256(",".join(map(str, sorted(ids))).encode()).hexdigest()
    return sorted((min(m), len(p), min(members[p[:-1]]) if p else -1, len(m), children[p], leaves[p], saved[p], digest(ends[p])) for p, m in members.items())


def run(spark, rows, parts=None):
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA).repartition(3)
    was = spark.conf.get("spark.sql.shuffle.partitions")
    adaptive = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    try:
        if parts:
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        found = T.conversation_trie(df)
        assert found.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
        return sorted(tuple(-1 if v is None else v for v in r) for r in found.collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", adaptive)


def talk(rng, ids, alphabet, longest):
    rows = []
    for c in ids:
        for t in range(rng.randrange(1, longest)):
            rows.append((c, t, rng.choice(["u", "a"]) if rng.random() < 0.1 else "ua"[t % 2], rng.choice(alphabet)))
    return rows


@pytest.mark.parametrize(("seed", "parts"), [(1, 1), (1, 4), (2, 4), (3, 4), (3, 23)])
def test_nodes_equal_plain_dictionaries(spark, seed, parts):
    rng = random.Random(seed)
    rows = talk(rng, range(-130, 180) if seed > 1 else range(60), ["a", "bb", "ccc", "é😀"][: seed + 1], 9)
    if seed == 3:
        hot = [("u", "hello"), ("a", "there"), ("u", "")]
        rows += [(c, t, *hot[t % 3]) for c in range(1000, 1150) for t in range(5)] + [(c, t, *hot[t]) for c in range(1200, 1260) for t in range(3)]
        rows += [(2000, None, None, None), (2000, None, "z", "x"), (2000, 0, "z", "x"), (2000, 0, "z", "x"), (2001, 7, None, "late"), (2001, -2, "b", None), (None, 1, "u", "x"), (3105, 0, "u", "alone"), (3104, 0, "u", "alone")]
        rows += [(2**40, t, "u", "y" * 5000) for t in range(300)]
    assert run(spark, rows, parts) == brute(rows)


@pytest.mark.parametrize("parts", [1, 7])
def test_one_conversation_repeated_by_all(spark, parts):
    rows = [(c, t, "u", str(t)) for c in range(400, 640) for t in range(4)]
    assert run(spark, rows, parts) == brute(rows)


def test_small_and_empty(spark):
    assert run(spark, []) == [] and run(spark, [(None, 1, "u", "x")]) == []
    for rows in ([(5, 1, None, None)], [(1, 0, "u", "x")], [(c, 0, "u", "x") for c in (1, 2, 3)]):
        assert run(spark, rows) == brute(rows)


def test_blocks_find_their_neighbours():
    rng = np.random.default_rng(6)
    least, conv = rng.integers(0, 5, 50), rng.integers(0, 1000, 50)
    blocks = T.Blocks(least, conv, np.ones(50, int), np.ones(50, int))
    for b in range(50):
        lo, hi = blocks.around(np.array([b]), np.array([3]))
        assert lo[0] == max((i for i in range(b) if least[i] < 3), default=-1) and hi[0] == min((i for i in range(b + 1, 50) if least[i] < 3), default=50)
        for z in range(b, 51):
            assert blocks.least_conv(b, z) == (conv[b:z].min() if z > b else T.FAR)
