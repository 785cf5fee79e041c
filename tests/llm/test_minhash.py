import random

import pytest

from lexiflow.llm import components, minhash
from lexiflow.llm.components import connected_components
from lexiflow.llm.minhash import bands_for, near_duplicates, superminhash


def brute(rows, size, percent):
    sets, root = {}, {}
    for d, t in rows:
        w = "".join(c.lower() if c.isascii() else c for c in t or "").encode().split()
        sets[d] = {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()
        root[d] = d

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d), find(d) == d) for d in ids}


def run(spark, rows, size, percent):
    df = spark.createDataFrame([(d, t, "x", 0) for d, t in rows], "doc_id long, text string, bands string, n_shingles int").repartition(3)
    return {r[0]: tuple(r[1:]) for r in near_duplicates(df, size, percent).collect()}


def family(rng, n, words, edits):
    base = [f"w{rng.randrange(10**6)}" for _ in range(words)]
    for _ in range(n):
        copy = list(base)
        for _ in range(rng.randrange(edits + 1)):
            copy[rng.randrange(words)] = f"e{rng.randrange(10**6)}"
        yield " ".join(copy)


def test_groups_equal_brute_force(spark):
    rng = random.Random(5)
    texts = [*family(rng, 60, 80, 6), *family(rng, 40, 30, 3), *family(rng, 20, 5, 1), *["the same text here now"] * 5, "one", "ONE", "", None, "a b", " A\tb "]
    rng.shuffle(texts)
    rows = [(7 * i + 3, t) for i, t in enumerate(texts)]
    for size, percent in ((3, 85), (5, 80)):
        assert run(spark, rows, size, percent) == brute(rows, size, percent)


def test_small_blocks_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(minhash, "FAMILY_MB", 0.01)
    monkeypatch.setattr(minhash, "REST_MB", 0.005)
    rng = random.Random(6)
    rows = list(enumerate([*family(rng, 90, 60, 5), *family(rng, 30, 100, 9)]))
    assert run(spark, rows, 3, 85) == brute(rows, 3, 85)


def test_empty_table_and_null_id(spark):
    assert run(spark, [], 3, 85) == {}
    assert run(spark, [(None, "a b c d"), (2, "a b c d")], 3, 85) == {None: (2, None, True), 2: (2, 2, True)}


def test_bands_follow_the_threshold():
    for percent in (80, 85):
        assert (1 - (percent / 100) ** 4) ** bands_for(percent) < 1e-7
    with pytest.raises(ValueError):
        bands_for(10)


def test_low_similarities_have_many_slots(spark):
    rng = random.Random(11)
    rows = list(enumerate(family(rng, 30, 40, 12)))
    assert run(spark, rows, 1, 50) == brute(rows, 1, 50)


def test_signatures_estimate_similarity():
    import numpy as np

    rng = np.random.default_rng(1)
    common = rng.integers(0, 2**63, 400, dtype=np.uint64)
    a, b = (np.unique(np.concatenate((common, rng.integers(0, 2**63, 100, dtype=np.uint64)))) for _ in range(2))
    slots = superminhash([a, b, a[:3], np.zeros(0, np.uint64)], 256)
    assert abs((slots[0] == slots[1]).mean() - 400 / 600) < 0.1
    assert (slots[3] == slots[3].max()).all() and len(set(slots[2].tolist())) == 256


def test_components(spark, monkeypatch):
    rng = random.Random(3)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(i, i + 1) for i in range(400, 480)] + [(5, 5)]
    root = {x: x for pair in links for x in pair}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    for most in (10**6, 20, 0):
        monkeypatch.setattr(components, "LOCAL_LINKS", most)
        got = sorted(map(tuple, connected_components(spark.createDataFrame(links, "node long, other long").repartition(4)).collect()))
        assert got == sorted({(x, find(x)) for a, b in links if a != b for x in (a, b)})
    assert connected_components(spark.createDataFrame([(1, 1)], "node long, other long")).collect() == []
