"""Hard negatives against plain loops, over odd rows and in small blocks."""

import math
import random

import numpy as np
import pytest

from lexiflow.llm import hard_negatives as H

SCHEMA = "vec_id long, embedding array<float>, label int, v int, anchor boolean"


def brute(rows, every=10, n_pos=5, n_neg=10, share=(30, 90)):
    fine = {}
    for i, x, label in sorted((r for r in rows if r[0] is not None and r[1] is not None and r[2] is not None and all(c is not None and math.isfinite(c) for c in r[1])), key=lambda r: (r[0], r[2])):
        v = [math.floor(256 * float(np.float32(c))) for c in x]
        fine[i] = min(fine.get(i, (label, v)), (label, v))
    out = []
    for a in (i for i in fine if i % every == 0):
        score = {i: sum(p * q for p, q in zip(fine[a][1], v, strict=False)) for i, (_, v) in fine.items() if i != a}
        best = lambda some: sorted(some, key=lambda i: (-score[i], i))
        for p in best(i for i in score if fine[i][0] == fine[a][0])[:n_pos]:
            hard = best(i for i in score if fine[i][0] != fine[a][0] and share[0] * score[p] <= 100 * score[i] <= share[1] * score[p])
            out += [(a, p, n + 1, i, score[p], score[i]) for n, i in enumerate(hard[:n_neg])]
    return sorted(out)


def run(spark, rows, **more):
    df = spark.createDataFrame([(*r, 0, False) for r in rows], SCHEMA).repartition(3)
    return sorted(map(tuple, H.hard_negatives(df, "vec_id % 10 = 0", **more).collect()))


@pytest.mark.parametrize("step", [7, 2048])
def test_equal_plain_loops(spark, monkeypatch, step):
    rng = random.Random(step)
    monkeypatch.setattr(H, "STEP", step)
    monkeypatch.setattr(H, "ANCHOR_BYTES", 8 * 6 * 4)
    rows = [(i, [rng.gauss(0, 1) for _ in range(6)], rng.randrange(3)) for i in range(-60, 200)]
    rows += [(200 + i, [0.5, -0.25, 1.0, 0.125, 0.0, -2.0], i % 2) for i in range(40)]  # ties, in a row and across labels
    rows += [(300, None, 1), (301, [0.1] * 6, None), (310, [float("nan")] * 6, 1), (311, [1.0, None, 0.0, 0.0, 0.0, 0.0], 0), (320, [float("inf")] * 6, 0), (None, [1.0] * 6, 0)]
    rows += [(330, [0.0] * 6, 0), (340, [], 1), (350, [1.0, 2.0], 1), (360, [-1.0] * 6, 9), (0, [3.0] * 6, 0), (0, [3.0] * 6, 0), (370, [1e5, 0.0, 0.0, 0.0, 0.0, -1e5], 1)]
    got = run(spark, rows)
    assert got and got == brute(rows)


def test_one_label_has_most_rows(spark):
    rng = random.Random(5)
    rows = [(i, [rng.random() for _ in range(4)], 0 if i % 9 else i % 5) for i in range(400)]
    assert run(spark, rows) == brute(rows)
    assert run(spark, rows, n_positives=2, n_negatives=3, share=(50, 99)) == brute(rows, n_pos=2, n_neg=3, share=(50, 99))


def test_empty_and_too_large(spark):
    assert run(spark, []) == [] and run(spark, [(0, [1.0], 1)]) == []
    with pytest.raises(ValueError):
        run(spark, [(0, [1e30], 1), (1, [1.0], 1)])


def test_sliced_products_are_exact():
    rng = np.random.default_rng(2)
    a, v = rng.integers(-255, 256, (9, 33)), rng.integers(-256, 256, (500, 33))
    top = np.sort(a @ v.T, axis=1)[:, -3:-2]
    x, c, score = H.sliced_products(a, v, 8, np.ones((9, 500), bool), lambda lo, hi, alive: alive & (hi >= top))
    want = a @ v.T
    assert (score == want[x, c]).all() and {*zip(x.tolist(), c.tolist(), strict=True)} >= {*zip(*(p.tolist() for p in np.nonzero(want >= top)), strict=True)}
