"""The correction queries over all words and the whole vocabulary, against brute force over words with accents."""

import re
from collections import Counter

import pytest

from lexiflow.functions import constants as C
from lexiflow.operators import correct, ngram
from lexiflow.plans.registry import QUERIES

DOCS = ["Élève élève élève naïve café café naïf. Größe größe straße, l'été niño niña", "cafés thé une élève. Une élève du café; une élevé", "größer schön schon señor the then them"]
TALK = ["Une éleve du cafe, une élvèe naive", "grösse gröse Größe größé niñio nino lété", "schöon tehn une caféé. señro zzzz élève thé 'tis"]


def sentences(texts):
    return [re.findall(r"(?:[^\W\d_]|')+", part.lower()) for t in texts for part in re.split("[.?!]", t)]


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def swaps(w):
    return {w[:i] + w[i + 1] + w[i] + w[i + 2 :] for i in range(len(w) - 1) if w[i] != w[i + 1]}


def doubles(w):
    return {w[: i + 1] + w[i:] for i in range(len(w))} | {w[:i] + w[i + 1 :] for i in range(len(w) - 1) if w[i] == w[i + 1]} if len(w) >= 4 else set()


def marks(w):
    return {w[:i] + "'" + w[i:] for i in range(1, len(w))} if "'" not in w else set()


FREQ = Counter(w for s in sentences(DOCS) for w in s)
PAIRS = Counter(p for s in sentences(DOCS) for p in zip(s, s[1:], strict=False))
TOTALS = Counter()
for (first, _), n in PAIRS.items():
    TOTALS[first] += n
ASKED = {(w, s[i - 1] if i else "") for s in sentences(TALK) for i, w in enumerate(s)}
TYPED = {w for w, _ in ASKED}
STRANGE = TYPED - set(FREQ)


def candidates(t):
    found = []
    for w, n in FREQ.items():
        d = 1 if w in swaps(t) | marks(t) else levenshtein(t, w)
        if d <= (1 if len(t) <= 4 else 2):
            slip = 0 if w in marks(t) else 1 if w in doubles(t) else 2 if w in swaps(t) else 3 if len(t) >= 3 and len(w) > len(t) and w.startswith(t) else 4
            found.append((d, slip, -n, w))
    return [(w, d, -n, slip) for d, slip, n, w in sorted(found)]


def decide(t, prev):
    if t in FREQ:
        return t, "already a real word"
    rows, after = candidates(t)[:20], TOTALS[prev]
    share = lambda w, n: 0.7 * PAIRS[prev, w] / after + 0.3 * n / FREQ.total() if after else n / FREQ.total()
    rows = [(w, d, n, slip, share(w, n) * C.SLIP_WEIGHTS[slip]) for w, d, n, slip in rows]
    context = bool(rows) and prev != "" and after > 0 and rows[0][3] != 0
    if context:
        rows.sort(key=lambda r: (r[1], -r[4], r[0]))
    if not rows:
        return t, "no close word found"
    best, runner = rows[0], rows[1] if len(rows) > 1 else None
    if best[1] == 2 and len(t) < 6:
        return t, "too short to guess at two mistakes"
    margin = 2 if best[1] == 1 else 4
    clear = runner is None or runner[1] > best[1] or (best[4] >= margin * runner[4] if context else best[3] < runner[3] or best[2] >= margin * runner[2])
    return (best[0], "corrected") if clear else (t, "two words are too close to call")


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("accents")
    spark.createDataFrame(list(enumerate(DOCS)), "doc_id long, text string").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(1, i, "user", t) for i, t in enumerate(TALK)], "conv_id long, turn long, role string, text string").write.parquet(f"{d}/conversations.parquet")
    return str(d)


def rows_of(spark, sf_dir, name):
    return sorted(tuple(r) for r in QUERIES[name](spark, sf_dir).collect())


def test_pairs_and_edits(spark, sf_dir):
    assert len(STRANGE) > 10 and min(FREQ.values()) == 1
    assert rows_of(spark, sf_dir, "edit_distance_pairs") == sorted((t, w, d) for t in STRANGE for w in FREQ if (d := levenshtein(t, w)) <= 2)
    for name, make in (("letter_swaps", swaps), ("double_letter_fixes", doubles)):
        want = sorted((t, w, FREQ[w]) for t in STRANGE for w in make(t) if w in FREQ)
        assert want and rows_of(spark, sf_dir, name) == want


def test_corrections(spark, sf_dir):
    want = sorted((t, w, d, n, slip, i + 1) for t in STRANGE for i, (w, d, n, slip) in enumerate(candidates(t)[:5]))
    assert rows_of(spark, sf_dir, "fuzzy_corrections") == want


def test_decisions(spark, sf_dir):
    plain = sorted((t, decide(t, "")[1] == "corrected", *decide(t, "")) for t in TYPED)
    assert rows_of(spark, sf_dir, "autocorrect_decisions") == plain
    context = sorted((t, p, decide(t, p)[1] == "corrected", *decide(t, p)) for t, p in ASKED)
    assert rows_of(spark, sf_dir, "autocorrect_in_context") == context
    assert any(changed and not corrected.isascii() for _, changed, corrected, _ in plain)


@pytest.mark.parametrize("name", ["fuzzy_corrections", "autocorrect_decisions", "autocorrect_in_context"])
def test_no_growing_table_is_broadcast(spark, sf_dir, monkeypatch, name):
    """Stored tables look small and are many times as large in the driver: no step of the corrections may broadcast one; F8, F4, F6."""
    plans, write = [], correct.once
    kept = lambda df: (plans.append(df._jdf.queryExecution().executedPlan().toString()), df)[1]
    monkeypatch.setattr(correct, "once", lambda df, name: write(kept(df), name))
    found = kept(QUERIES[name](spark, sf_dir))
    assert found.collect() and len(plans) > 2
    plans.append(found._jdf.queryExecution().executedPlan().toString())  # as it ran
    assert not [p for p in plans if "BroadcastHashJoin" in p]


def test_only_chosen_pairs_are_told_apart(spark):
    made = [(a, b, n) for a in "abcdefgh" for b in "ijklmnop" for n in (1, 2)]
    every, chosen = spark.createDataFrame(made, "first string, second string, cnt long"), spark.createDataFrame([("a", "i"), ("a", "j"), ("b", "p"), ("z", "q")], "first string, second string")
    got = {(r.first, r.second): r.cnt for r in ngram.count_chosen(every, chosen).toLocalIterator()}
    assert got["a", "i"] == got["a", "j"] == got["b", "p"] == 3 and len(got) < 20
    assert Counter({a: 24 for a in "abcdefgh"}) == sum((Counter({a: n}) for (a, _), n in got.items()), Counter())
