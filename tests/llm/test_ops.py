"""Every query over odd rows (nulls, empty and long texts, ties, repeats, clashing columns) against brute force, and over empty tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from lexiflow.llm import queries as Q
from lexiflow.llm.language_id import CompressionClassifier, has_letter, sample_dictionaries
from lexiflow.llm.license_scan import evaluate, parse_expression
from lexiflow.llm.substring_dedup import substring_dedup
from lexiflow.llm.token_codes import TokenFile, encode_file, read_token_files, write_token_files
from lexiflow.llm.tokens import PieceEncoder
from lexiflow.llm.url_filter import viterbi

ALNUM = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
EN, FR = "the and of with tion ing er that was for".split(), "le de que eau ment tre aux ier pas la".split()


def low(text):
    return bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode())


def prose(rng, n, parts):
    return " ".join("".join(rng.choice(parts) for _ in range(rng.randrange(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def data(spark, tmp_path_factory):
    rng, d = random.Random(9), tmp_path_factory.mktemp("data")
    passage, item = prose(rng, 60, EN), prose(rng, 30, EN)
    docs = []
    for i in range(60):
        parts, lang = (EN, "en") if i % 3 else (FR, "fr")
        docs.append((i, prose(rng, rng.randrange(20, 200), parts).capitalize() + ".", lang, "s", 1))
    docs += [(100, None, "en", "s", 0), (101, "", None, "s", 0), (102, " \n\t ", "en", "s", 3), (103, "1234 !!", "en", "s", 7), (104, "one", "en", "s", 3)]
    docs += [(105 + i, prose(rng, 20, EN) + "\n" + passage + " " + prose(rng, 10, EN), "en", "s", 1) for i in range(4)]
    docs += [(120, item + " end", "en", "s", 1), (121, prose(rng, 900, EN) + " " + item.upper(), "en", "s", 1), (122, item, "en", "s", 1)]
    docs += [(130 + i, docs[1][1], "en", "s", 1) for i in range(5)] + [(140, docs[1][1] + " more", "en", "s", 1), (150, prose(rng, 20_000, EN), "en", "s", 1)]
    docs += [(160, "Released under the MIT License, mit license\nApache-License GENERAL public license", "en", "s", 1), (161, "// SPDX-License-Identifier: (MIT OR GPL-2.0-only) AND Apache-2.0\nx", "en", "s", 1)]
    docs += [(170, "a\xa0 b  c\n\n d <|endoftext|> é́ \u3000x", "en", "s", 1)]
    clash = "doc_id long, text string, lang string, source string, n_chars long"
    more = [(*r, 5, "k") for r in docs]
    spark.createDataFrame(more, clash + ", n_words int, node string").repartition(3).write.parquet(f"{d}/documents.parquet")
    bench = [(7, item), (12, prose(rng, 8, EN)), (3, None), (4, ""), (5, "...")]
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    urls = ["http://a.example.com/en/7", "https://shop.net/de/1?x", "http://example.net/de/88#t", "x.org/es/1", None, "HTTP://WWW.TheAnd.ORG/es/", "ftp://h", "a://b://c/d", "http://notcom/en/", "https://com/en/q", "http://mail.example.com/fr/7"]
    html = "<html><script>bad words</script><p>the and of theand</p></html>"
    spark.createDataFrame([(i, u, html if i % 2 else None, "h") for i, u in enumerate(urls * 3)], "page_id long, url string, html string, host string").write.parquet(f"{d}/pages.parquet")
    vec = [[rng.gauss(0, 1) for _ in range(8)] for _ in range(260)]
    rows = [(i, v, 1) for i, v in enumerate(vec)] + [(300 + i, vec[3], 1) for i in range(40)] + [(400, None, 1), (401, [0.0] * 8, 1), (402, [float("nan")] * 8, 1), (403, [None] * 8, 1), (404, [1.0], 1), (405, [float("inf")] * 8, 1), (420, [0.5] * 8, 1)]
    spark.createDataFrame([(*r, r[0] % 3) for r in rows], "vec_id long, embedding array<float>, score int, label int").write.parquet(f"{d}/embeddings.parquet")
    talk = [(1, 0, "user", "hi"), (1, 1, "assistant", "hello there"), (1, 2, None, None), (1, 2, None, None), (1, 70, "user", ""), (2, None, "user", "x"), (None, 1, "user", "x"), (3, 5, "ann", "é"), (3, 4, "bob", "b")]
    talk += [(4, 0, "system", "rules"), (4, 1, "a|>\n<|assistant", "x <|assistant|> y"), (4, None, "b", "last"), (4, -3, "b", "first"), (4, 2**40, "b", "z"), (5, 0, "system", "alone")]
    spark.createDataFrame([(*t, 1) for t in talk], "conv_id long, turn long, role string, text string, loss int").write.parquet(f"{d}/conversations.parquet")
    spark.createDataFrame([(i, i % 2, 0, 0.5) for i in range(60)], "doc_id long, quality int, toxic int, score double").write.parquet(f"{d}/labels.parquet")
    return str(d), docs, bench, urls * 3, rows, talk


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory, data):
    d = tmp_path_factory.mktemp("empty")
    for name in "documents benchmark pages embeddings conversations labels".split():
        spark.read.parquet(f"{data[0]}/{name}.parquet").limit(0).write.parquet(f"{d}/{name}.parquet")
    return str(d)


@pytest.mark.parametrize("name", list(Q.queries()))
def test_empty_tables(spark, empty, name):
    assert Q.queries()[name](spark, empty).collect() == []


def removed(rows, size):
    words, first = {d: (t or "").encode().split() for d, t in rows}, {}
    for d in sorted(words):
        for i in range(len(words[d]) - size + 1):
            first.setdefault(tuple(words[d][i : i + size]), d)
    out = {}
    for d, w in words.items():
        gone = {j for i in range(len(w) - size + 1) if first[tuple(w[i : i + size])] < d for j in range(i, i + size)}
        out[d] = (len(w), len(gone), b" ".join(x for i, x in enumerate(w) if i not in gone))
    return out


def test_op1(spark, data):
    want = {d: (n, g, hashlib.sha256(k).hexdigest()) for d, (n, g, k) in removed([r[:2] for r in data[1]], 13).items()}
    assert {r[0]: tuple(r[1:]) for r in Q.op1_substring_dedup(spark, data[0]).collect()} == want


def test_relays_change_nothing(spark, data, monkeypatch):
    from lexiflow.llm import substring_dedup as module

    monkeypatch.setattr(module, "DIRECT", 4)
    frame = spark.read.parquet(f"{data[0]}/documents.parquet").select("doc_id", "text")
    want = removed([r[:2] for r in data[1]], 13)
    for mb in (0.02, 0.005):  # about 20 and 80 buckets
        got = {r.doc_id: (r.n_words, r.n_removed, r.kept_text.encode()) for r in substring_dedup(frame, 13, bucket_mb=mb).collect()}
        assert got == want


def test_substring_dedup_of_long_words_and_hot_ids(spark):
    text = "w" * 300_000 + " " + " ".join(f"w{i}" for i in range(30)) + " " + "é" * 300_000
    rows = [(3, text), (4, "x " + text), (None, "a b"), (5, "")] + [(None, f"n{i} " * 20) for i in range(40)]
    got = {(r.doc_id, r.n_words): r.n_removed for r in substring_dedup(spark.createDataFrame(rows, "doc_id long, text string"), 13, bucket_mb=0.05).collect()}
    assert got == {(3, 32): 0, (4, 33): 32, (None, 2): 0, (5, 0): 0, (None, 20): 0}


def test_substring_dedup_repeated_and_null_ids(spark):
    text = " ".join(map(str, range(20)))
    df = spark.createDataFrame([(1, text, "a"), (1, text, "b"), (None, text, "c"), (2, text + " x", "d")], "doc_id long, text string, kept_text string")
    got = sorted((r.doc_id or 0, r.n_removed, r.kept_text) for r in substring_dedup(df, 13, carry=("kept_text",), bucket_mb=0.0001).collect())
    assert got == [(0, 20, ""), (1, 0, text), (1, 0, text), (2, 20, "x")]


def test_op2(spark, data):
    good = {i: np.asarray(v, np.float32).astype(float) for i, v, _ in data[4] if v and len(v) == 8 and None not in v and np.isfinite(v).all() and any(v)}
    got = {}
    for r in Q.op2_nearest_neighbours(spark, data[0]).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert set(got) == {i for i in good if i % 20 == 0}
    hits = 0
    for q, rows in got.items():
        rows.sort()
        assert [r[0] for r in rows] == list(range(1, 21))
        assert all(abs(s - float((good[q] * good[v]).sum())) < 1e-9 for _, v, s in rows) and rows == [(n, v, s) for n, (s, v) in enumerate(sorted(((s, v) for _, v, s in rows), key=lambda x: (-x[0], x[1])), 1)]
        best = sorted(((-(good[q] * good[v]).sum(), v) for v in good if v != q))[:20]
        hits += len({v for _, v in best} & {v for _, v, _ in rows})
    assert hits / (20 * len(got)) >= 0.9


def test_neighbours_of_ties_and_repeated_ids(spark):
    from lexiflow.llm.ann_tree import nearest_neighbours

    rows = [(0, [1.0, 0.0])] + [(i, [0.5, float(i)]) for i in range(1, 40)] + [(50, [2.0, 1.0]), (50, [0.25, 9.0]), (50, None), (None, [9.0, 9.0])]
    found = nearest_neighbours(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3), k=20, every=60).orderBy("rank").collect()
    assert [(r.query_id, r.vec_id, r.score) for r in found] == [(0, i, 0.5) for i in range(1, 21)]  # 39 tie; of id 50 the smaller vector counts


def test_tree_grows_with_the_table(spark, monkeypatch):
    from lexiflow.llm import ann_tree

    for name, value in (("SAMPLE", 300), ("LEAF_SAMPLE", 60), ("UPPER", 8), ("LEAF", 4)):
        monkeypatch.setattr(ann_tree, name, value)
    rng = np.random.default_rng(6)
    centers = rng.normal(size=(30, 16))
    vectors = centers[rng.integers(0, 30, 4000)] + rng.normal(size=(4000, 16)) * 0.3
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "group_id long, vector array<double>").repartition(4)
    tree = ann_tree.grow_tree(frame, "double", 16)
    leaf = tree.assign(vectors)
    sizes = np.bincount(leaf, minlength=tree.leaves)
    assert tree.leaves > 100 and sizes.sum() == 4000 and sorted(tree.visit(vectors[5], sizes, 1e9)) == list(range(tree.leaves))
    again = ann_tree.KMeansTree.load(tree.dump())
    assert (again.assign(vectors) == leaf).all() and again.visit(vectors[5], sizes, 500) == tree.visit(vectors[5], sizes, 500)
    true = np.argsort(-(vectors[:50] @ vectors.T), axis=1)[:, :10]
    seen = [np.isin(leaf[t], tree.visit(q, sizes, 1200)).mean() for q, t in zip(vectors[:50], true, strict=True)]
    assert np.mean(seen) > 0.9  # with less than a third of the vectors


def test_neighbours_shuffle_a_query_once(spark, tmp_path):
    import time

    from lexiflow.llm.ann_tree import nearest_neighbours

    def shuffled():
        time.sleep(2)  # Spark notes it from time to time
        rows = spark.sparkContext._jsc.sc().statusStore().executorList(True)
        return sum(rows.apply(i).totalShuffleWrite() for i in range(rows.size()))

    rng = np.random.default_rng(8)
    vectors = rng.normal(size=(4000, 64)).astype(np.float32)
    vectors[3000:3040] = vectors[0]  # more equal ones than a query returns
    spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/vectors")
    before = shuffled()
    limit = "spark.sql.autoBroadcastJoinThreshold"
    old = spark.conf.get(limit)
    spark.conf.set(limit, "-1")  # larger tables are beyond it
    try:
        found = nearest_neighbours(spark.read.parquet(f"{tmp_path}/vectors"), k=5, every=2).collect()
    finally:
        spark.conf.set(limit, old)
    assert shuffled() - before < 5 * vectors.nbytes
    exact, got, hits = vectors.astype(float) @ vectors.astype(float).T, {}, 0
    for r in found:
        assert abs(r.score - exact[r.query_id, r.vec_id]) < 1e-9
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id))
    np.fill_diagonal(exact, -np.inf)
    for q, rows in got.items():
        assert [r for r, _ in sorted(rows)] == [1, 2, 3, 4, 5]
        hits += len({v for _, v in rows} & set(np.lexsort((np.arange(4000), -exact[q].round(9)))[:5].tolist()))
    assert len(got) == 2000 and hits / 10_000 >= 0.9
    assert [v for _, v in sorted(got[0])] == [3000, 3001, 3002, 3003, 3004] and [v for _, v in sorted(got[3000])] == [0, 3001, 3002, 3003, 3004]


def test_tree_is_bounded_by_bytes(spark, monkeypatch):
    from lexiflow.llm import ann_tree

    assert ann_tree.bounds(64) == (20_000, 512, 128)
    for dims in (1, 768, 100_000):
        rows, upper, lower = ann_tree.bounds(dims)
        assert rows * dims * 8 <= max(ann_tree.SAMPLE_BYTES, 2 * ann_tree.LEAF * dims * 8) and upper * lower * dims * 4 <= max(ann_tree.TREE_BYTES, ann_tree.BRANCH * dims * 4)
    rng = np.random.default_rng(3)
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.normal(size=(600, 16)))], "vec_id long, embedding array<float>")
    for name, value in (("TREE_BYTES", 16 * 4 * 40), ("LEAF", 8), ("UPPER", 8)):
        monkeypatch.setattr(ann_tree, name, value)
    groups = vectors.select(vectors.vec_id.alias("group_id"), vectors.embedding.alias("vector"))
    tree = ann_tree.grow_tree(groups, "float", 16)
    assert tree.matrix.nbytes <= ann_tree.TREE_BYTES and tree.matrix.dtype == np.float32 and tree.leaves > 4
    assert ann_tree.nearest_neighbours(vectors, k=5, every=20).count() == 30 * 5


def test_op3(spark, data):
    rows = Q.op3_language_id(spark, data[0]).collect()
    docs = {r[0]: r for r in data[1]}
    assert len(rows) == len(docs) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert all((r.lang_pred == "und") == (not has_letter(docs[r.doc_id][1])) and 0 <= r.score <= 1 for r in rows)
    judged = [r for r in rows if r.doc_id < 60]
    assert sum(r.lang_pred == docs[r.doc_id][2] for r in judged) / len(judged) > 0.95


def test_languages_equal_a_plain_loop(spark, data):
    import zstandard

    frame = spark.read.parquet(f"{data[0]}/documents.parquet").select("doc_id", "text", "lang")
    held = {r[0] for r in data[1] if zlib.crc32(str(r[0]).encode()) % 4 == 2}
    made = sample_dictionaries(frame.filter(~frame.doc_id.isin(*held)))
    got = {r.doc_id: r for r in Q.op3_language_id(spark, data[0]).collect()}
    how = zstandard.ZstdCompressionParameters(strategy=zstandard.STRATEGY_BTOPT, min_match=3, window_log=17, hash_log=15, chain_log=15, search_log=4, write_content_size=False, write_checksum=False, write_dict_id=False)
    for d, text, *_ in data[1][::7] + data[1][60:65]:
        if not text or not any(c.isalpha() for c in text):
            assert (got[d].lang_pred, got[d].score, got[d].accepted) == ("und", 0.0, False)
            continue
        raw = re.sub(r"[\W\d_]+", " ", text.lower()).encode()
        sizes = []
        for name, dictionary in made.items():
            kept = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            kept.precompute_compress(compression_params=how)
            sizes.append((sum(len(zstandard.ZstdCompressor(compression_params=how, dict_data=kept).compress(raw[i : i + 2048])) for i in range(0, len(raw), 2048)), list(made).index(name), name))
        sizes.sort()
        margin = (sizes[1][0] - sizes[0][0]) / sizes[1][0]
        assert got[d].lang_pred == sizes[0][2] and abs(got[d].score - 1 / (1 + math.exp(-margin / 0.04))) < 1e-9 and got[d].accepted == (margin >= 0.005)


def test_languages_of_odd_rows(spark):
    from lexiflow.llm.language_id import identify_language

    rows = [(None, "the and of " * 30, "en"), (1, "le de que " * 30, "fr"), (1, "le de que " * 30, None), (2, "", "fr"), (3, "x" * 300_000 + " the and of", None), (4, "12 !", "en")]
    frame = spark.createDataFrame([(*r, "own", 0.5) for r in rows], "doc_id long, text string, lang string, lang_pred string, score double")
    model = CompressionClassifier({"en": b"the and of " * 40, "also": b"the and of " * 40, "fr": b"le de que " * 40})
    got = [(r.doc_id, r.lang_pred) for r in identify_language(frame, model).collect()]
    assert sorted(got, key=str) == sorted([(None, "en"), (1, "fr"), (1, "fr"), (2, "und"), (3, "en"), (4, "und")], key=str)  # ties go to the first
    assert identify_language(frame, CompressionClassifier({})).filter("lang_pred != 'und'").count() == 0


def test_dictionaries_of_many_languages(spark):
    rows = [(i, f"text {chr(97 + i % 26)}{chr(97 + i // 26 % 26)}", f"l{i % 300:03}") for i in range(900)]
    made = sample_dictionaries(spark.createDataFrame(rows, "doc_id long, text string, lang string"), per_language=2)
    assert len(made) == 300 and all(v.count(b"text") == 2 for v in made.values())


def test_dictionaries_share_a_bound(spark):
    rows = spark.createDataFrame([(i, f"text number {i} " * 400, f"l{i % 8}") for i in range(16)], "doc_id long, text string, lang string")
    assert {len(d) for d in sample_dictionaries(rows, total_bytes=8 * 2048).values()} <= {2047, 2048}
    with pytest.raises(ValueError):
        sample_dictionaries(rows, total_bytes=8 * 512)


def test_dictionaries_hold_a_share_of_each_text(spark):
    mark = lambda i: f"q{chr(97 + i // 26)}{chr(97 + i % 26)}q"
    rows = [(i, f"{mark(i)} " + "long text " * 400, "en") for i in range(200)]
    rows += [(300 + i, mark(i), "fr") for i in range(9)] + [(310, "plus long " * 9000, "fr")]
    made = sample_dictionaries(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert all(mark(i).encode() in made["en"] for i in range(200)) and 65_000 < len(made["en"]) <= 65_536
    assert all(mark(i).encode() in made["fr"] for i in range(9)) and 65_000 < len(made["fr"]) <= 65_536


def test_op4(spark, data):
    rules, got = Q.RULES, {r.page_id: r for r in Q.op4_url_filter(spark, data[0]).collect()}
    for i, url in enumerate(data[3]):
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        host = "".join(c.lower() if c.isascii() else c for c in re.match("[^/?#]*", rest)[0])
        path = re.match("[^?#]*", rest[len(host) :])[0]
        fits = [(len(r), r, v) for v, r in rules if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith(r[r.index("/") :])]
        rule = max(fits)[1] if fits else None
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule)
        assert got[i].verdict == max(fits)[2] if fits else got[i].verdict in ("allow", "block")
    assert viterbi("theandof", {"the": 50, "and": 40, "of": 30, "a": 5}, 200.0) == ["the", "and", "of"]


def splits(label, counts, total):
    """All ways to split a label, with their log probabilities."""
    for i in range(len(label) + 1):
        if i == len(label):
            word = math.log(counts[label] / total) if counts.get(label) else math.log(10 / total) - i * math.log(10)
            yield word, [label]
        elif i:
            head = label[:i]
            word = math.log(counts[head] / total) if counts.get(head) else math.log(10 / total) - i * math.log(10)
            yield from ((word + p, [head, *rest]) for p, rest in splits(label[i:], counts, total))


def test_viterbi_equals_all_splits():
    rng = random.Random(2)
    for _ in range(60):
        label = "".join(rng.choice("abc") for _ in range(rng.randrange(1, 11)))
        counts = {"".join(rng.choice("abc") for _ in range(rng.randrange(1, 6))): rng.randrange(1, 500) for _ in range(12)}
        best = viterbi(label, counts, 3000.0)
        ways = {tuple(w): p for p, w in splits(label, counts, 3000.0)}
        assert "".join(best) == label and ways[tuple(best)] >= max(ways.values()) - 1e-9


def test_url_verdicts_equal_brute_force_and_tell_spam_from_clean(spark):
    from lexiflow.llm.url_filter import FEATURES, SMOOTH, UNWANTED, filter_urls

    rng, rows = random.Random(5), []
    clean, spam = ["garden", "river", "school", "city", "music", "travel"], ["casino", "win", "free", "bets", "cheap", "pills"]
    text = "<p>" + " ".join(clean * 30 + spam * 30 + ["news", "daily", "x"] * 20) + "</p>"
    for i in range(400):
        bad = i % 8 == 0
        host = "".join(rng.sample(spam if bad else clean, 2)) + rng.choice([".example.com", ".example.org", ".test.fr", ".test.it"])
        rows.append((i, f"http://{host}/{rng.choice(['en', 'fr', 'es'])}/{rng.choice(['news', 'daily'])}/{i}", text if i < 3 else None))
    rows += [(1000, None, None), (1001, "http://" + "a" * 70_000 + ".test.fr/", None), (1002, "http://x.test.fr/" + "b" * 200_000, "<p></p>"), (None, rows[0][1], None), (1003, rows[0][1], None)]
    got = {r.page_id: r for r in filter_urls(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3), Q.RULES).collect()}
    assert len(got) == len(rows) and got[1001].host_words[0] == "a" * 70_000 and got[None].score == got[1003].score == got[0].score
    unruled = [got[i] for i in range(400) if got[i].rule is None]
    of_spam = [r.verdict == "block" for r in unruled if {"casino", "bets", "pills"} & set(r.host_words)]
    of_clean = [r.verdict == "allow" for r in unruled if not set(spam) & set(r.host_words)]
    beside = [r.verdict == "block" for r in unruled if set(spam) & set(r.host_words) and not set(UNWANTED) & set(r.host_words)]
    assert all(of_spam) and len(of_spam) > 10 and all(of_clean) and len(of_clean) > 100
    assert all(beside) and len(beside) > 3  # spam of no listed word, only of words that stand beside them
    drop = {w for _, r in Q.RULES for w in re.findall("[a-z0-9]+", r)}
    words = {}
    for r in got.values():
        path = re.sub("[0-9]+", " 0 ", r.path.lower())
        words[r.page_id] = [f"h:{w}" for w in r.host_words if w not in drop] + [f"p:{w}" for w in re.split("[^a-z0-9]+", path) if w and w not in drop]
    taught = {r.page_id: "block" if set(UNWANTED) & set(r.host_words) else "allow" if r.rule_verdict != "block" else None for r in got.values()}
    seen = {c: Counter(w for i, t in taught.items() if t == c for w in words[i]) for c in ("block", "allow")}
    total, both = {c: seen[c].total() for c in seen}, seen["block"] + seen["allow"]
    assert len(both) < FEATURES / 1000  # so few that hashed columns hardly meet
    log = lambda w, c: math.log((seen[c][w] + SMOOTH * both[w] / both.total()) / (total[c] + SMOOTH))
    odds = {i: sum(log(w, "block") - log(w, "allow") for w in ws if seen["block"][w] + seen["allow"][w]) for i, ws in words.items()}
    shift = {round(math.log(r.score / (1 - r.score)) - odds[i], 6) for i, r in got.items() if 1e-9 < r.score < 1 - 1e-9}
    pages = Counter(taught.values())
    assert len(shift) == 1 and abs(shift.pop() - math.log((pages["block"] + 1) / (pages["allow"] + 1))) < 1e-5  # all scores are the odds and the prior


def test_url_words_of_any_length(spark):
    from lexiflow.llm.url_filter import filter_urls

    word = "donaudampfschifffahrtsgesellschaft"
    rows = [(1, f"http://{word}.com/", f"<p>{word} gesellschaft</p>"), (2, f"http://the{word}the.com/", "<p>the the</p>"), (3, "http://x.com/", None)]
    got = {r.page_id: r.host_words for r in filter_urls(spark.createDataFrame(rows, "page_id long, url string, html string"), Q.RULES).collect()}
    assert got[1][0] == word and got[2][:3] == ["the", word, "the"]


def test_op5(spark, data):
    from tokenizers import Tokenizer

    tokenizer, got, fill = Tokenizer.from_file(Q.tokenizer_path("word_bpe_49k.json")), {}, {}
    rows = Q.op5_packing(spark, data[0]).collect()
    for r in rows:
        got.setdefault(r.doc_id, []).append((r.start, r.length, r.ids_crc32, r.doc_tokens))
        fill.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for d, text, *_ in data[1]:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for start, length, crc, total in sorted(got[d]):
            assert start == at and total == len(ids) and crc == zlib.crc32(ids[at : at + length].tobytes())
            at += length
        assert at == len(ids)
    for spans in fill.values():
        assert all(o == sum(n for _, n in sorted(spans)[:i]) for i, (o, _) in enumerate(sorted(spans)))
    assert sorted(sum(n for _, n in s) for s in fill.values())[1:] == [2048] * (len(fill) - 1)


def test_packing_of_null_and_repeated_ids(spark):
    from lexiflow.llm.packing import pack

    text = "some words to pack " * 900
    rows = [(None, text), (None, text), (7, "a b"), (7, "a b"), (7, None), (8, "")]
    frame = spark.createDataFrame([(*r, 3) for r in rows], "doc_id long, text string, length int").repartition(3)
    got = pack(frame, Q.tokenizer_path("word_bpe_49k.json"), length=256).collect()
    line = sorted((r.sequence_id * 256 + r.offset, r.length, r.doc_id, r.start, r.doc_tokens) for r in got)
    assert [a for a, *_ in line] == np.cumsum([0, *(n for _, n, *_ in line)])[:-1].tolist()  # gapless
    assert Counter((d, t) for _, _, d, start, t in line if start == 0) == Counter({(None, 3601): 2, (7, 3): 2, (7, 1): 1, (8, 1): 1})
    assert sum(n for _, n, *_ in line) == 2 * 3601 + 6 + 2
    with pytest.raises(ValueError):
        pack(frame, Q.tokenizer_path("word_bpe_49k.json"), length=0)


def test_totals_of_many_parts(spark, monkeypatch):
    from lexiflow.llm import common

    rng = random.Random(1)
    rows = [(p, i, rng.randrange(100)) for p in range(30) for i in range(2)]
    frame = spark.createDataFrame(rows, "part long, piece long, n long").repartition(5)
    want = {(p, i): sum(n for q, j, n in rows if (q, j) < (p, i)) for p, i, _ in rows}
    monkeypatch.setattr(common, "RUN", 4)
    for most in (10**6, 0):
        monkeypatch.setattr(common, "BROADCAST_ROWS", most)
        got = common.with_base(frame, common.running_totals(frame, ["part", "piece"], "n"), ["part", "piece"]).collect()
        assert {(r.part, r.piece): r.base for r in got} == want and len(got) == len(rows)


def test_op7(spark, data):
    from tokenizers import Tokenizer

    tokenizer, got, at = Tokenizer.from_file(Q.tokenizer_path("byte_bpe_50k.json")), {r.doc_id: tuple(r)[1:] for r in Q.op7_token_files(spark, data[0]).collect()}, 0
    for d, text, *_ in sorted(data[1], key=lambda r: r[0]):
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        assert got[d] == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)


def test_token_files_in_order_with_null_and_repeated_ids(spark):
    rows = [(5, "b c"), (None, None), (5, "d" * 9), (-3, ""), (None, "x y"), (5, "b c")]
    files, folder = write_token_files(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), Q.tokenizer_path("byte_bpe_50k.json"), file_tokens=1, partition_mb=1e-6)
    made = [TokenFile(open(r.path, "rb").read()) for r in files.orderBy("part", "piece").collect()]
    names = [i for f in made for i in f.doc_ids(0, f.n_docs).tolist()]
    assert names == [np.iinfo(np.int64).min] * 2 + [-3, 5, 5, 5]
    plain = PieceEncoder(Q.tokenizer_path("byte_bpe_50k.json"), "byte")
    texts = [None, "x y", "", "b c", "d" * 9, "b c"]
    docs = [f.document(k).tolist() for f in made for k in range(f.n_docs)]
    assert docs == [plain.encode([t], 2)[0].tolist() for t in texts]
    read = sorted((r.place, r.doc_id, np.frombuffer(r.ids, "<u4").tolist()) for r in read_token_files(files, folder, docs_at_once=1).collect())
    assert [x[2] for x in read] == docs and [x[1] for x in read] == [None, None, -3, 5, 5, 5] and [x[0] for x in read] == np.cumsum([0, *map(len, docs)])[:-1].tolist()


def test_token_file_random_access():
    rng = np.random.default_rng(4)
    ids = np.concatenate((rng.integers(0, 200, 3000), rng.integers(0, 2**31, 3000), [0, 255, 256, 65535, 65536])).astype(np.uint32)
    rng.shuffle(ids)
    file = TokenFile(encode_file(ids, np.array([1, 2]), np.array([0, 10, len(ids)])))
    n = len(ids)
    assert (file.tokens(0, n) == ids).all() and all(file.token(i) == ids[i] for i in range(0, n, 37)) and len(file.levels) == 4
    for a, b in [(0, 0), (n, n), (511, 513), (512, 1024), (1, 8), (5997, n), *rng.integers(0, n, (50, 2)).tolist()]:
        assert (file.tokens(min(a, b), max(a, b)) == ids[min(a, b) : max(a, b)]).all()
    whole = np.arange(256, 256 + 1024)  # as many ids as two blocks, all of which go on
    assert (TokenFile(encode_file(whole, np.array([1]), np.array([0, 1024]))).tokens(1000, 1024) == whole[1000:]).all()
    assert TokenFile(encode_file(np.zeros(0, np.uint32), np.zeros(0), np.zeros(1))).tokens(0, 0).tolist() == []
    with pytest.raises(IndexError):
        file.token(len(ids))


def test_piece_encoder_is_exact():
    from tokenizers import Tokenizer

    odd = ["a\xa0 b  c \n\n d\u3000e", "x  y\n\nZ \t q'ss don't I'LL  ", "<|endoftext|> hi", " lead", "trail \n", "\n\nA", "é́ ", None, "", " ", "a \n\xa0b", "ﬀ ΑΣ Σ İ", " \x1c x\x1cy"]
    odd += ["a\nb c\nd.\nÉté!", "\na b", "a b\n", "a\n\nb", "a\n b \nc", "***", " *** x*** é***y", "É, naïve... 5é ñ's ªº µ 12. don't. x'", "a\rb", "\n", "ä" * 3000, "b\x0bc d\x0c"]
    odd += ["a\x00b \x00 c\x00", "x" * 15 + " " + "x" * 16 + " é" + "y" * 13 + " aaaaaaaaaaaaaaa aaaa", "×a a÷b ß ẞ", "a .b ,, c.. ¡Hola!"]
    rng, signs = random.Random(1), [*"abcdeABCÉéßàñ×÷ \n\t  ''.,!?\"0129-", "'s", "'ll", " \n", "\xa0", "ł", "中", "\x00", "e\u0301"]
    odd += ["".join(rng.choice(signs[: 30 if i % 2 else None]) for _ in range(rng.randrange(80))) for i in range(600)]
    for name, kind in (("word_bpe_49k.json", "word"), ("byte_bpe_50k.json", "byte")):
        code, plain = PieceEncoder(Q.tokenizer_path(name), kind), Tokenizer.from_file(Q.tokenizer_path(name))
        ids, first = code.encode(odd, 1)
        for i, text in enumerate(odd):
            assert ids[first[i] : first[i + 1]].tolist() == [*plain.encode(text or "", add_special_tokens=False).ids, 1]


@pytest.mark.parametrize("name, kind", [("byte_bpe_50k.json", "byte"), ("word_bpe_49k.json", "word")])
def test_piece_encoder_is_exact_on_slices(name, kind):
    """Texts for the library alone, in slices of a batch as tasks cut them; F2."""
    import pyarrow as pa
    from tokenizers import Tokenizer

    rng = random.Random(2)
    texts = [(prose(rng, 30, EN) + rng.choice(["", " é", "\xa0x", "<|endoftext|> a", "\u3000"])) if i % 7 else None for i in range(200)]
    code, plain, column = PieceEncoder(Q.tokenizer_path(name), kind), Tokenizer.from_file(Q.tokenizer_path(name)), pa.array(texts, pa.string())
    for a in range(0, 200, 23):
        ids, first = code.encode(column.slice(a, 23), 1)
        want = [[*plain.encode(t or "", add_special_tokens=False).ids, 1] for t in texts[a : a + 23]]
        assert [ids[x:y].tolist() for x, y in zip(first[:-1], first[1:], strict=True)] == want


def test_slots_grow_beyond_their_first_size():
    from lexiflow.llm.tokens import _Slots

    slots, rng = _Slots(4), np.random.default_rng(1)
    a, b = np.arange(5000, dtype=np.uint64), rng.integers(0, 9, 5000).astype(np.uint64)
    for i in range(0, 5000, 700):
        slots.add(a[i : i + 700], b[i : i + 700], np.arange(i, min(i + 700, 5000)))
    assert slots.find(a, b).tolist() == list(range(5000)) and (slots.find(a, b + np.uint64(9)) == -1).all()


def test_op8_perspectives(spark, data):
    got = {}
    for r in Q.op8_chat_perspectives(spark, data[0]).collect():
        got.setdefault((r.conv_id, r.perspective), []).append(r)
    esc = lambda x: x.replace("<|", "<\\|").replace("|>", "|\\>")
    talk = [(c, t if t is not None else 1 << 63, esc(s or "unknown"), esc(x or "")) for c, t, s, x in data[5] if c is not None]
    assert set(got) == {(c, s) for c, _, s, _ in talk if s != "system"}
    for (conv, me), rows in got.items():
        said = sorted((t, s, x) for c, t, s, x in talk if c == conv)
        text = "".join(("<|assistant|>\n" if s == me else "<|system|>\n" if s == "system" else f"<|user:{s}|>\n") + x + "\n" for _, s, x in said)
        rows.sort(key=lambda r: r.message_start)
        assert "".join(r.rendered for r in rows) == text
        assert [text[r.text_start : r.text_end] for r in rows] == [x for _, _, x in said] and [r.loss for r in rows] == [int(s == me) for _, s, _ in said]


def hits(docs, bench):
    windows = {}
    for item, text in bench:
        w = ALNUM.findall(low(text))
        for i in range(max(1, len(w) - 12) if w else 0):
            windows.setdefault(tuple(w[i : i + 13]), set()).add(str(item))
    out = {}
    for d, text in docs:
        w, hit, items = ALNUM.findall(low(text)), set(), set()
        for n in {len(k) for k in windows}:
            for i in range(len(w) - n + 1):
                if found := windows.get(tuple(w[i : i + n])):
                    hit.update(range(i, i + n))
                    items |= found
        out[d] = (len(w), len(hit), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w))
    return out


def test_op9(spark, data):
    assert {r[0]: tuple(r[1:6]) for r in Q.op9_decontamination(spark, data[0]).collect()} == hits([r[:2] for r in data[1]], data[2])


def test_contamination_in_blocks(spark, data):
    from lexiflow.llm.decontaminate import contamination

    docs, bench = (spark.read.parquet(f"{data[0]}/{n}.parquet") for n in ("documents", "benchmark"))
    view = lambda df: {r.doc_id: (r.n_words, r.n_hit, r.longest, r.contaminated, len(r.matches)) for r in df.collect()}
    assert view(contamination(docs, bench)) == view(contamination(docs, bench, block_mb=0.0001))


def test_contamination_in_blocks_keeps_rows(spark, data):
    from lexiflow.llm.decontaminate import contamination

    item = data[2][0][1]
    rows = [(None, item), (None, "one two"), (None, None), (5, "short"), (5, "word " * 40 + item), (5, item + " end"), (5, item + " end")]
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string").repartition(2), spark.read.parquet(f"{data[0]}/benchmark.parquet")
    view = lambda df: Counter((r.doc_id, r.n_words, r.n_hit, r.longest, r.contaminated, str(r.matches)) for r in df.collect())
    got = view(contamination(docs, bench, block_mb=0.0001))
    assert got == view(contamination(docs, bench)) and got.total() == len(rows)
    assert sorted((k[0] or 0, *k[1:3]) for k in got.elements()) == sorted((d or 0, len(ALNUM.findall(low(t))), 30 if t and item in t else 0) for d, t in rows)


def test_suffix_array_of_many_distinct_words():
    from lexiflow.llm.decontaminate import SuffixArray

    n = (1 << 21) + 5
    words = np.arange(1, n + 1, dtype=np.uint64)
    item = words[n - 40 : n - 10]
    shard = SuffixArray(words, np.array([0, 1000, n]), 30)
    length, lo, hi = search(shard, _items(item))
    assert shard.order[lo].tolist() == list(range(n - 39, n - 9)) and (hi - lo).tolist() == [1] * 30 and length.tolist() == list(range(30, 0, -1))


def search(shard, items):
    from lexiflow.llm.decontaminate import Search

    return Search(shard, items).longest(np.arange(len(items.words)), items.left)


@pytest.mark.parametrize("letters", ["ab", "abcdefgh"])
def test_suffixes_are_searched_to_their_longest_match(letters):
    from lexiflow.llm.decontaminate import SuffixArray

    rng = np.random.default_rng(len(letters))
    words, item = rng.integers(1, len(letters) + 1, 900).astype(np.uint64), rng.integers(1, len(letters) + 2, 60).astype(np.uint64)
    item[10:40] = words[500:530]
    first = np.array([0, 0, 300, 530, 900])
    shard = SuffixArray(words, first, 60)
    length, lo, hi = search(shard, _items(item))
    docs = [bytes(words[a:b].astype(np.uint8)) for a, b in zip(first[:-1], first[1:], strict=True)]
    flat = bytes(item.astype(np.uint8))
    for j in range(60):
        want = max(n for n in range(61 - j) if any(flat[j : j + n] in d for d in docs))
        places = {int(shard.start[d]) + i for d, text in enumerate(docs) for i in range(len(text)) if text[i : i + want] == flat[j : j + want]}
        assert length[j] == want and (want == 0 or set(shard.order[lo[j] : hi[j]].tolist()) == places)


def test_contamination_of_a_single_repeated_word(spark):
    from lexiflow.llm.decontaminate import contamination

    docs = spark.createDataFrame([(1, "word " * 20_000), (2, "word " * 12), (3, "x " + "word " * 13)], "doc_id long, text string")
    got = {r.doc_id: r for r in contamination(docs, spark.createDataFrame([(1, "word " * 400), (2, "word " * 30)], "item_id long, text string")).collect()}
    assert (got[1].n_hit, got[1].longest, [tuple(m) for m in got[1].matches]) == (20_000, 400, [(1, 0, 0, 400), (2, 0, 0, 30)])
    assert (got[2].n_hit, got[2].matches, got[3].n_hit, got[3].longest, got[3].spans[0]) == (0, [], 13, 13, (1, 13))


def test_contamination_places_equal_brute_force(spark):
    from lexiflow.llm.decontaminate import contamination

    rng = random.Random(8)
    vocabulary = ["a", "b", "c"]
    docs = [(i % 40 or None, " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(60)))) for i in range(120)]
    bench = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(1, 40)))) for i in range(30)] + [(31, docs[5][1] + " b a"), (32, "c " + docs[50][1])]
    frame, tests = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string")
    for block in (8.0, 0.0002):
        rows = Counter()
        for r in contamination(frame, tests, window=4, carry=("text",), block_mb=block).collect():
            rows[r.doc_id, r.text, r.n_hit, tuple(map(tuple, r.matches)), tuple(map(tuple, r.spans))] += 1
        want = Counter()
        for d, text in docs:
            w, hit, matches = text.split(), set(), []
            for i, t in bench:
                v, best = t.split(), None
                for n in range(len(v), min(4, len(v)) - 1, -1):
                    found = [(j, a) for a in range(len(v) - n + 1) for j in range(len(w) - n + 1) if w[j : j + n] == v[a : a + n]]
                    if found and best is None:
                        best = (i, min(found)[1], min(found)[0], n)
                    hit |= {j + x for j, _ in found for x in range(n)}
                if best:
                    matches.append(best)
            edge = [j for j in sorted(hit) if j - 1 not in hit]
            spans = tuple((j, next(n for n in range(1, 99) if j + n not in hit)) for j in edge)
            want[d, text, len(hit), tuple(matches), spans] += 1
        assert rows == want


def thue_morse(n):
    """Two different words of 2 ** n letters whose polynomials modulo a power of two are the same for every odd base."""
    word = "a"
    for _ in range(n):
        word += word.translate({97: "b", 98: "a"})
    return word, word.translate({97: "b", 98: "a"})


def test_words_of_equal_polynomials_are_told_apart(spark):
    from lexiflow.llm.decontaminate import contamination
    from lexiflow.llm.minhash import near_duplicates

    one, two = thue_morse(11)
    rows = [(1, " ".join([one] * 13)), (2, " ".join([two] * 13)), (3, " ".join([one] * 13))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.n_removed for r in substring_dedup(docs, 13).collect()} == {1: 0, 2: 0, 3: 13}
    assert {r.doc_id: r.component_id for r in near_duplicates(docs, 3, 85).collect()} == {1: 1, 2: 2, 3: 1}
    assert {r.doc_id: r.n_hit for r in contamination(docs, spark.createDataFrame([(1, rows[0][1])], "item_id long, text string")).collect()} == {1: 13, 2: 0, 3: 13}
    a, b = (" ".join(w) for w in thue_morse(11))  # the same of words
    docs = spark.createDataFrame([(1, a), (2, b)], "doc_id long, text string")
    assert {r.component_id for r in near_duplicates(docs, 2048, 85).collect()} == {1, 2}


#: Words of 16 bytes that the unkeyed hashes of an earlier version could not tell apart, under the seeds of op1, op6 and op9.
TWINS = ["benchmarkquestio", "{2-(<S-jo*+l%3]", "vnjwq2igbcj37pz6", "1ehzf9mp5pmlu6t4"]


def test_words_made_to_collide_are_told_apart(spark):
    from lexiflow.llm.decontaminate import contamination
    from lexiflow.llm.minhash import near_duplicates

    rest = " ".join(f"w{i}" for i in range(12))
    rows = [(i, f"{w} {rest}") for i, w in enumerate(TWINS)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.n_removed for r in substring_dedup(docs, 13).collect()} == {0}
    alone = spark.createDataFrame([(i, w) for i, w in enumerate(TWINS)], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in near_duplicates(alone, 3, 85).collect()} == {i: i for i in range(4)}
    assert [r.n_hit for r in contamination(docs, spark.createDataFrame([(1, f"{TWINS[0]} {rest}")], "item_id long, text string")).orderBy("doc_id").collect()] == [13, 0, 0, 0]


def test_hashes_are_of_the_secret():
    """Lanes that collide under one secret, found with it, do not under another; no two of many words that differ in one lane collide."""
    from lexiflow.llm.textscan import Hasher

    rng = np.random.default_rng(1)
    one, other = Hasher(b"a" * 32, False), Hasher(b"b" * 32, False)
    data = np.frombuffer(b"".join(rng.integers(33, 127, 16).astype(np.uint8).tobytes() for _ in range(20_000)), np.uint8).copy()
    data = np.concatenate((data, np.concatenate([data.reshape(-1, 16)[:, :8], data.reshape(-1, 16)[::-1, 8:]], axis=1).reshape(-1)))
    starts = np.arange(0, len(data), 16)
    got = [h.words(data, starts, starts + 16) for h in (one, other)]
    words = len({data[s : s + 16].tobytes() for s in starts})
    assert len(set(got[0].tolist())) == len(set(got[1].tolist())) == words and not set(got[0].tolist()) & set(got[1].tolist())
    top = [np.flatnonzero(np.bincount((g >> np.uint64(48)).astype(np.int64)) > 4) for g in got]  # halves alone do collide, but not the same ones
    assert len(top[0]) != len(top[1]) or (top[0] != top[1]).any()


def test_a_book_inside_a_document_is_found_in_time(spark):
    import time

    from lexiflow.llm.decontaminate import contamination

    rng = np.random.default_rng(5)
    book = " ".join(f"w{i}" for i in rng.integers(0, 20_000, 100_000))
    same = " ".join(["la"] * 30_000)  # a single word, again and again, and a period of three
    three = " ".join(["do", "re", "mi"] * 8_000)
    docs = spark.createDataFrame([(1, "before " + book + " after"), (2, book[: len(book) // 2]), (3, same), (4, three + " " + three)], "doc_id long, text string")
    items = spark.createDataFrame([(1, book), (2, same[:30_000]), (3, three)], "item_id long, text string")
    began = time.time()
    got = {r.doc_id: r for r in contamination(docs, items).collect()}
    assert time.time() - began < 60
    assert (got[1].n_hit, got[1].longest, [tuple(m) for m in got[1].matches]) == (100_000, 100_000, [(1, 0, 1, 100_000)])
    assert got[2].longest >= 49_000 and got[2].matches[0].item_start == got[2].matches[0].doc_start == 0
    assert (got[3].longest, got[3].n_hit) == (10_000, 30_000) and (got[4].longest, got[4].n_hit) == (24_000, 48_000)


def test_kept_words_and_stretches():
    import pyarrow as pa

    from lexiflow.llm.textscan import SPACED, joined, scan, stretches

    rng = random.Random(7)
    texts = [rng.choice(["", " ", "\n a"]) + rng.choice([" ", "  ", "\n"]).join("é" * rng.randrange(4) + "x" for _ in range(rng.randrange(12))) + rng.choice(["", " \t"]) for _ in range(60)] + [None, "a", " "]
    found = scan(pa.array(texts), SPACED)
    for share in (0.0, 0.5, 1.0):
        keep = np.array([rng.random() < share for _ in found.starts], bool)
        made, spans, at = joined(found, keep).to_pylist(), stretches(~keep, found.first).to_pylist(), 0
        for text, got, gone in zip(texts, made, spans, strict=True):
            words = (text or "").encode().split()
            mine = keep[at : at + len(words)].tolist()
            at += len(words)
            assert got.encode() == b" ".join(w for w, k in zip(words, mine, strict=True) if k)
            inside = [x for s in gone for x in range(s["start"], s["start"] + s["length"])]
            assert inside == [i for i, k in enumerate(mine) if not k] and all(b["start"] > a["start"] + a["length"] for a, b in zip(gone, gone[1:], strict=False))


def test_fingerprints_that_share_one_half():
    from lexiflow.llm.substring_dedup import _grouped

    first, extra, doc = np.array([5, 5, 3, 5, 5], np.uint64), np.array([1, 2, 9, 1, 2], np.uint64), np.array([7, 4, 1, 2, 6])
    order = np.argsort(first, kind="stable")
    place, f, e, least = _grouped(first, extra, doc, order)
    assert list(zip(f.tolist(), e.tolist(), least.tolist(), strict=True)) == [(3, 9, 1), (5, 1, 2), (5, 2, 4)]
    group = np.empty(5, np.int64)
    group[order] = place
    assert group.tolist() == [1, 2, 0, 1, 2]


def test_word_hashes_are_of_the_bytes():
    import pyarrow as pa

    from lexiflow.llm.textscan import SPACED, hasher, scan

    rng = random.Random(3)
    words = ["".join(rng.choice("abAB\x00é語") for _ in range(n)) for n in (*range(1, 80), 5000)] * 2
    text = scan(pa.array([" ".join(words), words[3] + "\n" + words[70]]), SPACED)
    for fold in (False, True):
        got = hasher(bytes(range(32)), fold).words(text.data, text.starts, text.ends)
        key = lambda w: low(w) if fold else w.encode()
        assert len({(key(w), int(h)) for w, h in zip([*words, words[3], words[70]], got, strict=True)}) == len({key(w) for w in words}) == len(set(got.tolist()))


def _items(words):
    from lexiflow.llm.decontaminate import Items

    n = len(words)
    return Items(np.array([1], np.int64), words, np.zeros(n, np.int64), np.arange(n), n - np.arange(n))


def test_two_words_a_key_give_the_same(data, monkeypatch):
    import pyarrow as pa
    from pyspark.sql import types as T
    from pyspark.sql.pandas.types import to_arrow_schema

    from lexiflow.llm.decontaminate import RESULTS, Items, SuffixArray, _search

    items = type("Held", (), {"value": Items.of([i for i, t in data[2] if t], [t for _, t in data[2] if t], bytes(32))})
    batch = pa.record_batch([pa.array([d[0] for d in data[1]]), pa.array([d[1] for d in data[1]])], names=["doc_id", "text"])
    schema = to_arrow_schema(T.StructType([T.StructField("doc_id", T.LongType()), *RESULTS]))
    found = lambda: [b.to_pydict() for b in _search([items], 13, "text", schema, bytes(32))([batch])]
    want = found()
    monkeypatch.setattr(SuffixArray, "NARROW", 0)
    assert found() == want and any(n for b in want for n in b["n_hit"])


def test_op10(spark, data):
    phrases = {b"mit license": "mit", b"apache license": "apache", b"general public license": "gpl"}
    got = {r.doc_id: r for r in Q.op10_license_scan(spark, data[0]).collect()}
    for d, text, *_ in data[1]:
        w = ALNUM.findall(low(text))
        places = [(i, label) for p, label in phrases.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
        starts = [i for i, _ in places]
        r = got[d]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (len(w), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places})))
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1
    assert got[161].labels == "apache,gpl,mit" and got[161].permissive and got[160].permissive is False


def test_license_expressions():
    form = lambda t: evaluate(parse_expression(t))
    assert form("MIT OR GPL-2.0 AND Apache-2.0")[:2] == ("(MIT OR (GPL-2.0 AND Apache-2.0))", True)
    assert form("(MIT OR GPL-2.0) AND GPL-3.0 */")[1] is False
    assert form("GPL-2.0 WITH Classpath-exception-2.0 or BSD-3-Clause")[0] == "((GPL-2.0 WITH Classpath-exception-2.0) OR BSD-3-Clause)"
    assert form("LicenseRef-x AND mit-0 AND Artistic-2.0")[1:] == (False, {"custom", "mit", "artistic"})
    long_ = " OR ".join(["GPL-2.0"] * 50_000)
    assert form(long_)[1:] == (False, {"gpl"}) and form(long_)[0].count("GPL-2.0") == 50_000
    assert parse_expression("") is None and parse_expression("AND MIT") is None and parse_expression("(MIT") is None and parse_expression("MIT OR") is None


def test_near_dedup_stage_of_repeated_and_null_ids(spark, tmp_path):
    text = " ".join(f"w{i}" for i in range(30))
    rows = [(5, text, "a"), (5, text, "b"), (3, text, "c"), (None, text, "d"), (None, "other words stand here now", "e"), (7, "other words stand here now", "f"), (7, "and again some more words", "g"), (9, None, "h"), (9, "", "i")]
    spark.createDataFrame(rows, "doc_id long, text string, node string").repartition(2).write.parquet(f"{tmp_path}/docs")
    got = corpus_pipeline.near_dedup(spark, spark.read.parquet(f"{tmp_path}/docs"), "")
    assert got.columns == ["doc_id", "text", "node"] and sorted(r.node for r in got.collect()) == ["c", "f", "g", "h", "i"]


def test_rows_keep_their_numbers_however_the_table_is_read(spark, tmp_path):
    rng = random.Random(12)
    text = prose(rng, 40, EN)
    rows = [(i, text if i % 3 == 0 else prose(rng, 40, EN), "en", "s", 1) for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(8)
    docs.write.parquet(f"{tmp_path}/docs")
    docs, split = spark.read.parquet(f"{tmp_path}/docs"), "spark.sql.files.minPartitionNum"
    try:
        spark.conf.set(split, "1")
        kept = corpus_pipeline.near_dedup(spark, docs, str(tmp_path))
        spark.conf.set(split, "40")
        assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i in range(120) if i % 3 or i == 0)
    finally:
        spark.conf.unset(split)


@pytest.mark.parametrize("stage", corpus_pipeline.STAGES[:-1], ids=lambda s: s[0])
def test_columns_named_as_results_pass_every_stage(spark, data, stage):
    names = "lang_pred score margin accepted n_words n_removed kept_text removed_spans n_hit longest matches spans contaminated component_id kept n_shingles node label".split()
    docs = spark.read.parquet(f"{data[0]}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    from pyspark.sql import functions as F

    docs = docs.withColumns({n: F.concat(F.lit(f"{n}-"), F.col("doc_id")) for n in names})
    got = stage[1](spark, docs, data[0])
    assert got.columns == docs.columns and got.schema.simpleString() == docs.schema.simpleString()
    rows = got.collect()
    assert rows and all(r[n] == f"{n}-{r.doc_id}" for r in rows for n in names)


def test_pipeline_equals_brute_force(spark, data):
    import sys
    from pathlib import Path

    from lexiflow.llm.common import shared_dir

    sys.path.insert(0, str(Path(__file__).parent))
    from test_minhash import brute

    frame = spark.read.parquet(f"{data[0]}/documents.parquet").drop("n_words", "node")
    model = CompressionClassifier(sample_dictionaries(frame))
    docs = [(d, t) for d, t, *_ in data[1] if model.judge(t)[3]]
    kept = brute(docs, 5, 80)
    docs = [(d, t) for d, t in docs if kept[d][2]]
    cut = removed(docs, corpus_pipeline.PASSAGE)
    docs = [(d, cut[d][2].decode() if cut[d][1] else t) for d, t in docs]
    bad = hits(docs, data[2])
    docs = {d: t for d, t in docs if not bad[d][4]}
    before = set(Path(shared_dir(spark).removeprefix("file://")).iterdir())
    rows = corpus_pipeline.run(spark, data[0]).collect()
    left = sorted(p.name.split("-")[1] for p in set(Path(shared_dir(spark).removeprefix("file://")).iterdir()) - before)
    assert left == ["bases", "stage", "tokens"]  # what the last stage reads
    sizes = Counter()
    for r in rows:
        sizes[r.doc_id] += r.length
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(Q.tokenizer_path("word_bpe_49k.json"))
    assert sizes == {d: len(tokenizer.encode(t, add_special_tokens=False).ids) + 1 for d, t in docs.items()}
    assert any(cut[d][1] for d in cut) and any(b[4] for b in bad.values())
