"""Fixtures for completion, correction, confusion, prediction, learning, scanning, rules and the vocabulary build."""

import random

import pytest
from pyspark.sql import functions as F

from lexiflow.functions import text as X
from lexiflow.operators import complete, confuse, correct, learn, ngram, predict, rules, similarity, vocab_build

WORDS = "word string, freq long"
PAIRS = "first string, second string, cnt long"


def words(spark, **freq):
    return spark.createDataFrame([(w.replace("_", "'"), n) for w, n in freq.items()], WORDS)


def one(spark, column, **values):
    return spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items())).select(column).first()[0]


def completions(spark, vocabulary, prefix, k=5):
    rows = complete.complete(spark.createDataFrame([(prefix,)], "prefix string"), vocabulary, k=k).orderBy("rank").collect()
    return [r.word for r in rows]


def test_completion(spark):
    v = words(spark, the=1000, they=500, them=400, there=300, these=200, theory=100, dog=50)
    assert completions(spark, v, "The ") == ["the", "they", "them", "there", "these"]
    assert completions(spark, v, " ") == [] and completions(spark, v, "the", 0) == []
    assert completions(spark, words(spark, **{"and": 112359, "andrew": 263, "anderson": 209}), "and") == ["and"]
    assert completions(spark, words(spark, help=5282, hello=285, helpful=60), "hel") == ["help", "hello", "helpful"]
    assert completions(spark, words(spark, can_t=208, canterbury=90, canton=60, cantor=20), "cant")[0] == "can't"


def test_context_ranking(spark):
    v, b = words(spark, morning=100, more=900, money=500, good=1000), spark.createDataFrame([("good", "morning", 90), ("good", "more", 10)], PAIRS)
    rows = complete.complete(spark.createDataFrame([("mo", "good"), ("mo", None)], "prefix string, previous string"), v, b).collect()
    scores = {(r.previous, r.word): r.score for r in rows}
    assert scores["good", "morning"] == pytest.approx(0.642) and scores["good", "more"] == pytest.approx(0.178) and scores["", "more"] == pytest.approx(0.36)


def decide(spark, vocabulary, typed, previous=None, pairs=None, start=False, **more):
    ask = spark.createDataFrame([(typed, start, previous)], "typed string, is_sentence_start boolean, previous string")
    r = correct.autocorrect(ask, vocabulary, spark.createDataFrame(pairs, PAIRS) if pairs else None, **more).first()
    return r.corrected, r.reason


def test_autocorrect_rules(spark):
    v = words(spark, the=10000, keyboard=500, receive=400, separate=300, hello=900, cat=1000, cut=100, bear=500, beat=500, form=300, fort=200)
    users = spark.createDataFrame([("seecs",)], "word string")
    assert decide(spark, v, "teh") == ("the", "corrected")
    assert decide(spark, v, "Teh", start=True) == ("The", "corrected")
    assert decide(spark, v, "Teh")[1] == "looks like a name"
    assert decide(spark, v, "recieve") == ("receive", "corrected")
    assert decide(spark, v, "beap")[1] == "two words are too close to call"
    assert decide(spark, v, "the")[1] == "already a real word" and decide(spark, v, "")[1] == "not a word" and decide(spark, v, "a1")[1] == "has a digit in it"
    assert decide(spark, v, "zzzzzzz")[1] == "no close word found" and decide(spark, v, "teh", enabled=False)[1] == "autocorrect is off"
    assert decide(spark, v, "SEECS", user_words=users)[1] == "you added this word"
    assert decide(spark, v, "xeybord", fix_messy_words=False)[1] == "too messy to fix on its own"
    assert decide(spark, words(spark, bear=200, beat=100), "beap") == ("bear", "corrected")


def test_autocorrect_in_context(spark):
    v, b = words(spark, the=1000, than=100), [("more", "than", 50), ("more", "the", 1)]
    assert decide(spark, v, "thn", "more", b)[0] == "than" and decide(spark, v, "thn", None, b)[0] == "the" and decide(spark, v, "thn", "zebra", b)[0] == "the"
    assert decide(spark, words(spark, bear=100, beat=100), "beap", "polar", [("polar", "bear", 20)])[0] == "bear"
    assert decide(spark, words(spark, bake=50, back=5000), "bak", "come", [("come", "back", 300)])[0] == "back"
    assert decide(spark, words(spark, can_t=10, can=1000), "cant", "i", [("i", "can", 500)])[0] == "can't"
    assert decide(spark, words(spark, hello=100, help=1000), "helo", "say", [("say", "hello", 10), ("say", "help", 15)])[0] == "hello"


def test_corrections_order(spark):
    v = words(spark, the=1000, then=300, them=250, they=200, cat=500, cut=100, car=400, cart=90, hello=30, help=900, can_t=208, canto=6, can=10739, untie=20, until=400)
    got = {}
    typed = spark.createDataFrame([("teh",), ("cant",), ("helo",), ("cat",), (None,)], "typed string")
    for r in correct.find_corrections(typed, v).orderBy("typed", "rank").collect():
        got.setdefault(r.typed, []).append(r.word)
    assert got["teh"][0] == "the" and got["cant"][0] == "can't" and got["helo"][0] == "hello" and "cat" not in got and "" not in got


def test_similarity_strategies_agree(spark):
    rng = random.Random(8)
    made = lambda n: spark.createDataFrame([("".join(rng.choice("abcdefgh") for _ in range(rng.randrange(1, 8))),) for _ in range(n)], "w string")
    left, right = made(60).withColumnRenamed("w", "typed"), made(400).withColumnRenamed("w", "word")
    for k in (0, 1, 2):
        want = set(similarity.similarity_join(left, right, k, "scan").collect())
        assert want == set(similarity.similarity_join(left, right, k, "length").collect()) == set(similarity.similarity_join(left, right, k, "deletes").collect())
    assert similarity.similarity_join(left, right, -1).count() == 0


def test_similarity_of_long_words(spark):
    rng = random.Random(4)
    edit = lambda w: (lambda i: rng.choice([w[:i] + w[i + 1 :], w[:i] + "z" + w[i:], w[:i] + "q" + w[i + 1 :]]))(rng.randrange(len(w)))
    base = ["".join(rng.choice("ab") for _ in range(n)) for n in (20, 22, 23, 24, 25, 26, 27, 28, 40, 3000)] + ["ab" * 20, "a" * 27]
    typed = [edit(edit(w)) for w in base for _ in range(6)] + base
    left, right = spark.createDataFrame([(w,) for w in typed], "typed string"), spark.createDataFrame([(w,) for w in {*base, *map(edit, base)}], "word string")
    for k in (0, 1, 2):
        assert set(similarity.similarity_join(left, right, k).collect()) == set(similarity.similarity_join(left, right, k, "scan").collect())


def test_prediction(spark):
    v = words(spark, the=5000, good=1000, you=3000, **{"and": 4000})
    b = spark.createDataFrame([("good", "morning", 60), ("good", "night", 30), ("good", "luck", 8), ("thank", "you", 100), ("gone", "x", 0)], PAIRS)
    rows = predict.predict_next(spark.createDataFrame([("Good",), ("zebra",), ("gone",)], "previous string"), v, b, 2).collect()
    got = {(r.previous, r["rank"]): (r.word, r.is_fallback) for r in rows}
    assert got == {("good", 1): ("morning", False), ("good", 2): ("night", False), ("zebra", 1): ("the", True), ("zebra", 2): ("and", True), ("gone", 1): ("the", True), ("gone", 2): ("and", True)}
    total = ngram.bigram_probabilities(b).groupBy("first").agg(F.sum("probability").alias("p")).collect()
    assert all(r.p == pytest.approx(1) or r.first == "gone" for r in total)


def test_real_words(spark):
    b = spark.createDataFrame([("email", "from", 100), ("email", "form", 2), ("from", "the", 500), ("form", "the", 5), ("different", "form", 1), ("different", "from", 60), ("form", "of", 300), ("from", "of", 1)], PAIRS)
    v = spark.createDataFrame([("from", 1000), ("form", 200), ("the", 5000), ("of", 4000), ("email", 100), ("different", 100)], WORDS)
    ask = spark.createDataFrame([("email", "form", "the"), (None, "form", None), ("x", "dog", "y"), ("zz", "form", "qq")], "before string, word string, after string")
    got = {r.before: r for r in confuse.check_real_words(ask, v, b).collect()}
    assert got["email"].corrected == "from" and got["email"].advantage == pytest.approx(686, abs=1)
    assert (got[None].reason, got["x"].reason, got["zz"].reason) == ("nothing around it to go on", "not a word people mix up", "no alternative fits better")
    learned = spark.createDataFrame([("email", "form", 400), ("form", "the", 400)], PAIRS)
    with_learned = learn.apply_learned_pairs(b, learned)
    assert confuse.check_real_words(ask.limit(1), v, with_learned, learned).first().corrected == "from"


def test_learning(spark):
    v, b = words(spark, good=1000, morning=6, bye=65, night=54), spark.createDataFrame([("good", "bye", 65), ("good", "night", 54), ("good", "morning", 6)], PAIRS)
    none = spark.createDataFrame([], "word string")
    uses = spark.createDataFrame([("morning", "good"), ("teh", "good"), ("m0rning", None)], "word string, previous string")
    w, p = learn.learn_deltas(uses, v, none)
    assert {r.word: r.cnt for r in w.collect()} == {"morning": 25} and [tuple(r) for r in p.collect()] == [("good", "morning", 25)]
    after = learn.apply_learned(v, w)
    assert {r.word: r.freq for r in after.collect()}["morning"] == 31 and {r.word: r.freq for r in learn.undo_learned(after, w).collect()}["morning"] == 6
    assert {r.second: r.cnt for r in learn.apply_learned_pairs(b, p).collect()}["morning"] == 31
    merged = {r.word: r.freq for r in learn.merge_user_words(v, spark.createDataFrame([(" Nustian",), ("good",), ("a1",)], "word string")).collect()}
    assert merged["nustian"] == 100 and merged["good"] == 1000 and "a1" not in merged


def test_counts_and_edits_of_the_vocabulary(spark):
    v = ngram.insert_words(words(spark, the=10), spark.createDataFrame([(" THE ", 5), ("", 3), ("cat", 1)], WORDS))
    assert {r.word: r.freq for r in v.collect()} == {"the": 15, "cat": 1}
    assert {r.word: r.freq for r in ngram.set_frequencies(v, words(spark, cat=9, dog=2)).collect()} == {"the": 15, "cat": 9, "dog": 2}
    assert [r.word for r in ngram.remove_words(v, words(spark, The=0)).collect()] == ["cat"]
    assert tuple(ngram.vocab_stats(v.limit(0)).first()) == (0, 0, 0)


def test_scalars(spark):
    t, c = F.col("t"), F.col("c")
    assert one(spark, X.current_prefix(t, c), t="hello wor", c=9) == "wor" and one(spark, X.current_prefix(t, c), t="hello ", c=60) == ""
    assert one(spark, X.previous_word(t, c), t="The Quick brown fo", c=18) == "brown" and one(spark, X.previous_word(t, c), t="end. fo", c=7) is None
    assert one(spark, X.previous_word(t, c), t="covid 19 is", c=11) == "covid" and one(spark, X.word_at_caret(t, c), t="one two", c=5) == "two"
    assert [tuple(r) for r in one(spark, X.word_spans(t), t="it's a — día!")] == [("it's", 0), ("a", 5), ("día", 9)]
    assert [one(spark, X.is_sentence_start(t, c), t="Hi. (no) yes", c=n) for n in (0, 4, 5, 9)] == [True, True, False, False]
    assert tuple(one(spark, X.replacement_plan(t, c), t="cant ", c="can't ")) == (2, "'t ") and tuple(one(spark, X.replacement_plan(t, c), t="wor", c="world ")) == (0, "ld ")
    assert one(spark, X.levenshtein_with_limit(t, c, 1), t="kitten", c="sitting") == 2 and one(spark, X.levenshtein_with_limit(t, c, 3), t="kitten", c="sitting") == 3
    assert set(one(spark, X.letter_swaps(t), t="aab")) == {"aba"} and one(spark, X.letter_swaps(t), t="a") == []
    assert one(spark, X.apostrophe_insertions(t), t="its") == ["i'ts", "it's"] and "runing" in one(spark, X.double_letter_edits(t), t="running")
    near = lambda a, b: one(spark, X.is_one_edit_away(t, c), t=a, c=b)
    assert all(near("ab", w) for w in ("a", "b", "ba", "xb", "abz", "xab")) and near("it's", "its")
    assert not any(near(*w) for w in (("ab", "ab"), ("its", "it's"), ("abc", "bca"), ("ab", "abcd"), ("abcd", "badc")))
    assert one(spark, X.strip_wrapper(t), t="x\n*** START OF THE BOOK ***\nbody\n*** END OF THE BOOK ***\ny") == "body\n"


def test_rules(spark):
    t, e, n = F.col("t"), F.col("e"), F.col("n")
    assert one(spark, rules.looks_sensitive(t), t="Sign In - Bank") and not one(spark, rules.looks_sensitive(t), t=" ")
    assert one(spark, rules.is_code_window(t), t=" Code.EXE") and not one(spark, rules.is_code_window(t), t="decode")
    assert one(spark, rules.confirms_prefix(t, e), t="say wor", e="wor") and one(spark, rules.confirms_prefix(t, e), t="say wo", e="wor") and not one(spark, rules.confirms_prefix(t, e), t="swor", e="wor")
    assert one(spark, rules.is_known_text_class(t), t="RichEdit20W") and one(spark, rules.is_confusable(t), t="Their")
    assert one(spark, rules.check_predictions(t, e), t=True, e=False) == "NoSession"
    assert one(spark, rules.confirms_word(t, e, n), t=None, e="a", n=3) is False


def test_vocabulary_build(spark):
    web = spark.createDataFrame([("the", 200_000), ("environment", 60_000), ("enviroment", 20), ("im", 900), ("xii", 900), ("ot", 900), ("i", 900), ("abc", 9), ("wok", 1), ("email", 50), ("viagra", 70), ("wierd", 20), ("weird", 5000), ("zebra", 3)], "word string, raw long")
    valid = spark.createDataFrame([(w,) for w in "the environment enviroment im xii ot i abc wok viagra wierd weird zebra".split()], "word string")
    kept = {r.word: r.freq for r in vocab_build.filter_vocabulary(web, valid).collect()}
    assert set(kept) == {"the", "environment", "enviroment", "i", "wok", "email", "wierd", "weird", "zebra"} and kept["the"] == 200_000
    none = spark.createDataFrame([], "word string")
    bad = spark.createDataFrame([("zebra", "the")], "bad string, good string")
    books = spark.createDataFrame([("Don’t. don't; DON'T! can't",)], "text string")
    listed = spark.createDataFrame([("kubernetes",)], "word string")
    built = {r.word: r.freq for r in vocab_build.build_vocabulary(web, valid, none, bad, books, listed).collect()}
    assert "enviroment" not in built and "wierd" not in built and "zebra" not in built and built["don't"] == 3 and "can't" not in built and built["kubernetes"] == 30 and built["lol"] == 420
    exempt = spark.createDataFrame([("wierd",)], "word string")
    frame = spark.createDataFrame([("wierd", 20), ("weird", 5000)], WORDS)
    assert vocab_build.drop_misspellings(frame, exempt).count() == 2 and vocab_build.drop_misspellings(frame).count() == 1
    level = words(spark, abca=1, abcb=1, abcc=1, abd=1, zz=1, x=9)
    for most, left in ((5, "abcb abcc abd x zz"), (4, "abcc abd x zz"), (3, "abd x zz"), (2, "x zz"), (1, "x")):
        assert sorted(r.word for r in vocab_build.trim(level, words(spark, q=1), most).collect()) == left.split()
    small = vocab_build.trim(words(spark, b=1, a=1, c=2, d=9, e=1), words(spark, a=1), 3)
    assert sorted(r.word for r in small.collect()) == ["a", "c", "d"]
    pairs = spark.createDataFrame([("the", "weird", 10), ("the", "nope", 99), ("the", "the", 4)], "first string, second string, raw long")
    assert {r.second: r.cnt for r in vocab_build.scale_pairs(pairs, frame.union(words(spark, the=1))).collect()} == {"weird": 200_000, "the": 80_000}


def test_affixes(spark):
    text = "SFX S N 9\nSFX S 0 old .\nSFX S Y 2\nSFX S y ies/X [^aeiou]y\nSFX S 0 s [^y]\nPFX U Y 1\nPFX U 0 un .\nPFX N N 1\nPFX N t 0\nSFX\nother line\n"
    rules_ = vocab_build.affix_rules(spark, text)
    forms = lambda *rows: {r.word for r in vocab_build.expand_affixes(spark.createDataFrame(list(rows), "word string, flags string"), rules_).collect()}
    assert rules_.count() == 4 and forms(("tidy", "SU")) == {"tidy", "tidies", "untidy", "untidies"} and forms(("cat", "S"), ("Cat", None), (None, "S")) == {"cat", "cats"}
    assert forms(("try", "SN")) == {"try", "tries", "ry"} and forms(("dog", "QU")) == {"dog", "undog"} and forms() == set()


def test_case_scores(spark):
    cases = spark.createDataFrame([("teh", None, "the"), ("cat", "a", "cat"), ("qqq", None, "quick")], "typed string, previous string, expected string")
    done = correct.autocorrect(cases.select("typed", "previous"), words(spark, the=10, cat=5))
    assert tuple(correct.score_cases(cases, done).first()) == (1, 0, 1, 1)


def test_caret_boxes(spark):
    shape = "array<struct<left:double,top:double,width:double,height:double>>"
    df = spark.createDataFrame([([(1.0, 2.0, 3.0, 14.0), (5.0, 6.0, 7.0, 15.0)], "\n"), ([], "a"), (None, None), ([(9.0, 9.0, 2.0, 900.0)], "x")], f"b {shape}, c string")
    b = F.col("b")
    got = df.select(rules.box_from_caret(b).alias("a"), rules.box_from_char_before(b, F.col("c")).alias("x"), rules.box_from_char_after(b).alias("y")).collect()
    shown = lambda r: tuple(r) if r else None
    assert [tuple(map(shown, r)) for r in got] == [((5.0, 6.0, 0.0, 15.0), None, (1.0, 2.0, 0.0, 14.0)), (None,) * 3, (None,) * 3, ((9.0, 9.0, 0.0, 900.0), (11.0, 9.0, 0.0, 900.0), (9.0, 9.0, 0.0, 900.0))]
    one_box = "struct<left:double,top:double,width:double,height:double>"
    cases = [((5.0, 5.0, 0.0, 10.0), None, True), ((0.0, 0.0, 0.0, 10.0), None, False), ((5.0, 5.0, 0.0, 401.0), None, False), ((float("nan"), 5.0, 0.0, 9.0), None, False), (None, None, False)]
    cases += [((5.0, 5.0, 0.0, 10.0), (100.0, 0.0, 50.0, 50.0), False), ((60.0, 5.0, 0.0, 10.0), (100.0, 0.0, 50.0, 50.0), True), ((5.0, 5.0, 0.0, 10.0), (100.0, 0.0, 0.0, 50.0), True)]
    df = spark.createDataFrame([(a, f or (0.0, 0.0, 0.0, 0.0)) for a, f, _ in cases], f"a {one_box}, f {one_box}")
    assert [r[0] for r in df.select(rules.box_is_usable(F.col("a"), F.col("f"))).collect()] == [w for *_, w in cases]


def test_user_dictionary(spark):
    mine = spark.createDataFrame([("seecs",), (" Nustian",), ("",)], "word string")
    table, told = learn.add_user_words(mine, spark.createDataFrame([("SEECS",), ("qadees",), ("a1",), (None,)], "word string"))
    assert {tuple(r) for r in told.collect()} == {("seecs", False), ("qadees", True), ("a1", False), ("", False)}
    assert [r.word for r in learn.all_user_words(table).collect()] == ["nustian", "qadees", "seecs"]
    table, told = learn.remove_user_words(table, spark.createDataFrame([("Seecs",), ("the",)], "word string"))
    assert {tuple(r) for r in told.collect()} == {("seecs", True), ("the", False)} and table.count() == 2
    live = learn.live_vocabulary(words(spark, the=5, seecs=7), table, spark.createDataFrame([("seecs",)], "word string"))
    assert {tuple(r) for r in live.collect()} == {("the", 5), ("nustian", 100), ("qadees", 100)}


def test_replacements_and_separators(spark):
    t, w = F.col("t"), F.col("w")
    keys = lambda a, b: tuple(one(spark, X.replacement_keys(t, w), t=a, w=b))
    assert keys("teh", "the") == (True, 2, 2, 8, "he") and keys("the", "the") == (True, 0, 0, 0, "")
    assert keys("a", "") == (False, 0, 0, 0, None) and keys("a", "b" * 101)[0] is False and keys("a" * 101, "b")[0] is False and keys("a" * 100, "b")[0]
    got = {c: one(spark, X.is_word_separator(t), t=c) for c in (" ", ",", "a", "é", "'", "5", "\t", "\x7f", "-", "")}
    assert {c for c, ok in got.items() if ok} == {" ", ",", "-"}


def test_a_ranking_of_ones_own(spark):
    v = words(spark, the=1000, they=500, theory=100)
    rows = complete.complete(spark.createDataFrame([("th",)], "prefix string"), v, score=lambda freq, cnt, after, total: -freq.cast("double")).orderBy("rank").collect()
    assert [r.word for r in rows] == ["theory", "they", "the"]


def test_similarity_join_sends_no_side_to_all_tasks(spark):
    """What deletions leave of a small table may be large: a broadcast of it went through the driver; F7."""
    left = spark.createDataFrame([(f"word{i}",) for i in range(50)], "typed string")
    right = spark.createDataFrame([(f"wird{i}",) for i in range(50)] + [("w" * 30,)], "word string")
    found = similarity.similarity_join(left, right, 2)
    assert set(found.collect()) == set(similarity.similarity_join(left, right, 2, "scan").collect())
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()


def test_hashes_of_rests_stand_for_the_rests():
    from itertools import combinations

    words = ["", "a", "aab", "abab", "é😀é", "abcde", "xabc"]
    rests = [{"".join(c for i, c in enumerate(w) if i not in gone) for n in range(3) for gone in combinations(range(len(w)), n)} for w in words]
    hashes = [[] for _ in words]
    for row, _, found in similarity._rest_hashes(words, 2, (0x9E3779B97F4A7C15, 12345)):
        for r, h in zip(row.tolist(), found.tolist(), strict=True):
            hashes[r].append(h)
    assert [len(h) for h in hashes] == [len(r) for r in rests] and len({h for some in hashes for h in some}) == len(set().union(*rests))
    assert all(len(set(a) & set(b)) == len(x & y) for a, x in zip(hashes, rests, strict=True) for b, y in zip(hashes, rests, strict=True))


def test_completion_in_context_joins_no_prefix_with_all_its_words(spark):
    """Few contenders a pair of prefix and previous word, and the same rows as from all matches; F5."""
    rng = random.Random(1)
    some = sorted({"".join(rng.choice("ab'") for _ in range(rng.randrange(1, 7))) for _ in range(150)})
    v = spark.createDataFrame([(w, rng.choice([0, 1, 1, 2, 9, 50])) for w in some], "word string, freq long")
    pairs = {(rng.choice(some[:12]), rng.choice(some)): rng.choice([-2, 0, 1, 1, 5, 30]) for _ in range(200)}
    b = spark.createDataFrame([(*p, n) for p, n in sorted(pairs.items())], "first string, second string, cnt long")
    asked = spark.createDataFrame([(rng.choice(some)[: rng.choice([1, 2, 3])], rng.choice([*some[:15], "", None])) for _ in range(60)], "prefix string, previous string")
    want = complete.complete(asked, v, b, 3, lambda *x: complete.context_score(*x))  # a score of its own is taken of all matches
    assert set(complete.complete(asked, v, b, 3).collect()) == set(want.collect())
    one = spark.createDataFrame([("a", "none")], "prefix string, previous string")
    every = spark.createDataFrame([("a", f"a{i}", 1, 1) for i in range(500)], "prefix string, word string, freq long, src int")
    assert complete._contenders(one, every, v, b, 3).count() <= 3 + 2 * len(some)
