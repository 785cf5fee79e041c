"""Scalar text functions as columns: normalising, scanning, edits, slips, replacement plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import constants as C

WORD = r"[\p{L}']+"
SENTENCE_END = "[.?!]"


def norm(c: Column) -> Column:
    """Key form: lower case without surrounding Unicode white space; null is empty."""
    return F.lower(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)^\s+|\s+$", ""))


def numbers(first: int, last: Column) -> Column:
    """first..last as an array; empty when last is below first (sequence would count down)."""
    return F.when(last >= first, F.sequence(F.lit(first), last.cast("int"))).otherwise(F.array().cast("array<int>"))


def find_words(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"({WORD})"), 1)


def sentence_words(text: Column) -> Column:
    """Lower-cased words of each sentence; previous words never cross `.`, `?` or `!`."""
    return F.transform(F.split(F.coalesce(text, F.lit("")), SENTENCE_END), lambda s: find_words(F.lower(s)))


def word_spans(text: Column) -> Column:
    """(word, start) of each word, start counted in characters from 0, from running sums of the pieces between words."""
    parts = F.split(F.coalesce(text, F.lit("")), rf"(?<=[\p{{L}}'])(?![\p{{L}}'])|(?<![\p{{L}}'])(?=[\p{{L}}'])")
    empty = F.array().cast("array<struct<word:string,start:int>>")
    state = F.struct(F.lit(0).alias("at"), empty.alias("out"))

    def step(acc: Column, part: Column) -> Column:
        found = F.array(F.struct(part.alias("word"), acc["at"].alias("start")))
        return F.struct((acc["at"] + F.length(part)).alias("at"), F.when(part.rlike(WORD), F.concat(acc["out"], found)).otherwise(acc["out"]).alias("out"))

    return F.aggregate(parts, state, step, lambda acc: acc["out"])


def before_caret(text: Column, caret: Column) -> Column:
    clean = F.coalesce(text, F.lit(""))
    return F.left(clean, F.greatest(F.lit(0), F.least(caret, F.length(clean))))


def current_prefix(text: Column, caret: Column) -> Column:
    return F.regexp_extract(before_caret(text, caret), r"[\p{L}']*\z", 0)


def current_word_start(text: Column, caret: Column) -> Column:
    return F.length(before_caret(text, caret)) - F.length(current_prefix(text, caret))


def previous_word(text: Column, caret: Column) -> Column:
    """Lower-cased word before the current one; null at a sentence end or without one."""
    head = F.left(before_caret(text, caret), current_word_start(text, caret))
    found = F.regexp_extract(head, rf"({WORD})[^\p{{L}}'.?!]*\z", 1)
    return F.when(found != "", F.lower(found))


def word_at_caret(text: Column, caret: Column) -> Column:
    tail = F.substring(F.coalesce(text, F.lit("")), F.length(before_caret(text, caret)) + 1, F.length(text))
    return F.concat(current_prefix(text, caret), F.regexp_extract(tail, r"\A[\p{L}']*", 0))


def is_sentence_start(text: Column, start: Column) -> Column:
    return before_caret(text, start).rlike(r"(?U)(^|[.?!])\s*\z")


def match_capitalization(original: Column, replacement: Column) -> Column:
    first = F.left(original, F.lit(1))
    no_lower = ~original.rlike(r"[\p{L}&&[^\p{Lu}]]")
    capital = F.concat(F.upper(F.left(replacement, F.lit(1))), F.substring(replacement, F.lit(2), F.length(replacement)))
    return F.when((F.length(original) > 1) & no_lower, F.upper(replacement)).when(first.rlike(r"\p{Lu}"), capital).otherwise(replacement)


def shared_prefix(a: Column, b: Column) -> Column:
    return F.size(F.filter(numbers(1, F.least(F.length(a), F.length(b))), lambda i: F.left(a, i) == F.left(b, i)))


def replacement_plan(typed: Column, wanted: Column) -> Column:
    """(backspaces, to_type) that turn typed into wanted."""
    same = shared_prefix(typed, wanted)
    return F.struct((F.length(typed) - same).alias("backspaces"), F.substring(wanted, same + 1, F.length(wanted)).alias("to_type"))


def is_word_separator(c: Column) -> Column:
    """Whether a single character ends a word: no control character, no letter or apostrophe, no digit."""
    return F.coalesce(c.rlike(r"\A[^\p{Cc}\p{L}'\p{Nd}]\z"), F.lit(False))


def replacement_keys(typed: Column, wanted: Column) -> Column:
    """(ok, deleted, typed, expected): the keys that a replacement sends, two events each; an empty replacement or more than
    MAX_REPLACEMENT characters on either side are refused, and what is right already needs none."""
    was = F.coalesce(typed, F.lit(""))
    plan = replacement_plan(was, wanted)
    refused = (F.coalesce(F.length(wanted), F.lit(0)) == 0) | (F.length(wanted) > C.MAX_REPLACEMENT) | (F.length(was) > C.MAX_REPLACEMENT)
    n = lambda c: F.when(refused, F.lit(0)).otherwise(c)
    return F.struct((~refused).alias("ok"), n(plan["backspaces"]).alias("deleted"), n(F.length(plan["to_type"])).alias("typed"), n(2 * (plan["backspaces"] + F.length(plan["to_type"]))).alias("expected"), F.when(~refused, plan["to_type"]).alias("to_type"))


def levenshtein_with_limit(a: Column, b: Column, k: int) -> Column:
    """Distance, or k + 1 beyond k; a negative k counts as 0."""
    k = max(0, k)
    d = F.levenshtein(F.coalesce(a, F.lit("")), F.coalesce(b, F.lit("")), k)
    return F.when(d < 0, F.lit(k + 1)).otherwise(d)


def max_distance(word: Column) -> Column:
    return F.when(F.length(word) <= C.SHORT_WORD, C.SHORT_DISTANCE).otherwise(C.LONG_DISTANCE)


def letter_swaps(word: Column) -> Column:
    """Words that come from exchanging two neighbouring unequal letters."""
    at = F.filter(numbers(1, F.length(word) - 1), lambda i: word.substr(i, F.lit(1)) != word.substr(i + 1, F.lit(1)))
    return F.transform(at, lambda i: F.concat(F.left(word, i - 1), word.substr(i + 1, F.lit(1)), word.substr(i, F.lit(1)), word.substr(i + 2, F.length(word))))


def apostrophe_insertions(word: Column) -> Column:
    """Words with an apostrophe put inside; none if there is one already."""
    made = F.transform(numbers(1, F.length(word) - 1), lambda i: F.concat(F.left(word, i), F.lit("'"), word.substr(i + 1, F.length(word))))
    return F.when(F.instr(word, "'") == 0, made).otherwise(F.array().cast("array<string>"))


def double_letter_edits(word: Column) -> Column:
    """Words with one letter doubled, or one of two equal neighbours dropped; none below four letters."""
    at = numbers(1, F.length(word))
    doubled = F.transform(at, lambda i: F.concat(F.left(word, i), word.substr(i, F.length(word))))
    pairs = F.filter(numbers(1, F.length(word) - 1), lambda i: word.substr(i, F.lit(1)) == word.substr(i + 1, F.lit(1)))
    dropped = F.transform(pairs, lambda i: F.concat(F.left(word, i), word.substr(i + 2, F.length(word))))
    return F.when(F.length(word) >= C.MIN_DOUBLE_LETTER, F.array_distinct(F.concat(doubled, dropped))).otherwise(F.array().cast("array<string>"))


def is_completion_of(typed: Column, word: Column) -> Column:
    return (F.length(typed) >= C.MIN_COMPLETION) & (F.length(word) > F.length(typed)) & word.startswith(typed)


def is_one_edit_away(word: Column, other: Column) -> Column:
    """Whether a deletion, a swap of neighbours, or a letter a-z put in or in the place of another turns word into other."""
    marks = lambda w: F.length(w) - F.length(F.translate(w, "'", ""))
    near = F.levenshtein(word, other, 2)
    return (near == 1) & (marks(other) <= marks(word)) | (near == 2) & F.array_contains(letter_swaps(word), other)


def deletions(word: Column, k: int) -> Column:
    """The word and what is left of it after up to k deletions."""
    drop = lambda w: F.transform(numbers(1, F.length(w)), lambda i: F.concat(F.left(w, i - 1), w.substr(i + 1, F.length(w))))
    level, out = F.array(word), F.array(word)
    for _ in range(k):
        level = F.array_distinct(F.flatten(F.transform(level, drop)))
        out = F.array_distinct(F.concat(out, level))
    return out


def slip_rank(apostrophe: Column, double: Column, swap: Column, completion: Column) -> Column:
    return F.when(apostrophe, 0).when(double, 1).when(swap, 2).when(completion, 3).otherwise(4)


def strip_wrapper(text: Column) -> Column:
    """What stands between a book's START and END markers, or all of it without them."""
    body = F.regexp_replace(text, r"(?s)\A.*?\*\*\* ?START OF[^\n]*\n", "")
    return F.regexp_replace(body, r"(?s)\*\*\* ?END OF.*\z", "")


def clean(text: Column) -> Column:
    """Curly quotes made straight, lower-cased."""
    return F.lower(F.translate(F.coalesce(text, F.lit("")), "‘’“”", "''\"\""))


def tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, sentence, pos, word, previous_word, next_word): neighbours come from the sentence's own array, without a shuffle."""
    per = docs.select(id_col, F.posexplode(sentence_words(F.col(text_col))).alias("sentence", "words"))
    flat = per.select(id_col, "sentence", "words", F.posexplode("words").alias("pos", "word"))
    return flat.select(id_col, "sentence", "pos", "word", F.get("words", F.col("pos") - 1).alias("previous_word"), F.get("words", F.col("pos") + 1).alias("next_word"))
