"""Rule classifiers over titles, processes, controls, prefixes and text before a caret, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions.text import norm


def _contains_any(text: Column, parts: list[str]) -> Column:
    return F.exists(F.array(*map(F.lit, parts)), lambda p: F.contains(text, p))


def looks_sensitive(title: Column) -> Column:
    return F.coalesce((norm(title) != "") & _contains_any(F.lower(title), C.SENSITIVE_TERMS), F.lit(False))


def is_code_window(process: Column) -> Column:
    return F.regexp_replace(norm(process), r"\.exe\z", "").isin(C.CODE_PROCESSES)


def takes_text(has_caret: Column, has_focus: Column, control: Column) -> Column:
    return F.when(has_caret, True).when(~has_focus, False).when(norm(control) == "", True).otherwise(~_contains_any(norm(control), C.NON_TEXT_CLASSES))


def is_known_text_class(control: Column) -> Column:
    return (norm(control) != "") & _contains_any(norm(control), C.TEXT_CLASSES + C.UNKNOWABLE_CLASSES)


def check_completions(prefix: Column, target: Column, start_known: Column) -> Column:
    return F.when(~target, "NotATextTarget").when(~start_known, "WordStartUnknown").when(F.length(F.coalesce(prefix, F.lit(""))) < C.MIN_PREFIX, "TooFewLetters").otherwise("None")


def check_predictions(target: Column, session_live: Column) -> Column:
    return F.when(~target, "NotATextTarget").when(~session_live, "NoSession").otherwise("None")


def should_show(refusal: Column) -> Column:
    return refusal == "None"


def confirms_word(before: Column, expected: Column, requested: Column) -> Column:
    last = before.substr(F.length(before) - F.length(expected), F.lit(1))
    whole = F.length(before) == F.length(expected)
    ok = F.when(whole, requested > F.length(expected)).otherwise(~last.rlike(r"[\p{L}\p{Nd}']"))
    return F.coalesce(before.isNotNull() & (F.coalesce(expected, F.lit("")) != "") & F.endswith(before, expected) & ok, F.lit(False))


def confirms_prefix(before: Column, prefix: Column) -> Column:
    asked = F.length(prefix) + 1
    shorter = F.left(prefix, F.length(prefix) - 1)
    return confirms_word(before, prefix, asked) | ((F.length(prefix) > 1) & confirms_word(before, shorter, asked))


def is_allowed_word(word: Column) -> Column:
    return F.coalesce(word, F.lit("")).rlike(r"^[\p{L}']+\z")


def is_confusable(word: Column) -> Column:
    return F.lower(word).isin([w for pair in C.CONFUSION_SETS for w in pair])


def _line(box: Column, left: Column) -> Column:
    return F.when(box.isNotNull(), F.struct(left.alias("left"), box["top"].alias("top"), F.lit(0.0).alias("width"), box["height"].alias("height")))


def box_from_caret(boxes: Column) -> Column:
    """The caret's rectangle (left, top, width, height) from its own boxes: the last one's left edge; null without any."""
    box = F.get(boxes, F.size(boxes) - 1)
    return _line(box, box["left"])


def box_from_char_before(boxes: Column, character: Column) -> Column:
    """The right edge of the character before the caret; null for a line break, whose box is on the line above."""
    box = F.get(boxes, F.size(boxes) - 1)
    return F.when(~F.coalesce(character.rlike(r"[\n\r]"), F.lit(False)), _line(box, box["left"] + box["width"]))


def box_from_char_after(boxes: Column) -> Column:
    """The left edge of the character after the caret."""
    box = F.get(boxes, F.lit(0))
    return _line(box, box["left"])


def box_is_usable(box: Column, field: Column | None = None) -> Column:
    """A caret rectangle that is finite, not at the origin, of a line's height and, where the field's rectangle has a size, inside it
    but for a margin."""
    left, top, height = box["left"], box["top"], box["height"]
    finite = ~F.exists(F.array(left, top, height), lambda x: F.isnan(x) | (F.abs(x) == float("inf")))
    sound = finite & ~((left == 0) & (top == 0)) & (height > 0) & (height <= C.MAX_LINE_HEIGHT)
    if field is not None:
        within = (left >= field["left"] - C.FIELD_MARGIN) & (left <= field["left"] + field["width"] + C.FIELD_MARGIN)
        within &= (top >= field["top"] - C.FIELD_MARGIN) & (top + height <= field["top"] + field["height"] + C.FIELD_MARGIN)
        sound &= (field["width"] <= 0) | (field["height"] <= 0) | within
    return F.coalesce(box.isNotNull() & sound, F.lit(False))
