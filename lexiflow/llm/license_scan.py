"""License scan: one Aho-Corasick pass over each text's words, then a shunting-yard parser for licence expressions.

Patterns are sequences of words: notice phrases and SPDX identifiers' own words, matched only as whole consecutive words. Where the
identifier tag stands, the rest of its line is parsed as an expression of identifiers with AND, OR, WITH and parentheses. Patterns
are a fixed table of a few dozen entries.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, frugal

#: Phrases whose places are counted, with their labels.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Further notice phrases, with their labels.
NOTICES = {
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "redistribution and use in source and binary forms": "bsd",
    "bsd license": "bsd",
    "neither the name of the copyright holder nor the names of its contributors": "bsd",
    "licensed under the apache license version 2 0": "apache",
    "free software foundation either version": "gpl",
    "permission to use copy modify and or distribute this software for any purpose": "isc",
    "this software is provided as is without any express or implied warranty": "zlib",
    "lesser general public license": "lgpl",
    "library general public license": "lgpl",
    "affero general public license": "agpl",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "isc license": "isc",
    "boost software license": "bsl",
    "creative commons attribution": "cc-by",
    "creative commons attribution sharealike": "cc-by-sa",
    "creative commons attribution noncommercial": "cc-by-nc",
    "common development and distribution license": "cddl",
    "server side public license": "sspl",
    "business source license": "busl",
    "artistic license": "artistic",
    "do what the fuck you want to public license": "wtfpl",
    "python software foundation license": "psf",
    "open software license": "osl",
    "sil open font license": "ofl",
    "cc by 4 0": "cc-by",
    "cc0 1 0 universal": "cc0",
    "released into the public domain": "public-domain",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "all rights reserved": "proprietary",
}
#: Beginnings of SPDX identifiers, with their labels; the longest that fits is taken.
IDENTIFIERS = {
    "mit": "mit",
    "mit-": "mit",
    "apache-": "apache",
    "gpl-": "gpl",
    "lgpl-": "lgpl",
    "agpl-": "agpl",
    "bsd-": "bsd",
    "mpl-": "mpl",
    "epl-": "epl",
    "isc": "isc",
    "bsl-": "bsl",
    "cc-by-": "cc-by",
    "cc-by-sa-": "cc-by-sa",
    "cc-by-nc-": "cc-by-nc",
    "cc-by-nd-": "cc-by-nd",
    "cc0-": "cc0",
    "unlicense": "unlicense",
    "0bsd": "bsd",
    "zlib": "zlib",
    "artistic-": "artistic",
    "cddl-": "cddl",
    "wtfpl": "wtfpl",
    "psf-": "psf",
    "python-": "psf",
    "osl-": "osl",
    "afl-": "afl",
    "ofl-": "ofl",
    "eupl-": "eupl",
    "sspl-": "sspl",
    "busl-": "busl",
    "ms-pl": "ms-pl",
    "postgresql": "postgresql",
    "ncsa": "ncsa",
    "x11": "x11",
    "licenseref-": "custom",
}
#: Labels that allow use without passing their own terms on.
PERMISSIVE = {"mit", "apache", "bsd", "isc", "bsl", "zlib", "cc0", "unlicense", "public-domain", "cc-by", "wtfpl", "psf", "afl", "postgresql", "ncsa", "x11"}

TAG = "spdx license identifier"
_SEPARATORS = bytes(c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))
_TAG = re.compile(r"spdx-license-identifier\s*:\s*([^\n\r]*)", re.I)
_TOKEN = re.compile(r"\(|\)|[A-Za-z0-9.+\-:]+")
RESULT = "__lf_id long, n_words long, places array<struct<pattern:string,label:string,word:long,base:boolean>>, expressions array<struct<expression:string,permissive:boolean,labels:array<string>>>"


def identifier_label(name: str) -> str | None:
    name = name.lower()
    fits = [k for k in IDENTIFIERS if name == k or k.endswith("-") and name.startswith(k)]
    return IDENTIFIERS[max(fits, key=len)] if fits else None


def parse_expression(text: str) -> list[str] | None:
    """An expression in postfix order by the shunting-yard method: WITH binds before AND, AND before OR. It ends where the text
    stops being one; None if it holds no whole expression."""
    rank = {"OR": 1, "AND": 2, "WITH": 3}
    out: list[str] = []
    stack: list[str] = []
    operand_next = True
    for token in _TOKEN.findall(text):
        word = token.upper()
        if operand_next:
            if token == "(":
                stack.append(token)
            elif word in rank or token == ")":
                return None
            else:
                out.append(token)
                operand_next = False
        elif word in rank:
            while stack and stack[-1] != "(" and rank[stack[-1]] >= rank[word]:
                out.append(stack.pop())
            stack.append(word)
            operand_next = True
        elif token == ")":
            while stack and stack[-1] != "(":
                out.append(stack.pop())
            if not stack:
                break
            stack.pop()
        else:
            break
    if operand_next or "(" in stack:
        return None
    return out + stack[::-1]


def evaluate(postfix: list[str]) -> tuple[str, bool, set[str]]:
    """Canonical form, whether some choice of its alternatives is permissive throughout, and the labels that occur."""
    stack: list[tuple[object, bool]] = []  # the tree, and whether it is permissive
    labels: set[str] = set()
    for i, token in enumerate(postfix):
        if token in ("OR", "AND", "WITH"):
            b, a = stack.pop(), stack.pop()
            good = a[1] or b[1] if token == "OR" else a[1] and b[1] if token == "AND" else a[1]
            stack.append(((a[0], token, b[0]), good))
        else:
            label = identifier_label(token)
            stack.append((token, label in PERMISSIVE))
            if label and postfix[i + 1 : i + 2] != ["WITH"]:  # what follows WITH is an exception, no licence
                labels.add(label)
    out, todo = [], [stack[0][0]]
    while todo:  # written out piece by piece, as a chain may be long
        part = todo.pop()
        if isinstance(part, tuple):
            todo += [")", part[2], f" {part[1]} ", part[0], "("]
        else:
            out.append(part)
    return "".join(out), stack[0][1], labels


class Scanner:
    """The automaton; made anew in each Python worker."""

    def __init__(self):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for phrase, label in {**NOTICES, **BASE}.items():
            self.automaton.add_word(f" {phrase} ", (phrase, label, phrase in BASE))
        self.automaton.add_word(f" {TAG} ", (TAG, None, False))
        self.automaton.make_automaton()

    def scan(self, text: str | None) -> tuple[int, list[dict], list[dict]]:
        words = (text or "").encode().translate(_SEPARATORS).split()
        if not words:
            return 0, [], []
        line = (b" " + b" ".join(words) + b" ").decode("latin-1")  # one character a byte; patterns are ASCII
        places, tagged, at, word = [], False, 0, 0
        for end, (phrase, label, base) in self.automaton.iter(line):
            start = end - len(phrase) - 1
            if start >= at:
                word, at = word + line.count(" ", at, start), start
                here = word
            else:
                here = word - line.count(" ", start, at)
            if label is None:
                tagged = True
            else:
                places.append({"pattern": phrase, "label": label, "word": here, "base": base})
        found = []
        if tagged:
            for m in _TAG.finditer(text):
                if postfix := parse_expression(m[1]):
                    form, good, labels = evaluate(postfix)
                    found.append({"expression": form, "permissive": good, "labels": sorted(labels)})
        return len(words), sorted(places, key=lambda p: (p["word"], p["pattern"])), found


def _run(schema: pa.Schema):
    def run(batches):
        scanner = Scanner()
        for batch in batches:
            rows = [scanner.scan(t) for t in batch.column(1).to_pylist()]
            n, places, found = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.record_batch([batch.column(0), *(pa.array(x, f.type) for x, f in zip((n, places, found), list(schema)[1:], strict=True))], schema=schema)

    return run


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_words, places (pattern, label, first word's index from 0, whether a base phrase), expressions
    (canonical form, permissive, labels), labels (all, sorted), permissive (no expression or notice with a label outside PERMISSIVE
    unless an expression offers a permissive choice; null without labels) and score (0 without finds; else 1 - 1/2^n for n finds,
    an expression counting as three).

    Words are lower-cased (A-Z) runs of digits, letters and non-ASCII characters. Null and empty texts have none; texts and expressions may be
    of any length and are scanned whole. Rows are judged one by one, so null and repeated ids and repeated rows give a result each;
    overlapping phrases all count, in the order of their first words, then of their texts. An empty table gives none; other columns are ignored.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    spark = docs.sparkSession
    part = docs.select(F.col(id_col).cast("long").alias("__lf_id"), F.col(text_col).alias("__lf_text"))
    schema = spark.createDataFrame([], RESULT).schema
    bounded_batches(spark)
    found = part.mapInArrow(frugal(_run(to_arrow_schema(schema))), schema)
    by_place, by_expression = F.transform("places", lambda p: p["label"]), F.flatten(F.transform("expressions", lambda e: e["labels"]))
    labels = F.array_sort(F.array_distinct(F.concat(by_place, by_expression)))
    finds = F.size("places") + 3 * F.size("expressions")
    all_good = F.forall(by_place, lambda x: x.isin(*sorted(PERMISSIVE))) & F.forall("expressions", lambda e: e["permissive"])
    return found.select(F.col("__lf_id").alias(id_col), "n_words", "places", "expressions", labels.alias("labels"), F.when(F.size(labels) > 0, all_good).alias("permissive"), (1 - F.pow(F.lit(2.0), -finds)).alias("score"))
