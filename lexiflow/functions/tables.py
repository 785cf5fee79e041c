"""Table functions for SQL: forms of dictionary entries, and completions under any score."""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import udtf


class _Last:
    """Reverses the order of a text, so that of equal scores a heap gives up the larger word first."""

    def __init__(self, text: str):
        self.text = text

    def __lt__(self, other: _Last) -> bool:
        return self.text > other.text

    def __eq__(self, other: object) -> bool:
        return isinstance(other, _Last) and self.text == other.text


def affix_rows(aff: str) -> list[dict]:
    """The rules of an .aff text as rows, as affix_rules gives them; a handful for a table function to hold."""
    heads, body = {}, []
    for i, line in enumerate(aff.splitlines()):
        t = line.split()
        if line[:4] not in ("PFX ", "SFX ") or len(t) < 4:
            continue
        if len(t) == 4 and t[2] in ("Y", "N") and t[3].isdigit():
            heads[t[1]] = (i, t[0] == "SFX", t[2] == "Y")
        else:
            strip, add = ("" if x == "0" else x.split("/")[0] for x in t[2:4])
            body.append((i, t[1], {"strip": strip, "add": add, "condition": t[4] if len(t) > 4 else "."}))
    return [{"flag": f, "suffix": heads[f][1], "crosses": heads[f][2], **r} for i, f, r in body if f in heads and i > heads[f][0]]


@udtf(returnType="entry string, form string", useArrow=True)
class affix_forms:  # noqa: N801  it is called by this name in SQL
    """affix_forms(TABLE(entries), aff): for each row (word, flags) its distinct lower-cased forms under the rules of an .aff text, itself
    included. A null word has none; null flags are no flags; flags without a rule do nothing."""

    def __init__(self):
        self.text, self.rules = None, []

    def eval(self, row: Row, aff: str) -> Iterator[tuple[str, str]]:
        if aff != self.text:
            self.text, self.rules = aff, affix_rows(aff or "")
        word = row["word"]
        if word is None:
            return
        mine = [r for r in self.rules if r["flag"] in (row["flags"] or "")]
        forms, stems = {word}, [(word, True)]
        for r in mine:
            if r["suffix"] and word.endswith(r["strip"]) and re.search(f"(?:{r['condition']})$", word):
                forms.add(word.removesuffix(r["strip"]) + r["add"])
                stems.append((word.removesuffix(r["strip"]) + r["add"], r["crosses"]))
        for stem, crosses in stems:
            forms |= {r["add"] + stem[len(r["strip"]) :] for r in mine if not r["suffix"] and (stem is word or crosses and r["crosses"]) and re.match(f"(?:{r['condition']})", stem)}
        for form in sorted({f.lower() for f in forms}):
            yield word, form


@udtf(returnType="prefix string, word string, freq long, score double, rank long", useArrow=True)
class ranked_completions:  # noqa: N801
    """ranked_completions(TABLE(matches) PARTITION BY (prefix), k): the k rows (prefix, word, freq, score) of each prefix with the highest
    score, ties by word. The score is whatever the query computes. Rows with a null word or score take no part; k below 1 gives
    none. A partition's rows pass through a heap of k, so its size does not matter."""

    def __init__(self):
        self.heap, self.prefix, self.k = [], None, 0

    def eval(self, row: Row, k: int) -> None:
        self.prefix, self.k = row["prefix"], k
        if row["word"] is None or row["score"] is None or k < 1:
            return
        item = (float(row["score"]), _Last(row["word"]), row["freq"])
        if len(self.heap) < k:
            heapq.heappush(self.heap, item)
        else:
            heapq.heappushpop(self.heap, item)

    def terminate(self) -> Iterator[tuple]:
        best = sorted(self.heap, key=lambda x: (-x[0], x[1].text))
        for rank, (score, word, freq) in enumerate(best, 1):
            yield self.prefix, word.text, freq, score, rank


def register(spark: SparkSession) -> None:
    """Makes the table functions known to the session's SQL."""
    spark.udtf.register("affix_forms", affix_forms)
    spark.udtf.register("ranked_completions", ranked_completions)
