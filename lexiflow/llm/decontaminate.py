"""Benchmark decontamination with suffix arrays of the training text.

Each task cuts its documents into shards of a few megabytes and sorts the word suffixes of a shard: three-word keys first, then
prefix doubling over what is still tied. The ranks of each doubling are kept. Every suffix of every test item is then binary-searched in
the shard's array, all of them together: first with three words, then with twice as many, and so on, by the ranks of its two halves. Its
longest verbatim match is put together from such pieces, the long ones first, in a number of steps that grows with the logarithm of its
length. The suffixes that match alike share one interval of the array, and only distinct intervals are looked into.

What begins with a window of an item (an item of fewer words is one window) is a hit. The longest match of a document and an item
cannot be made longer to its left, so only pairs of places whose words before differ are measured: one for each stretch that two texts
share, however long it is. Test items are held in blocks of bounded size, all searched in one pass over
the documents, whose rows are judged where they lie: training text is never shuffled.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, chunks_by_bytes, frugal, whole
from .textscan import ALNUM, covered, fresh_secret, hasher, scan, stretches

MATCH = T.StructType([T.StructField(c, T.LongType()) for c in ("item_id", "item_start", "doc_start", "length")])
SPAN = T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length")])
RESULTS = [T.StructField(c, T.LongType()) for c in ("n_words", "n_hit", "longest")] + [T.StructField("matches", T.ArrayType(MATCH)), T.StructField("spans", T.ArrayType(SPAN)), T.StructField("contaminated", T.BooleanType())]
#: Pairs of places that are measured at once.
SLICE = 1 << 20


def word_hashes(column: pa.Array, secret: bytes):
    found = scan(column, ALNUM)
    return found, hasher(secret, fold=True).words(found.data, found.starts, found.ends)


@dataclass
class Items:
    """Words of the test items, joined, and for each suffix: its item, where it starts in it and how many words remain."""

    ids: np.ndarray
    words: np.ndarray
    item: np.ndarray
    inner: np.ndarray
    left: np.ndarray

    @classmethod
    def of(cls, ids: list[int], texts: list[str | None], secret: bytes) -> Items:
        found, words = word_hashes(pa.array(texts, pa.string()), secret)
        item = np.repeat(np.arange(len(ids)), found.counts)
        inner = np.arange(len(words)) - found.first[:-1][item]
        return cls(np.array(ids, np.int64), words, item, inner, found.counts[item] - inner)


def _spread(lo: np.ndarray, many: np.ndarray) -> np.ndarray:
    """All places of the intervals lo .. lo + many, one after the other."""
    return np.repeat(lo - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))


class SuffixArray:
    """Word suffixes of one shard in sorted order, as far as `depth` words; no suffix matches past the end of a document."""

    #: Distinct words up to which three words make a key of 63 bits; with more, two words do, of 31 bits each.
    NARROW = (1 << 21) - 3

    def __init__(self, words: np.ndarray, first: np.ndarray, depth: int):
        lengths = np.diff(first)
        self.start = first[:-1] + np.arange(len(lengths))  # one separator after each document
        at = np.arange(len(words)) + np.repeat(np.arange(len(lengths)), lengths)
        self.vocabulary, rank = np.unique(words, return_inverse=True)
        self.width, self.bits = (3, 21) if len(self.vocabulary) <= self.NARROW else (2, 31)
        n = len(words) + len(lengths)
        symbols = np.zeros(n + 3, np.int64)  # 0 is the separator
        symbols[at] = rank + 1
        self.size, self.symbols = n, symbols
        self.key = self._pack([symbols[i : n + 1 + i] for i in range(self.width)])
        self.order = np.argsort(self.key[:n])
        self.sorted_keys = self.key[self.order]
        self.key = np.concatenate((self.key, np.zeros(depth + 8, np.int64)))
        self.depth, self.ranks = depth, []
        self._refine(depth)

    def _pack(self, parts: list[np.ndarray]) -> np.ndarray:
        """Keys of up to `width` words; missing ones count as 0."""
        out = np.zeros(len(parts[0]), np.int64)
        for i, part in enumerate(parts):
            out |= part << (self.width - 1 - i) * self.bits
        return out

    def _refine(self, depth: int) -> None:
        n, done = self.size, self.width
        new = np.ones(n, bool)
        new[1:] = self.sorted_keys[1:] != self.sorted_keys[:-1]
        group = np.maximum.accumulate(np.where(new, np.arange(n), 0))  # a group's first place
        rank = np.empty(n + depth + 8, np.int64)
        rank[n:] = -1
        rank[self.order] = group
        self.ranks.append(rank.astype(np.int32))  # by their first `width` words; then by twice as many each
        while done < depth:
            tied = ~new
            tied[:-1] |= ~new[1:]
            places = np.flatnonzero(tied)
            if not len(places):
                break
            what = self.order[places]
            ranks = rank[what] << 32 | (rank[np.minimum(what + done, n)] + 1)
            by = np.argsort(ranks)
            self.order[places], ranks = what[by], ranks[by]
            new[places[1:]] |= ranks[1:] != ranks[:-1]
            group = np.maximum.accumulate(np.where(new, np.arange(n), 0))
            rank[self.order[places]] = group[places]
            self.ranks.append(rank.astype(np.int32))
            done *= 2

    def rank(self, level: int) -> np.ndarray:
        """First places of the groups that share width * 2**level words; where no two suffixes do any more, more words change nothing."""
        return self.ranks[min(level, len(self.ranks) - 1)]

    def _bound(self, values: np.ndarray, lo, hi, depth, key, right: bool):
        """The first place from lo on, before hi, whose value `depth` words later is not below the key (or is above it)."""
        lo, hi = lo.copy(), hi.copy()
        while len(lo) and (lo < hi).any():
            mid = (lo + hi) >> 1
            value = values[self.order[np.minimum(mid, self.size - 1)] + depth]
            up = (value <= key if right else value < key) & (lo < hi)
            lo, hi = np.where(up, mid + 1, lo), np.where(up | (lo >= hi), hi, mid)
        return lo

    def _narrowed(self, symbols, suffix, lo, hi, depth, width: int):
        """The intervals of those that go on with the next `width` words of each test suffix; empty where a word does not occur."""
        parts = [symbols[suffix + depth + i] for i in range(width)]
        known = np.logical_and.reduce([p > 0 for p in parts])
        low = self._pack([np.maximum(p, 0) for p in parts])
        high = low | ((1 << (self.width - width) * self.bits) - 1)
        first = self._bound(self.key, lo, hi, depth, low, False)
        return first, np.where(known, self._bound(self.key, first, hi, depth, high, True), first)


class Search:
    """The suffixes of test items in a shard. names: for each doubling, the interval of the places that begin with so many of their words."""

    def __init__(self, shard: SuffixArray, items: Items):
        self.shard, self.items, n = shard, items, len(items.words)
        place = np.searchsorted(shard.vocabulary, items.words)
        known = shard.vocabulary[np.minimum(place, len(shard.vocabulary) - 1)] == items.words
        self.symbols = np.concatenate((np.where(known, place + 1, -1), np.full(3, -1)))
        lo, hi = np.zeros(n, np.int32), np.zeros(n, np.int32)
        some = np.flatnonzero((items.left >= shard.width) & known)
        parts = [self.symbols[some + i] for i in range(shard.width)]
        fine = np.logical_and.reduce([p > 0 for p in parts])
        some, keys = some[fine], shard._pack([p[fine] for p in parts])
        lo[some], hi[some] = np.searchsorted(shard.sorted_keys, keys), np.searchsorted(shard.sorted_keys, keys, "right")
        self.names = [(shard.width, lo, hi)]

    def deepen(self, limit: int) -> None:
        """Names of up to `limit` words."""
        while self.names[-1][0] * 2 <= limit:
            words, lo, hi = self.names[-1]
            rank = self.shard.rank(len(self.names) - 1)
            some = np.flatnonzero((hi > lo) & (self.items.left >= 2 * words))
            some = some[hi[some + words] > lo[some + words]]
            key = lo[some + words]
            low = self.shard._bound(rank, lo[some].astype(np.int64), hi[some].astype(np.int64), words, key, False)
            high = self.shard._bound(rank, low, hi[some].astype(np.int64), words, key, True)
            lo, hi = np.zeros_like(lo), np.zeros_like(hi)
            lo[some], hi[some] = low, high
            self.names.append((2 * words, lo, hi))

    def longest(self, suffix: np.ndarray, most: np.ndarray):
        """The words of each test suffix's longest match, at most so many, and the interval of the places where that stands."""
        shard, n = self.shard, len(suffix)
        length, lo, hi = np.zeros(n, np.int64), np.zeros(n, np.int64), np.full(n, shard.size, np.int64)
        self.deepen(int(most.max(initial=0)))
        for level in range(len(self.names) - 1, -1, -1):
            words, low, high = self.names[level]
            ask = np.flatnonzero(most >= length + words)
            at = suffix[ask] + length[ask]
            fine = high[at] > low[at]
            ask, at = ask[fine], at[fine]
            first, last, inner = low[at].astype(np.int64), high[at].astype(np.int64), np.flatnonzero(length[ask])
            if len(inner):
                rank, some = shard.rank(level), ask[inner]
                first[inner] = shard._bound(rank, lo[some], hi[some], length[some], low[at[inner]], False)
                last[inner] = shard._bound(rank, first[inner], hi[some], length[some], low[at[inner]], True)
            got = last > first
            some = ask[got]
            lo[some], hi[some] = first[got], last[got]
            length[some] += words
        open_ = np.ones(n, bool)
        for width in range(shard.width - 1, 0, -1):  # what fails with more words is tried with fewer
            some = np.flatnonzero(open_ & (most >= length + width))
            first, last = shard._narrowed(self.symbols, suffix[some], lo[some], hi[some], length[some], width)
            some, first, last = some[last > first], first[last > first], last[last > first]
            lo[some], hi[some], open_[some] = first, last, False
            length[some] += width
        return length, lo, hi

    def shared(self, suffix: np.ndarray, place: np.ndarray, least: int) -> np.ndarray:
        """How many words test suffixes share with places of the shard, at least `least`."""
        length, left = np.full(len(suffix), least, np.int64), self.items.left[suffix]
        for level in range(len(self.names) - 1, -1, -1):
            words, low, high = self.names[level]
            ask = np.flatnonzero(left >= length + words)
            at = suffix[ask] + length[ask]
            same = (high[at] > low[at]) & (self.shard.rank(level)[place[ask] + length[ask]] == low[at])
            length[ask[same]] += words
        for _ in range(self.shard.width - 1):
            ask = np.flatnonzero(left > length)
            same = self.shard.symbols[place[ask] + length[ask]] == self.symbols[suffix[ask] + length[ask]]
            length[ask[same]] += 1
        return length


class _Found:
    """What one block of items gives for the documents of a shard."""

    def __init__(self, shard: SuffixArray, tests: Items, window: int):
        self.shard, self.tests = shard, tests
        self.places, self.lengths = [], []  # suffixes of the shard that begin with a window
        self.best = np.zeros((4, 0), np.int64)  # document * items + item, place in the document, in the item, words
        search, every = Search(shard, tests), np.arange(len(tests.words))
        length, lo, hi = search.longest(every, np.minimum(tests.left, window))
        full = np.flatnonzero(length == window)
        if len(full):
            search.deepen(int(tests.left[full].max()))
            self._stretches(search, full, *self._intervals(lo[full], hi[full], window), window)
        short = np.flatnonzero((tests.inner == 0) & (tests.left < window) & (length == tests.left))
        for size in np.unique(tests.left[short]).tolist():
            some = short[tests.left[short] == size]
            self._whole(some, *self._intervals(lo[some], hi[some], size), size)

    def _intervals(self, lo, hi, size: int):
        """Intervals of one depth are equal or apart: the places of the distinct ones, which interval each has, and each suffix's."""
        lo, first, of = np.unique(lo, return_index=True, return_inverse=True)
        many = hi[first] - lo
        places = self.shard.order[_spread(lo, many)]
        self.places.append(places)
        self.lengths.append(np.full(len(places), size))
        return places, np.repeat(np.arange(len(lo)), many), of

    def _document(self, places: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.shard.start, places, "right") - 1

    def _stretches(self, search: Search, suffix, places, interval, of, window: int) -> None:
        """Measures the pairs of test suffixes and places that share a window and have different words before."""
        span = len(self.shard.vocabulary) + 2
        before = np.where(places > 0, self.shard.symbols[places - 1], 0)  # 0 at a document's beginning
        by = np.argsort(interval * span + before, kind="stable")
        places, keys = places[by], (interval * span + before)[by]
        mine = np.where(self.tests.inner[suffix] > 0, search.symbols[suffix - 1], 0)
        mine = np.where(mine > 0, mine, span - 1)  # what no place has
        cuts = [np.searchsorted(keys, of * span + x, side) for x, side in ((0, "left"), (mine, "left"), (mine, "right"), (span, "left"))]
        many = cuts[1] - cuts[0] + cuts[3] - cuts[2]
        total, a = np.cumsum(many), 0
        while a < len(suffix):
            b = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + SLICE, "right")))
            at = np.concatenate([_spread(x[a:b], (y - x)[a:b]) for x, y in (cuts[:2], cuts[2:])])
            who = np.concatenate([np.repeat(suffix[a:b], (y - x)[a:b]) for x, y in (cuts[:2], cuts[2:])])
            self._keep(places[at], who, search.shared(who, places[at], window))
            a = b

    def _whole(self, suffix, places, interval, of, size: int) -> None:
        """Items that are one window: the first place in each document."""
        by = np.lexsort((places, interval))
        places, interval = places[by], interval[by]
        doc = self._document(places)
        first = np.ones(len(places), bool)
        first[1:] = (interval[1:] != interval[:-1]) | (doc[1:] != doc[:-1])
        places, interval = places[first], interval[first]
        lo, hi = np.searchsorted(interval, of), np.searchsorted(interval, of, "right")
        total, a = np.cumsum(hi - lo), 0
        while a < len(suffix):
            b = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + SLICE, "right")))
            at = _spread(lo[a:b], (hi - lo)[a:b])
            self._keep(places[at], np.repeat(suffix[a:b], (hi - lo)[a:b]), np.full(len(at), size))
            a = b

    def _keep(self, places, suffix, length) -> None:
        """The longest match of each document and item; of equally long ones the first in the document, then in the item."""
        doc = self._document(places)
        new = np.stack((doc * len(self.tests.ids) + self.tests.item[suffix], places - doc, self.tests.inner[suffix], length))
        new = np.concatenate((self.best, new), axis=1)
        new = new[:, np.lexsort((new[2], new[1], -new[3], new[0]))]
        one = np.ones(new.shape[1], bool)
        one[1:] = new[0][1:] != new[0][:-1]
        self.best = new[:, one]


def _judged(found, words: np.ndarray, blocks, window: int) -> dict:
    """n_words, n_hit, longest, matches, spans and contaminated of each document of a shard."""
    first, shard, drop = found.first, None, np.zeros(len(words), bool)
    doc, made = np.zeros(0, np.int64), [np.zeros(0, np.int64) for _ in MATCH]
    for block in blocks if len(words) else ():
        tests: Items = block.value
        depth = max(window, int((tests.left + tests.inner).max(initial=1)))
        if shard is None or shard.depth < depth:
            shard = SuffixArray(words, first, depth)
        got = _Found(shard, tests, window) if len(tests.words) else None
        if got is not None and got.best.shape[1]:
            pairs, at, inner, length = got.best
            d, item = pairs // len(tests.ids), pairs % len(tests.ids)
            doc = np.concatenate((doc, d))
            made = [np.concatenate(x) for x in zip(made, (tests.ids[item], inner, at - first[:-1][d], length), strict=True)]
            places, lengths = np.concatenate(got.places), np.concatenate(got.lengths)
            drop |= covered(len(words), places - (np.searchsorted(shard.start, places, "right") - 1), lengths)
        if len(blocks) > 1:
            vars(block).pop("_value", None)  # one block at a time
    by = np.lexsort((made[1], made[2], made[0], doc))
    doc, made = doc[by], [x[by] for x in made]
    longest = np.zeros(len(found), np.int64)
    np.maximum.at(longest, doc, made[3])
    hit = np.diff(np.concatenate(([0], np.cumsum(drop)))[first])
    struct = pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in made], [f.name for f in MATCH])
    matches = pa.ListArray.from_arrays(pa.array(np.searchsorted(doc, np.arange(len(found) + 1)), pa.int32()), struct)
    plain = {"n_words": found.counts, "n_hit": hit, "longest": longest, "contaminated": (hit > 0) & (20 * hit >= found.counts)}
    return {k: pa.array(v) for k, v in plain.items()} | {"matches": matches, "spans": stretches(drop, first)}


def _search(blocks, window: int, text: str, schema: pa.Schema, secret: bytes):
    results = {f.name for f in RESULTS}

    def run(batches):
        for batch in chunks_by_bytes(batches, text):
            made = _judged(*word_hashes(batch.column(text), secret), blocks, window)
            yield pa.record_batch([whole(made[f.name] if f.name in results else batch.column(f.name)).cast(f.type) for f in schema], schema=schema)

    return run


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 13, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", block_mb: float = 8.0, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: id, the carried columns, n_words, n_hit (words inside an occurrence of a test window), longest (words of the
    longest verbatim match of at least a window), matches (the longest one of each item that has a window in the document: item, start in
    the item, start in the document, length; the first of equally long ones), spans (hit words: start, length) and contaminated (n_hit > 0 and at least a
    twentieth of the words).

    Words are lower-cased (A-Z) runs of digits, letters and non-ASCII characters. An item of fewer words than a window is one
    window; one without words or with a null id or text matches nothing. Null and empty documents have no words; null and repeated ids
    and repeated rows are judged row by row; texts may be of any length, a document is searched whole. An empty benchmark hits nothing and an
    empty table gives no rows. Items that repeat an id are matched one by one. Items are held in blocks of `block_mb` of text, of which a
    task loads one at a time (an item is never cut, so a longer one is a block of its own); all are searched in a single pass. Words are
    compared by 64-bit hashes under a secret of the call: two given words share one with a probability of 2^-64, whoever chose them. Carried columns that are named as a result are left out.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    spark = docs.sparkSession
    bounded_batches(spark)
    tests = benchmark.select(F.col(item_col).cast("long").alias("id"), F.col(item_text).alias("t")).filter("id is not null and t is not null")
    secret, blocks, ids, texts, size = fresh_secret(), [], [], [], 0

    def close() -> None:
        blocks.append(spark.sparkContext.broadcast(Items.of(ids, texts, secret)))
        ids.clear(), texts.clear()

    for row in tests.orderBy("id", "t").toLocalIterator():  # a block's text at a time
        ids.append(row["id"]), texts.append(row["t"])
        size += len(row["t"].encode())
        if size > block_mb * 1e6:
            close()
            size = 0
    if ids or not blocks:
        close()
    names = {f.name for f in RESULTS}
    kept = [c for c in dict.fromkeys([id_col, *carry]) if c not in names]
    part = docs.select(*dict.fromkeys([*kept, text_col]))
    shape = T.StructType([*part.select(*kept).schema, *RESULTS])
    return part.mapInArrow(frugal(_search(blocks, window, text_col, to_arrow_schema(shape), secret)), shape)


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 13, text_col: str = "text", **more) -> DataFrame:
    """The rows of docs without the contaminated ones, each judged by its own text (all columns, whatever their names)."""
    inner = [f"__lf_{i}" for i in range(len(docs.columns))]
    named = docs.toDF(*inner)
    judged = contamination(named, benchmark, window, inner[0], inner[docs.columns.index(text_col)], carry=tuple(inner), **more)
    return judged.filter("not contaminated").select(*inner).toDF(*docs.columns)
