"""Exact substring deduplication behind a count-min prefilter.

Documents are dealt to buckets by a hash of their id and text, so that null or repeated ids spread, once; every pass works on a bucket. A bucket's count-min sketch (one row
of counters, sparse: the counters it touched and whether once or more) is cut into ranges of counters. Each range is merged by
one task, which adds the sketches of all buckets and answers each bucket with one bit a counter: estimated to be repeated or
not. Estimates are never too low, so a window whose counter is not flagged is unique. In the second pass only windows that are
estimated to be repeated are grouped, by 128-bit fingerprints of their words (two hashes of words and runs under two secrets of the call; over 10^13 windows,
some two different ones share a fingerprint with a probability below 10^-8, whoever chose them): a bucket sends each distinct one once, with its smallest document
id, and gets back whether a smaller id has it elsewhere. The last pass removes the words.

Messages between buckets and ranges would grow with the square of their number. So beyond DIRECT buckets they go by relays: a relay
stands between about as many buckets as it stands before ranges, the square root of their number; it merges its buckets' messages
before it passes them on, and deals the answers out again. So messages grow with the power 1.5, and each still holds over a hundred windows at
100 TB of text.

Nothing is broadcast; the sketch grows with the input (32 counters for about every six bytes of text) but a task only ever
holds its own range. Hot passages and groups of copies are reduced to one entry a bucket before they are sent.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, frugal_group, text_megabytes, whole
from .textscan import SPACED, U, covered, fresh_secret, hasher, joined, scan, stretches, window_starts

BUCKET, SHARD, KIND, BLOB = "__lf_bucket", "__lf_shard", "__lf_kind", "__lf_blob"
MESSAGE = f"{SHARD} long, {BUCKET} long, {KIND} int, {BLOB} binary"
LAST = np.iinfo(np.int64).max
#: Buckets up to which messages go to the ranges directly.
DIRECT = 1024


class _Plan:
    """What every task knows: window size, secrets of the hashes, counters (a power of two) and the number of shards."""

    def __init__(self, window: int, megabytes: float, bucket_mb: float):
        self.window, self.secrets = window, (fresh_secret(), fresh_secret())
        self.buckets = max(4, math.ceil(megabytes / bucket_mb))
        self.bits = max(20, math.ceil(math.log2(max(1.0, megabytes * 1e6 / 6 * 32))))
        self.width = -(-(1 << self.bits) // self.buckets)  # counters of a shard
        self.fan = 1 if self.buckets <= DIRECT else math.isqrt(self.buckets - 1) + 1  # buckets, and shards, of a relay
        self.groups = -(-self.buckets // self.fan)

    def windows(self, table: pa.Table, text: str):
        found = scan(whole(table.column(text)), SPACED)
        one = hasher(self.secrets[0])
        words = one.words(found.data, found.starts, found.ends)
        at, doc = window_starts(found.first, self.window)
        return found, at, doc, one.runs(words, at, self.window)

    def counters(self, hashes: np.ndarray) -> np.ndarray:
        return (hashes >> U(64 - self.bits)).astype(np.int64)

    def addressed(self, bucket: int, counters: np.ndarray):
        """For the sorted counters of a bucket: (address, first counter, from, to) of each group of shards that has any. The address is that of
        the relay between the bucket and the group, or without relays that of the shard."""
        cuts = np.searchsorted(counters, np.arange(self.groups + 1) * self.fan * self.width)
        row = bucket // self.fan * self.groups if self.fan > 1 else 0
        return [(row + g, g * self.fan * self.width, a, b) for g, (a, b) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)) if b > a]

    def shards(self, relay: int, counters: np.ndarray):
        """The same for the shards behind a relay."""
        first = relay % self.groups * self.fan
        cuts = np.searchsorted(counters, np.arange(first, first + self.fan + 1) * self.width)
        return [(first + i, (first + i) * self.width, a, b) for i, (a, b) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)) if b > a]


def _pack(counters: np.ndarray, again: np.ndarray) -> bytes:
    """Sorted counters as 16-bit differences with a list of overflows, then one bit each for `seen again`."""
    delta = np.diff(counters, prepend=0)
    over = np.flatnonzero(delta > 0xFFFF)
    head = np.array([len(counters), len(over)], np.int64)
    return b"".join(x.tobytes() for x in (head, (delta & 0xFFFF).astype(np.uint16), over.astype(np.uint32), delta[over] >> 16, np.packbits(again)))


def _unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    n, m = np.frombuffer(blob, np.int64, 2)
    delta = np.frombuffer(blob, np.uint16, n, 16).astype(np.int64)
    over = np.frombuffer(blob, np.uint32, m, 16 + 2 * n)
    delta[over] += np.frombuffer(blob[16 + 2 * n + 4 * m :], np.int64, m) << 16
    return np.cumsum(delta), np.unpackbits(np.frombuffer(blob, np.uint8, offset=16 + 2 * n + 12 * m), count=n)


def _messages(rows: list[tuple[int, int, int, bytes]]) -> pa.Table:
    cols = list(zip(*rows, strict=True)) or [(), (), (), ()]
    return pa.table({SHARD: pa.array(cols[0], pa.int64()), BUCKET: pa.array(cols[1], pa.int64()), KIND: pa.array(cols[2], pa.int32()), BLOB: pa.array(cols[3], pa.binary())})


def _bits(table: pa.Table, kind: int) -> np.ndarray:
    """The answers of one kind to a bucket, in the order of shards."""
    rows = sorted((s, b) for s, k, b in zip(*(table.column(c).to_pylist() for c in (SHARD, KIND, BLOB)), strict=True) if k == kind)
    parts = [np.unpackbits(np.frombuffer(b, np.uint8, offset=8), count=int(np.frombuffer(b, np.int64, 1)[0])) for _, b in rows]
    return np.concatenate(parts).astype(bool) if parts else np.zeros(0, bool)


def _answer(bits: np.ndarray) -> bytes:
    return np.int64(len(bits)).tobytes() + np.packbits(bits).tobytes()


def _ids(table: pa.Table, id_col: str) -> np.ndarray:
    return whole(table.column(id_col)).cast(pa.int64()).fill_null(LAST).to_numpy(zero_copy_only=False)


def _grouped(first: np.ndarray, extra: np.ndarray, doc: np.ndarray, order: np.ndarray):
    """Of fingerprints that `order` sorts by `first`: the group of each, in that order, and the groups' fingerprints and smallest documents.
    order is sorted by `extra` as well where two fingerprints share the one and not the other."""
    f, e = first[order], extra[order]
    same = f[1:] == f[:-1]
    if (same & (e[1:] != e[:-1])).any():
        order[:] = np.lexsort((extra, first))
        f, e = first[order], extra[order]
        same = f[1:] == f[:-1]
    new = np.ones(len(order), bool)
    new[1:] = ~same | (e[1:] != e[:-1])
    begin = np.flatnonzero(new)
    least = np.minimum.reduceat(doc[order], begin) if len(begin) else np.zeros(0, np.int64)
    return np.cumsum(new) - 1, f[new], e[new], least


class _Repeats:
    """Windows of a bucket that are estimated to be repeated, as sorted distinct fingerprints with their smallest document."""

    def __init__(self, plan: _Plan, table: pa.Table, flags: np.ndarray, id_col: str, text: str):
        self.scan, at, doc, hashes = plan.windows(table, text)
        order = np.argsort(hashes)
        counters = plan.counters(hashes[order])  # in order too, as they are the first bits
        new = np.ones(len(order), bool)
        new[1:] = counters[1:] != counters[:-1]
        order = order[flags[np.cumsum(new) - 1]]
        hit = np.zeros(len(hashes), bool)
        hit[order] = True
        number = np.cumsum(hit) - 1  # of a window among the flagged ones, in the order of the text
        self.at, self.doc = at[hit], _ids(table, id_col)[doc[hit]]
        first, order = hashes[hit], number[order]
        other = hasher(plan.secrets[1])
        extra = other.runs(other.words(self.scan.data, self.scan.starts, self.scan.ends), self.at, plan.window)
        place, self.first, self.extra, self.least = _grouped(first, extra, self.doc, order)
        self.group = np.empty(len(order), np.int64)
        self.group[order] = place


def _sketch(plan: _Plan, text: str):
    def run(key, table):
        *_, hashes = plan.windows(table, text)
        counters = plan.counters(np.sort(hashes))
        begin = np.flatnonzero(np.concatenate(([True], counters[1:] != counters[:-1]))) if len(counters) else np.zeros(0, np.int64)
        counters, count = counters[begin], np.diff(np.append(begin, len(counters)))
        bucket = key[0].as_py()
        return _messages([(to, bucket, 0, _pack(counters[a:b] - base, count[a:b] > 1)) for to, base, a, b in plan.addressed(bucket, counters)])

    return run


def _merge(plan: _Plan):
    def run(key, table):
        sums = np.zeros(plan.width, np.uint8)
        blobs, buckets, shard = table.column(BLOB), table.column(BUCKET).to_pylist(), key[0].as_py()
        for blob in blobs:
            at, again = _unpack(blob.as_py())
            sums[at] = np.minimum(sums[at] + 1 + again, 2)  # only `more than once` matters, so counters saturate
        return _messages([(shard, bucket, 1, _answer(sums[_unpack(blob.as_py())[0]] > 1)) for bucket, blob in zip(buckets, blobs, strict=True)])

    return run


def _ask(plan: _Plan, id_col: str, text: str):
    def run(key, table, flags):
        got = _Repeats(plan, table, _bits(flags, 1), id_col, text)
        bucket = key[0].as_py()
        return _messages([(to, bucket, 2, _request(got.first[a:b], got.extra[a:b], got.least[a:b])) for to, _, a, b in plan.addressed(bucket, plan.counters(got.first))])

    return run


def _request(first: np.ndarray, extra: np.ndarray, least: np.ndarray) -> bytes:
    docs, index = np.unique(least, return_inverse=True)
    small = index.astype(np.uint16 if len(docs) <= 1 << 16 else np.uint32)
    return b"".join(x.tobytes() for x in (np.array([len(first), len(docs)], np.int64), first, extra, docs, small))


def _requests(blob: bytes):
    n, m = np.frombuffer(blob, np.int64, 2)
    first, extra, docs = np.frombuffer(blob, np.uint64, n, 16), np.frombuffer(blob, np.uint64, n, 16 + 8 * n), np.frombuffer(blob, np.int64, m, 16 + 16 * n)
    index = np.frombuffer(blob, np.uint16 if m <= 1 << 16 else np.uint32, n, 16 + 16 * n + 8 * m)
    return first, extra, docs[index]


class _Joined:
    """The requests of several senders: distinct fingerprints with their smallest documents, and the place of each request among them."""

    def __init__(self, table: pa.Table):
        self.senders, parts = table.column(BUCKET).to_pylist(), [_requests(b.as_py()) for b in table.column(BLOB)]
        first, extra, self.doc = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64))
        order = np.argsort(first)
        place, self.first, self.extra, self.least = _grouped(first, extra, self.doc, order)
        self.place = np.empty(len(order), np.int64)
        self.place[order] = place
        self.cuts = np.cumsum([0, *(len(p[0]) for p in parts)])

    def dealt(self, address: int, kind: int, bits: np.ndarray) -> pa.Table:
        """Bits of all requests, in order, as one answer to each sender."""
        return _messages([(address, sender, kind, _answer(bits[a:b])) for sender, a, b in zip(self.senders, self.cuts[:-1], self.cuts[1:], strict=True)])


def _group(key, table):
    all_ = _Joined(table)
    return all_.dealt(key[0].as_py(), 3, all_.least[all_.place] < all_.doc)


def _union(table: pa.Table) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """The distinct counters of several senders, whether each was seen again, and the counters of each sender."""
    parts = [_unpack(b.as_py()) for b in table.column(BLOB)]
    counters, place = np.unique(np.concatenate([c for c, _ in parts]) if parts else np.zeros(0, np.int64), return_inverse=True)
    times = np.bincount(place, np.concatenate([1 + again for _, again in parts]) if parts else None, minlength=len(counters))
    return counters, times > 1, [c for c, _ in parts]


def _relay_sketches(plan: _Plan):
    def run(key, table):
        relay = key[0].as_py()
        counters, again, _ = _union(table)
        counters += relay % plan.groups * plan.fan * plan.width
        return _messages([(s, relay, 0, _pack(counters[a:b] - base, again[a:b])) for s, base, a, b in plan.shards(relay, counters)])

    return run


def _relay_flags(plan: _Plan):
    def run(key, table, flags):
        counters, _, parts = _union(table)
        bits = _bits(flags, 1)
        return _messages([(key[0].as_py() % plan.groups, sender, 1, _answer(bits[np.searchsorted(counters, part)])) for sender, part in zip(table.column(BUCKET).to_pylist(), parts, strict=True)])

    return run


def _relay_requests(plan: _Plan):
    def run(key, table):
        relay, all_ = key[0].as_py(), _Joined(table)
        return _messages([(s, relay, 2, _request(all_.first[a:b], all_.extra[a:b], all_.least[a:b])) for s, _, a, b in plan.shards(relay, plan.counters(all_.first))])

    return run


def _relay_known(plan: _Plan):
    def run(key, table, known):
        all_ = _Joined(table)
        return all_.dealt(key[0].as_py() % plan.groups, 3, _bits(known, 3)[all_.place] | (all_.least[all_.place] < all_.doc))

    return run


def _remove(plan: _Plan, id_col: str, text: str, carry: list[str], schema: pa.Schema):
    def run(key, table, answers):
        got = _Repeats(plan, table, _bits(answers, 1), id_col, text)
        elsewhere = _bits(answers, 3)
        gone = (got.doc > got.least[got.group]) | elsewhere[got.group] if len(got.group) else np.zeros(0, bool)
        first = got.scan.first
        drop = covered(int(first[-1]), got.at[gone], plan.window)
        removed = np.diff(np.concatenate(([0], np.cumsum(drop)))[first])
        made = {"n_words": pa.array(got.scan.counts), "n_removed": pa.array(removed), "kept_text": joined(got.scan, ~drop), "removed_spans": stretches(drop, first)}
        return pa.table([whole(made[f.name] if f.name in made else table.column(f.name)).cast(f.type) for f in schema], schema=schema)

    return run


def substring_dedup(docs: DataFrame, window: int = 13, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = (), bucket_mb: float = 4.0) -> DataFrame:
    """Removes words covered by a window of `window` words that also starts in a document with a smaller id.

    Words are runs without ASCII white space, unchanged; windows are judged on the input. One row per input row: id, the carried
    columns, n_words, n_removed, kept_text (kept words joined by one space) and removed_spans (word start and length). A null or
    empty text has no words; a null id counts as larger than any other; rows with the same id never remove each other's words;
    texts of fewer than `window` words lose nothing; texts and words may be of any length, as a text is worked on whole in its bucket; an
    empty table gives no rows. Carried columns that are named as a result are left out.
    """
    results = [T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_text", T.StringType()), T.StructField("removed_spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("length", T.LongType())])))]
    taken = {f.name for f in results}
    extra = [c for c in dict.fromkeys(carry) if c not in taken | {id_col}]
    fields = [c for c in dict.fromkeys([id_col, text_col, *extra])]
    bounded_batches(docs.sparkSession)
    plan = _Plan(window, text_megabytes(docs, text_col), bucket_mb)
    dealt = docs.select(*fields).withColumn(BUCKET, F.pmod(F.xxhash64(F.col(id_col), F.col(text_col)), F.lit(plan.buckets))).repartition(plan.buckets, BUCKET)
    shape = T.StructType([f for f in docs.select(id_col, *extra).schema] + results)
    from pyspark.sql.pandas.types import to_arrow_schema

    of_bucket, made = dealt.groupBy(BUCKET), lambda groups, run: groups.applyInArrow(frugal_group(run), MESSAGE)

    def answered(sent: DataFrame, up, merge, down) -> DataFrame:
        """What the shards answer to messages, through relays if there are any."""
        if plan.fan == 1:
            return made(sent.groupBy(SHARD), merge)
        back = made(made(sent.groupBy(SHARD), up(plan)).groupBy(SHARD), merge)
        return made(sent.groupBy(SHARD).cogroup(back.groupBy(BUCKET)), down(plan))

    flags = answered(made(of_bucket, _sketch(plan, text_col)), _relay_sketches, _merge(plan), _relay_flags)
    asked = made(of_bucket.cogroup(flags.groupBy(BUCKET)), _ask(plan, id_col, text_col))
    known = answered(asked, _relay_requests, _group, _relay_known)
    answers = flags.unionByName(known)
    return of_bucket.cogroup(answers.groupBy(BUCKET)).applyInArrow(frugal_group(_remove(plan, id_col, text_col, extra, to_arrow_schema(shape))), shape)
