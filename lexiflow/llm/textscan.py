"""Vectorised word scanning and hashing over Arrow text columns.

Words are maximal runs of bytes of a class. The classes used here only ever exclude ASCII characters, so scanning UTF-8 bytes
gives the same words as scanning characters. Hashes are 64 bits and keyed by a secret that is drawn for each call of an operator, so no
text can be made to collide beforehand; they agree between the tasks of a call.
"""

from __future__ import annotations

import hashlib
import secrets
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
#: Words `[^\x20\x09-\x0D]+`.
SPACED = np.ones(256, bool)
SPACED[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
#: Words `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` of a text whose A-Z are lower-cased first.
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x41:0x5B] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True

_LOW = U(0xFFFFFFFF)
#: Bytes up to which words are hashed in lanes of eight; longer ones go through a keyed BLAKE2.
_LANES = 4
_BLOCK = 1 << 19
_KEEP = np.array([(1 << 8 * n) - 1 for n in range(8)] + [2**64 - 1], np.uint64)
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[0x41:0x5B] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (xor-shift and multiply)."""
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def fresh_secret() -> bytes:
    """A secret for one call of an operator, drawn on the driver and sent to tasks with their code."""
    return secrets.token_bytes(32)


class Hasher:
    """Word and word-run hashes under one secret; fold lower-cases A-Z.

    A word of up to 32 bytes has two 32-bit halves, each the upper half of a sum over its length and its lanes of 32 bits, times secret
    64-bit numbers of that half's own. So any two given words share a hash with a probability of 2^-64 over the secrets, whoever chose
    them; longer words go through BLAKE2 with the secret as its key. Runs of 1, 2, 4, ... words are joined by secret odd factors: two
    given runs share a hash with a probability below 2^-57.
    """

    def __init__(self, secret: bytes, fold: bool):
        rng = np.random.default_rng(np.frombuffer(hashlib.blake2b(secret, digest_size=32).digest(), np.uint32))
        self.fold, self.start, self.secret = fold, U(rng.integers(2**63)), secret
        self.keys = rng.integers(1, 2**64, 64, dtype=np.uint64) | U(1)
        self.halves = rng.integers(2**64, size=(2, 2 + 2 * _LANES), dtype=np.uint64)

    def words(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        data = np.concatenate((_FOLD[data] if self.fold else data, np.zeros(8, np.uint8)))
        eight = np.ndarray(len(data) - 7, "<u8", data, strides=(1,))  # the eight bytes from each place
        out = np.empty(len(starts), np.uint64)
        for a in range(0, len(starts), _BLOCK):
            s, n = starts[a : a + _BLOCK], (ends - starts)[a : a + _BLOCK]
            out[a : a + _BLOCK] = self._lanes(data, eight, s, n)
        return out

    def _lanes(self, data: np.ndarray, eight: np.ndarray, s: np.ndarray, n: np.ndarray) -> np.ndarray:
        sums = [k[0] + n.astype(np.uint64) * k[1] for k in self.halves]
        for lane in range(_LANES):
            more = np.flatnonzero(n > 8 * lane) if lane else slice(None)
            if lane and not len(more):
                break
            bytes_ = eight[s[more] + 8 * lane] & _KEEP[np.minimum(n[more] - 8 * lane, 8)]
            low, high = bytes_ & _LOW, bytes_ >> U(32)
            for total, k in zip(sums, self.halves, strict=True):
                total[more] += low * k[2 + 2 * lane] + high * k[3 + 2 * lane]
        out = (sums[0] & ~_LOW) | (sums[1] >> U(32))
        long_ = np.flatnonzero(n > 8 * _LANES)
        if len(long_):
            made = (hashlib.blake2b(data[b : b + m], digest_size=8, key=self.secret).digest() for b, m in zip(s[long_].tolist(), n[long_].tolist(), strict=True))
            out[long_] = np.frombuffer(b"".join(made), np.uint64)
        return out

    def runs(self, words: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
        """Hashes of the runs words[start : start + length], start ascending: those of 1, 2, 4, ... words are joined to the length."""
        out = np.empty(len(starts), np.uint64)
        for a in range(0, len(starts), _BLOCK):
            some = starts[a : a + _BLOCK]
            base = int(some[0])
            out[a : a + _BLOCK] = self._runs(words[base : int(some[-1]) + length], length)[some - base]
        return out

    def _runs(self, level: np.ndarray, length: int) -> np.ndarray:
        done, size, found = 0, 1, None
        places = len(level) - length + 1
        while True:
            if length & size:
                part = level[done : done + places]
                found = mix(part ^ self.start) if found is None else mix(found * self.keys[size.bit_length()] + part)
                done += size
            if done == length:
                return found
            level = mix(level[:-size] * self.keys[32 + size.bit_length()] + level[size:])
            size *= 2


@lru_cache(maxsize=8)
def hasher(secret: bytes, fold: bool = False) -> Hasher:
    return Hasher(secret, fold)


@dataclass
class Scan:
    """Words of several texts: byte spans, and for each text the index of its first word (one more entry at the end)."""

    data: np.ndarray
    offsets: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    def __len__(self) -> int:
        return len(self.first) - 1

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def text(self, i: int) -> bytes:
        return self.data[self.offsets[i] : self.offsets[i + 1]].tobytes()


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; a null counts as empty."""
    arr = pc.fill_null(column.cast(pa.large_string()), "")
    if isinstance(arr, pa.ChunkedArray):
        arr = pa.concat_arrays(arr.chunks) if arr.num_chunks else pa.array([], pa.large_string())
    _, offsets, data = arr.buffers()
    if not len(arr):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(offsets, np.int64)[arr.offset : arr.offset + len(arr) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def scan(column: pa.Array, kind: np.ndarray) -> Scan:
    """Finds the words of each text of a column."""
    data, offsets = text_bytes(column)
    inside = kind[data]
    edges = offsets[(offsets > 0) & (offsets < len(data))]
    before, after = np.empty_like(inside), np.empty_like(inside)
    if len(data):
        before[0], before[1:] = False, inside[:-1]
        after[-1], after[:-1] = False, inside[1:]
        before[edges], after[edges - 1] = False, False
    starts = np.flatnonzero(inside & ~before)
    return Scan(data, offsets, starts, np.flatnonzero(inside & ~after) + 1, np.searchsorted(starts, offsets))


def window_starts(first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Word index and text index of every window of `size` words that lies within one text."""
    n = np.maximum(np.diff(first) - size + 1, 0)
    text = np.repeat(np.arange(len(n)), n)
    inner = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    return first[:-1][text] + inner, text


def covered(n: int, starts: np.ndarray, lengths: np.ndarray | int) -> np.ndarray:
    """Which of n places lie in any of the spans."""
    delta = np.zeros(n + 1, np.int64)
    np.add.at(delta, starts, 1)
    np.add.at(delta, starts + lengths, -1)
    return np.cumsum(delta[:-1]) > 0


def stretches(inside: np.ndarray, first: np.ndarray) -> pa.ListArray:
    """The marked stretches of words of each text: start in the text and length."""
    at = np.flatnonzero(inside)
    text = np.searchsorted(first, at, "right") - 1
    new = np.ones(len(at), bool)
    new[1:] = (np.diff(at) > 1) | (np.diff(text) > 0)
    begin = np.flatnonzero(new)
    struct = pa.StructArray.from_arrays([pa.array(at[begin] - first[text[begin]]), pa.array(np.diff(np.append(begin, len(at))))], ["start", "length"])
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(text[begin], np.arange(len(first))), pa.int32()), struct)


def joined(found: Scan, keep: np.ndarray) -> pa.Array:
    """The kept words of each text, joined by one space."""
    starts, sizes = found.starts[keep], (found.ends - found.starts)[keep]
    first = np.concatenate(([0], np.cumsum(keep)))[found.first]  # of the kept words
    room = sizes + 1
    last = first[1:][np.diff(first) > 0] - 1
    room[last] -= 1  # no space behind a text's last word
    ends = np.cumsum(room)
    at = np.repeat(starts - (ends - room), room)
    at += np.arange(len(at))
    out = found.data[np.minimum(at, max(len(found.data) - 1, 0))] if len(at) else np.zeros(0, np.uint8)
    spaced = np.ones(len(ends), bool)
    spaced[last] = False
    out[ends[spaced] - 1] = 0x20
    offsets = np.concatenate(([0], ends))[first]
    return pa.LargeStringArray.from_buffers(len(found), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(out))
