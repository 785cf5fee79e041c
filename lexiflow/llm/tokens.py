"""Fast, exact encoding with public tokenizers: a batch of texts is cut into words, and each distinct word is encoded once.

Everything is done for a whole batch with arrays: words of up to 15 bytes are two 64-bit numbers, looked up together in an open
hash table; what is not known yet is merged together by the tokenizer's own merge list, one merge of every part a round. Words outside
the settled cases go through the tokenizers library.
"""

from __future__ import annotations

import json
import re
from codecs import charmap_decode

import numpy as np
import pyarrow as pa
import regex

from .common import HELD
from .textscan import _KEEP, SPACED, U, scan, text_bytes

#: White space outside ASCII (in UTF-8), which the byte-level pattern may join with ASCII white space.
_WIDE_SPACE = re.compile(rb"\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80")
_WIDE_LEAD = np.isin(np.arange(256), [0xC2, 0xE1, 0xE2, 0xE3])
#: The tokenizers' own splits inside a word, for characters below U+0130 (whose classes and cases are settled).
_INSIDE = {
    "word": regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+"),
    "byte": regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"),
}
_FIRST_UNSETTLED = "İ"
_ASCII_LETTER = np.array([b < 128 and chr(b).isalpha() for b in range(256)])
#: ASCII marks which, behind letters, every tokenizer here splits off as one part.
_MARK = np.array([0x21 <= b < 0x7F and not chr(b).isalnum() and chr(b) != "'" for b in range(256)])
#: Bytes of the longest word that the table holds, and symbols of the longest part that is merged in arrays.
_SHORT, _PART = 15, 64
#: Parts are merged together with others of about their length.
_WIDTHS = [(0, 1), (1, 4), (4, 6), (6, 8), (8, 10), (10, 13), (13, 17), (17, 32), (32, _PART)]
#: The table is emptied beyond so many entries.
MOST_ENTRIES = 400_000
_NONE = 1 << 30


def _byte_letters() -> dict[int, str]:
    """The letter that byte-level models use for each byte: printable ones stand for themselves, the others follow from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


_LETTERS = "".join(letter for _, letter in sorted(_byte_letters().items()))


def _mapped(data: bytes) -> str:
    return charmap_decode(data, "strict", _LETTERS)[0]


def _grown(array: np.ndarray, size: int) -> np.ndarray:
    return array if size <= len(array) else np.concatenate((array, np.zeros(max(size, 2 * len(array)) - len(array), array.dtype)))


def _without(column: pa.Array, gone: list[int]) -> pa.Array:
    """The texts with some of them empty, from their bytes: pyarrow's if_else garbles arrays that are slices of others."""
    data, offsets = text_bytes(column)
    sizes, kept = np.diff(offsets), np.ones(len(column), bool)
    kept[gone] = False
    ends = np.concatenate(([0], np.cumsum(sizes * kept))).astype(np.int64)
    return pa.LargeStringArray.from_buffers(len(column), pa.py_buffer(ends), pa.py_buffer(data[np.repeat(kept, sizes)]))


class _Slots:
    """Open addressing from pairs of 64-bit keys to numbers; all keys of a batch are looked up or added together. Half of the slots stay free."""

    def __init__(self, bits: int):
        self.a, self.b = np.zeros(1 << 12, np.uint64), np.zeros(1 << 12, np.uint64)
        self.used = 0
        self._empty(bits)

    def _empty(self, bits: int) -> None:
        self.shift, self.mask = U(64 - bits), (1 << bits) - 1
        self.slot = np.full(1 << bits, -1, np.int32)

    def _place(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        at = a * U(0x9E3779B97F4A7C15) ^ b * U(0xC2B2AE3D27D4EB4F)
        at ^= at >> U(32)
        at *= U(0xD6E8FEB86659FD93)
        return (at >> self.shift).astype(np.int64)

    def find(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The number of each key, -1 for unknown ones."""
        at = self._place(a, b)
        out = self.slot[at]
        wrong = np.flatnonzero((out >= 0) & ((self.a[out] != a) | (self.b[out] != b)))
        while len(wrong):
            at[wrong] = (at[wrong] + 1) & self.mask
            got = out[wrong] = self.slot[at[wrong]]
            wrong = wrong[(got >= 0) & ((self.a[got] != a[wrong]) | (self.b[got] != b[wrong]))]
        return out

    def add(self, a: np.ndarray, b: np.ndarray, numbers: np.ndarray) -> None:
        """Distinct keys that are not there yet."""
        size = int(numbers.max(initial=0)) + 1
        self.a, self.b = _grown(self.a, size), _grown(self.b, size)
        self.a[numbers], self.b[numbers] = a, b
        self.used += len(numbers)
        if 2 * self.used > len(self.slot):  # a single text may bring any number of words
            numbers = np.concatenate((self.slot[self.slot >= 0], numbers))
            a, b = self.a[numbers], self.b[numbers]
            self._empty((2 * self.used).bit_length())
        at, todo = self._place(a, b), np.arange(len(a))
        while len(todo):
            free = todo[self.slot[at[todo]] < 0]
            self.slot[at[free]] = numbers[free]
            todo = todo[self.slot[at[todo]] != numbers[todo]]
            at[todo] = (at[todo] + 1) & self.mask


class _Merges:
    """A merge list applied to many parts at once. A part's bytes are its first symbols; its last one may have a form of its own."""

    def __init__(self, model: dict):
        vocab, suffix = model["vocab"], model.get("end_of_word_suffix") or ""
        pairs = list(dict.fromkeys(tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]))
        self.made = np.array([vocab[x + y] for x, y in pairs], np.uint32)
        self.ranks = _Slots(18)
        self.ranks.add(self._pair(np.array([vocab[x] for x, _ in pairs], np.uint32), np.array([vocab[y] for _, y in pairs], np.uint32)), np.zeros(len(pairs), np.uint64), np.arange(len(pairs)))
        self.inner = np.array([vocab.get(c, _NONE) for c in _LETTERS], np.uint32)
        self.last = np.array([vocab.get(c + suffix, _NONE) for c in _LETTERS], np.uint32)

    @staticmethod
    def knows(model: dict) -> bool:
        odd = ("dropout", "continuing_subword_prefix", "byte_fallback", "ignore_merges")
        return model["type"] == "BPE" and not any(model.get(k) for k in odd) and all(c + s in model["vocab"] for c in _LETTERS for s in {"", model.get("end_of_word_suffix") or ""})

    @staticmethod
    def _pair(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return x.astype(np.uint64) << U(32) | y

    def _keys(self, x: np.ndarray, y: np.ndarray, row: np.ndarray | int) -> np.ndarray:
        """Rank of the merge of x and y above the row it stands in: the least key is the first of the best merges."""
        found = self.ranks.find(self._pair(x, y), np.zeros(len(x), np.uint64))
        return np.where(found < 0, _NONE, found << 6 | row).astype(np.int32)

    def _columns(self, ids: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Merges parts that stand in columns; every round makes one merge in each column that has any, and so loses a row. Gives the columns
        in the order in which they are done, their ids and their lengths."""
        keys = np.full((len(ids) - 1, ids.shape[1]), _NONE, np.int32)
        for row in range(len(keys)):
            some = np.flatnonzero(sizes > row + 1)
            keys[row, some] = self._keys(ids[row, some], ids[row + 1, some], row)
        column, done = np.arange(ids.shape[1]), []
        while True:
            best = keys.min(axis=0) if len(keys) else np.full(len(column), _NONE, np.int32)
            more = best < _NONE >> 1
            if not more.all():
                over = ~more
                flat = ids[:, over].T
                done.append((column[over], flat[np.arange(flat.shape[1]) < sizes[over][:, None]], sizes[over]))
                if not more.any():
                    break
                ids, keys, column, sizes, best = ids[:, more], keys[:, more], column[more], sizes[more], best[more]
            row, at = best & 63, np.arange(len(column))
            ids[row, at] = self.made[best >> 6]
            for r in range(1, len(ids) - 1):
                np.copyto(ids[r], ids[r + 1], where=row < r)
            for r in range(len(keys) - 1):
                np.copyto(keys[r], keys[r + 1] - 1, where=row <= r)
            ids, keys, sizes = ids[:-1], keys[:-1], sizes - 1
            right, left = np.flatnonzero(row + 1 < sizes), np.flatnonzero(row > 0)
            x, y = np.concatenate((row[right], row[left] - 1)), np.concatenate((right, left))
            keys[x, y] = self._keys(ids[x, y], ids[x + 1, y], x)
        return tuple(np.concatenate(x) for x in zip(*done, strict=True))

    def apply(self, data: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all parts (of at most 64 bytes), and how many each has."""
        begin = np.cumsum(lengths) - lengths
        padded = np.concatenate((data, np.zeros(_PART, np.uint8)))
        parts, ids, many = [], [], []
        for low, high in _WIDTHS:
            here = np.flatnonzero((lengths > low) & (lengths <= high))
            if len(here):
                raw = padded[begin[here] + np.arange(high)[:, None]]
                first = self.inner[raw]
                first[lengths[here] - 1, np.arange(len(here))] = self.last[data[begin[here] + lengths[here] - 1]]
                column, made, size = self._columns(first, lengths[here])
                parts.append(here[column])
                ids.append(made)
                many.append(size)
        if not parts:
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        part, ids, many = (np.concatenate(x) for x in (parts, ids, many))
        by = np.argsort(part)
        start = (np.cumsum(many) - many)[by]
        many = many[by]
        return ids[np.repeat(start - (np.cumsum(many) - many), many) + np.arange(len(ids))], many


class PieceEncoder:
    """Encodes texts to ids exactly as Tokenizer.encode(text, add_special_tokens=False) does.

    kind "word" is for the word tokenizer (lower case, white space dropped), "byte" for the byte-level one, where a word has
    a space before it or stands bare, and other white space has ids of its own. Words with characters from U+0130 on go through the whole
    library; so do texts that hold an added token's string or, for "byte", white space outside ASCII.
    """

    def __init__(self, path: str, kind: str):
        from tokenizers import Tokenizer

        self.tokenizer, self.kind = Tokenizer.from_file(path), kind
        self.added = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        model = json.loads(self.tokenizer.to_str())["model"]
        self.merges = _Merges(model) if _Merges.knows(model) else None
        self._clear()

    def _clear(self) -> None:
        self.slots, self.others = _Slots(20), {}
        self.entries, self.used = 0, 0
        self.starts, self.lengths = np.zeros(1 << 14, np.uint32), np.zeros(1 << 14, np.uint32)
        self.ids = np.zeros(1 << 16, np.uint32)

    def _enter(self, ids: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """New entries with these ids, one after the other; their numbers."""
        a, n = self.entries, len(lengths)
        self.starts, self.lengths, self.ids = _grown(self.starts, a + n), _grown(self.lengths, a + n), _grown(self.ids, self.used + len(ids))
        self.starts[a : a + n], self.lengths[a : a + n] = np.cumsum(lengths) - lengths + self.used, lengths
        self.ids[self.used : self.used + len(ids)] = ids
        self.entries, self.used = a + n, self.used + len(ids)
        return np.arange(a, a + n)

    def _by_library(self, part: bytes) -> list[int]:
        return [t.id for t in self.tokenizer.model.tokenize(_mapped(part))]

    def _merged(self, words: list[list[bytes] | list[int]]) -> np.ndarray:
        """Entries of words that are given as their parts, or as ids."""
        out = np.empty(len(words), np.int64)
        plain = [i for i, w in enumerate(words) if self.merges and w and isinstance(w[0], bytes) and max(map(len, w)) <= _PART]
        if plain:
            parts = [p for i in plain for p in words[i]]
            ids, many = self.merges.apply(np.frombuffer(b"".join(parts), np.uint8), np.fromiter(map(len, parts), np.int64, len(parts)))
            cuts = np.cumsum([len(words[i]) for i in plain])
            out[plain] = self._enter(ids, np.diff(np.cumsum(many)[cuts - 1], prepend=0))
        for i in sorted({*range(len(words))}.difference(plain)):
            ids = [x for p in words[i] for x in (self._by_library(p) if isinstance(p, bytes) else [p])]
            out[i] = self._enter(np.array(ids, np.uint32), np.array([len(ids)]))[0]
        return out

    def _parts(self, word: bytes, bare: bool) -> list[bytes] | list[int]:
        text = word.decode() if bare or self.kind == "word" else " " + word.decode()
        if max(text) >= _FIRST_UNSETTLED:
            return self.tokenizer.encode(text, add_special_tokens=False).ids
        return [p.encode() for p in _INSIDE[self.kind].findall(text.lower() if self.kind == "word" else text)]

    def _learn(self, a: np.ndarray, b: np.ndarray) -> None:
        """Enters distinct new words, given as table keys: letters with marks behind them all at once, others one by one."""
        word, n = self.kind == "word", len(a)
        data = np.stack((a, b), axis=1).view(np.uint8).reshape(n, 16)
        bare = data[:, _SHORT] == 2
        data = data[:, :_SHORT].copy()
        size = (data != 0).sum(axis=1)
        place = np.arange(_SHORT)
        inside = place < size[:, None]
        second = np.zeros_like(inside)  # of a letter in U+00C0..U+00FF
        second[:, 1:] = (data[:, :-1] == 0xC3) & (data[:, 1:] != 0x97) & (data[:, 1:] != 0xB7)
        letter = _ASCII_LETTER[data] | second
        letter[:, :-1] |= (data[:, :-1] == 0xC3) & second[:, 1:]
        letter &= inside
        head = np.where(letter.all(axis=1), _SHORT, np.argmin(letter, axis=1))
        easy = (head > 0) & (_MARK[data] | ~inside | (place < head[:, None])).all(axis=1) if self.merges else np.zeros(n, bool)
        numbers = np.empty(n, np.int64)
        if easy.any():
            some, lead = data[easy], (~bare[easy] & (not word)).astype(np.int64)
            if word:
                some = some + 32 * ((some >= 0x41) & (some <= 0x5A) | second[easy] & (some <= 0x9E)).astype(np.uint8)
            shown = np.concatenate((lead[:, None] == 1, inside[easy]), axis=1)
            flat = np.concatenate((np.full((len(some), 1), 0x20, np.uint8), some), axis=1)[shown]
            lengths = np.stack((head[easy] + lead, size[easy] - head[easy]), axis=1).ravel()
            ids, many = self.merges.apply(flat, lengths[lengths > 0])
            each = np.zeros(len(lengths), np.int64)
            each[lengths > 0] = many
            numbers[easy] = self._enter(ids, each.reshape(-1, 2).sum(axis=1))
        hard = np.flatnonzero(~easy)
        if len(hard):
            numbers[hard] = self._merged([self._parts(data[i, : size[i]].tobytes(), bool(bare[i])) for i in hard.tolist()])
        self.slots.add(a, b, numbers)

    def _short(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        found = self.slots.find(a, b)
        fresh = np.flatnonzero(found < 0)
        if len(fresh):
            x, y = a[fresh], b[fresh]
            by = np.lexsort((y, x))
            new = np.ones(len(by), bool)
            new[1:] = (x[by][1:] != x[by][:-1]) | (y[by][1:] != y[by][:-1])
            self._learn(x[by][new], y[by][new])
            found[fresh] = self.slots.find(x, y)
        return found.astype(np.int64)

    def _other(self, keys: list[tuple]) -> np.ndarray:
        """Entries of long words, white space and the end id, through a dictionary."""
        fresh = [k for k in dict.fromkeys(keys) if k not in self.others]
        if fresh:
            made = [[k[1]] if k[0] == "end" else self._parts(k[1], k[2]) if k[0] == "word" else self._gap(k[1], k[0] == "tail") for k in fresh]
            self.others.update(zip(fresh, self._merged(made).tolist(), strict=True))
        return np.fromiter(map(self.others.__getitem__, keys), np.int64, len(keys))

    @staticmethod
    def _gap(gap: bytes, tail: bool) -> list[bytes]:
        """White space before a word keeps its last character apart, which goes to the word if it is a space."""
        if tail:
            return [gap]
        return [p for p in (gap[:-1], b"" if gap[-1] == 0x20 else gap[-1:]) if p]

    def _words(self, found, bare: np.ndarray) -> np.ndarray:
        starts, sizes = found.starts, found.ends - found.starts
        data = np.concatenate((found.data, np.zeros(16, np.uint8)))
        eight = np.ndarray(len(data) - 7, "<u8", data, strides=(1,))
        a = eight[starts] & _KEEP[np.minimum(sizes, 8)]
        b = (bare.astype(np.uint64) + U(1)) << U(56)
        more = np.flatnonzero((sizes > 8) & (sizes <= _SHORT))
        b[more] |= eight[starts[more] + 8] & _KEEP[sizes[more] - 8]
        long_ = sizes > _SHORT
        if (zero := np.flatnonzero(found.data == 0)).size:  # a zero byte would be taken for the end of a word
            inner = np.searchsorted(starts, zero, "right") - 1
            long_[inner] = True
        if not long_.any():
            return self._short(a, b)
        out, short = np.empty(len(starts), np.int64), ~long_
        out[short] = self._short(a[short], b[short])
        raw, at = found.data, np.flatnonzero(long_)
        out[at] = self._other([("word", raw[s:e].tobytes(), x) for s, e, x in zip(starts[at].tolist(), found.ends[at].tolist(), bare[at].tolist(), strict=True)])
        return out

    def _gaps(self, found) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where white space other than a single space stands: byte place, number of words before it, entry."""
        first, starts, ends, data, offsets = found.first, found.starts, found.ends, found.data, found.offsets
        begin = np.zeros(len(starts), np.int64)
        begin[1:] = ends[:-1]
        some = first[:-1][np.diff(first) > 0]
        begin[some] = offsets[:-1][np.diff(first) > 0]
        size = starts - begin
        at = np.flatnonzero((size > 1) | (size == 1) & (data[begin] != 0x20)) if len(starts) else np.zeros(0, np.int64)
        begin, size = begin[at], size[at]
        entry = np.empty(len(at), np.int64)
        line = (size == 1) & (data[begin] == 0x0A) if len(at) else np.zeros(0, bool)
        if line.any():
            entry[line] = self._other([("gap", b"\n")])[0]
        rest = np.flatnonzero(~line)
        entry[rest] = self._other([("gap", data[s : s + n].tobytes()) for s, n in zip(begin[rest].tolist(), size[rest].tolist(), strict=True)])
        close = np.where(np.diff(first) > 0, ends[np.maximum(first[1:] - 1, 0)], offsets[:-1]) if len(starts) else offsets[:-1]
        tail = np.flatnonzero(offsets[1:] > close)
        tails = self._other([("tail", data[s:e].tobytes()) for s, e in zip(close[tail].tolist(), offsets[1:][tail].tolist(), strict=True)])
        return np.concatenate((begin, close[tail])), np.concatenate((at, first[1:][tail])), np.concatenate((entry, tails))

    def _special(self, column: pa.Array) -> dict[int, np.ndarray]:
        """Ids of the texts that only the library can encode."""
        data, offsets = text_bytes(column)
        raw, which = memoryview(data).cast("B") if len(data) else b"", set()
        whole = bytes(raw)
        for a in self.added:
            if a in whole:
                which |= {i for i in range(len(column)) if a in whole[offsets[i] : offsets[i + 1]]}
        if self.kind == "byte" and len(places := np.flatnonzero(_WIDE_LEAD[data])):
            for i in np.unique(np.searchsorted(offsets, places, "right") - 1).tolist():
                if _WIDE_SPACE.search(whole, int(offsets[i]), int(offsets[i + 1])):
                    which.add(i)
        return {i: np.array(self.tokenizer.encode(whole[offsets[i] : offsets[i + 1]].decode(), add_special_tokens=False).ids, np.uint32) for i in sorted(which)}

    def encode(self, texts: pa.Array | list[str | None], end: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in order, each followed by `end`, and where each begins (one more entry at the end)."""
        column = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string())
        if self.entries > MOST_ENTRIES:
            self._clear()
        special = self._special(column)
        if special:
            column = _without(column, list(special))
        found = scan(column, SPACED)
        first, last = found.first, int(self._other([("end", end)])[0])
        place, before, entry = found.offsets[1:] * 2, first[1:], np.full(len(found), last)  # the end ids
        if self.kind == "byte":
            bare = np.ones(len(found.starts), bool)
            inner = found.starts > 0
            bare[inner] = found.data[found.starts[inner] - 1] != 0x20
            at_start = first[:-1][np.diff(first) > 0]
            bare[at_start] |= found.starts[at_start] == found.offsets[:-1][np.diff(first) > 0]
            gap_place, gap_before, gap_entry = self._gaps(found)
            place, before, entry = np.concatenate((place, gap_place * 2 + 1)), np.concatenate((before, gap_before)), np.concatenate((entry, gap_entry))
            by = np.argsort(place, kind="stable")
            before, entry = before[by], entry[by]
            closes = np.empty(len(found), np.int64)
            ends = by < len(found)
            closes[by[ends]] = np.flatnonzero(ends)
        else:
            bare, closes = np.zeros(len(found.starts), bool), np.arange(len(found))
        which = np.insert(self._words(found, bare), before, entry)
        lengths = self.lengths[which]
        ends = np.cumsum(lengths, dtype=np.int64)
        at = np.repeat(self.starts[which] - (ends - lengths), lengths)
        at += np.arange(len(at))
        out = self.ids[at]
        begins = np.concatenate(([0], ends[first[1:] + closes]))
        if special:
            longer = np.zeros(len(begins), np.int64)
            for i, ids in special.items():
                longer[i + 1] = len(ids)
            out = np.insert(out, np.repeat(begins[list(special)], [len(x) for x in special.values()]), np.concatenate(list(special.values())))
            begins = begins + np.cumsum(longer)
        return out, begins


_ENCODERS: dict[tuple[str, str], PieceEncoder] = HELD.setdefault("encoders", {})


def encoder(path: str, kind: str) -> PieceEncoder:
    """One encoder a Python worker, so that its table serves all batches of an operator."""
    if (path, kind) not in _ENCODERS:
        _ENCODERS[path, kind] = PieceEncoder(path, kind)
    return _ENCODERS[path, kind]
