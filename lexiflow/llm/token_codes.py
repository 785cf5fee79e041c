"""Token files of directly addressable codes.

An id is cut into chunks of eight bits. Level 0 holds the lowest chunk of every id; a bitmap beside each level says which ids go on,
and the next level holds the next chunk of just those. A rank directory counts the set bits before each block of 512, so the
place of an id's next chunk is found by one directory entry and a population count: any token, and any run of tokens, is read by its
place in the file without decoding others.

File: magic, counts, the sizes of each level's three parts, the levels, then one id and one first token per document, all little-endian.
Files lie uncompressed in the shared folder, in ascending doc_id order over all files. A task writes its files under names of its own
attempt; the table of files names only those of tasks that ended well, so a lost executor leaves nothing that is read.
"""

from __future__ import annotations

import struct
import uuid

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, chunks_by_bytes, frugal, made_folder, running_totals, stored, text_megabytes, with_base
from .tokens import encoder

MAGIC = b"LXDAC\x02\x00\x00"
BLOCK = 512
FILES = "part long, piece long, n_docs long, n_tokens long, path string"
READ = "doc_id long, place long, n_tokens long, ids binary"
NULL_ID = np.iinfo(np.int64).min


def encode_file(ids: np.ndarray, doc_ids: np.ndarray, first: np.ndarray) -> bytes:
    """One file's bytes. first: where each document begins, and the end."""
    levels, rest = [], ids.astype(np.uint32, copy=False)
    while True:
        more = rest > 0xFF
        counts = np.add.reduceat(more, np.arange(0, len(more), BLOCK), dtype=np.int64) if len(more) else np.zeros(0, np.int64)
        ranks = (np.cumsum(counts) - counts).astype("<u4")
        levels.append((rest.astype(np.uint8).tobytes(), np.packbits(more, bitorder="little").tobytes(), ranks.tobytes()))
        if not more.any():
            break
        rest = rest[more] >> np.uint32(8)
    head = MAGIC + struct.pack("<QQQ", len(doc_ids), len(ids), len(levels)) + b"".join(struct.pack("<QQQ", *map(len, parts)) for parts in levels)
    return b"".join((head, *(p for parts in levels for p in parts), doc_ids.astype("<i8").tobytes(), first.astype("<i8").tobytes()))


class TokenFile:
    """Reads a file of codes: bytes, a memory map, or an open file that can be read at any place."""

    def __init__(self, data):
        self.read = data.read_at if hasattr(data, "read_at") else lambda n, at: data[at : at + n]
        if bytes(self.read(8, 0)) != MAGIC:
            raise ValueError("not a token file")
        self.n_docs, self.n_tokens, n_levels = struct.unpack("<QQQ", self.read(24, 8))
        sizes = np.frombuffer(self.read(24 * n_levels, 32), "<u8").astype(np.int64).reshape(n_levels, 3)
        begin = 32 + 24 * n_levels + np.cumsum(sizes.ravel()) - sizes.ravel()
        self.levels = begin.reshape(n_levels, 3).tolist()  # where each level's codes, bitmap and ranks begin
        self.end = 32 + 24 * n_levels + int(sizes.sum())

    def _array(self, kind: str, n: int, at: int) -> np.ndarray:
        return np.frombuffer(self.read(n * np.dtype(kind).itemsize, at), kind)

    def doc_ids(self, a: int, b: int) -> np.ndarray:
        """The ids of documents a to b (exclusive) of this file; NULL_ID for null."""
        return self._array("<i8", b - a, self.end + 8 * a)

    def first(self, a: int, b: int) -> np.ndarray:
        """Where documents a to b (exclusive) begin; document n_docs is the end."""
        return self._array("<i8", b - a, self.end + 8 * (self.n_docs + a))

    def _rank(self, level: list[int], i: int) -> int:
        """How many of the ids before place i of a level go on."""
        block, bits = divmod(i, BLOCK)
        lead = self._array("u1", -(-bits // 8), level[1] + block * BLOCK // 8)
        return (int(self._array("<u4", 1, level[2] + 4 * block)[0]) if bits else self._whole_rank(level, block)) + int(np.unpackbits(lead, bitorder="little")[:bits].sum())

    def _whole_rank(self, level: list[int], block: int) -> int:
        """The rank at the edge of a block, which may be the end, where the directory has no entry."""
        if not block:
            return 0
        bits = self._array("u1", BLOCK // 8, level[1] + (block - 1) * BLOCK // 8)
        return int(self._array("<u4", 1, level[2] + 4 * (block - 1))[0]) + int(np.unpackbits(bits).sum())

    def token(self, i: int) -> int:
        """The i-th id, by rank queries alone."""
        if not 0 <= i < self.n_tokens:
            raise IndexError(i)
        value = 0
        for shift, level in enumerate(self.levels):
            value |= int(self._array("u1", 1, level[0] + i)[0]) << 8 * shift
            if not self._array("u1", 1, level[1] + (i >> 3))[0] >> (i & 7) & 1:
                break
            i = self._rank(level, i)
        return value

    def tokens(self, a: int, b: int) -> np.ndarray:
        """The ids a to b (exclusive): of each level, the stretch that the rank directory points to."""
        if not 0 <= a <= b <= self.n_tokens:
            raise IndexError((a, b))
        out, going, shift = np.zeros(b - a, np.uint32), np.arange(b - a), 0
        for level in self.levels:
            if a == b:
                break
            out[going] |= self._array("u1", b - a, level[0] + a).astype(np.uint32) << np.uint32(shift)
            bits = np.unpackbits(self._array("u1", (b + 7 >> 3) - (a >> 3), level[1] + (a >> 3)), bitorder="little")[a & 7 :][: b - a].astype(bool)
            a = self._rank(level, a)
            going, b, shift = going[bits], a + int(bits.sum()), shift + 8
        return out

    def document(self, k: int) -> np.ndarray:
        """The ids of the k-th document of this file."""
        return self.tokens(*self.first(k, k + 2).tolist())


def _write(folder: str, tokenizer: str, kind: str, end: int, file_tokens: int):
    def run(batches):
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        part, piece, attempt = TaskContext.get().partitionId(), 0, uuid.uuid4().hex
        code, docs, ids, starts, n = encoder(tokenizer, kind), [], [], [], 0

        def flush():
            nonlocal docs, ids, starts, n, piece
            first = np.concatenate([*starts, [n]])
            path = f"{root}/part-{part:07}-{piece:05}-{attempt}.dac"
            with store.open_output_stream(path) as out:
                out.write(encode_file(np.concatenate(ids), np.concatenate(docs), first))
            row = [[part], [piece], [len(first) - 1], [n], [path]]
            docs, ids, starts, n, piece = [], [], [], 0, piece + 1
            return pa.record_batch([pa.array(x, t) for x, t in zip(row, (pa.int64(),) * 4 + (pa.string(),), strict=True)], names=["part", "piece", "n_docs", "n_tokens", "path"])

        for batch in chunks_by_bytes(batches, "text", 2 << 20):
            made, first = code.encode(batch.column("text"), end)
            docs.append(batch.column("doc_id").fill_null(NULL_ID).to_numpy(zero_copy_only=False))
            starts.append(first[:-1] + n)
            ids.append(made)
            n += len(made)
            if n >= file_tokens:
                yield flush()
        if docs:
            yield flush()

    return run


def write_token_files(docs: DataFrame, tokenizer: str, kind: str = "byte", end: int = 2, id_col: str = "doc_id", text_col: str = "text", file_tokens: int = 4_000_000, partition_mb: float = 40.0) -> tuple[DataFrame, str]:
    """Writes the ids of all documents, each followed by `end`, in ascending id order (nulls first). Returns the table of files: part and
    piece (ascending with the ids), n_docs, n_tokens, path; and the folder they lie in.

    A null or empty text gives just the end id; repeated ids and rows follow each other in the order of the input, and no id, however
    frequent, is bound to one task; texts may be of any length (a file holds whole documents); an empty table gives no file. A file closes at
    the first batch of documents that reaches `file_tokens`. Other columns are ignored. Texts are shuffled once, and encoded where they are written.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    many = max(2, int(-(-text_megabytes(docs, text_col) // partition_mb)))
    part = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"), F.col(text_col).alias("text"))
    ordered = part.repartitionByRange(many, "doc_id", "row").sortWithinPartitions("doc_id", "row").select("doc_id", "text")
    folder = made_folder(spark, "token-files")
    return stored(ordered.mapInArrow(frugal(_write(folder, tokenizer, kind, end, file_tokens), keep="encoders"), FILES), "token-index"), folder


def _read(folder: str, docs_at_once: int):
    def run(batches):
        from pyarrow import fs

        store, _ = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for base, path in zip(batch.column("base").to_pylist(), batch.column("path").to_pylist(), strict=True):
                with store.open_input_file(path) as source:
                    file = TokenFile(source)
                    for a in range(0, file.n_docs, docs_at_once):
                        b = min(a + docs_at_once, file.n_docs)
                        cut, names = file.first(a, b + 1), file.doc_ids(a, b)
                        ids = file.tokens(int(cut[0]), int(cut[-1])).astype("<u4")
                        ends = pa.array((cut - cut[0]) * 4, pa.int32()).buffers()[1]
                        blobs = pa.BinaryArray.from_buffers(pa.binary(), b - a, [None, ends, pa.py_buffer(ids)])
                        yield pa.record_batch([pa.array(names, pa.int64(), mask=names == NULL_ID), pa.array(cut[:-1] + base), pa.array(np.diff(cut)), blobs], names=["doc_id", "place", "n_tokens", "ids"])

    return run


def read_token_files(files: DataFrame, folder: str, docs_at_once: int = 1024) -> DataFrame:
    """Per document, read from the files by its place: doc_id, place (ids of all documents before it), n_tokens, ids (little-endian 32-bit).
    An id of the smallest 64-bit number is read back as null."""
    bases = running_totals(files, ["part", "piece"], "n_tokens")
    return with_base(files.select("part", "piece", "path"), bases, ["part", "piece"]).select("base", "path").mapInArrow(frugal(_read(folder, docs_at_once)), READ)
