"""Concatenate and cut: documents' tokens form one long line that is cut into sequences of a fixed length.

First pass: tokenise and store the ids with each document's place in its partition, and total each partition. Prefix sums over the
partition totals (one row a partition, in two levels) give global offsets. Second pass: cut each document where the line passes a multiple of
the length; the pieces are the boundary records. Only the last sequence can need padding.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, chunks_by_bytes, frugal, running_totals, stored, with_base
from .tokens import encoder

STORED = "doc_id long, part long, place long, doc_tokens long, ids binary"
PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def _tokenise(path: str, kind: str, end: int):
    def run(batches):
        part, place = TaskContext.get().partitionId(), 0
        code = encoder(path, kind)
        small = "<u2" if code.tokenizer.get_vocab_size() <= 1 << 16 and end < 1 << 16 else "<u4"
        for batch in chunks_by_bytes(batches, "text", 2 << 20):
            ids, first = code.encode(batch.column("text"), end)
            blob = ids.astype(small)
            offsets = pa.array(first * blob.itemsize, pa.int32()).buffers()[1]
            n = batch.num_rows
            yield pa.record_batch([batch.column("doc_id"), pa.array(np.full(n, part)), pa.array(first[:-1] + place), pa.array(np.diff(first)), pa.BinaryArray.from_buffers(pa.binary(), n, [None, offsets, pa.py_buffer(blob.tobytes())])], names=["doc_id", "part", "place", "doc_tokens", "ids"])
            place += int(first[-1])

    return run


def tokenised(docs: DataFrame, tokenizer: str, kind: str, end: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Stores the ids of each document, followed by `end`: doc_id, part and place (ids before it in its part), doc_tokens, ids (little-endian,
    16 bits each if all fit, else 32)."""
    bounded_batches(docs.sparkSession)
    part = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return stored(part.mapInArrow(frugal(_tokenise(tokenizer, kind, end), keep="encoders"), STORED), "tokens")


def _cut(length: int):
    def run(batches):
        for batch in batches:
            begin = batch.column("line").to_numpy()
            sizes = batch.column("doc_tokens").to_numpy()
            many = (begin + sizes - 1) // length - begin // length + 1
            doc = np.repeat(np.arange(len(many)), many)
            k = np.arange(len(doc)) - np.repeat(np.cumsum(many) - many, many)
            at = np.maximum(begin[doc], (begin[doc] // length + k) * length)
            to = np.minimum(begin[doc] + sizes[doc], (begin[doc] // length + k + 1) * length)
            start, long_ = at - begin[doc], to - at
            blobs = []
            ids, last, raw = batch.column("ids"), -1, None
            for d, s, n in zip(doc.tolist(), start.tolist(), long_.tolist(), strict=True):
                if d != last:
                    data = ids[d].as_buffer()
                    last, raw = d, np.frombuffer(data, "<u2" if len(data) == 2 * sizes[d] else "<u4").astype("<u4")
                blobs.append(raw[s : s + n].tobytes())
            ints = [start, long_, sizes[doc], at // length, at % length]
            s, n, t, q, o = (pa.array(x, pa.int64()) for x in ints)
            yield pa.record_batch([batch.column("doc_id").take(pa.array(doc)), s, n, pa.array(blobs, pa.binary()), t, q, o], names=["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, tokenizer: str, kind: str = "word", end: int = 1, length: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start (ids of the document before the piece), length, ids (little-endian 32-bit), doc_tokens (with
    the end id), sequence_id and offset in the sequence, which is filled without gaps from 0.

    A null text counts as empty, so that its only id is the end id; repeated rows and ids, null ids too, are packed as they come; texts may be of
    any length; an empty table gives no pieces. The order is that of the table's partitions; other columns are ignored.
    """
    if length < 1:
        raise ValueError("length must be positive")
    kept = tokenised(docs, tokenizer, kind, end, id_col, text_col)
    totals = kept.groupBy("part").agg(F.sum("doc_tokens").alias("n"))
    line = with_base(kept, running_totals(totals, ["part"], "n"), ["part"]).select("doc_id", "doc_tokens", "ids", (F.col("base") + F.col("place")).alias("line"))
    return line.mapInArrow(frugal(_cut(length)), PIECES)
