"""Quality of texts by nearest-neighbour voting in a latent-semantic space.

A text's terms are pairs of neighbouring character classes (white space, lower and upper letters, digits, each ASCII sign), hashed words,
and words said twice in a row. Their shares are square-rooted and weighted by how few of all documents have them. The space is spanned by
the strongest singular vectors of a bounded, balanced sample of labelled texts. The vectors of that sample are sent to all tasks, every
document gets its exact cosine with each of them, a block of documents at a time, and the nearest vote with their similarity.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, chunks_by_bytes, frugal, light, scratch, stored
from .textscan import SPACED, U, mix, scan

#: Classes of bytes: white space, lower letters (and all beyond ASCII), upper letters, digits, control bytes, each other sign.
_CLASS = np.full(256, 4, np.int32)
_CLASS[[9, 10, 11, 12, 13, 32]] = 0
_CLASS[0x61:0x7B] = _CLASS[0x80:] = 1
_CLASS[0x41:0x5B] = 2
_CLASS[0x30:0x3A] = 3
_SIGNS = [c for c in range(0x21, 0x7F) if _CLASS[c] == 4]
_CLASS[_SIGNS] = np.arange(5, 5 + len(_SIGNS))
CLASSES = 5 + len(_SIGNS)
PAIRS, WORDS = CLASSES**2, 2048
#: Pairs of classes, words, and (last) a word said again at once and one said anew.
TERMS = PAIRS + WORDS + 2
#: Labelled rows of each label that are learned from, dimensions of the space, neighbours that vote.
SAMPLE, DIMENSIONS, NEIGHBOURS = 1024, 64, 15
ROWS = 256


def _codes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A number for each word, of its bytes at its ends and its length: enough to tell usual words apart."""
    eight = np.concatenate((data, np.zeros(8, np.uint8)))
    view = np.ndarray(len(eight) - 7, "<u8", eight, strides=(1,))
    n = ends - starts
    keep = np.array([(1 << 8 * k) - 1 for k in range(8)] + [2**64 - 1], np.uint64)[np.minimum(n, 8)]
    return mix((view[starts] & keep) ^ mix(n.astype(np.uint64) ^ (view[np.maximum(ends - 8, starts)] & keep)))


def term_counts(column: pa.Array) -> np.ndarray:
    """How often each text has each term; null counts as empty."""
    found = scan(column, SPACED)
    out = np.zeros((len(found), TERMS), np.float32)
    if not len(found.data):
        return out
    flat = out.reshape(-1)
    kinds = _CLASS[found.data]
    pair = kinds[:-1] * CLASSES + kinds[1:]
    for i, (a, b) in enumerate(zip(found.offsets[:-1], found.offsets[1:], strict=True)):
        if b - a > 1:
            out[i, :PAIRS] = np.bincount(pair[a : b - 1], minlength=PAIRS)
    doc = np.repeat(np.arange(len(found)), found.counts)
    if len(doc):
        code = _codes(found.data, found.starts, found.ends)
        np.add.at(flat, doc * TERMS + PAIRS + (code % U(WORDS)).astype(np.int64), 1)
        again = np.zeros(len(doc), np.int64)
        again[1:] = (code[1:] == code[:-1]) & (doc[1:] == doc[:-1])
        np.add.at(flat, doc * TERMS + TERMS - 1 - again, 1)
    return out


def weighted(counts: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Unit vectors of the square roots of the shares among the pairs, the words and the repeats, weighted."""
    out = counts.copy()
    for a, b in ((0, PAIRS), (PAIRS, PAIRS + WORDS), (PAIRS + WORDS, TERMS)):
        out[:, a:b] /= np.maximum(out[:, a:b].sum(1, keepdims=True), 1)
    out = np.sqrt(out) * weights
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)


@dataclass
class QualityModel:
    """Term weights, the basis of the space, the labelled vectors in it (unit length) and their labels; 0.5 without labelled rows."""

    weights: np.ndarray
    basis: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    neighbours: int = NEIGHBOURS

    def place(self, counts: np.ndarray) -> np.ndarray:
        at = weighted(counts, self.weights) @ self.basis
        return at / np.maximum(np.linalg.norm(at, axis=1, keepdims=True), 1e-12)

    def scores(self, counts: np.ndarray) -> np.ndarray:
        """The share of label 1 among the nearest labelled vectors, each voting with the fourth power of its cosine; of equal cosines the earlier
        labelled rows vote. A text that is like none of them, such as an empty one, gets the share of the whole sample."""
        k = min(self.neighbours, len(self.labels))
        if not k:
            return np.full(len(counts), 0.5)
        cosines = (self.place(counts) @ self.vectors.T).astype(np.float64).round(5)
        near = np.argsort(-cosines, axis=1, kind="stable")[:, :k]
        close = np.take_along_axis(cosines, near, 1)
        vote = np.maximum(close, 0) ** 4 + 1e-9
        return np.where(close[:, 0] > 0, (vote * self.labels[near]).sum(1) / vote.sum(1), self.labels.mean())


def fit(counts: np.ndarray, labels: np.ndarray, weights: np.ndarray, dimensions: int = DIMENSIONS, neighbours: int = NEIGHBOURS) -> QualityModel:
    """The space of the sample: eigenvectors of the products of its texts, whose number is bounded, carried over to terms."""
    rows = weighted(counts, weights)
    values, vectors = np.linalg.eigh((rows @ rows.T).astype(np.float64))
    strong = np.argsort(-values)[:dimensions]
    strong = strong[values[strong] > 1e-9]
    basis = (rows.T @ (vectors[:, strong] / np.sqrt(values[strong]))).astype(np.float32)
    model = QualityModel(weights, basis, np.zeros((0, basis.shape[1]), np.float32), labels.astype(np.float64), neighbours)
    model.vectors = model.place(counts)
    return model


def _having(text: str):
    """(term, documents) of a task's rows."""

    def run(batches):
        total = np.zeros(TERMS, np.int64)
        for batch in chunks_by_bytes(batches, text, 1 << 20):
            for at in range(0, batch.num_rows, ROWS):
                total += (term_counts(batch.column(text).slice(at, ROWS)) > 0).sum(0)
        some = np.flatnonzero(total)
        yield pa.record_batch([pa.array(some.astype(np.int32)), pa.array(total[some])], names=["term", "n"])

    return run


def term_weights(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """log((1 + N) / (1 + documents with the term)) + 1 over all documents; TERMS numbers reach the driver."""
    part = docs.select(F.col(text_col).alias("__lf_text"))
    found = part.mapInArrow(frugal(_having("__lf_text")), "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    n = np.zeros(TERMS)
    for row in found:
        n[row["term"]] = row["n"]
    return (np.log((1 + docs.count()) / (1 + n)) + 1).astype(np.float32)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_label: int = SAMPLE) -> list:
    """(text, label) of at most per_label labelled rows of each label 0 and 1, first in the order of a hash of the id, then by id and text."""
    ids = labels.filter(F.col("doc_id").isNotNull()).select("doc_id", F.col(label).cast("int").alias("__lf_label")).distinct()
    with scratch():
        picked = [ids.filter(F.col("__lf_label") == y).orderBy(F.xxhash64("doc_id", F.lit(7)), "doc_id").limit(per_label) for y in (0, 1)]
        rows = docs.join(light(picked[0].union(picked[1]), "picked"), "doc_id").select("doc_id", F.col("text").alias("__lf_text"), "__lf_label")
        counted = stored(rows.mapInArrow(frugal(_counts), "doc_id long, label int, counts binary"), "labelled")
        kept = counted.groupBy("doc_id", "label").agg(F.min("counts").alias("counts"))  # of rows that repeat an id, one
        return kept.orderBy(F.xxhash64("doc_id", F.lit(7)), "doc_id", "label").collect()


def _counts(batches):
    for batch in chunks_by_bytes(batches, "__lf_text", 1 << 20):
        for at in range(0, batch.num_rows, ROWS):
            part = batch.slice(at, ROWS)
            blobs = [_packed(row) for row in term_counts(part.column("__lf_text"))]
            yield pa.record_batch([part.column("doc_id").cast(pa.int64()), part.column("__lf_label"), pa.array(blobs, pa.binary())], names=["doc_id", "label", "counts"])


def _packed(row: np.ndarray) -> bytes:
    some = np.flatnonzero(row)
    return np.stack((some, row[some])).astype(np.float32).tobytes()


def learn_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", per_label: int = SAMPLE) -> QualityModel:
    """Learns from at most per_label rows of each label; term weights come from all documents. Labels other than 0 and 1 are not learned."""
    bounded_batches(docs.sparkSession)
    found = labelled_sample(docs, labels, label, per_label)
    counts = np.zeros((len(found), TERMS), np.float32)
    for row, into in zip(found, counts, strict=True):
        some, n = np.frombuffer(row["counts"], np.float32).reshape(2, -1)
        into[some.astype(np.int64)] = n
    return fit(counts, np.array([r["label"] for r in found]), term_weights(docs))


def score_quality(docs: DataFrame, model: QualityModel, text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """docs with score (0 to 1, higher: label 1 likelier; 0.5 without labelled rows) and predicted (1 if score >= threshold, else 0).

    Every row is judged by its text alone, of any length; a null text counts as empty. Columns named score or predicted are replaced, others
    stay. An empty table gives no rows."""
    bounded_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast((model.weights, model.basis, model.vectors, model.labels, model.neighbours))
    schema = docs.drop("score", "predicted").withColumns({"score": F.lit(0.0), "predicted": F.lit(0)}).schema
    keep = [c for c in docs.columns if c not in ("score", "predicted")]

    def run(batches):
        model = QualityModel(*sent.value)
        for batch in chunks_by_bytes(batches, text_col, 1 << 20):
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                score = model.scores(term_counts(part.column(text_col)))
                columns = [part.column(c) for c in keep] + [pa.array(score), pa.array((score >= threshold).astype(np.int32))]
                yield pa.record_batch(columns, names=[*keep, "score", "predicted"])

    return docs.mapInArrow(frugal(run), schema)
