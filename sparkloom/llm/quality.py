"""A quality classifier: hashed word n-grams, logistic regression by FTRL-proximal.

Features are single words, word pairs and triples of word shapes (case class, punctuation mark,
repetition of the word before), each hashed into one table of fixed size; a document's counts are
scaled to length one and its score is a sparse dot product. Learning goes once through one task, over
a bounded sample of the labelled rows (``sample``, below), and returns a weight table of fixed size;
scoring goes over all texts in parallel.

Defined results: a null or empty text has no features and gets the score of the intercept; texts of
any length count whole; each of several equal rows is scored; contradictory labels of one document
count by their mean, halves as 1; of several documents of one id the one with the least hash of its
text is learned from; without usable labels the score is 0.5; an empty table gives an
empty table; only the id and the text column of the documents and the id and label column of the
labels are read, so further columns of any name do no harm.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import fields_of, map_arrow, text_slices

#: Slots of the weight table, as a power of two.
BITS = 18
#: About so many labelled documents are learned from, chosen by a hash of the id.
SAMPLE = 6_000
EPOCHS = 3
CACHE_WORDS = 400_000

_TOKEN = re.compile(r"\w+|[^\w\s]+")
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
_SHIFT = np.uint64(64 - BITS)


def _shape(token: str) -> int:
    if not (token[0].isalnum() or token[0] == "_"):
        return 8 + xxhash.xxh32_intdigest(token[:4]) % 240
    if token.islower():
        return 1
    if token.isupper():
        return 2 if len(token) == 1 else 3
    if token.isdigit():
        return 4
    return 5 if token[0].isupper() and token[1:].islower() else 6


class _Hashes(dict):
    """Word to 64 bits: the lower-cased word's hash, and in the last byte its shape."""

    def __missing__(self, token: str) -> int:
        value = (xxhash.xxh64_intdigest(token.lower()) & ~0xFF) | _shape(token)
        if len(self) < CACHE_WORDS and len(token) < 48:
            self[token] = value
        return value


_HASHES = _Hashes()


def release() -> None:
    _HASHES.clear()


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Slots and values of a text's features; the values' squares add up to one."""
    tokens = _TOKEN.findall(text)
    if not tokens:
        return np.zeros(0, dtype=np.int64), np.zeros(0)
    h = np.fromiter(map(_HASHES.__getitem__, tokens), dtype=np.uint64, count=len(tokens))
    word, shape = h >> np.uint64(8), h & np.uint64(0xFF)
    shape[1:] += np.uint64(256) * (word[1:] == word[:-1])
    parts = [(word * _A) >> _SHIFT, (word[:-1] * _A + word[1:] * _B) * _C >> _SHIFT, ((shape[:-2] * _B + shape[1:-1]) * _C + shape[2:]) * _A >> _SHIFT]
    slots, counts = np.unique(np.concatenate(parts).astype(np.uint32), return_counts=True)
    return slots.astype(np.int64), counts / np.sqrt((counts.astype(np.float64) ** 2).sum())


def _sigmoid(x: float) -> float:
    return 1 / (1 + np.exp(-min(max(x, -35.0), 35.0)))


class Ftrl:
    """FTRL-proximal with per-coordinate rates; the last slot is the intercept."""

    def __init__(self, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.1):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)

    def weights(self, slots: np.ndarray | slice = slice(None)) -> np.ndarray:
        z, n = self.z[slots], self.n[slots]
        return np.where(np.abs(z) > self.l1, -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2), 0.0)

    def learn(self, slots: np.ndarray, values: np.ndarray, label: int) -> None:
        slots, values = np.append(slots, 1 << BITS), np.append(values, 1.0)
        w = self.weights(slots)
        g = (_sigmoid(float(w @ values)) - label) * values
        n = self.n[slots]
        self.z[slots] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[slots] = n + g * g


def fit(documents: DataFrame, labels: DataFrame, learn_from: Column, sample: int = SAMPLE, epochs: int = EPOCHS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> np.ndarray | None:
    """The weight table, learned from documents whose id fulfils ``learn_from``; None without labels.

    ``sample`` bounds the labelled documents: ids are taken whose hash lies under the share that
    gives as many (about: each id's hash decides for itself). One row of each goes to one task, where
    they are learned from in the order of that hash, so every run learns the same weights.
    """
    usable = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).where(learn_from).groupBy(id_col).agg((F.avg(label_col) >= 0.5).cast("int").alias("__label"))
    count = usable.count()
    if not count:
        return None
    order = F.xxhash64(F.col(id_col), F.lit("quality"))
    share = min(1.0, sample / count)
    if share < 1:
        usable = usable.where(F.shiftrightunsigned(order, 11) < F.lit(int(share * (1 << 53))))
    # About ``sample`` rows of an id and a label: small at any input size. Of rows that share an id the one
    # with the least hash of its text counts, so neither copies nor the order of arrival make a difference.
    chosen = documents.where(learn_from).select(id_col, text_col).join(F.broadcast(usable), id_col).select(F.struct(order.alias("order"), F.col(id_col).alias("id"), F.xxhash64(text_col).alias("hash"), F.col("__label").alias("label"), F.col(text_col).alias("text")).alias("row"))
    chosen = chosen.groupBy("row.id").agg(F.min("row").alias("row")).select("row.order", "row.id", "row.label", "row.text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for part, texts in text_slices(batches, 3):
            for key, own, label, text in zip(*(part.column(k).to_pylist() for k in range(3)), texts, strict=True):
                rows.append((key, own, *features(text), label))
        rows.sort(key=lambda r: r[:2])
        model = Ftrl()
        for _ in range(epochs):
            for _, _, slots, values, label in rows:
                model.learn(slots, values, label)
        yield pa.RecordBatch.from_arrays([pa.array([model.weights().astype(np.float32).tobytes()], pa.binary()), pa.array([len(rows)], pa.int64())], ["weights", "rows"])

    found = map_arrow(chosen.repartition(1), run, "weights binary, rows long", "quality", release).collect()
    found = [row for row in found if row.rows]
    return np.frombuffer(found[0].weights, dtype=np.float32) if found else None


def score_text(text: str, weights: np.ndarray | None) -> float:
    if weights is None:
        return 0.5
    slots, values = features(text)
    return float(_sigmoid(float(weights[slots] @ values) + float(weights[-1])))


def score(df: DataFrame, weights: np.ndarray | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, score`` of every row."""
    shared = df.sparkSession.sparkContext.broadcast(weights)  # 1 MB, whatever the input

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_slices(batches, 1):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([score_text(t, shared.value) for t in texts], pa.float64())], [id_col, "score"])

    return map_arrow(df.select(id_col, text_col), run, f"`{id_col}` {df.schema[id_col].dataType.simpleString()}, score double", "quality", release)


def keep_good(df: DataFrame, weights: np.ndarray | None, least: float, text_col: str = "text") -> DataFrame:
    """The rows whose score reaches ``least``, columns as they are."""
    shared = df.sparkSession.sparkContext.broadcast(weights)
    at = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_slices(batches, at):
            yield part.filter(pa.array([score_text(t, shared.value) >= least for t in texts], pa.bool_()))

    return map_arrow(df, run, fields_of(df), "quality", release)
