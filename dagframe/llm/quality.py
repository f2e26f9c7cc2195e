"""Quality classifier: logistic regression on hashed word n-grams, trained by follow-the-regularised-leader updates.

N-grams are of words as they stand and of their shapes (runs of lower-case letters, capitals and digits as one sign each,
other ASCII signs as themselves, runs of one sign once); a word equal to the one before it stands as a repeat. Their
hashes are the features, their shares of the text's n-grams the values, and a score is a sparse dot product through the
logistic function, over the whole text. Ids, sources and other columns are no features.

Training reads at most `sample` labelled rows, those whose ids have the smallest MD5, in that order, in one task that holds
their features; scoring reads every row and holds one run of texts and the weights (2**BITS numbers).

Defined results: an empty, blank or null text has the score of the bias alone; without labelled rows all score 0.5; null
labels and labels of ids that have no document are left out; a repeated id trains with each of its rows; extra columns
pass through and a column named as an output is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dagframe.llm.shared import mapped
from dagframe.llm.wordbytes import U64, Words, mixed, runs

BITS = 20
#: Bound of the labelled rows that training reads.
SAMPLE = 4000
EPOCHS = 4
#: Bytes of text whose n-grams are held at once.
RUN = 1 << 20
#: What the shares of one kind of n-gram add up to: words weigh twice as much as their shapes.
WORD_MASS, SHAPE_MASS = 8.0, 4.0

_CLASS = np.arange(256, dtype=np.uint8)
_CLASS[ord("a") : ord("z") + 1] = 1
_CLASS[ord("A") : ord("Z") + 1] = 2
_CLASS[ord("0") : ord("9") + 1] = 3
_CLASS[128:] = 1
_SIGN = np.random.default_rng(11).integers(1, 1 << 63, 256, dtype=U64)
_STEP = U64(0xD6E8FEB86659FD93)
_REPEAT = U64(0x5851F42D4C957F2D)


def _shapes(words: Words) -> np.ndarray:
    """A hash of each word's shape."""
    lengths = words.ends - words.starts
    owner = np.repeat(np.arange(len(lengths)), lengths)
    at = np.arange(len(owner)) + np.repeat(words.starts - (np.cumsum(lengths) - lengths), lengths)
    kind = _CLASS[words.data[at]]
    new = np.ones(len(kind), bool)
    new[1:] = (kind[1:] != kind[:-1]) | (owner[1:] != owner[:-1])
    kind, owner = kind[new], owner[new]
    first = np.searchsorted(owner, np.arange(len(lengths)))
    rank = np.arange(len(owner)) - first[owner]
    part = mixed(_SIGN[kind] + rank.astype(U64) * _STEP)
    return np.add.reduceat(part, first) if len(part) else np.zeros(0, U64)


def features(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each n-gram of the texts: its text, its hashed feature and its value."""
    words = Words(column)
    n, owner = words.counts, words.text
    if not len(owner):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    h, s = words.hashes(), _shapes(words)
    same = np.zeros(len(h), bool)
    same[1:] = (h[1:] == h[:-1]) & (owner[1:] == owner[:-1])
    s = np.where(same, _REPEAT, s)
    groups = []
    for base, (x, mass) in enumerate(((h, WORD_MASS), (s, SHAPE_MASS))):
        for size in (1, 2) if base == 0 else (1, 2, 3):
            if len(x) < size:
                continue
            gram = x[: len(x) - size + 1].copy()
            for j in range(1, size):
                gram = gram * _STEP + x[j : len(x) - size + 1 + j]
            own = owner[: len(gram)]
            keep = owner[size - 1 :] == own
            gram, own = gram[keep], own[keep]
            slot = mixed(gram + U64(base * 8 + size)) >> U64(64 - BITS)
            groups.append((own, slot.astype(np.int64), mass / np.maximum(n[own] - size + 1, 1)))
    return tuple(np.concatenate(x) for x in zip(*groups, strict=True))


class FollowTheLeader:
    """Weights by coordinate: each step is the minimiser of all past gradients with L1 and L2 terms."""

    def __init__(self, alpha: float = 0.5, beta: float = 0.1, l1: float = 0.02, l2: float = 0.001):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)

    def weights(self, at) -> np.ndarray:
        z = self.z[at]
        return np.where(np.abs(z) <= self.l1, 0.0, (np.sign(z) * self.l1 - z) / ((self.beta + np.sqrt(self.n[at])) / self.alpha + self.l2))

    def learn(self, at: np.ndarray, value: np.ndarray, label: float) -> None:
        w = self.weights(at)
        g = (1 / (1 + np.exp(-np.clip(w @ value, -30, 30))) - label) * value
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + g * g


def fitted(rows: Iterator[tuple[np.ndarray, np.ndarray, float]], epochs: int = EPOCHS) -> np.ndarray:
    """Weights and, last, the bias, from rows of features, values and label; a feature comes once in a row."""
    model, rows = FollowTheLeader(), list(rows)
    order = np.random.default_rng(5)
    for _ in range(epochs):
        for k in order.permutation(len(rows)):
            at, value, label = rows[k]
            model.learn(np.append(at, 1 << BITS), np.append(value, 1.0), label)
    return model.weights(slice(None)).astype(np.float32)


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
    for batch in batches:
        labels = batch.column(1).to_pylist()
        for first, last in runs(batch.column(0), RUN):
            own, at, value = features(batch.column(0).slice(first, last - first))
            key, where = np.unique(own << BITS | at, return_inverse=True)
            total = np.bincount(where, value, len(key))
            edge = np.searchsorted(key >> BITS, np.arange(last - first + 1))
            for k in range(last - first):
                part = slice(edge[k], edge[k + 1])
                yield (key[part] & ((1 << BITS) - 1)).astype(np.int32), total[part].astype(np.float32), float(labels[first + k])


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE) -> np.ndarray:
    """Weights from the documents that `labels` (id_col, label_col 0 or 1) marks."""
    ids = F.md5(F.col(id_col).cast("string"))
    chosen = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).select(F.col(id_col).alias("_id"), F.col(label_col).cast("double").alias("_label"), ids.alias("_order")).orderBy("_order", "_label").limit(sample)
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(chosen), "_id")  # at most `sample` short rows
    rows = rows.repartition(1).sortWithinPartitions("_order", "_text").select("_text", "_label")

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([pa.array([fitted(_gathered(batches)).tobytes()], pa.binary())], ["weights"])

    made = mapped(rows, learn, "weights binary").collect()  # 4 MB
    return np.frombuffer(made[0][0], np.float32) if made else np.zeros((1 << BITS) + 1, np.float32)


def scores(column: pa.Array, weights: np.ndarray) -> np.ndarray:
    out = np.full(len(column), float(weights[-1]))
    for first, last in runs(column, RUN):
        own, at, value = features(column.slice(first, last - first))
        out[first:last] += np.bincount(own, weights[at] * value, last - first)
    return 1 / (1 + np.exp(-np.clip(out, -30, 30)))


def score(docs: DataFrame, weights: np.ndarray, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """Adds the score of each whole text, from 0 to 1, higher for the label 1."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)
    kept = [f for f in docs.schema.fields if f.name != score_col]
    names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = pa.array(scores(batch.column(batch.schema.get_field_index(text_col)), shared.value))
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(n)) for n in names), made], [*names, score_col])

    return mapped(docs, run, T.StructType([*kept, T.StructField(score_col, T.DoubleType())]))


def remainder(id_col: str, of: int) -> Column:
    """crc32 of the id as text, modulo `of`; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % of
