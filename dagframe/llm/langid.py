"""Language identification: a byte convolutional network trained in numpy on labelled text.

A text is cut into windows of WINDOW bytes (the last one filled up with zero bytes), all of them, over its whole length. A
window goes through byte embeddings, filters of several widths, the maximum over places of each filter (not below 0), and
a softmax; a text's probabilities are the mean over its windows by their bytes. For prediction, filters times embeddings are
summed beforehand for every pair of bytes, so that a place costs a few table rows.

Training reads all windows of at most `sample` labelled rows, those whose ids have the smallest MD5, in one task; a row weighs
as much as any other, however long. Inputs are the text's bytes alone.

Defined results: a null text or one without a letter is `und` with score 0; so is every text if no row is labelled; a null
language is no label; equal rows get equal answers; extra columns pass through and columns named as outputs are replaced.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dagframe.llm.shared import mapped
from dagframe.llm.wordbytes import runs, text_bytes

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS, EMBEDDING = 8, 8
#: Bound of the labelled rows that training reads.
SAMPLE = 1500
BATCH, EPOCHS, RATE = 64, 3, 0.01
UNKNOWN = "und"


def windows_of(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All windows of the texts as rows of bytes, the text of each, and how many bytes of text each has."""
    sizes = np.diff(offsets)
    n = -(-sizes // WINDOW)
    owner = np.repeat(np.arange(len(n)), n)
    first = offsets[:-1][owner] + (np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)) * WINDOW
    held = np.minimum(WINDOW, offsets[1:][owner] - first)
    padded = np.concatenate([data, np.zeros(WINDOW, np.uint8)])
    rows = np.lib.stride_tricks.sliding_window_view(padded, WINDOW)[first].copy()
    rows[np.arange(WINDOW) >= held[:, None]] = 0
    return rows, owner, held


class Network:
    def __init__(self, languages: list[str], seed: int = 3):
        r = np.random.default_rng(seed)
        self.languages = languages
        self.p = {"byte": r.normal(0, 0.5, (256, EMBEDDING)), "out": r.normal(0, 0.1, (len(WIDTHS) * FILTERS, len(languages))), "bias": np.zeros(len(languages))}
        for w in WIDTHS:
            self.p[f"filter{w}"] = r.normal(0, 1 / np.sqrt(w * EMBEDDING), (w, EMBEDDING, FILTERS))
            self.p[f"shift{w}"] = np.zeros(FILTERS)

    def _pooled(self, x: np.ndarray) -> tuple[np.ndarray, dict[int, np.ndarray]]:
        tops, places = [], {}
        for w in WIDTHS:
            rows = [self.p["byte"] @ self.p[f"filter{w}"][o] for o in range(w)]
            n = x.shape[1] - w + 1
            y = sum(rows[o][x[:, o : o + n]] for o in range(w))
            places[w] = y.argmax(1)
            tops.append(np.take_along_axis(y, places[w][:, None, :], 1)[:, 0, :] + self.p[f"shift{w}"])
        return np.concatenate(tops, 1), places

    def learn(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients of the weighted cross entropy of a batch."""
        top, places = self._pooled(x)
        act = np.maximum(top, 0)
        z = act @ self.p["out"] + self.p["bias"]
        q = np.exp(z - z.max(1, keepdims=True))
        q /= q.sum(1, keepdims=True)
        q[np.arange(len(y)), y] -= 1
        q *= (weight / len(y))[:, None]
        g = {"out": act.T @ q, "bias": q.sum(0), "byte": np.zeros_like(self.p["byte"])}
        back = (q @ self.p["out"].T) * (top > 0)
        for k, w in enumerate(WIDTHS):
            d = back[:, k * FILTERS : (k + 1) * FILTERS]
            g[f"shift{w}"] = d.sum(0)
            g[f"filter{w}"] = np.zeros_like(self.p[f"filter{w}"])
            for o in range(w):
                b = np.take_along_axis(x, places[w] + o, 1)  # the byte under this part of each filter's best place
                g[f"filter{w}"][o] = np.einsum("nfe,nf->ef", self.p["byte"][b], d)
                np.add.at(g["byte"], b, d[:, :, None] * self.p[f"filter{w}"][o].T[None])
        return g

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray, seed: int = 4) -> None:
        """Adam over batches; classes weigh alike, and windows within one by `weight`."""
        share = weight * (len(y) / (np.bincount(y, weight, len(self.languages)) * len(self.languages)))[y]
        first = {k: np.zeros_like(v) for k, v in self.p.items()}
        second = {k: np.zeros_like(v) for k, v in self.p.items()}
        r, t = np.random.default_rng(seed), 0
        for _ in range(EPOCHS):
            order = r.permutation(len(y))
            for k in range(0, len(y), BATCH):
                at, t = order[k : k + BATCH], t + 1
                for name, g in self.learn(x[at], y[at], share[at]).items():
                    first[name] += 0.1 * (g - first[name])
                    second[name] += 0.001 * (g * g - second[name])
                    self.p[name] = self.p[name] - RATE * (first[name] / (1 - 0.9**t)) / (np.sqrt(second[name] / (1 - 0.999**t)) + 1e-8)

    def tables(self) -> tuple[np.ndarray, ...]:
        """For prediction: what a pair of bytes gives to the filters that start at it, and what later bytes add."""
        t = {(w, o): (self.p["byte"] @ self.p[f"filter{w}"][o]).astype(np.float32) for w in WIDTHS for o in range(w)}
        pair = lambda w, o: (t[w, o][:, None, :] + t[w, o + 1][None, :, :]).reshape(65536, FILTERS)
        return np.concatenate([pair(2, 0), pair(3, 0), pair(4, 0)], 1), t[3, 2], pair(4, 2)

    def predict(self, x: np.ndarray, tables: tuple[np.ndarray, ...]) -> np.ndarray:
        start, third, later = tables
        f = FILTERS
        pairs = (x[:, :-1].astype(np.int32) << 8) | x[:, 1:]
        y = start[pairs]
        top = [y[:, :, :f].max(1)]
        top.append((y[:, :-1, f : 2 * f] + third[x[:, 2:]]).max(1))
        top.append((y[:, :-2, 2 * f :] + later[pairs[:, 2:]]).max(1))
        act = np.maximum(np.concatenate(top, 1) + np.concatenate([self.p[f"shift{w}"] for w in WIDTHS]), 0)
        z = act @ self.p["out"] + self.p["bias"]
        q = np.exp(z - z.max(1, keepdims=True))
        return q / q.sum(1, keepdims=True)


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> Network | None:
    """The network, from rows with a language."""
    order = F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    labelled = docs.where(F.col(lang_col).isNotNull() & (F.octet_length(text_col) > 0))
    # Ids first, so that the rows sorted are short; then the texts of those ids.
    ids = labelled.select(F.col(id_col).alias("_id"), order.alias("_order")).distinct().orderBy("_order").limit(sample)
    rows = labelled.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), F.col(lang_col).alias("_lang")).join(F.broadcast(ids), "_id")  # at most `sample` ids
    rows = rows.repartition(1).sortWithinPartitions("_order", "_text", "_lang").select("_text", "_lang")

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x, weight, lang = [], [], []
        for batch in batches:
            for first, last in runs(batch.column(0)):
                rows, owner, _ = windows_of(*text_bytes(batch.column(0).slice(first, last - first)))
                x.append(rows)
                weight.append(1 / np.bincount(owner, minlength=last - first)[owner])
                lang += [batch.column(1)[first + int(k)].as_py() for k in owner]
        if lang:
            names, y = np.unique(lang, return_inverse=True)
            net = Network(names.tolist())
            net.fit(np.concatenate(x), y, np.concatenate(weight))
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(net)], pa.binary())], ["net"])

    made = mapped(rows, learn, "net binary").collect()  # some 20 KB
    return pickle.loads(made[0][0]) if made else None


def identify(docs: DataFrame, net: Network | None, text_col: str = "text", lang_col: str = "lang_pred", score_col: str = "score") -> DataFrame:
    """Adds the language of each whole text and its probability."""
    kept = [f for f in docs.schema.fields if f.name not in (lang_col, score_col)]
    names = [f.name for f in kept]
    lettered = F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False))
    shared = docs.sparkSession.sparkContext.broadcast(net)
    flag = "_lettered"
    while flag in docs.columns:
        flag += "_"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        tables = net.tables() if net else None
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(text_col))
            total = np.zeros((batch.num_rows, len(net.languages) if net else 1))
            weight = np.zeros(batch.num_rows)
            for first, last in runs(column) if net else ():
                rows, owner, held = windows_of(*text_bytes(column.slice(first, last - first)))
                for k in range(0, len(rows), 512):
                    q = net.predict(rows[k : k + 512], tables) * held[k : k + 512, None]
                    np.add.at(total, owner[k : k + 512] + first, q)
                weight[first:last] = np.bincount(owner, held, last - first)
            known = batch.column(batch.schema.get_field_index(flag)).to_numpy(zero_copy_only=False) & (weight > 0)
            best = total.argmax(1)
            lang = np.where(known, np.array(net.languages if net else [UNKNOWN], object)[best], UNKNOWN)
            score = np.where(known, total[np.arange(len(best)), best] / np.maximum(weight, 1), 0.0)
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(n)) for n in names), pa.array(lang, pa.string()), pa.array(score)], [*names, lang_col, score_col])

    return mapped(docs.withColumn(flag, lettered), run, T.StructType([*kept, T.StructField(lang_col, T.StringType()), T.StructField(score_col, T.DoubleType())]))
