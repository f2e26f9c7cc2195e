"""Document fingerprints by I-Match over randomised lexicon subsets.

A term is a word in lower-case ASCII. The lexicon holds the terms whose document frequency, counted over all documents,
lies within a band of inverse document frequency; terms outside it say too little or are too rare to come back. A text's
distinct lexicon terms are sorted and hashed once for each of several random subsets of the lexicon. Subsets come in
groups of SUBSETS, in which a term is with a chance of 2**-5, 2**-7 and so on; a text is fingerprinted in the group that
leaves about one of its terms in a subset, and in all sparser ones, so that long and short texts can be compared.

The likeness of two fingerprints is the share of equal hashes among the subsets in which either has a term, in the densest
group that both have: 1 for equal texts, and near their terms' Jaccard similarity otherwise.

The lexicon is sent to the workers. Each of its terms is in at least a BAND[0]-th of the documents, so that it has at most
1 / BAND[0] times as many terms as a document has distinct ones on average (some 540,000 at 270), however many documents.

Defined results: ids are integers (others fail); a text with no lexicon term is fingerprinted by all its terms; null, empty and blank texts
have the fingerprint of no terms, alike only to itself; a null id comes first in the order of ids, rows of one id are
ordered by a hash of their text; the only row is its own next document; no rows give no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dagframe.llm.ctw import _counts
from dagframe.llm.shared import mapped, released
from dagframe.llm.wordbytes import RUN_BYTES, U64, Words, distinct_by_text, mixed, runs, text_bytes

#: Band of document frequency, as a share of all documents.
BAND = (0.0005, 0.05)
SUBSETS = 32
#: Bits of the chance of a subset in each group, and the terms of a text from which the next group is its densest.
GROUPS = (5, 7, 9, 11, 13, 15)
TERMS = (64, 256, 1024, 4096, 16384)
#: Bytes of text in a range of ids.
RANGE_BYTES = 8 << 20
MOST_RANGES = 8192
_SEEDS = np.random.default_rng(8).integers(1, 1 << 63, len(GROUPS), dtype=U64)


def lexicon(docs: DataFrame, text_col: str = "text", band: tuple[float, float] = BAND) -> np.ndarray:
    """Sorted hashes of the terms within the band, from all documents."""
    def terms(column: pa.Array) -> np.ndarray:
        words = Words(column, lower=True)
        return distinct_by_text(words.hashes(), words.counts)[0]

    n = docs.count()
    counts = _counts(docs.select(text_col), terms, "imatch-df")
    least = max(int(np.ceil(band[0] * n)), 1)
    kept = counts.where(F.col("n").between(least, max(band[1] * n, 2))).select("key").toArrow()  # at most mean distinct terms / band[0]
    released(counts)
    return np.sort(kept.column("key").to_numpy().view(U64))


class Prints:
    """Fingerprints of a run of texts: the densest group of each, how many terms, and a hash for each group and subset."""

    def __init__(self, column: pa.Array, terms: np.ndarray):
        words = Words(column, lower=True)
        h, n = distinct_by_text(words.hashes(), words.counts)
        own = np.repeat(np.arange(len(n)), n)
        at = np.searchsorted(terms, h)
        known = np.zeros(len(h), bool)
        inside = at < len(terms)
        known[inside] = terms[at[inside]] == h[inside]
        none = np.bincount(own, known, len(n)) == 0
        keep = known | none[own]
        h, own = h[keep], own[keep]
        self.terms = np.bincount(own, minlength=len(n))
        self.group = np.searchsorted(TERMS, self.terms, "right")
        self.hashes = np.zeros((len(n), len(GROUPS), SUBSETS), np.uint16)
        for g, bits in enumerate(GROUPS):
            subset = mixed(h ^ _SEEDS[g]) >> U64(64 - bits)
            held = subset < SUBSETS
            if not held.any():
                continue
            # h is sorted within a text; a stable sort by subset keeps that order.
            cell = own[held] * SUBSETS + subset[held].astype(np.int64)
            order = np.argsort(cell, kind="stable")
            cell, value = cell[order], mixed(h[held][order] + _SEEDS[g])
            first = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
            rank = np.arange(len(cell)) - np.repeat(first, np.diff(np.append(first, len(cell))))
            total = np.add.reduceat(value * (rank.astype(U64) * U64(2) + U64(1)), first)
            self.hashes[cell[first] // SUBSETS, g, cell[first] % SUBSETS] = (mixed(total) % U64(65535) + U64(1)).astype(np.uint16)

    def strings(self) -> list[str]:
        return [f"{n:x}:{hashes[g:].astype('>u2').tobytes().hex()}" if n else "0:" for n, g, hashes in zip(self.terms.tolist(), self.group.tolist(), self.hashes, strict=True)]


def likeness(a: Prints, b: Prints) -> np.ndarray:
    """Of the texts of a and b at the same place."""
    g = np.maximum(a.group, b.group)
    at = np.arange(len(g))
    x, y = a.hashes[at, g], b.hashes[at, g]
    both = ((x == y) & (x > 0)).sum(1)
    either = ((x > 0) | (y > 0)).sum(1)
    return np.where((a.terms == 0) & (b.terms == 0), 1.0, both / np.maximum(either, 1))


def fingerprints(docs: DataFrame, terms: np.ndarray, text_col: str = "text", out_col: str = "fingerprint") -> DataFrame:
    """Adds the fingerprint of each whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(terms)
    kept = [f for f in docs.schema.fields if f.name != out_col]
    names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(text_col))
            made = [s for first, last in runs(column) for s in Prints(column.slice(first, last - first), shared.value).strings()]
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(n)) for n in names), pa.array(made, pa.string())], [*names, out_col])

    from pyspark.sql import types as T

    return mapped(docs, run, T.StructType([*kept, T.StructField(out_col, T.StringType())]))


def _dealt(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows by ranges of ids and, within one, in the order of ids; the rows of the id that opens a range are also sent, as `tail`, to the
    range before it. Texts move once, compressed."""
    given = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    order = F.coalesce("id", F.lit(-(1 << 63)))
    size = given.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("size")).first()[0]
    n = int(min(MOST_RANGES, max(1, size // RANGE_BYTES)))
    cuts = given.agg(F.min(order), F.percentile_approx(order, [k / n for k in range(1, n)] or [0.0], 100 * n)).first()
    # Percentiles are ids of the table, so each is the first of its range.
    lows = np.array(sorted({cuts[0], *(cuts[1] or [])} - {None}), np.int64)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last in runs(batch.column(2)):
                part = batch.slice(first, last - first)
                key = part.column(0).to_numpy(zero_copy_only=False)
                place = np.searchsorted(lows, key, "right") - 1
                opens = np.flatnonzero(lows[place] == key)
                edge, data = text_bytes(part.column(2))
                packed = [pa.compress(data[edge[k] : edge[k + 1]], "zstd", asbytes=True) if edge[k] < edge[k + 1] else b"" for k in range(len(key))]
                rows = pa.array(np.concatenate([np.arange(len(key)), opens]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate([place, (place[opens] - 1) % len(lows)])), pa.array(np.arange(len(rows)) >= len(key)), part.column(0).take(rows), part.column(1).take(rows),
                     part.column(3).take(rows), pa.array(packed, pa.binary()).take(rows), pa.array(np.diff(edge)).take(rows)],
                    ["range", "tail", "key", "id", "tie", "packed", "size"],
                )

    dealt = mapped(given.select(order.alias("key"), "id", "text", F.xxhash64("text").alias("tie")), deal, "range long, tail boolean, key long, id long, tie long, packed binary, size long")
    return dealt.repartition("range").sortWithinPartitions("range", "tail", "key", "tie").select("range", "tail", "id", "packed", "size")


def _paired(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[str], list[str]]]:
    """Of dealt rows: ids, texts and the texts that follow them, in runs of RUN_BYTES or so."""
    ids: list = []
    texts: list[str] = []
    nexts: list[str] = []
    held, before = 0, None  # bytes of the run; the row that waits for its next one: range, id, text
    for batch in batches:
        for place, tail, own, packed, size in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            text = pa.decompress(packed, size, "zstd", asbytes=True).decode() if packed else ""
            if before and before[0] == place:
                ids.append(before[1])
                texts.append(before[2])
                nexts.append(text)
                held += len(before[2])
                if held > RUN_BYTES:
                    yield ids, texts, nexts
                    ids, texts, nexts, held = [], [], [], 0
            before = None if tail else (place, own, text)
    if ids:
        yield ids, texts, nexts


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text, next_text): each row with the text of the next one in the order of integer ids, the last with the first."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts, nexts in _paired(batches):
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(texts, pa.string()), pa.array(nexts, pa.string())], ["id", "text", "next_text"])

    return mapped(_dealt(docs, id_col, text_col), run, "id long, text string, next_text string")


def compared(docs: DataFrame, terms: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each text against the next one and against its edit, whose last floor(n / 2) code points are the next one's first."""
    shared = docs.sparkSession.sparkContext.broadcast(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts, nexts in _paired(batches):
            edits = [t[: len(t) - len(t) // 2] + u[: len(t) // 2] for t, u in zip(texts, nexts, strict=True)]
            own, edited, following = (Prints(pa.array(x, pa.string()), shared.value) for x in (texts, edits, nexts))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(list(map(len, texts)), pa.int64()), pa.array([hashlib.sha256(x.encode()).hexdigest() for x in edits], pa.string()),
                 pa.array(own.strings(), pa.string()), pa.array(edited.strings(), pa.string()), pa.array(likeness(own, edited)), pa.array(likeness(own, following))],
                [id_col, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
            )

    schema = f"`{id_col}` long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return mapped(_dealt(docs, id_col, text_col), run, schema)
