"""Language-model scoring by context-tree weighting over bytes.

A text is its words in lower-case ASCII, one blank between them, and an end sign. Each byte is eight binary decisions; each
decision has a tree over the DEPTH bytes before it. A node holds the Krichevsky-Trofimov estimate of its two counts;
the prediction at a node is its own estimate and its child's, mixed by the weight that the tree's block probabilities
give to stopping there:
    Pw(s) = 1/2 Pe(s) + 1/2 prod Pw(children of s),    stop(s) = 1/2 Pe(s) / Pw(s).
The score of a text is the log10 of the product of all its predictions; the model is frozen after training.

Counts come from all training texts: runs of DEPTH + 1 bytes are counted in each task, summed over all tasks, and turned
into nodes in groups that share the two latest bytes, where all deeper nodes of a subtree meet; the two upper levels are
dense. Every gram gives nodes of full depth, however seldom it was seen. Grams of texts to be scored are dealt into the same groups
(with a count of 0 if no training text has them), where their predictions are mixed as far up as the group's nodes go; the
upper levels finish them into a table of all grams' chances. Workers hold the chances of the most frequent grams (at most
`grams`) as a cache; every other gram of a text finds its chance in a join.

Beside it stands a base score: add-one unigram word probabilities with exact counts over all training texts. Counts of the
most frequent words (at most `frequent`) are sent to the workers; every other word of a text finds its count in a join.

Defined results: a null or blank text is its end sign alone; without training texts every prediction is 1/2 and the base
has N = 0 and V = 0; equal texts get equal scores; a null id counts as the empty text; extra columns are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dagframe.llm.shared import mapped, released, stored
from dagframe.llm.wordbytes import U64, Words, mixed, runs

DEPTH = 5
GRAMS = 1 << 19
FREQUENT = 1 << 19
RUN = 2 << 20
#: Groups in which nodes are made; all grams that share their two latest context bytes are in one.
GROUPS = 192
END = 10
#: The hash that stands for the end token; words' hashes may meet it with a chance of 2**-64.
END_WORD = np.array([0x0A0A0A0A0A0A0A0B], U64)


def stream(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """The texts as bytes, words joined by blanks and ended by END, and where each begins (one more than texts)."""
    n = words.counts
    sizes = words.ends - words.starts
    per_text = np.bincount(words.text, sizes, len(n)).astype(np.int64) + np.maximum(n, 1)
    begins = np.concatenate([[0], np.cumsum(per_text)])
    out = np.full(begins[-1], 32, np.uint8)
    out[begins[1:] - 1] = END
    if len(sizes):
        source = np.arange(int(sizes.sum())) + np.repeat(words.starts - (np.cumsum(sizes) - sizes), sizes)
        before = np.cumsum(n == 0) - (n == 0)  # texts without words, which have an end sign only
        shift = np.arange(len(sizes)) + before[words.text]
        out[np.arange(len(source)) + np.repeat(shift, sizes)] = words.data[source]
    return out, begins


def grams_of(stream_bytes: np.ndarray, begins: np.ndarray, depth: int) -> np.ndarray:
    """Each byte with the `depth` bytes before it, the latest lowest; a text begins after end signs."""
    key = stream_bytes.astype(U64)
    place = np.arange(len(key)) - np.repeat(begins[:-1], np.diff(begins))
    for d in range(1, depth + 1):
        earlier = np.full(len(key), END, U64)
        earlier[d:] = stream_bytes[: len(key) - d]
        key |= np.where(place >= d, earlier, U64(END)) << U64(8 * d)
    return key


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Of numbers from 1/2 on, by Stirling's series at x + 8."""
    x = np.asarray(x, float)
    product = np.ones_like(x)
    for j in range(8):
        product *= x + j
    y = x + 8
    return (y - 0.5) * np.log(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - np.log(product)


def log_estimate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Log of the Krichevsky-Trofimov probability of a zeros and b ones in any one order."""
    return np.where(a + b > 0, log_gamma(a + 0.5) + log_gamma(b + 0.5) - 2 * 0.5723649429247001 - log_gamma(a + b + 1.0), 0.0)


def _summed(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    if not len(keys):
        return (keys, *values)
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return (keys[first], *(np.add.reduceat(v[order], first) for v in values))


def bit_nodes(grams: np.ndarray, counts: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(context of `depth` bytes, bits of the byte so far) as one key, with the counts of zeros and of ones."""
    context = (grams >> U64(8)) & U64((1 << (8 * depth)) - 1)
    byte = grams & U64(255)
    keys, zeros, ones = [], [], []
    for j in range(8):
        keys.append(context << U64(8) | U64(1 << j) | byte >> U64(8 - j))
        one = (byte >> U64(7 - j)) & U64(1) == 1
        zeros.append(np.where(one, 0, counts))
        ones.append(np.where(one, counts, 0))
    return _summed(np.concatenate(keys), np.concatenate(zeros), np.concatenate(ones))


def weighed(a, b, child_a, child_b, child_log) -> tuple[np.ndarray, np.ndarray]:
    """Stop weight and log Pw of nodes, given the sums over their children; counts in no child are one child without nodes."""
    own = log_estimate(a, b)
    below = child_log + log_estimate(a - child_a, b - child_b)
    both = np.logaddexp(own, below)
    return np.exp(own - both), both - np.log(2)


def levels(grams: np.ndarray, counts: np.ndarray, depth: int, upto: int, least: int) -> list[tuple]:
    """Nodes from `depth` up to `upto`: (depth, keys, stop weights, estimates of a one), and of `upto` also a, b and log Pw."""
    out = []
    below = None
    for d in range(depth, upto - 1, -1):
        keys, a, b = bit_nodes(grams, counts, d)
        if d == depth:
            keep = a + b >= least
            keys, a, b = keys[keep], a[keep], b[keep]
            stop, log = np.ones(len(keys)), log_estimate(a, b)
        else:
            held = np.zeros((3, len(keys)))
            if len(below[0]):
                parent, ca, cb, cl = _summed(below[0] & U64((1 << (8 * d + 8)) - 1), *below[1:])
                held[:, np.searchsorted(keys, parent)] = ca, cb, cl
            stop, log = weighed(a, b, *held)
        below = keys, a.astype(float), b.astype(float), log
        out.append((d, keys, stop, (b + 0.5) / (a + b + 1.0), a, b, log))
    return out


class Places:
    """Places of 64-bit keys in a table, found by hash: the first bits name a short run, 32 others tell its keys apart."""

    def __init__(self, keys: np.ndarray):
        """keys: distinct. `order` is how the table's other columns must be arranged."""
        h = mixed(keys)
        self.order = np.argsort(h)
        self.shift = U64(64 - max(1, int(len(h)).bit_length()))
        h = h[self.order]
        self.starts = np.searchsorted(h, np.arange((1 << (64 - int(self.shift))) + 1, dtype=U64) << self.shift if len(h) else np.zeros(3, U64)).astype(np.int32)
        self.starts[-1] = len(h)
        self.low = np.append(h.astype(np.uint32), np.uint32(0))

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The place of each key, and whether it is there; where it isn't, the place is some place or one past the last."""
        h = mixed(keys)
        top, low = (h >> self.shift).astype(np.int64), h.astype(np.uint32)
        at, end = self.starts[top], self.starts[top + 1]
        there = (self.low[at] == low) & (at < end)
        left = np.flatnonzero(~there & (at + 1 < end))
        while len(left):
            at[left] += 1
            hit = self.low[at[left]] == low[left]
            there[left] = hit
            left = left[~hit & (at[left] + 1 < end[left])]
        return at, there


class Tree:
    """The frozen model in one piece: for each level its nodes' stop weights (in 255ths) and estimates."""

    def __init__(self, depth: int):
        self.depth = depth
        self.tables: list[tuple[Places, np.ndarray, np.ndarray]] = []

    def add(self, keys: np.ndarray, stop: np.ndarray, one: np.ndarray) -> None:
        """The next level, from depth 0 on."""
        places = Places(keys)
        self.tables.append((places, np.append(np.rint(stop * 255)[places.order], 255).astype(np.uint8), np.append(one[places.order], 0.5).astype(np.float32)))
        places.order = None

    def walked(self, grams: np.ndarray) -> np.ndarray:
        """log10 of the probability of each gram's byte after the bytes before it."""
        total = np.zeros(len(grams))
        byte, context = grams & U64(255), grams >> U64(8)
        for j in range(8):
            node = U64(1 << j) | byte >> U64(8 - j)
            chances = np.full(len(grams), 0.5)
            mix = []
            known = np.ones(len(grams), bool)
            for d in range(self.depth + 1):
                places, stop, one = self.tables[d]
                at, there = places.find((context & U64((1 << (8 * d)) - 1)) << U64(8) | node)
                known = known & there
                mix.append((known, stop[at] / 255, one[at]))
            for d in range(self.depth, -1, -1):
                known, stop, one = mix[d]
                deeper = mix[d + 1][0] if d < self.depth else np.zeros(len(grams), bool)
                chances = np.where(known, np.where(deeper, stop * one + (1.0 - stop) * chances, one), chances)
            bit = (byte >> U64(7 - j)) & U64(1) == 1
            total += np.log10(np.where(bit, chances, 1 - chances))
        return total


def predicted(grams: np.ndarray, made: list[tuple], below: np.ndarray | None = None) -> np.ndarray:
    """For each gram and bit of its byte the chance of a one at the last of some levels (deepest first, keys in order), given
    `below`, that at the level under them; NaN is no node."""
    out = np.full((len(grams), 8), np.nan) if below is None else below.astype(float)
    byte, context = grams & U64(255), grams >> U64(8)
    for j in range(8):
        node = U64(1 << j) | byte >> U64(8 - j)
        chance = out[:, j]
        for d, keys, stop, one, *_ in made:
            if len(keys):
                wanted = (context & U64((1 << (8 * d)) - 1)) << U64(8) | node
                at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
                mix = np.where(np.isnan(chance), one[at], stop[at] * one[at] + (1.0 - stop[at]) * chance)
                chance = np.where(keys[at] == wanted, mix, chance)
        out[:, j] = chance
    return out


def _counted(batches: Iterator[pa.RecordBatch], of) -> Iterator[pa.RecordBatch]:
    """Sums of keys over a task, let go whenever there are many. Texts whose second column is false give keys and count for nothing."""
    keys, counts = np.zeros(0, U64), np.zeros(0, np.int64)
    for batch in batches:
        parts = [(batch.column(0), 1)] if batch.num_columns == 1 else [(batch.column(0).filter(batch.column(1)), 1), (batch.column(0).filter(pc.invert(batch.column(1))), 0)]
        for column, weight in parts:
            for first, last in runs(column, RUN):
                k, n = np.unique(of(column.slice(first, last - first)), return_counts=True)
                keys, counts = _summed(np.concatenate([keys, k]), np.concatenate([counts, n * weight]))
                if len(keys) > 1_500_000:
                    yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(counts)], ["key", "n"])
                    keys, counts = keys[:0], counts[:0]
    if len(keys):
        for k in range(0, len(keys), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(keys[k : k + 100_000].view(np.int64)), pa.array(counts[k : k + 100_000])], ["key", "n"])


def _counts(texts: DataFrame, of, name: str) -> DataFrame:
    return stored(mapped(texts, lambda batches: _counted(batches, of), "key long, n long").groupBy("key").agg(F.sum("n").alias("n")), name)


def _least(counts: DataFrame, most: int) -> int:
    """A count that at most `most` keys reach: the smallest power of 2**(1/8) (rounded up) of which that holds. The table asked for is
    as short as the logarithm of the largest count."""
    step = F.ceil(8 * F.log2(F.col("n").cast("double"))).alias("step")
    sizes = counts.where("n > 0").groupBy(step).agg(F.count("*").alias("keys"), F.max("n").alias("top")).orderBy(F.desc("step")).collect()  # at most 8 * 63 rows
    held = 0
    for k, r in enumerate(sizes):
        held += r["keys"]
        if held > most:
            return int(r["top"]) + 1
    return 1


def chances(texts: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(key, n, chance) of every gram of the texts (text, learns): how often training texts have it, and log10 of the probability of
    its byte after the bytes before it, by the tree of all training texts."""
    def of(column: pa.Array) -> np.ndarray:
        return grams_of(*stream(Words(column, lower=True)), depth)

    counts = _counts(texts, of, "ctw-grams")

    def build(table: pa.Table) -> pa.Table:
        keys, n = table.column("key").to_numpy().view(U64), table.column("n").to_numpy()
        order = np.argsort(keys)
        keys, n = keys[order], n[order]
        made = levels(keys[n > 0], n[n > 0], depth, 2, 1)
        mixes = predicted(keys, made).astype(np.float32)
        _, node, _, _, a, b, log = made[-1]
        first, a, b, log = _summed(node & U64(65535), a, b, log) if len(node) else (node, a, b, log)
        near = {"key": first.view(np.int64), "n": pa.nulls(len(first), pa.int64()), "mix": pa.nulls(len(first), pa.binary()), "a": a.astype(np.int64), "b": b.astype(np.int64), "log": log.astype(float)}
        size = mixes.shape[1] * 4
        held = pa.Array.from_buffers(pa.binary(), len(keys), [None, pa.py_buffer(np.arange(len(keys) + 1, dtype=np.int32) * np.int32(size)), pa.py_buffer(mixes.tobytes())])
        far = {"key": keys.view(np.int64), "n": n, "mix": held, "a": pa.nulls(len(keys), pa.int64()), "b": pa.nulls(len(keys), pa.int64()), "log": pa.nulls(len(keys), pa.float64())}
        return pa.concat_tables([pa.table(near), pa.table(far)])

    schema = "key long, n long, mix binary, a long, b long, log double"
    nodes = stored(counts.withColumn("near", F.expr(f"pmod(xxhash64(shiftright(key, 8) & 65535), {GROUPS})")).groupBy("near").applyInArrow(build, schema), "ctw-nodes")
    second = nodes.where("mix is null").groupBy("key").agg(F.sum("a").alias("a"), F.sum("b").alias("b"), F.sum("log").alias("log")).toArrow()  # at most 2**16 rows
    keys, a, b, log = (second.column(c).to_numpy() for c in ("key", "a", "b", "log"))
    order = np.argsort(keys)
    keys, a, b, log = keys[order].astype(U64), a[order], b[order], log[order]
    stop1, log1 = weighed(a, b, a, b, log)
    root, a0, b0, child = _summed(keys & U64(255), a, b, log1)
    stop0, _ = weighed(a0, b0, a0, b0, child)
    upper = [(1, keys, stop1, (b + 0.5) / (a + b + 1.0)), (0, root, stop0, (b0 + 0.5) / (a0 + b0 + 1.0))]

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grams = batch.column(0).to_numpy().view(U64)
            one = predicted(grams, upper, np.frombuffer(b"".join(batch.column(2).to_pylist()), np.float32).reshape(-1, 8))
            one = np.where(np.isnan(one), 0.5, one)
            bits = (grams[:, None] >> np.arange(7, -1, -1, dtype=U64)) & U64(1) == 1
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.log10(np.where(bits, one, 1 - one)).sum(1))], ["key", "n", "chance"])

    out = stored(mapped(nodes.where("mix is not null").select("key", "n", "mix"), finish, "key long, n long, chance double"), "ctw-chances")
    released(counts, nodes)
    return out


def _of_each(keys: np.ndarray, own: np.ndarray, rows: int) -> pa.ListArray:
    """Keys that are to be joined, once for each text (`own`) with their number."""
    order = np.lexsort((keys, own))
    keys, own = keys[order], own[order]
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (own[1:] != own[:-1])
    begin = np.flatnonzero(new)
    times = np.diff(np.append(begin, len(keys)))
    edges = np.searchsorted(own[begin], np.arange(rows + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(edges), pa.StructArray.from_arrays([pa.array(keys[begin].view(np.int64)), pa.array(times)], ["key", "times"]))


def score(docs: DataFrame, learns: Column, id_col: str = "doc_id", text_col: str = "text", depth: int = DEPTH, grams: int = GRAMS, frequent: int = FREQUENT) -> DataFrame:
    """Per row: id, whether it was held out (not `learns`), n_tokens, n_known, train_tokens, base_score and score."""
    spark = docs.sparkSession
    given = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.coalesce(learns, F.lit(False)).alias("learns"))
    texts = given.where("learns").select("text")
    table = chances(given.select("text", "learns"), depth)
    seen = max(1, _least(table.where("n > 0"), grams))
    cache = table.where(F.col("n") >= seen).toArrow()  # at most `grams` rows
    places = Places(cache.column("key").to_numpy().view(U64))
    cached = np.append(cache.column("chance").to_numpy()[places.order], 0)
    places.order = None

    def tokens(column: pa.Array) -> np.ndarray:
        words = Words(column, lower=True)
        return np.concatenate([words.hashes(), np.repeat(END_WORD, len(words.counts))])

    vocabulary = _counts(texts, tokens, "lm-words")
    total = vocabulary.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    least = _least(vocabulary, frequent)
    often = vocabulary.where(F.col("n") >= least).toArrow()  # at most `frequent` rows
    words, n = often.column("key").to_numpy().view(U64), often.column("n").to_numpy()
    order = np.argsort(words)
    shared = spark.sparkContext.broadcast((places, cached, np.append(words[order], U64((1 << 64) - 1)), np.append(n[order], 0)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, cached, known, count = shared.value
        for batch in batches:
            column = batch.column(1)
            for first, last in runs(column):
                rows = last - first
                words = Words(column.slice(first, rows), lower=True)
                flow, begins = stream(words)
                gram = grams_of(flow, begins, depth)
                at, there = places.find(gram)
                chance = np.add.reduceat(np.where(there, cached[at], 0.0), begins[:-1])
                far = np.flatnonzero(~there)
                seldom = _of_each(gram[far], np.searchsorted(begins, far, "right") - 1, rows)
                h = np.concatenate([words.hashes(), np.repeat(END_WORD, rows)])
                own = np.concatenate([words.text, np.arange(rows)])
                word, back = np.unique(h, return_inverse=True)
                at = np.searchsorted(known, word)
                c = np.where(known[at] == word, count[at], 0).astype(float)
                there = (c > 0)[back]
                base = np.bincount(own, np.log10(c + 1.0)[back], rows)
                rest = np.flatnonzero(~there)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, rows), pa.array(batch.column(2).slice(first, rows)), pa.array(words.counts + 1), pa.array(np.bincount(own, there, rows).astype(np.int64)),
                     pa.array(base), pa.array(chance), _of_each(h[rest], own[rest], rows), seldom],
                    ["id", "learns", "n_tokens", "n_known", "base", "score", "rest", "seldom"],
                )

    schema = f"id {dict(given.dtypes)['id']}, learns boolean, n_tokens long, n_known long, base double, score double, rest array<struct<key:long,times:long>>, seldom array<struct<key:long,times:long>>"
    scored = stored(mapped(given, run, schema).withColumn("row", F.monotonically_increasing_id()), "lm-scored")
    rare = scored.select("row", F.explode("rest").alias("w")).select("row", "w.key", "w.times")
    found = rare.join(vocabulary.where(F.col("n") < least), "key").groupBy("row").agg(F.sum("times").alias("more"), F.sum(F.col("times") * F.log10(F.col("n") + 1.0)).alias("add"))
    apart = scored.select("row", F.explode("seldom").alias("g")).select("row", "g.key", "g.times")
    deep = apart.join(table.where(F.col("n") < seen), "key").groupBy("row").agg(F.sum(F.col("times") * F.col("chance")).alias("deep"))
    size = float(np.log10(total[0] + total[1] + 1.0))
    return scored.drop("rest", "seldom").join(found, "row", "left").join(deep, "row", "left").select(
        F.col("id").alias(id_col),
        (~F.col("learns")).alias("held_out"),
        "n_tokens",
        (F.col("n_known") + F.coalesce("more", F.lit(0))).alias("n_known"),
        F.lit(int(total[0])).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("add", F.lit(0.0)) - F.col("n_tokens") * F.lit(size)).alias("base_score"),
        (F.col("score") + F.coalesce("deep", F.lit(0.0))).alias("score"),
    )
