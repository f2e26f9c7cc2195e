"""N-gram Jaccard join: documents whose sets of word shingles have a Jaccard similarity of at least 3/4, by skipping
along set relations.

A document's set holds its distinct 5-word shingles (a shorter text's whole sequence as one). Equal sets are one class
from the start. Each set's shingles are ordered by rarity, and those of its prefix are index entries: linked sets share one.

Answers of a set come from those of similar sets where they can. In some rounds classes are compared with leaders of their lists;
one that links takes over the leader's component, and from then on a list whose members stand in one component holds no question and is skipped whole. Entries meet across components
only; long index lists are in blocks by set size, an entry's place and size say which sizes can still reach it, and other
blocks are skipped before rows meet. So a group of near copies costs a few comparisons for each member, and every link between components is found.

Each set has a parity map: a bit for each slot that holds an odd number of its shingles. Where two maps differ, the sets differ, so that
two sets whose maps differ in more than a seventh of both sizes never link. Maps of 256 bits hold back pairs as entries meet, maps of two bits a shingle
those that are left, before whole sets are compared.

Rarity is counted over all shingles, in a table of fixed size; it only orders shingles, so that its collisions cost
time and never a link. Sets travel only for pairs that their maps let through.

Defined results: a text of no words has the empty set, links with nothing and is its own component; a null id is never a
component's smallest; rows of one id are compared as the documents they are; extra columns are dropped.
"""

from __future__ import annotations

import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dagframe.llm.components import components
from dagframe.llm.shared import mapped, released, stored
from dagframe.llm.wordbytes import U64, Words, distinct_by_text, mixed, runs, shingles

#: Slots of the rarity table and (at most) of the filters that keep rows out of shuffles; both cost time only where they collide.
SLOT_BITS, FILTER_BITS = 20, 25
PIECE = 1 << 14
#: Rounds in which classes ask leaders end when one pair in so many links, or after STAR_ROUNDS; the ratio of set sizes that a block
#: spans; lists of more entries are in blocks.
FEW_LINKS, STAR_ROUNDS, BLOCK, LONG_LIST = 20, 12, 1.1, 64
#: Words of 64 bits of a short parity map.
SHORT = 4


def _sets(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct shingles, how many each text has, and a hash of each set (its class)."""
    h, n = distinct_by_text(*shingles(Words(column, lower=True)))
    total = np.zeros(len(n), U64)
    if len(h):
        filled = np.flatnonzero(n)
        total[filled] = np.add.reduceat(mixed(h + U64(0x51ED270B)), (np.cumsum(n) - n)[filled])
    return h, n, mixed(total + n.astype(U64)).view(np.int64)


def rarity(texts: DataFrame) -> np.ndarray:
    """Class of how often the shingles of each slot occur, in eighths of a power of two."""
    slots = 1 << SLOT_BITS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(slots, np.int64)
        for batch in batches:
            for first, last in runs(batch.column(0)):
                h, _ = shingles(Words(batch.column(0).slice(first, last - first), lower=True))
                total += np.bincount((h >> U64(64 - SLOT_BITS)).astype(np.int64), minlength=slots)
        held = total.reshape(-1, PIECE)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(held), dtype=np.int32)), pa.array([np.minimum(x, 0xFFFFFFFF).astype(np.uint32).tobytes() for x in held], pa.binary())], ["piece", "n"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}  # at most slots / PIECE
        for batch in batches:
            for piece, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                sums[piece] = sums.get(piece, 0) + np.frombuffer(n, np.uint32).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], ["piece", "n"])

    rows = mapped(mapped(texts, count, "piece int, n binary").repartition("piece"), add, "piece int, n binary").collect()  # 8 MB
    out = np.zeros(slots, np.int64)
    for piece, n in rows:
        out[piece * PIECE : (piece + 1) * PIECE] = np.frombuffer(n, np.int64)
    return np.minimum(8 * np.log2(out + 1), 127).astype(np.uint8)


def _parity(h: np.ndarray, own: np.ndarray, width: np.ndarray) -> np.ndarray:
    """Parity maps, one behind the other, of sets of as many bits as `width` says (powers of two, 64 at least)."""
    slot = (np.cumsum(width) - width)[own] + (h & (width[own] - 1).astype(U64)).astype(np.int64)
    return np.packbits((np.bincount(slot, minlength=int(width.sum())) & 1).astype(np.uint8), bitorder="little")


def _prefixes(batch: pa.RecordBatch, classes: np.ndarray) -> Iterator[pa.RecordBatch]:
    for first, last in runs(batch.column(1)):
        rows = last - first
        h, n, cls = _sets(batch.column(1).slice(first, rows))
        token = classes[(h >> U64(64 - SLOT_BITS)).astype(np.int64)].astype(U64) << U64(56) | h >> U64(8)
        own = np.repeat(np.arange(rows), n)
        width = np.maximum(64 * SHORT, 1 << np.ceil(np.log2(np.maximum(2 * n, 1))).astype(np.int64))
        whole, short = _parity(h, own, width), _parity(h, own, np.full(rows, 64 * SHORT)).view(np.int64).reshape(rows, SHORT)
        maps = pa.BinaryArray.from_buffers(pa.binary(), rows, [None, pa.py_buffer(np.concatenate([[0], np.cumsum(width // 8)]).astype(np.int32)), pa.py_buffer(whole)])
        order = np.lexsort((token, own))
        token = token[order]
        place = np.arange(len(token)) - np.repeat(np.cumsum(n) - n, n)
        most = np.where(n > 0, n - (3 * n + 3) // 4 + 1, 0)
        keep = place < most[own]
        edges = np.concatenate([[0], np.cumsum(most)]).astype(np.int32)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0).slice(first, rows), pa.array(cls), pa.array(n.astype(np.int64)), pa.ListArray.from_arrays(pa.array(edges), pa.array(token[keep].view(np.int64))), batch.column(2).slice(first, rows), maps]
            + [pa.array(short[:, k]) for k in range(SHORT)],
            ["id", "cls", "n", "prefix", "key", "map", *(f"s{k}" for k in range(SHORT))],
        )


def cleaned(spark: SparkSession) -> None:
    """Lets Spark's cleaner delete the shuffles of queries that are over: it does so once their plans are collected as garbage."""
    gc.collect()
    spark._jvm.System.gc()


def _slots(keys: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    h = mixed(keys.view(U64))
    return (h >> U64(64 - width)).astype(np.int64), (h << U64(width) >> U64(64 - width)).astype(np.int64)


def _bits(keys: DataFrame, column: str, count: int | None = None) -> np.ndarray:
    """A filter with two bits for the hash of each key: at most 2**FILTER_BITS bits come to the driver, whatever the keys; some 16 a key
    where their count is given."""
    width = FILTER_BITS if count is None else min(FILTER_BITS, max(PIECE.bit_length() + 3, (16 * count).bit_length()))

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(1 << width, bool)
        for batch in batches:
            for slot in _slots(batch.column(0).to_numpy(), width):
                bits[slot] = True
        packed = np.packbits(bits).reshape(-1, PIECE)
        some = np.flatnonzero(packed.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array([packed[k].tobytes() for k in some], pa.binary())], ["piece", "n"])

    def either(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}  # at most 2**FILTER_BITS / 8 / PIECE
        for batch in batches:
            for piece, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held[piece] = held.get(piece, 0) | np.frombuffer(n, np.uint8)
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([x.tobytes() for x in held.values()], pa.binary())], ["piece", "n"])

    rows = mapped(mapped(keys.select(column), mark, "piece int, n binary").repartition("piece"), either, "piece int, n binary").collect()
    out = np.zeros((1 << width) // 8, np.uint8)
    for piece, n in rows:
        out[piece * PIECE : (piece + 1) * PIECE] = np.frombuffer(n, np.uint8)
    return out


def _marked(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    one, two = (bits[slot >> 3] >> (7 - (slot & 7)).astype(np.uint8) & 1 for slot in _slots(keys, len(bits).bit_length() + 2))
    return one & two == 1


def _joined(pairs: DataFrame, held: DataFrame, step, name: str) -> DataFrame:
    """Pairs (a, b) with `same`, what `step` makes of both classes' rows of `held` (cls, held); those of which it makes none are left out."""
    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                made = pa.array([step(np.frombuffer(x, U64), np.frombuffer(y, U64)) for x, y in zip(part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True)], pa.int64())
                keep = made.is_valid()
                yield pa.RecordBatch.from_arrays([part.column(0).filter(keep), part.column(1).filter(keep), made.filter(keep)], ["a", "b", "same"])

    full = pairs.join(held.select(F.col("cls").alias("a"), F.col("held").alias("x")), "a").join(held.select(F.col("cls").alias("b"), F.col("held").alias("y")), "b")
    return stored(mapped(full.select("a", "b", "x", "y"), check, "a long, b long, same long"), name)


def _same(x: np.ndarray, y: np.ndarray) -> int:
    place = np.minimum(np.searchsorted(y, x), len(y) - 1)
    return int((y[place] == x).sum())


def _may_link(x: np.ndarray, y: np.ndarray) -> int | None:
    """By parity maps, each after its set's size: how many shingles the sets differ in at least."""
    n, x, y = int(x[0] + y[0]), x[1:], y[1:]
    while len(x) != len(y):  # the wider one, folded, is the map that a set has at half the width
        if len(x) < len(y):
            x, y = y, x
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    differ = int(np.bitwise_count(x ^ y).sum())
    return differ if 7 * differ <= n else None


def _compared(pairs: DataFrame, held: DataFrame, texts: DataFrame) -> DataFrame:
    """Pairs (a, b) of classes with `same`, the size of their intersection, but for those that parity maps rule out. Whole sets are made
    again for the classes that are left, from one text of each."""
    likely = _joined(pairs, held.select("cls", "held"), _may_link, "likely").drop("same")
    asked = stored(likely.select(F.col("a").alias("cls")).unionAll(likely.select(F.col("b").alias("cls"))).distinct().join(held.select("cls", "key"), "cls"), "asked")
    count = asked.count()
    wanted, keys = (texts.sparkSession.sparkContext.broadcast(_bits(asked, c, count)) for c in ("cls", "key"))

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: set[int] = set()  # classes of this task's rows
        for batch in batches:
            some = batch.column(1).filter(pa.array(_marked(keys.value, batch.column(0).to_numpy())))
            for first, last in runs(some):
                h, n, cls = _sets(some.slice(first, last - first))
                edge = np.concatenate([[0], np.cumsum(n)])
                new = []
                for k in np.flatnonzero(_marked(wanted.value, cls) & (n > 0)).tolist():
                    if int(cls[k]) not in sent:
                        sent.add(int(cls[k]))
                        new.append(k)
                if new:
                    yield pa.RecordBatch.from_arrays([pa.array(cls[new]), pa.array([h[edge[k] : edge[k + 1]].tobytes() for k in new], pa.binary())], ["cls", "held"])

    whole = stored(mapped(texts, fetch, "cls long, held binary").dropDuplicates(["cls"]), "fetched")
    out = _joined(likely, whole, _same, "compared")
    released(asked, whole)
    return out


def _links(compared: DataFrame, sizes: DataFrame) -> DataFrame:
    """Adds both sizes and whether the two sets link."""
    m, n = (sizes.select(F.col("cls").alias(c), F.col("n").alias(f"n_{c}")) for c in ("a", "b"))
    return compared.join(m, "a").join(n, "b").withColumn("linked", F.expr("100 * same >= 75 * (n_a + n_b - same)"))


def _rooted(entries: DataFrame, roots: DataFrame | None) -> DataFrame:
    """Adds the component of each entry's class and how many classes that has."""
    if roots is None:
        return entries.withColumn("root", F.col("cls")).withColumn("weight", F.lit(1).cast("long"))
    of = roots.join(roots.groupBy("root").agg(F.count("*").alias("weight")), "root").select(F.col("node").alias("cls"), "root", "weight")
    return entries.join(of, "cls", "left").withColumn("root", F.coalesce("root", "cls")).withColumn("weight", F.coalesce("weight", F.lit(1)))


def _asked(entries: DataFrame, turn: int) -> DataFrame:
    """Pairs (a, b) of classes and leaders of their lists. Lists of one component are skipped whole.

    At first the smallest set leads a list, and each class asks the one leader that it shares most entries with. Later any class of the
    list's largest component leads, another one in each list, and the others ask the leaders of all their lists: a pair an entry at most."""
    order = F.struct("n", "cls", "root", "place") if turn == 0 else F.struct((-F.col("weight")).alias("w"), F.xxhash64("cls", "token", F.lit(turn)).alias("h"), "cls", "root", "n", "place")
    lead = entries.groupBy("token").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.min(order).alias("lead")).where("low < high").select("token", "lead")
    near = "4 * n >= 3 * lead.n and 4 * lead.n >= 3 * n and 7 * least(n - place, lead.n - lead.place) >= 3 * (n + lead.n)"
    led = entries.join(lead, "token").where(f"root <> lead.root and {near}").select("cls", F.col("lead.cls").alias("a"))
    if turn == 0:
        shared = led.groupBy("cls", "a").agg(F.count("*").alias("k"))
        led = shared.groupBy("cls").agg(F.max(F.struct("k", "a")).alias("best")).select("cls", "best.a")
    return led.select(F.least("a", "cls").alias("a"), F.greatest("a", "cls").alias("b")).distinct()


def _block(n: str) -> str:
    return f"cast(floor(log({n}) / log({BLOCK})) as int)"


#: Two entries of one list that may stand for a link, the first one's set not above the other's.
_MEET = (
    "x.token = y.token and x.block = y.block and x.root <> y.root and struct(x.n, x.cls) < struct(y.n, y.cls) and 4 * x.n >= 3 * y.n "
    "and 7 * least(x.n - x.place, y.n - y.place) >= 3 * (x.n + y.n) and 7 * (" + " + ".join(f"bit_count(x.s{k} ^ y.s{k})" for k in range(SHORT)) + ") <= x.n + y.n"
)


def _open(entries: DataFrame) -> DataFrame:
    """Entries of lists that hold several components, and whether the list is long."""
    lists = entries.groupBy("token").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("k"))
    return entries.join(lists.where("low < high").select("token", (F.col("k") > LONG_LIST).alias("long")), "token")


def _crossing(entries: DataFrame, held: DataFrame) -> DataFrame:
    """Pairs (a, b) across components that share a token at places from which both can still link, and whose short maps let them.
    Entries of a long list are in the block of their size, and in all blocks that they must meet: from its place and size an entry works out which
    sizes not above its own can still reach it."""
    most = "least(n, cast(floor((7 * (n - place) - 3 * n) / 3) as bigint))"
    least = "cast(ceil(3 * n / 4) as bigint)"
    open_ = stored(_open(entries).select("token", "cls", "root", "place", "long").join(held.drop("held", "key"), "cls"), "open")
    x = open_.where("7 * place <= n").withColumn("block", F.expr(f"if(long, {_block('n')}, -1)")).alias("x")
    y = open_.where(f"{most} >= {least}").withColumn("block", F.explode(F.expr(f"if(long, sequence({_block(least)}, {_block(most)}), array(-1))"))).alias("y")
    pairs = stored(x.join(y, F.expr(_MEET)).select(F.col("x.cls").alias("a"), F.col("y.cls").alias("b")).distinct(), "crossing")
    released(open_)
    return pairs


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", star_rounds: int = STAR_ROUNDS) -> DataFrame:
    """Per row: id, n_shingles, and component_id, the smallest id reachable by links."""
    spark = docs.sparkSession
    given = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(id_col).alias("key"))
    texts = given.select("key", "text")
    classes = spark.sparkContext.broadcast(rarity(given.select("text")))

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from _prefixes(batch, classes.value)

    sets = stored(mapped(given, prefixes, f"id {dict(given.dtypes)['id']}, cls long, n long, prefix array<long>, key long, map binary, {', '.join(f's{k} long' for k in range(SHORT))}"), "prefixes")

    # Of each class: size, maps, and the key of one text; `held` is the size and the wide map.
    size = F.unhex(F.concat(*(F.substring(F.lpad(F.hex("n"), 16, "0"), k, 2) for k in range(15, 0, -2))))
    held = stored(sets.where("n > 0").groupBy("cls").agg(F.min("key").alias("key"), *(F.min(c).alias(c) for c in ("n", "map", *(f"s{k}" for k in range(SHORT))))).withColumn("held", F.concat(size, "map")).drop("map"), "classes")

    # Lists of one class need no entries, nor do those in which every entry comes too late for a link to a set not below its own.
    tokens = sets.select("cls", "n", F.posexplode("prefix").alias("place", "token")).groupBy("token").agg(F.min("cls").alias("low"), F.max("cls").alias("high"), F.max(F.expr("7 * place <= n")).alias("early"))
    several = spark.sparkContext.broadcast(_bits(tokens.where("low < high and early").select("token"), "token"))

    def indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cls, n, lists = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2)
            size = np.diff(lists.offsets.to_numpy())
            token = lists.flatten().to_numpy()
            own = np.repeat(np.arange(len(size)), size)
            place = np.arange(len(token)) - np.repeat(np.cumsum(size) - size, size)
            keep = _marked(several.value, token)
            yield pa.RecordBatch.from_arrays([pa.array(token[keep]), pa.array(cls[own[keep]]), pa.array(n[own[keep]]), pa.array(place[keep].astype(np.int64))], ["token", "cls", "n", "place"])

    entries = mapped(sets.select("cls", "n", "prefix").where("n > 0"), indexed, "token long, cls long, n long, place long")
    entries = stored(entries.groupBy("token", "cls").agg(F.min("n").alias("n"), F.min("place").alias("place")), "index")
    cleaned(spark)
    sizes = held.select("cls", "n")

    live, roots = entries, None
    for turn in range(star_rounds):
        asked = stored(_asked(_rooted(live, roots), turn), "pairs")
        compared = _compared(asked, held, texts)
        made = stored(_links(compared, sizes).where("linked").select("a", "b"), "links")
        all_, linked = asked.count(), made.count()
        was = roots
        roots = components(made if was is None else made.unionAll(was.toDF("a", "b")))
        released(asked, compared, made)
        if was is not None:
            released(was)
        if turn == 0:
            live = stored(_open(_rooted(entries, roots)).select(*entries.columns), "live")
        elif linked * FEW_LINKS < all_ or not all_:
            break
        cleaned(spark)
    crossing = _crossing(_rooted(live, roots), held)
    last = _compared(crossing, held, texts)
    found = _links(last, sizes).where("linked").select("a", "b")
    was, roots = roots, components(found if roots is None else found.unionAll(roots.toDF("a", "b")))
    if was is not None:
        released(was)

    rows = sets.select("id", "cls", "n").join(roots.select(F.col("node").alias("cls"), "root"), "cls", "left").select("id", "n", F.coalesce("root", "cls").alias("root"))
    rows = stored(rows, "rows")
    released(sets, held, entries, crossing, last, roots)
    if star_rounds:
        released(live)
    least = rows.where("n > 0").groupBy("root").agg(F.min("id").alias("least"))
    return rows.join(least, "root", "left").select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("id")).alias("component_id"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The document with the smallest id of each component; of rows that agree in id and text, one."""
    found = near_copies(docs, id_col, text_col)
    kept = found.where(F.col(id_col).eqNullSafe(F.col("component_id"))).select(F.col(id_col).alias("_kept")).distinct()
    row = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    row = row.select("row", F.col("row")[id_col].alias("id"), F.xxhash64(F.col("row")[text_col]).alias("same"))
    return row.join(kept, F.col("id").eqNullSafe(F.col("_kept")), "left_semi").dropDuplicates(["id", "same"]).select("row.*")
