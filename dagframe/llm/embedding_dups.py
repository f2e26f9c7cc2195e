"""Embedding near-dedup by sign codes and matrix products.

Each pass gives every vector a code, the signs of its products with random directions; vectors with equal codes are one
bucket, and all pairs of a bucket are compared, however many it holds: a bucket is dealt into blocks, and each pair of blocks is
one matrix product. Pairs whose cosine in double precision reaches the threshold are links; a tile sends on no more links than
connect what it found. Passes together give the components. Two vectors share a code of s signs with a chance that follows from
their angle alone, and the passes are as many as leave at most `miss` of the pairs at the threshold (closer ones are found
much sooner), wherever they lie. What follows from the data is only how many signs cost least, by bucket sizes counted in the first
pass: where much is crowded together without being links, codes get longer and passes more.

Then the links are counted in full within each component, by the same tiles, from which only a count for each vector
comes out. Equal vectors are one row with their number throughout.

Defined results: null, empty and zero vectors and those with null or non-finite components link with nothing; vectors of
different lengths don't link; rows that share an id are vectors of their own; extra columns are dropped.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dagframe.llm.components import components
from dagframe.llm.shared import stored

#: Signs of the longest code, the step between lengths that are weighed, and rows of a block.
SIGNS, STEP, BLOCK = 33, 3, 1024
MOST_PASSES = 200
#: What a row sent to a tile costs, in products of two vectors.
ROW_COST = 3000


def passes_for(signs: int, threshold: float, miss: float) -> int:
    """The passes after which a pair at the threshold has missed a shared code of `signs` signs in all with a chance of `miss` at most."""
    shared = (1 - math.acos(threshold) / math.pi) ** signs
    return 1 if shared >= 1 else max(1, math.ceil(math.log(miss) / math.log1p(-shared)))


def _directions(turn: int, size: int) -> np.ndarray:
    return np.random.default_rng([turn, size]).normal(size=(size, SIGNS))


def unit_rows(column: pa.Array) -> list[bytes | None]:
    """Each vector as the bytes of its unit vector in double precision."""
    out: list[bytes | None] = []
    for x in column.to_pylist():
        made = None
        if x and None not in x:
            v = np.array(x, float)
            if np.isfinite(v).all() and (top := np.abs(v).max()) > 0:
                v = v / top
                made = (v / math.sqrt(float(v @ v))).tobytes()
        out.append(made)
    return out


def _class(x: bytes) -> int:
    return int.from_bytes(hashlib.md5(x).digest()[:8], "little", signed=True)


def _matrix(held: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Vectors as rows, filled up with zeros, and their lengths."""
    sizes = np.array([len(x) // 8 for x in held])
    out = np.zeros((len(held), int(sizes.max(initial=0))))
    for size in np.unique(sizes):
        at = np.flatnonzero(sizes == size)
        out[at, :size] = np.frombuffer(b"".join(held[k] for k in at), float).reshape(len(at), size)
    return out, sizes


def _parts(table: pa.Table, threshold: float) -> Iterator[tuple]:
    """Of each component or bucket of a tile: its rows, which of them face which, whether these are all, and who is linked."""
    roots, sides = table.column("root").to_numpy(), table.column("side").to_numpy()
    held = table.column("held").to_pylist()
    order = np.argsort(roots, kind="stable")
    for part in np.split(order, np.flatnonzero(np.diff(roots[order])) + 1):
        side = sides[part]
        whole = side[0] < 0
        if whole and len(part) == 1:
            continue
        v, sizes = _matrix([held[k] for k in part])
        x, y = (np.arange(len(part)),) * 2 if whole else (np.flatnonzero(side == 0), np.flatnonzero(side == 1))
        linked = (v[x] @ v[y].T >= threshold) & (sizes[x][:, None] == sizes[y][None])
        if whole:
            np.fill_diagonal(linked, False)
        yield part, x, y, whole, linked


def _near(table: pa.Table, threshold: float) -> pa.Table:
    """Of the vectors of a tile, each with the first one that its links reach."""
    cls = table.column("cls").to_numpy()
    left, right = [cls[:0]], [cls[:0]]
    for part, x, y, _, linked in _parts(table, threshold):
        i, j = np.nonzero(linked)
        if not len(i):
            continue
        i, j = x[i], y[j]
        label = np.arange(len(part))
        while (label[i] != label[j]).any():
            low = np.minimum(label[i], label[j])
            for at in (label[i], label[j], i, j):
                np.minimum.at(label, at, low)
            label = label[label]
        own = np.flatnonzero(label != np.arange(len(part)))
        left.append(cls[part[label[own]]])
        right.append(cls[part[own]])
    return pa.table({"a": np.concatenate(left), "b": np.concatenate(right)})


def _counted(table: pa.Table, threshold: float) -> pa.Table:
    """Links of the vectors of one tile, or of many whole small components."""
    cls, copies = table.column("cls").to_numpy(), table.column("copies").to_numpy()
    names, sums = [cls[:0]], [copies[:0]]
    for part, x, y, whole, linked in _parts(table, threshold):
        for at, n in ((x, linked @ copies[part][y]), *(() if whole else ((y, linked.T @ copies[part][x]),))):
            names.append(cls[part][at])
            sums.append(n)
    return pa.table({"cls": np.concatenate(names), "n": np.concatenate(sums).astype(np.int64)})


def _tiles(rows: DataFrame, few: int) -> DataFrame:
    """Adds `tile` and `side` to rows of groups `root` of `size`: a large one is dealt into blocks, and a row goes to the tiles of its block."""
    blocks = rows.withColumn("blocks", F.ceil(F.col("size") / BLOCK).cast("int")).withColumn("mine", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int"))
    return blocks.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        *(c for c in rows.columns if c != "size"),
        F.when(F.col("mine") == F.col("other"), -1).otherwise((F.col("mine") > F.col("other")).cast("int")).alias("side"),
        F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("root"), F.lit(few))).otherwise(F.xxhash64("root", F.least("mine", "other"), F.greatest("mine", "other"))).alias("tile"),
    )


def _signs(codes: DataFrame, threshold: float, miss: float) -> int:
    """The number of signs by which all passes cost least, by the buckets of one pass (size, code)."""
    allowed = [s for s in range(0, SIGNS + 1, STEP) if passes_for(s, threshold, miss) <= MOST_PASSES]
    cut = codes.select("size", F.explode(F.array(*(F.struct(F.lit(s).alias("signs"), F.shiftright("code", SIGNS - s).alias("code")) for s in allowed))).alias("c"))
    buckets = cut.groupBy("size", "c.signs", "c.code").agg(F.count("*").cast("double").alias("n"))
    cost = F.sum(F.lit(float(ROW_COST)) * F.col("n") * F.ceil(F.col("n") / BLOCK) + F.col("n") * F.col("n"))
    costs = {r.signs: r.cost * passes_for(r.signs, threshold, miss) for r in buckets.groupBy("signs").agg(cost.alias("cost")).collect()}
    return min(costs, key=lambda s: (costs[s], s), default=0)


def near_copies(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = 0.95, miss: float = 0.01) -> DataFrame:
    """Per row: id, n_links, component_id and kept."""
    given = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("vector"))

    def unit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = unit_rows(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([None if x is None else _class(x) for x in held], pa.int64()), pa.array(held, pa.binary())], ["id", "cls", "held"])

    rows = stored(given.mapInArrow(unit, f"id {dict(given.dtypes)['id']}, cls long, held binary"), "vectors")
    classes = stored(rows.where("cls is not null").groupBy("cls").agg(F.count("*").alias("copies"), F.min("held").alias("held")), "classes")
    n_classes = classes.count()

    def code(turns: int, signs: int, rows: bool):
        weight = np.int64(1) << np.arange(signs - 1, -1, -1)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, 4096):
                    part = batch.slice(at, 4096)
                    v, sizes = _matrix(part.column(1).to_pylist())
                    for turn in range(turns):
                        codes = np.zeros(len(v), np.int64)
                        for size in np.unique(sizes).tolist():
                            own = sizes == size
                            codes[own] = (v[own, :size] @ _directions(turn, size)[:, :signs] > 0) @ weight
                        made = [pa.array(np.full(len(v), turn)), pa.array(sizes.astype(np.int64)), pa.array(codes)]
                        yield pa.RecordBatch.from_arrays([*made, part.column(0), part.column(1)] if rows else made, ["turn", "size", "code", "cls", "held"][: 5 if rows else 3])

        return run

    given_codes, bucket = classes.select("cls", "held"), F.xxhash64("turn", "size", "code").alias("root")
    signs = _signs(given_codes.mapInArrow(code(1, SIGNS, False), "turn long, size long, code long"), threshold, miss)
    turns = passes_for(signs, threshold, miss)
    crowded = given_codes.mapInArrow(code(turns, signs, False), "turn long, size long, code long").groupBy(bucket).agg(F.count("*").alias("size"))
    crowded = stored(crowded.where(F.col("size") > BLOCK), "crowded")  # at most a row for each BLOCK rows
    coded = given_codes.mapInArrow(code(turns, signs, True), "turn long, size long, code long, cls long, held binary").select(bucket, "cls", "held")
    placed = _tiles(coded.join(crowded, "root", "left").withColumn("size", F.coalesce("size", F.lit(1))), max(1, turns * n_classes // (4 * BLOCK)))
    links = stored(placed.groupBy("tile").applyInArrow(lambda table: _near(table, threshold), "a long, b long"), "links")
    roots = components(links)

    member = stored(roots.withColumnRenamed("node", "cls").join(classes, "cls"), "members")
    sizes = member.groupBy("root").agg(F.count("*").alias("size"))
    tiles = _tiles(member.join(sizes, "root").select("root", "cls", "copies", "held", "size"), max(1, member.count() // (4 * BLOCK)))
    counts = tiles.groupBy("tile").applyInArrow(lambda table: _counted(table, threshold), "cls long, n long").groupBy("cls").agg(F.sum("n").alias("n"))
    of_class = stored(classes.select("cls", "copies").join(counts, "cls", "left").join(roots.withColumnRenamed("node", "cls"), "cls", "left").select("cls", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n"), F.coalesce("root", "cls").alias("root")), "counts")
    known = stored(rows.select("id", "cls").join(of_class, "cls", "left"), "rows")
    least = known.where("root is not null").groupBy("root").agg(F.min("id").alias("least"))
    out = known.join(least, "root", "left").withColumn("component", F.coalesce("least", "id"))
    return out.select(F.col("id").alias(id_col), F.coalesce("n", F.lit(0)).alias("n_links"), F.col("component").alias("component_id"), F.col("id").eqNullSafe(F.col("component")).alias("kept"))
