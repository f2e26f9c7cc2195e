"""Mixing sources to target weights, with DataFrame operations alone.

Each document gets a hash-random key. Every source is taken in the order of its keys: whole passes over the source
first, then the part of one more pass that its budget leaves. The cut is found without sorting whole sources: words are
summed by source and key range, prefix sums over the ranges name the one range that holds the cut, and only that range's
rows are sorted. What is compared and shuffled are keys and sizes, never texts.

Targets: sources in code-point order (null last) weigh 5, 2, 1, repeating, and share `ratio` times all words; a target
stops at `most` times its source's words, and the excess goes to the others by weight until none is above.

Defined results: a null or blank text has size 0 and takes 0; a source of no words has target 0; a null source is a source
of its own; a null id counts as the empty text; repeated rows (same id and size) take equal parts of what reaches them,
rounded down; no rows give no rows; extra columns are not read by the cut and pass through `materialised` unchanged.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dagframe.llm.shared import stored

WORD = r"[^\x20\x09-\x0D]+"
#: Key ranges of a source. The rows sorted are those of one range of each source.
RANGES = 1024
#: Copies of a source's row when documents meet their sources, so that a hot source is no single key.
SALTS = 64


def _marked(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """Each row as one struct, so that no column of it clashes, with its source, key and size."""
    row = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"))
    size = F.coalesce(F.regexp_count(F.col("_row")[text_col], F.lit(WORD)), F.lit(0)).cast("long")
    return row.select("*", size.alias("_size")).select(
        "*",
        F.coalesce(F.concat(F.lit("1"), F.col("_row")[source_col]), F.lit("2")).alias("_source"),
        F.md5(F.concat(F.coalesce(F.col("_row")[id_col].cast("string"), F.lit("")), F.lit(":"), F.col("_size").cast("string"))).alias("_key"),
    )


def targets(sources: DataFrame, weights: tuple[int, ...] = (5, 2, 1), ratio: float = 1.5, most: float = 2.0) -> DataFrame:
    """Of (_source, _total): adds the target in words. One row a source goes through one task."""
    everything = Window.partitionBy()
    cycle = F.array(*(F.lit(w).cast("long") for w in weights))
    ranked = sources.select("*", F.row_number().over(Window.orderBy("_source")).alias("_rank"))
    weighed = ranked.select(
        "_source", "_total",
        F.element_at(cycle, ((F.col("_rank") - 1) % len(weights) + 1).cast("int")).alias("_weight"),
        (F.sum("_total").over(everything) * ratio).alias("_all"),
    ).withColumn("_cap", F.col("_total") * most)
    # In the order of cap to weight, a source is full if its share of what the full ones before it leave reaches its cap.
    before = Window.orderBy(F.col("_cap") / F.col("_weight"), "_source").rowsBetween(Window.unboundedPreceding, -1)
    shared = weighed.select(
        "*",
        (F.col("_all") - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))).alias("_left"),
        (F.sum("_weight").over(everything) - F.coalesce(F.sum("_weight").over(before), F.lit(0))).alias("_sharers"),
    ).withColumn("_full", F.col("_left") / F.col("_sharers") * F.col("_weight") > F.col("_cap"))
    open_weight = F.sum(F.when(~F.col("_full"), F.col("_weight"))).over(everything)
    open_words = F.col("_all") - F.coalesce(F.sum(F.when(F.col("_full"), F.col("_cap"))).over(everything), F.lit(0.0))
    return shared.select("_source", "_total", F.when(F.col("_full"), F.col("_cap")).otherwise(open_words / open_weight * F.col("_weight")).alias("_target"))


def _cuts(marked: DataFrame, weights, ratio, most, ranges) -> DataFrame:
    """A row for each source: whole passes, the key at which the last pass is cut, and what each row of that key takes."""
    ranged = marked.select("_source", "_key", "_size", (F.conv(F.substring("_key", 1, 4), 16, 10).cast("int") * ranges / 65536).cast("int").alias("_range"))
    sums = stored(ranged.groupBy("_source", "_range").agg(F.sum("_size").alias("_words")), "mix-ranges")
    goals = targets(sums.groupBy("_source").agg(F.sum("_words").alias("_total")), weights, ratio, most)
    words = F.floor(F.col("_target") + 0.5)
    goals = goals.select(
        "*",
        F.when(F.col("_total") > 0, F.floor(words / F.col("_total"))).otherwise(0).cast("long").alias("_passes"),
    ).withColumn("_rest", (words - F.col("_passes") * F.col("_total")).cast("long"))
    upto = Window.partitionBy("_source").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    placed = sums.select("*", F.coalesce(F.sum("_words").over(upto), F.lit(0)).alias("_before")).join(goals, "_source")
    holds = (F.col("_before") < F.col("_rest")) & (F.col("_rest") <= F.col("_before") + F.col("_words"))
    held = stored(placed.where(holds).select("_source", "_range", "_before", "_rest"), "mix-cut")
    keys = ranged.join(held, ["_source", "_range"]).groupBy("_source", "_range", "_key", "_size", "_before", "_rest").agg(F.count("*").alias("_n"))
    inside = Window.partitionBy("_source").orderBy("_key").rowsBetween(Window.unboundedPreceding, -1)
    reach = keys.select("*", (F.col("_before") + F.coalesce(F.sum(F.col("_size") * F.col("_n")).over(inside), F.lit(0))).alias("_at"))
    ends = (F.col("_at") < F.col("_rest")) & (F.col("_rest") <= F.col("_at") + F.col("_size") * F.col("_n"))
    cut = reach.where(ends).select("_source", F.col("_key").alias("_cut"), F.floor((F.col("_rest") - F.col("_at")) / F.col("_n")).cast("long").alias("_part"))
    return stored(goals.join(cut, "_source", "left").select("_source", "_total", "_target", "_passes", "_cut", "_part"), "mix-sources")


def _met(marked: DataFrame, cuts: DataFrame) -> DataFrame:
    """Documents with their source's row. Its stored size decides between a broadcast and a salted shuffle."""
    salted = cuts.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salt = (F.conv(F.substring("_key", 1, 4), 16, 10).cast("int") % SALTS).alias("_salt")
    extra = F.when(F.col("_key") < F.col("_cut"), F.col("_size")).when(F.col("_key") == F.col("_cut"), F.col("_part")).otherwise(0)
    met = marked.select("*", salt).join(salted, ["_source", "_salt"])
    return met.withColumn("_taken", (F.col("_passes") * F.col("_size") + extra).cast("long"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (5, 2, 1), ratio: float = 1.5, most: float = 2.0, ranges: int = RANGES) -> DataFrame:
    """The mix by document: id, size, source_size, target and taken words."""
    marked = _marked(docs.select(id_col, text_col, source_col), id_col, text_col, source_col)
    marked = stored(marked.select(F.col("_row")[id_col].alias(id_col), "_source", "_key", "_size"), "mix-keys")
    met = _met(marked, _cuts(marked, weights, ratio, most, ranges))
    return met.select(id_col, F.col("_size").alias("size"), F.col("_total").alias("source_size"), F.col("_target").alias("target"), F.col("_taken").alias("taken"))


def materialised(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (5, 2, 1), ratio: float = 1.5, most: float = 2.0, ranges: int = RANGES) -> DataFrame:
    """The mix as documents, unchanged and in whole texts: a row for each pass that takes at least half of it."""
    marked = _marked(docs, id_col, text_col, source_col)
    slim = stored(marked.select("_source", "_key", "_size"), "mix-keys")
    met = _met(marked, _cuts(slim, weights, ratio, most, ranges))
    copies = F.floor(F.col("_taken") / F.greatest(F.col("_size"), F.lit(1)) + 0.5).cast("int")
    return met.where(copies > 0).select("_row", F.explode(F.array_repeat(F.lit(0), copies))).select("_row.*")
