"""Structural rewrites of graphs: edge surgery, checks, costs and budgets; bounded iteration and what it emits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dagframe.operators import graph

DIMENSIONS = ("nodes", "edges", "depth", "frontier", "ops")
#: The budget a run starts with.
BUDGET = {"nodes": 16, "edges": 32, "depth": 6, "frontier": 4, "ops": 4}


def namespaced(parent: Column, local: Column) -> Column:
    return F.concat_ws(":", parent.cast("string"), local.cast("string"))


def rewritten(edges: DataFrame, anchors: DataFrame, inner: DataFrame, entries: DataFrame, exits: DataFrame, kind: str) -> DataFrame:
    """Edges after a rewrite at each anchor (graph_id, id). `inner` holds the new sub-graph's edges, entries and exits its ends
    (graph_id, id), with final ids.

    replace: the sub-graph takes the anchor's place; envelope: the anchor stays before it and hands its successors over;
    append: the sub-graph follows the anchor, and successors wait for its exits."""
    if kind not in ("replace", "envelope", "append"):
        raise ValueError(kind)
    a = anchors.select("graph_id", F.col("id").alias("anchor"))
    before = edges.join(a, (edges.graph_id == a.graph_id) & (edges.dst == a.anchor)).select(edges.graph_id, "src")
    after = edges.join(a, (edges.graph_id == a.graph_id) & (edges.src == a.anchor)).select(edges.graph_id, "dst")
    rest = graph.remove_vertices(edges, anchors) if kind == "replace" else edges.join(anchors.select("graph_id", F.col("id").alias("src")), ["graph_id", "src"], "left_anti").select(*graph.EDGE)
    first = before if kind == "replace" else a.select("graph_id", F.col("anchor").alias("src"))
    into = first.join(entries.select("graph_id", F.col("id").alias("dst")), "graph_id")
    out = exits.select("graph_id", F.col("id").alias("src")).join(after, "graph_id")
    return rest.unionByName(inner.select(*graph.EDGE)).unionByName(into).unionByName(out.select(*graph.EDGE)).distinct()


def spec_faults(vertices: DataFrame, edges: DataFrame, entries: DataFrame, exits: DataFrame) -> DataFrame:
    """What is wrong with a sub-graph: (graph_id, id, fault). Vertices on no way from an entry to an exit, ends and edge ends that aren't vertices,
    repeated vertices, loops, no vertex, entry or exit at all, and vertices on or behind a cycle."""
    on = ["graph_id", "id"]
    ahead = graph.bfs_distance(edges, entries).select(*on)
    back = graph.bfs_distance(graph.transpose(edges), exits).select(*on)
    mark = lambda df, name: df.select(*on, F.lit(name).alias("fault"))
    ends = edges.select("graph_id", F.explode(F.array("src", "dst")).alias("id")).distinct()
    every = vertices.select("graph_id").union(edges.select("graph_id")).union(entries.select("graph_id")).union(exits.select("graph_id")).distinct()
    lacks = lambda df, name: every.join(df.select("graph_id"), "graph_id", "left_anti").select("graph_id", F.lit(None).cast("long").alias("id"), F.lit(name).alias("fault"))
    sorted_ = graph.levels(vertices, edges).select(*on)
    parts = [
        mark(vertices.select(*on).subtract(ahead.intersect(back)), "orphan"),
        mark(entries.join(vertices, on, "left_anti"), "unknown_entry"), mark(exits.join(vertices, on, "left_anti"), "unknown_exit"),
        mark(ends.join(vertices, on, "left_anti"), "unknown_end"), mark(vertices.groupBy(*on).count().where("count > 1"), "repeated"),
        mark(edges.where("src = dst").select("graph_id", F.col("src").alias("id")).distinct(), "loop"),
        lacks(vertices, "empty"), lacks(entries, "no_entry"), lacks(exits, "no_exit"),
        mark(vertices.select(*on).distinct().join(sorted_, on, "left_anti"), "cycle"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def cost(old: DataFrame, new: DataFrame) -> DataFrame:
    """What a rewrite adds to each graph: vertices, edges, levels of depth, vertices of the widest level, and one operation."""
    ends = lambda e: e.select("graph_id", F.explode(F.array("src", "dst")).alias("id")).distinct()
    n = ends(new).subtract(ends(old)).groupBy("graph_id").agg(F.count("*").alias("nodes"))
    m = new.subtract(old).groupBy("graph_id").agg(F.count("*").alias("edges"))

    def shape(e: DataFrame, name: str) -> DataFrame:
        widths = graph.levels(ends(e), e).groupBy("graph_id", "level").agg(F.count("*").alias("width"))
        return widths.groupBy("graph_id").agg(F.max("level").alias(f"depth_{name}"), F.max("width").alias(f"width_{name}"))

    out = m.join(n, "graph_id", "full").join(shape(new, "new"), "graph_id", "left").join(shape(old, "old"), "graph_id", "left")
    more = lambda k: F.greatest(F.lit(0), F.coalesce(f"{k}_new", F.lit(0)) - F.coalesce(f"{k}_old", F.lit(0)))
    return out.select("graph_id", F.coalesce("nodes", F.lit(0)).alias("nodes"), F.coalesce("edges", F.lit(0)).alias("edges"), more("depth").alias("depth"), more("width").alias("frontier"), F.lit(1).alias("ops"))


def admitted(journal: DataFrame, budget: dict[str, int] = BUDGET, key: str = "graph_id", order: str = "rewrite_id") -> DataFrame:
    """A journal of costs with what is left of the budget after each row, and the first dimension that was exceeded.

    Rows of mode `gassed` are charged, witnessed and external ones aren't. A row that exceeds the budget is refused and leaves it as
    it was, so that each row depends on the ones before: one graph's costs (not its whole rows) are folded in order."""
    dims = [d for d in DIMENSIONS if d in journal.columns]
    charge = F.struct(F.col(order).alias("at"), *(F.when(F.col("mode") == "gassed", F.col(d)).otherwise(0).cast("long").alias(d) for d in dims))
    left = lambda s, x, d: s[d] - x[d]

    def step(s: Column, x: Column) -> Column:
        fits = F.lit(True)
        for d in dims:
            fits = fits & (left(s, x, d) >= 0)
        over = F.coalesce(*(F.when(left(s, x, d) < 0, F.lit(d)) for d in dims))
        after = [F.when(fits, left(s, x, d)).otherwise(s[d]).alias(d) for d in dims]
        row = F.struct(x["at"].alias("at"), *after, over.alias("exceeded"))
        return F.struct(*after, F.concat(s["rows"], F.array(row)).alias("rows"))

    at = dict(journal.dtypes)[order]
    none = F.array().cast(f"array<struct<at:{at},{','.join(f'{d}:bigint' for d in dims)},exceeded:string>>")
    start = F.struct(*(F.lit(budget[d]).cast("long").alias(d) for d in dims), none.alias("rows"))
    folded = journal.groupBy(key).agg(F.aggregate(F.array_sort(F.collect_list(charge)), start, step)["rows"].alias("rows"))
    rows = folded.select(key, F.explode("rows").alias("r")).select(key, F.col("r.at").alias(order), *(F.col(f"r.{d}").alias(f"{d}_left") for d in dims), "r.exceeded")
    return journal.join(rows, [key, order])


def materialised(vertices: DataFrame, removed: DataFrame, added: DataFrame, rewrite: str) -> tuple[DataFrame, DataFrame]:
    """Vertices (graph_id, id, status) after a rewrite, removed ones gone and new ones pending, and where the new ones come from."""
    on = ["graph_id", "id"]
    fresh = added.select(*on).distinct().join(vertices, on, "left_anti")
    kept = vertices.select(*on, "status").join(removed.select(*on), on, "left_anti")
    return kept.unionByName(fresh.withColumn("status", F.lit("pending"))), fresh.withColumn("rewrite", F.lit(rewrite))


def reconciled(topology: DataFrame, statuses: DataFrame) -> DataFrame:
    """Statuses for all vertices of the topology: unknown ones are pending; a status without a vertex is a fault."""
    on = ["graph_id", "id"]
    both = topology.select(*on, F.lit(True).alias("there")).join(statuses.select(*on, "status"), on, "full_outer")
    return both.select(*on, F.coalesce("status", F.lit("pending")).alias("status"), F.when(F.col("there").isNull(), F.lit("no_vertex")).alias("fault"))


def self_appended(loops: DataFrame, local: DataFrame) -> DataFrame:
    """Ids of the vertices of each admitted pass (loop, passes): root:iter_i:local, flat, and the edges from a pass to the next one."""
    each = loops.where("passes > 0").select("loop", "passes", F.explode(F.sequence(F.lit(0), F.col("passes") - 1)).alias("pass"))
    name = lambda i: F.concat(F.col("loop").cast("string"), F.lit(":iter_"), i.cast("string"), F.lit(":"), F.col("local"))
    rows = each.crossJoin(F.broadcast(local.select("local")))  # `local` is one loop body, as long as its source text
    return rows.select("loop", "pass", "local", name(F.col("pass")).alias("id"), F.when(F.col("pass") + 1 < F.col("passes"), name(F.col("pass") + 1)).alias("next"))


def controlled(steps: DataFrame, bound: int, key: str, order: str, terminal: Column) -> DataFrame:
    """Each step of a loop with what is left of its bound, and whether it is admitted: until the bound is used up or a step before was the last."""
    w = Window.partitionBy(key).orderBy(order)
    out = steps.select("*", F.row_number().over(w).alias("_n"), F.coalesce(F.max(terminal.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_ended"))
    return out.select(key, order, F.greatest(F.lit(0), F.lit(bound) - F.col("_n")).alias("remaining"), ((F.col("_n") <= bound) & (F.col("_ended") == 0)).alias("admitted"))


def replayed(journal: DataFrame, watermark: int) -> DataFrame:
    """Journal rows by whether the stored topology holds them already."""
    return journal.withColumn("part", F.when(F.col("rewrite_id") <= watermark, "materialised").otherwise("pending"))


def admitted_bound(requested: Column, cap: Column) -> Column:
    """The smaller of both; a request of none is refused (null)."""
    return F.when(requested > 0, F.least(requested, cap))


def emitted(rows: DataFrame, key: str, order: str, value: str, policy: str, cap: int | None = None) -> DataFrame:
    """What a loop keeps of emitted values: accumulate the first `cap` in order, reduce to the last, or discard; and their number."""
    counts = F.count(value).alias("emitted")
    if policy == "accumulate":
        w = Window.partitionBy(key).orderBy(order)
        # no more than `cap` values of a key are gathered
        kept = rows.where(F.col(value).isNotNull()).withColumn("_place", F.row_number().over(w)).where(F.col("_place") <= cap)
        lists = kept.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("_place", value))), lambda x: x[value]).alias("kept"))
        return rows.groupBy(key).agg(counts).join(lists, key, "left")
    if policy == "reduce_last":
        return rows.groupBy(key).agg(counts, F.max_by(F.col(value), F.when(F.col(value).isNotNull(), F.col(order))).alias("kept"))
    if policy == "discard":
        return rows.groupBy(key).agg(counts)
    raise ValueError(policy)


def outcome(steps: Column, bound: Column, terminal: Column, on_exhaustion: str = "partial") -> Column:
    """How a loop ended: by its own terminal step, or by its bound, which fails, keeps the part, or falls back."""
    return F.when(terminal, "finished").when(steps >= bound, {"fail": "failed", "partial": "partial", "fallback": "fallback"}[on_exhaustion]).otherwise("running")
