"""Graphs as frames: vertices (graph_id, id) and edges (graph_id, src, dst), many graphs at once.

Walks are loops of joins over all graphs together; each step is written to the shared folder and the loop ends when no row is
new. Orders that depend on every step before (depth first, by priority) run on one graph's edges in one task a graph.
"""

from __future__ import annotations

import heapq
from collections import deque
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dagframe.sources.tables import Growing, released, written

EDGE = ["graph_id", "src", "dst"]


def path(vertices: DataFrame, order: str = "id") -> DataFrame:
    w = Window.partitionBy("graph_id").orderBy(order)
    return vertices.select("graph_id", F.col("id").alias("src"), F.lead("id").over(w).alias("dst")).where("dst is not null")


def clique(vertices: DataFrame) -> DataFrame:
    """An edge from each vertex to every later one."""
    a, b = vertices.select("graph_id", F.col("id").alias("src")), vertices.select("graph_id", F.col("id").alias("dst"))
    return a.join(b, "graph_id").where("src < dst")


def star(vertices: DataFrame) -> DataFrame:
    """From each graph's first vertex to all others."""
    hub = vertices.groupBy("graph_id").agg(F.min("id").alias("src"))
    return vertices.join(hub, "graph_id").where("id <> src").select("graph_id", "src", F.col("id").alias("dst"))


def overlay(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b).distinct()


def connect(a: DataFrame, b: DataFrame) -> DataFrame:
    """Edges from all of a's vertices to all of b's, graph by graph."""
    return a.select("graph_id", F.col("id").alias("src")).join(b.select("graph_id", F.col("id").alias("dst")), "graph_id").distinct()


def transpose(edges: DataFrame) -> DataFrame:
    return edges.select("graph_id", F.col("dst").alias("src"), F.col("src").alias("dst"))


def induced(edges: DataFrame, kept: DataFrame) -> DataFrame:
    inside = edges.join(kept.select("graph_id", F.col("id").alias("src")), ["graph_id", "src"], "left_semi")
    return inside.join(kept.select("graph_id", F.col("id").alias("dst")), ["graph_id", "dst"], "left_semi").select(*EDGE)


def diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows added and removed, with `change`."""
    return new.subtract(old).withColumn("change", F.lit("added")).unionByName(old.subtract(new).withColumn("change", F.lit("removed")))


def add_edge(edges: DataFrame, extra: DataFrame) -> DataFrame:
    return overlay(edges, extra)


def remove_vertices(edges: DataFrame, gone: DataFrame) -> DataFrame:
    """Without the vertices' edges on either side."""
    left = edges.join(gone.select("graph_id", F.col("id").alias("src")), ["graph_id", "src"], "left_anti")
    return left.join(gone.select("graph_id", F.col("id").alias("dst")), ["graph_id", "dst"], "left_anti").select(*EDGE)


def quotient(edges: DataFrame, name: Callable[[Column], Column]) -> DataFrame:
    return edges.select("graph_id", name(F.col("src")).alias("src"), name(F.col("dst")).alias("dst")).distinct()


def degrees(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    ends = edges.select("graph_id", F.col("src").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionAll(edges.select("graph_id", "dst", F.lit(0), F.lit(1)))
    sums = ends.groupBy("graph_id", "id").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"))
    return vertices.select("graph_id", "id").join(sums, ["graph_id", "id"], "left").select("graph_id", "id", F.coalesce("out_degree", F.lit(0)).alias("out_degree"), F.coalesce("in_degree", F.lit(0)).alias("in_degree"))


def sources(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    return vertices.select("graph_id", "id").join(edges.select("graph_id", F.col("dst").alias("id")), ["graph_id", "id"], "left_anti")


def sinks(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    return sources(vertices, transpose(edges))


def adjacency(edges: DataFrame) -> DataFrame:
    return edges.groupBy("graph_id", "src").agg(F.array_sort(F.collect_set("dst")).alias("next"))


def predecessors(edges: DataFrame, of: DataFrame) -> DataFrame:
    return successors(transpose(edges), of)


def successors(edges: DataFrame, of: DataFrame) -> DataFrame:
    """(graph_id, id, next) of the vertices asked for."""
    return edges.join(of.select("graph_id", F.col("id").alias("src")), ["graph_id", "src"]).select("graph_id", F.col("src").alias("id"), F.col("dst").alias("next"))


def remove_edges(edges: DataFrame, gone: DataFrame) -> DataFrame:
    return edges.join(gone.select(*EDGE), EDGE, "left_anti").select(*EDGE)


def bfs_distance(edges: DataFrame, roots: DataFrame, most: int | None = None) -> DataFrame:
    """(graph_id, id, hops) of all that the roots reach, roots at 0."""
    held = written(edges.select(*EDGE), "bfs-edges")
    start = roots.select("graph_id", "id").distinct()
    seen, hops = Growing(roots.sparkSession, start.schema, "bfs", "hops"), 0
    seen.add(start.withColumn("hops", F.lit(0)))
    front = seen.part(0)
    while most is None or hops < most:
        hops += 1
        ahead = front.join(held, (front.graph_id == held.graph_id) & (front.id == held.src)).select(held.graph_id, held.dst.alias("id")).distinct()
        seen.add(ahead.join(seen.whole().drop("hops"), ["graph_id", "id"], "left_anti").withColumn("hops", F.lit(hops)))
        front = seen.part(hops)
        if front.isEmpty():
            break
    released(held)
    return seen.whole()


def levels(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(graph_id, id, level): longest path from a source, sources 1; vertices on or behind a cycle have none.

    A step follows the edges out of the level before only, and adds what came to the vertices that still wait; one that has all its incoming
    edges is of the next level."""
    on = ["graph_id", "id"]
    held = written(edges.select(*EDGE).distinct(), "levels-edges")
    need = held.groupBy("graph_id", F.col("dst").alias("id")).agg(F.count("*").alias("need"))
    need = written(vertices.select(*on).distinct().join(need, on, "left").select(*on, F.coalesce("need", F.lit(0)).alias("need")), "levels-need")
    state, level = Growing(vertices.sparkSession, need.select(*on, "need", F.col("need").alias("came")).schema, "levels", "level"), 1
    state.add(need.where("need = 0").select(*on, "need", F.col("need").alias("came"), F.lit(1).alias("level")))
    while True:
        now = state.part(level)
        front, waits = now.where("came = need"), now.where("came < need")
        if front.isEmpty():
            break
        level += 1
        came = front.join(held, (front.graph_id == held.graph_id) & (front.id == held.src)).groupBy(held.graph_id, held.dst.alias("id")).agg(F.count("*").alias("came"))
        came = came.unionByName(waits.select(*on, "came")).groupBy(*on).agg(F.sum("came").alias("came"))
        state.add(need.join(came, on).select(*on, "need", "came", F.lit(level).alias("level")))
    released(held, need)
    return state.whole().where("came = need").select(*on, "level")


def cyclic_graphs(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """Graphs with a cycle, and how many vertices stand on or behind one."""
    rest = vertices.select("graph_id", "id").join(levels(vertices, edges), ["graph_id", "id"], "left_anti")
    return rest.groupBy("graph_id").agg(F.count("*").alias("unsorted"))


def topo_order(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """A place for each vertex of the graphs without cycles, all edges forward, ties by id."""
    found = written(levels(vertices, edges), "order")
    w = Window.partitionBy("graph_id").orderBy("level", "id")
    cyclic = vertices.select("graph_id", "id").join(found, ["graph_id", "id"], "left_anti").select("graph_id").distinct()
    return found.join(cyclic, "graph_id", "left_anti").select("graph_id", "id", "level", (F.row_number().over(w) - 1).alias("place"))


def _pushed(found: DataFrame, edges: DataFrame, start: DataFrame, give: Column, step: Callable[[Column], Column]) -> DataFrame:
    """Values along a graph by levels: a vertex's value is `start`'s, else `step` of what its predecessors give, `give` of their `value`.

    What a vertex gives is written once, under the level of the vertex that takes it, and read once there."""
    on = ["graph_id", "id"]
    extra = [c for c in edges.columns if c not in EDGE]
    at = lambda name, level: found.select("graph_id", F.col("id").alias(name), F.col("level").alias(level))
    placed = edges.join(at("src", "src_level"), ["graph_id", "src"]).join(at("dst", "level"), ["graph_id", "dst"])
    by_source = Growing(found.sparkSession, placed.select(*EDGE, *extra, "level").schema, "fold-edges", "src_level")
    by_source.add(placed.select(*EDGE, *extra, "level", "src_level"))
    begun = written(start.join(found, on).select(*on, "value", "level"), "fold-start")
    came = Growing(found.sparkSession, begun.select(*on, "value").schema, "fold", "level")
    came.add(begun.select(*on, "value", "level").limit(0))
    own = lambda rows: rows.join(begun.select(*on), on, "left_anti").groupBy(*on).agg(step(F.col("value")).alias("value"))
    deepest = found.agg(F.max("level")).first()[0] or 0
    for level in range(1, deepest):
        now = begun.where(F.col("level") == level).select(*on, "value").unionByName(own(came.part(level)))
        out = by_source.part(level).join(now.withColumnRenamed("id", "src"), ["graph_id", "src"])
        came.add(out.select("graph_id", F.col("dst").alias("id"), give.cast(came.schema["value"].dataType).alias("value"), "level"))
    return begun.select(*on, "value").unionByName(own(came.whole().drop("level")))


def fold_dag(vertices: DataFrame, edges: DataFrame, start: Column, step: Callable[[Column], Column]) -> DataFrame:
    """(graph_id, id, value): `start` where nothing leads, else `step` of an aggregate over predecessors' values."""
    held = written(edges.select(*EDGE), "fold-given")
    found = written(levels(vertices, held), "fold-levels")
    return _pushed(found, held, found.where("level = 1").select("graph_id", "id", start.alias("value")), F.col("value"), step)


def influence(vertices: DataFrame, edges: DataFrame, origins: DataFrame, alpha: float = 0.85) -> DataFrame:
    """(graph_id, id, mass): 1 at the origin, passed on in equal parts times alpha, level by level, so that each edge counts once.
    A graph with a cycle has no rows."""
    held = written(edges.select(*EDGE), "influence-given")
    found = written(levels(vertices, held), "influence-levels")
    cyclic = vertices.select("graph_id", "id").join(found, ["graph_id", "id"], "left_anti").select("graph_id").distinct()
    good = written(found.join(cyclic, "graph_id", "left_anti"), "influence-good")
    share = held.join(held.groupBy("graph_id", "src").agg(F.count("*").alias("out")), ["graph_id", "src"])
    start = origins.select("graph_id", "id").distinct().withColumn("value", F.lit(1.0))
    return _pushed(good, share, start, alpha * F.col("value") / F.col("out"), F.sum).withColumnRenamed("value", "mass")


def longest_path(vertices: DataFrame, edges: DataFrame, entries: DataFrame, exits: DataFrame) -> DataFrame:
    """(graph_id, nodes): the most vertices on a way from an entry to an exit, where there is one."""
    reached = written(bfs_distance(edges, entries).select("graph_id", "id"), "longest")
    found = levels(reached, induced(edges, reached))  # what is reached begins at entries only
    return found.join(exits.select("graph_id", "id"), ["graph_id", "id"], "left_semi").groupBy("graph_id").agg(F.max("level").alias("nodes"))


def cycle_witness(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(graph_id, cycle): for each graph with a cycle the vertices of one, first to first. What no cycle can hold is left out before;
    the rest of a graph goes through one task."""
    on = ["graph_id", "id"]
    rest = written(vertices.select(*on).distinct().join(levels(vertices, edges), on, "left_anti"), "witness")
    inner = induced(edges, rest)

    def find(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        before = frame.groupby("dst").src.min().to_dict()  # every vertex here has an edge from another one here
        at, way = min(before), []
        seen: dict[int, int] = {}
        while at not in seen:
            seen[at] = len(way)
            way.append(int(at))
            at = before[at]
        turn = way[seen[at] :][::-1]
        first = turn.index(min(turn))
        turn = turn[first:] + turn[:first]
        return pd.DataFrame({"graph_id": [key[0]], "cycle": [[*turn, turn[0]]]})

    return inner.groupBy("graph_id").applyInPandas(find, "graph_id long, cycle array<long>")


def linear_graphs(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(graph_id, linear): whether a graph is one chain: in one piece, no vertex with two edges in or out, and no cycle."""
    by = degrees(vertices, edges).groupBy("graph_id").agg(F.count("*").alias("n"), F.max(F.greatest("out_degree", "in_degree")).alias("most"), F.sum("out_degree").alias("m"))
    pieces = weak_components(vertices, edges).groupBy("graph_id").agg(F.countDistinct("root").alias("pieces"))
    return by.join(pieces, "graph_id").select("graph_id", ((F.col("pieces") == 1) & (F.col("most") <= 1) & (F.col("m") == F.col("n") - 1)).alias("linear"))


def folded(expression, empty, vertex: Callable, overlaid: Callable, connected: Callable):
    """What a graph expression comes to: None, ("vertex", x), ("overlay", a, b) or ("connect", a, b), from the leaves up."""
    if expression is None:
        return empty
    kind, *parts = expression
    if kind == "vertex":
        return vertex(parts[0])
    a, b = (folded(p, empty, vertex, overlaid, connected) for p in parts)
    return overlaid(a, b) if kind == "overlay" else connected(a, b)


def relation(expression, none: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Vertices and edges of a graph expression whose vertices are frames (graph_id, id); `none` is an empty one."""
    no_edges = none.select("graph_id", F.col("id").alias("src"), F.col("id").alias("dst")).limit(0)
    both = lambda a, b: (overlay(a[0], b[0]), overlay(a[1], b[1]))

    def across(a, b):
        v, e = both(a, b)
        return v, overlay(e, connect(a[0], b[0]))

    return folded(expression, (none.limit(0), no_edges), lambda x: (x.select("graph_id", "id").distinct(), no_edges), both, across)


def weak_components(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(graph_id, id, root): the least id joined by edges of either direction, by rounds of least labels and label jumping."""
    on = ["graph_id", "id"]
    both = written(edges.select(*EDGE).unionByName(transpose(edges)).distinct(), "weak-edges")
    labels = written(vertices.select(*on, F.col("id").alias("root")).distinct(), "weak")
    while True:
        heard = both.join(labels.withColumnRenamed("id", "src"), ["graph_id", "src"]).groupBy("graph_id", F.col("dst").alias("id")).agg(F.min("root").alias("heard"))
        low = labels.join(heard, on, "left").select(*on, F.least("root", F.coalesce("heard", "root")).alias("root"), F.col("root").alias("was"))
        up = labels.select("graph_id", F.col("id").alias("root"), F.col("root").alias("above"))
        after = written(low.join(up, ["graph_id", "root"], "left").select(*on, F.least("root", F.coalesce("above", "root")).alias("root"), "was"), "weak")
        settled = after.where("root <> was").isEmpty()
        released(labels)
        labels = after.select(*on, "root")
        labels.stored_at = after.stored_at
        if settled:
            released(both)
            return labels


def scc(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(graph_id, id, component): strongly connected components by their least member.

    Vertices that no cycle can hold are peeled off; in each round the least vertex left of each graph takes what it reaches
    both ways."""
    single = lambda df: df.select("graph_id", "id", F.col("id").alias("component"))
    left = written(vertices.select("graph_id", "id").distinct(), "scc")
    inner = edges
    done = None
    while not left.isEmpty():
        pivot = left.groupBy("graph_id").agg(F.min("id").alias("id"))
        ahead, behind = bfs_distance(inner, pivot), bfs_distance(transpose(inner), pivot)
        both = ahead.select("graph_id", "id").intersect(behind.select("graph_id", "id"))
        found = written(both.join(pivot.withColumnRenamed("id", "component"), "graph_id").select("graph_id", "id", "component"), "scc")
        done = found if done is None else done.unionByName(found)
        left = written(left.join(found, ["graph_id", "id"], "left_anti"), "scc")
        inner = written(induced(inner, left), "scc")
        loose = written(single(sources(left, inner).unionByName(sinks(left, inner)).distinct()), "scc")
        if not loose.isEmpty():
            done = done.unionByName(loose)
            left = written(left.join(loose, ["graph_id", "id"], "left_anti"), "scc")
            inner = written(induced(inner, left), "scc")
    return done if done is not None else single(vertices.limit(0))


def topology_hash(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """SHA-256 of each graph's sorted vertices and edges."""
    v = vertices.groupBy("graph_id").agg(F.array_join(F.transform(F.array_sort(F.collect_set("id")), lambda x: x.cast("string")), ",").alias("v"))
    e = edges.groupBy("graph_id").agg(F.array_join(F.transform(F.array_sort(F.collect_set(F.struct("src", "dst"))), lambda x: F.concat(x["src"].cast("string"), F.lit(">"), x["dst"].cast("string"))), ",").alias("e"))
    return v.join(e, "graph_id", "left").select("graph_id", F.sha2(F.concat("v", F.lit("|"), F.coalesce("e", F.lit(""))), 256).alias("hash"))


def visit_order(edges: DataFrame, roots: DataFrame, kind: str = "bfs", most: int | None = None, priority: DataFrame | None = None) -> DataFrame:
    """(graph_id, id, place, depth) in the order of a search over a frontier: bfs (queue), dfs (stack), pfs or max (least or greatest priority first).

    `priority` has (graph_id, id, h); without it the id is the priority. The depth is that of the way by which the search came. One graph
    is one task's group; children come in ascending order; `most` ends a graph's search early."""
    if kind not in ("bfs", "dfs", "pfs", "max"):
        raise ValueError(kind)

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        following: dict = {}
        for s, d in sorted(zip(frame.src[frame.src.notna()], frame.dst[frame.src.notna()], strict=True)):
            following.setdefault(s, []).append(d)
        given = frame[frame.h.notna()]
        h = dict(zip(given.root, given.h, strict=True))
        sign = -1 if kind == "max" else 1
        entry = lambda v, depth: (sign * h.get(v, v), v, depth)
        front = deque(entry(v, 0) for v in sorted(frame.root[frame.root.notna() & frame.h.isna()].unique().tolist()))
        if kind in ("pfs", "max"):
            front = list(front)
            heapq.heapify(front)
        seen, out, depths = set(), [], []
        while front and (most is None or len(out) < most):
            _, v, depth = heapq.heappop(front) if kind in ("pfs", "max") else front.popleft() if kind == "bfs" else front.pop()
            if v in seen:
                continue
            seen.add(v)
            out.append(v)
            depths.append(depth)
            for w in following.get(v, []):
                heapq.heappush(front, entry(w, depth + 1)) if kind in ("pfs", "max") else front.append(entry(w, depth + 1))
        return pd.DataFrame({"graph_id": key[0], "id": pd.array(out, dtype="Int64"), "place": range(len(out)), "depth": depths})

    none = F.lit(None)
    rows = edges.select("graph_id", "src", "dst", none.cast("long").alias("root"), none.cast("double").alias("h"))
    rows = rows.unionByName(roots.select("graph_id", none.cast("long").alias("src"), none.cast("long").alias("dst"), F.col("id").cast("long").alias("root"), none.cast("double").alias("h")))
    if priority is not None:
        rows = rows.unionByName(priority.select("graph_id", none.cast("long").alias("src"), none.cast("long").alias("dst"), F.col("id").cast("long").alias("root"), F.col("h").cast("double").alias("h")))
    return rows.groupBy("graph_id").applyInPandas(run, "graph_id long, id long, place long, depth long")
