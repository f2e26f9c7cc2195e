"""The ranked graph-memory query: walk a graph from an origin, filter, score on three axes, rank, take the first."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dagframe.operators import graph

ALPHA = 0.85
SETTLED = ("completed", "skipped", "rewritten")


@dataclass(frozen=True)
class Query:
    direction: str = "ancestors"  # ancestors, descendants, bidirectional
    scope: str = "settled"  # settled or all
    weights: tuple[float, float, float] = (1.0, 1.0, 1.0)  # graph, time, meaning
    key: str | None = None
    text: str | None = None
    most_hops: int | None = None
    limit: int | None = None
    strategy: str = "topological"  # or classic: direct inputs only


#: Named queries, and other names for them.
PRESETS = {
    "default": Query(),
    "causal": Query(),
    "influence_biased": Query(weights=(1.5, 1.0, 1.0)),
    "recent_bidirectional": Query(direction="bidirectional", weights=(1.0, 1.5, 1.0)),
}
PRESETS |= {"analyst": PRESETS["causal"], "reviewer": PRESETS["influence_biased"], "planner": PRESETS["recent_bidirectional"]}


def from_request(request: dict) -> Query:
    """A preset with the request's own settings over it."""
    names = {"direction": "direction", "scope": "scope", "routingKey": "key", "queryText": "text", "maxGraphDistance": "most_hops", "limit": "limit", "strategy": "strategy"}
    return replace(PRESETS[request.get("preset", "default")], **{names[k]: v for k, v in request.items() if k in names and v is not None})


def clamp01(x: Column) -> Column:
    return F.when(F.isnan(x) | x.isNull(), 0.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), x)))


def temporal(age_seconds: Column) -> Column:
    return 1.0 / (1.0 + F.greatest(F.lit(0.0), age_seconds.cast("double")) / 3600.0)


def tokens(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda t: t != ""))


def jaccard(a: Column, b: Column) -> Column:
    x, y = tokens(a), tokens(b)
    either = F.size(F.array_union(x, y))
    return F.when(either == 0, 0.0).otherwise(F.size(F.array_intersect(x, y)) / either)


def extracted(output: Column) -> tuple[Column, Column]:
    """Key and text of a JSON output, its envelope peeled: the first key that is there must be a string; the first string text."""
    held = F.try_parse_json(output)
    inner = F.coalesce(F.try_variant_get(held, "$.value", "variant"), held)
    is_text = lambda v: F.schema_of_variant(v) == "STRING"
    at = lambda k: F.try_variant_get(inner, f"$.{k}", "variant")
    first = F.coalesce(*(at(k) for k in ("routingKey", "slot", "claim_ref", "claimRef")))
    key = F.when(is_text(first), F.try_variant_get(first, "$", "string"))
    texts = (F.when(is_text(at(k)), F.try_variant_get(at(k), "$", "string")) for k in ("text", "body", "content"))
    return key, F.coalesce(*texts, F.when(is_text(inner), F.try_variant_get(inner, "$", "string")), F.lit(""))


def walk(vertices: DataFrame, edges: DataFrame, origins: DataFrame, direction: str, most_hops: int | None = None) -> DataFrame:
    """(graph_id, id, hops, mass) of what the origins reach, without them; of two directions the least hops and most mass."""
    parts = []
    for way in ("ancestors", "descendants") if direction == "bidirectional" else (direction,):
        e = graph.transpose(edges) if way == "ancestors" else edges
        near = graph.bfs_distance(e, origins, most_hops)
        mass = graph.influence(vertices, e, origins, ALPHA)
        parts.append(near.join(mass, ["graph_id", "id"], "left"))
    found = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    found = found.groupBy("graph_id", "id").agg(F.min("hops").alias("hops"), F.coalesce(F.max("mass"), F.lit(0.0)).alias("mass"))
    return found.join(origins, ["graph_id", "id"], "left_anti")


def ranked(vertices: DataFrame, edges: DataFrame, origins: DataFrame, now_hours: int, query: Query, semantic: Callable[[Column, Column], Column] = jaccard) -> DataFrame:
    """Matches by graph: id, hops, score and rank. Vertices carry status, output (text), key and hours (null: not settled yet)."""
    most = 1 if query.strategy == "classic" else query.most_hops
    found = walk(vertices, edges, origins, query.direction, most).join(vertices, ["graph_id", "id"]).where("output is not null")
    if query.scope == "settled":
        found = found.where(F.coalesce("status", F.lit("pending")).isin(*SETTLED))
    if query.key is not None:
        found = found.where(F.col("key") == query.key)
    g, t, s = query.weights
    age = (F.lit(now_hours) - F.col("hours")) * 3600
    meaning = F.lit(0.0) if query.text is None else clamp01(semantic(F.lit(query.text), F.col("output")))
    score = clamp01(g * clamp01(F.col("mass")) + t * F.coalesce(temporal(age), F.lit(0.0)) + s * meaning)
    order = Window.partitionBy("graph_id").orderBy(F.desc("score"), "hops", "id")
    # ranked by more digits than are shown; the last ones are noise of the sums' order
    out = found.withColumn("score", F.round(score, 12)).withColumn("rank", F.row_number().over(order)).withColumn("score", F.round("score", 9))
    out = out if query.limit is None else out.where(F.col("rank") <= query.limit)
    return out.select("graph_id", "id", "status", "hops", "score", "rank")
