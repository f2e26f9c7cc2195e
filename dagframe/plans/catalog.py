"""Registered queries of the engine's operators, each with its SQL on the same tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dagframe.functions import builtins as B
from dagframe.functions.expression import If, Literal, Text, Var, divided, fn, let, op, projection, record
from dagframe.operators import contracts, graph, histogram, history, memory, rewrite, runs, state
from dagframe.plans import flow
from dagframe.sources.tables import conversation_graph, sanitised, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _longs(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.col(n).cast("long") for n in names})


# --- expressions ---------------------------------------------------------------------------------------------------


@query("""SELECT l_returnflag, count(*) FILTER (l_linestatus = 'O' AND l_quantity >= 25)::BIGINT AS eligible,
  coalesce(sum(CASE WHEN l_linestatus = 'O' AND l_quantity >= 25 THEN l_quantity::DECIMAL(18,2) END), 0)::DOUBLE AS total FROM lineitem GROUP BY l_returnflag""")
def expr_eligibility_summary(spark, d):
    """filter, map, then count and sum, fused into one aggregate."""
    keep = projection({"l_returnflag": Var("l_returnflag"), "ok": op("&&", op("==", Var("l_linestatus"), "O"), op(">=", Var("l_quantity"), 25)), "q": Var("l_quantity")})
    rows = keep(table(spark, d, "lineitem"))
    return rows.groupBy("l_returnflag").agg(F.count_if("ok").alias("eligible"), F.coalesce(F.sum(F.when(F.col("ok"), F.col("q").cast("decimal(18,2)"))), F.lit(0)).cast("double").alias("total"))


@query("SELECT count(*)::BIGINT AS items, sum(l_quantity::DECIMAL(18,2) * l_discount::DECIMAL(18,2))::DOUBLE AS weighted FROM lineitem")
def expr_weighted_score(spark, d):
    """score times weight as one equation of a node, then a sum."""
    node = projection({"x": op("*", Var("q"), Var("w"))})
    rows = node(table(spark, d, "lineitem").select(F.col("l_quantity").cast("decimal(18,2)").alias("q"), F.col("l_discount").cast("decimal(18,2)").alias("w")))
    return rows.agg(F.count("*").alias("items"), F.sum("x").cast("double").alias("weighted"))


@query("""SELECT l_shipmode_key, round(sum(greatest(0, least(3, abs(l_extendedprice - 30000) * l_discount / 1000))), 4) AS risk, count(*)::BIGINT AS n
  FROM (SELECT l_suppkey % 10 AS l_shipmode_key, * FROM lineitem) GROUP BY 1""")
def expr_risk_adjustment(spark, d):
    rows = table(spark, d, "lineitem").select((F.col("l_suppkey") % 10).alias("l_shipmode_key"), B.clamp(F.lit(0.0), F.lit(3.0), F.abs(F.col("l_extendedprice") - 30000) * F.col("l_discount") / 1000).alias("x"))
    return rows.groupBy("l_shipmode_key").agg(F.round(F.sum("x"), 4).alias("risk"), F.count("*").alias("n"))


@query("SELECT p_brand, string_agg('tag-' || (p_partkey % 128), '|' ORDER BY p_partkey) AS labels, count(*)::BIGINT AS n FROM part GROUP BY p_brand")
def expr_label_rollup(spark, d):
    rows = table(spark, d, "part").groupBy("p_brand").agg(F.array_sort(F.collect_list("p_partkey")).alias("k"))
    labels = B.join_with("|", B.map_(lambda k: F.concat(F.lit("tag-"), (k % 128).cast("string")), F.col("k")))
    return rows.select("p_brand", labels.alias("labels"), B.length(F.col("k")).alias("n"))


def _order_arrays(spark, d):
    """Each order's quantities as whole numbers, by line."""
    rows = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", F.col("l_quantity").cast("long").alias("q")))).alias("s"))
    return rows.select("l_orderkey", F.transform("s", lambda x: x["q"]).alias("xs"))


_ARRAYS = "a AS (SELECT l_orderkey, list(l_quantity::BIGINT ORDER BY l_linenumber, l_quantity::BIGINT) AS xs FROM lineitem GROUP BY l_orderkey)"


@query(f"WITH {_ARRAYS} SELECT l_orderkey, list_sum(list_transform(list_filter(xs, lambda x: x > 10), lambda x: x * 2))::BIGINT AS doubled, list_reduce(list_prepend(0, xs), lambda s, x: (s * 3 + x) % 1000)::BIGINT AS folded, list_reduce(list_prepend(0, list_reverse(xs)), lambda s, x: (s * 3 + x) % 1000)::BIGINT AS folded_right FROM a WHERE len(list_filter(xs, lambda x: x > 10)) > 0")
def expr_map_filter_fold(spark, d):
    big = B.filter_(lambda x: x > 10, F.col("xs"))
    step = lambda s, x: (s * 3 + x) % 1000
    zero = F.lit(0).cast("long")
    rows = _order_arrays(spark, d).where(F.size(big) > 0)
    return rows.select("l_orderkey", B.sum_(B.map_(lambda x: x * 2, big)).cast("long").alias("doubled"), B.fold(step, zero, F.col("xs")).alias("folded"), B.fold_right(lambda x, s: step(s, x), zero, F.col("xs")).alias("folded_right"))


@query(f"WITH {_ARRAYS} SELECT l_orderkey, len(list_filter(xs, lambda x: x <= 5)) = 0 AS all_over, len(list_filter(xs, lambda x: x > 45)) > 0 AS any_top, len(list_filter(xs, lambda x: x % 2 = 0))::BIGINT AS even FROM a")
def expr_all_any_count(spark, d):
    xs = F.col("xs")
    return _order_arrays(spark, d).select("l_orderkey", B.all_(lambda x: x > 5, xs).alias("all_over"), B.any_(lambda x: x > 45, xs).alias("any_top"), B.count(lambda x: x % 2 == 0, xs).alias("even"))


@query(f"WITH {_ARRAYS} SELECT l_orderkey, array_to_string(list_sort(xs), ',') AS sorted, array_to_string(xs[1:2], ',') AS took, array_to_string(xs[3:], ',') AS dropped, array_to_string(list_reverse(xs), ',') AS turned FROM a")
def expr_sort_take_drop_reverse(spark, d):
    xs, text = F.col("xs"), lambda a: F.array_join(F.transform(a, lambda x: x.cast("string")), ",")
    return _order_arrays(spark, d).select("l_orderkey", text(F.sort_array(xs)).alias("sorted"), text(B.take(2, xs)).alias("took"), text(B.drop(2, xs)).alias("dropped"), text(F.reverse(xs)).alias("turned"))


@query(f"WITH {_ARRAYS}, s AS (SELECT l_orderkey, unnest(list_transform(xs, lambda x, i: {{'k': x % 5, 'i': i, 'x': x}})) AS e FROM a) SELECT l_orderkey, string_agg(e.x::VARCHAR, ',' ORDER BY e.k, e.i) AS by_key, string_agg((e.i - 1) || ':' || e.x, ',' ORDER BY e.i) AS numbered FROM s GROUP BY l_orderkey")
def expr_enumerate_indexed(spark, d):
    xs = F.col("xs")
    numbered = B.map_indexed(lambda i, x: F.concat(i.cast("string"), F.lit(":"), x.cast("string")), xs)
    by_key = F.transform(B.sort_by(lambda x: x % 5, xs), lambda x: x.cast("string"))
    return _order_arrays(spark, d).select("l_orderkey", F.array_join(by_key, ",").alias("by_key"), F.array_join(numbered, ",").alias("numbered"))


@query(f"WITH {_ARRAYS} SELECT l_orderkey, list_filter(xs, lambda x: x > 25)[1] AS found, (coalesce(list_position(list_transform(xs, lambda x: x > 25), true), 0) - 1)::BIGINT AS at, list_contains(xs, 17) AS has, (coalesce(list_position(xs, 17), 0) - 1)::BIGINT AS place FROM a")
def expr_find_indexof_contains(spark, d):
    xs, big = F.col("xs"), lambda x: x > 25
    return _order_arrays(spark, d).select("l_orderkey", B.find(big, xs).alias("found"), B.find_index(big, xs).alias("at"), B.contains(F.lit(17), xs).alias("has"), B.index_of(F.lit(17), xs).alias("place"))


@query(f"WITH {_ARRAYS} SELECT l_orderkey, array_to_string(list_transform(range(1, least(len(xs), 3) + 1), lambda i: xs[i] * i), ',') AS products FROM a")
def expr_zipwith_trunc(spark, d):
    zipped = B.zip_with(lambda x, y: (x * y).cast("string"), F.col("xs"), F.array(*(F.lit(k).cast("long") for k in (1, 2, 3))))
    return _order_arrays(spark, d).select("l_orderkey", F.array_join(zipped, ",").alias("products"))


@query("SELECT p_partkey, lower(p_name) AS low, upper(p_brand) AS up, length(p_name)::BIGINT AS n, starts_with(p_type, 'S') AS s, suffix(p_name, 'e') AS e FROM part")
def expr_strings_basic(spark, d):
    name = Var("p_name")
    node = projection({"p_partkey": Var("p_partkey"), "low": Var("toLower")(name), "up": Var("toUpper")(Var("p_brand")), "n": Var("strLength")(name), "s": Var("startsWith")("S", Var("p_type")), "e": Var("endsWith")("e", name)})
    return node(table(spark, d, "part"))


@query("SELECT doc_id, len(string_split(text, '. '))::BIGINT AS parts, substring(text, 4, 17) AS part, length(replace(text, 'e', 'XY'))::BIGINT AS n FROM documents")
def expr_split_replace_substring(spark, d):
    text = F.col("text")
    return table(spark, d, "documents").select("doc_id", B.length(B.split(". ", text)).alias("parts"), B.substring(F.lit(3), F.lit(20), text).alias("part"), F.length(B.replace("e", "XY", text)).cast("long").alias("n"))


@query("SELECT conv_id, turn, (len(string_split(text, chr(10))) - CASE WHEN suffix(text, chr(10)) OR text = '' THEN 1 ELSE 0 END)::BIGINT AS lines, length(trim(' ' || text || ' '))::BIGINT AS n FROM conversations")
def expr_trim_lines(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", B.length(B.lines(F.col("text"))).alias("lines"), F.length(B.trim(F.concat(F.lit(" "), "text", F.lit(" ")))).cast("long").alias("n"))


@query("SELECT event_id, array_to_string(list_sort(json_keys(props)), ',') AS names, (props->>'$.k')::BIGINT AS k FROM events")
def expr_records_keys_entries(spark, d):
    held = F.from_json("props", "map<string,bigint>")
    return table(spark, d, "events").select("event_id", F.array_join(B.keys(held), ",").alias("names"), F.get(B.values(held), F.lit(0)).alias("k"))


@query("""SELECT event_id, '{"k":' || (props->>'$.k') || '}' AS canonical FROM events""")
def expr_json_roundtrip(spark, d):
    return table(spark, d, "events").select("event_id", B.to_json(B.from_json("map<string,bigint>", F.col("props"))).alias("canonical"))


@query("SELECT event_id, coalesce(nullif(event_type, 'click'), 'none') AS kind, event_type = 'click' AS empty FROM events")
def expr_null_default(spark, d):
    x = F.nullif("event_type", F.lit("click"))
    node = projection({"event_id": Var("event_id"), "kind": Var("withDefault")("none", Var("x")), "empty": Var("isNull")(Var("x"))})
    return node(table(spark, d, "events").withColumn("x", x))


@query("SELECT p_partkey, greatest(0, p_size - 5)::BIGINT AS span, coalesce(list_sum(range(5, p_size)), 0)::BIGINT AS total FROM part")
def expr_range_guarded(spark, d):
    r = B.range_(F.lit(5), F.col("p_size"))
    return table(spark, d, "part").select("p_partkey", B.length(r).alias("span"), B.sum_(r).cast("long").alias("total"))


@query("SELECT o_orderkey, round(o_totalprice / (o_custkey + 1), 9) AS share FROM orders")
def expr_division_float(spark, d):
    return table(spark, d, "orders").select("o_orderkey", F.round(divided(F.col("o_totalprice"), F.col("o_custkey") + 1), 9).alias("share"))


@query("""SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'large' ELSE 'small' END AS size, o_orderstatus || '/' || o_orderpriority AS label, o_custkey % 7 + 1 AS bucket,
  o_orderstatus = 'F' OR o_orderstatus = 'O' AS known FROM orders""")
def expr_let_if_text(spark, d):
    """Lets, a lazy condition, interpolation, record merge and a lambda, compiled for a whole frame."""
    node = projection(
        {
            "o_orderkey": Var("o_orderkey"),
            "size": If(op(">", Var("price"), 200000), Literal("large"), Literal("small")),
            "label": Text((Var("o_orderstatus"), Literal("/"), Var("o_orderpriority"))),
            "bucket": let(fn("x", body=op("+", Var("x"), 1))(Var("rest")), step=1),
            "known": op("||", op("==", Var("o_orderstatus"), "F"), op("==", Var("o_orderstatus"), "O")),
        },
        where=op("//", record(price=0, rest=0), record(price=Var("o_totalprice"), rest=Var("remainder"))),
    )
    return node(table(spark, d, "orders").withColumn("remainder", F.col("o_custkey") % 7))


@query("SELECT part_key AS p_partkey, first_value AS first, second_value AS second FROM (SELECT p_partkey AS part_key, least(p_size, 10)::BIGINT AS first_value, greatest(p_size, 10)::BIGINT AS second_value FROM part)")
def expr_min_max_index(spark, d):
    return table(spark, d, "part").select("p_partkey", B.min_(F.col("p_size"), F.lit(10)).cast("long").alias("first"), B.max_(F.col("p_size"), F.lit(10)).cast("long").alias("second"))


# --- contracts -----------------------------------------------------------------------------------------------------

EVENT_CONTRACT = {"type": "object", "additionalProperties": False, "required": ["k"], "properties": {"k": {"type": "integer", "minimum": 10, "maximum": 80}}}


@query("""SELECT event_id, CASE WHEN (props->>'$.k')::BIGINT < 10 THEN 'TOO_SMALL' WHEN (props->>'$.k')::BIGINT > 80 THEN 'TOO_LARGE' END AS code,
  CASE WHEN (props->>'$.k')::BIGINT NOT BETWEEN 10 AND 80 THEN '$.k' END AS path FROM events""")
def contract_validate_events(spark, d):
    found = contracts.validated(F.col("props"), EVENT_CONTRACT)
    return table(spark, d, "events").select("event_id", found.alias("f")).select("event_id", F.col("f.code").alias("code"), F.col("f.path").alias("path"))


@query("SELECT event_id, 'event' AS contract, 'application/json' AS media_type, event_type AS producer FROM events")
def contract_envelopes(spark, d):
    made = contracts.envelope("event", F.col("props"), producer=F.col("event_type"))
    return table(spark, d, "events").select("event_id", made.alias("e")).select("event_id", "e.contract", "e.media_type", "e.producer")


# --- graphs --------------------------------------------------------------------------------------------------------

_GRAPH = """WITH RECURSIVE v AS (SELECT conv_id AS graph_id, turn AS id, role AS key, text AS output, turn AS hours,
    CASE turn % 8 WHEN 2 THEN 'skipped' WHEN 4 THEN 'pending' WHEN 5 THEN 'rewritten' WHEN 6 THEN 'running' WHEN 7 THEN 'failed' ELSE 'completed' END AS status FROM conversations),
  e AS (SELECT a.graph_id, a.id AS src, b.id AS dst FROM v a JOIN v b ON a.graph_id = b.graph_id AND a.id < b.id
    WHERE b.id = a.id + 1 OR (a.graph_id + a.id * 37 + b.id * 101 + a.id * b.id * 13) % 7 < 2)"""
_LAST = "o AS (SELECT graph_id, max(id) AS id FROM v GROUP BY graph_id)"


def _last_turns(vertices):
    return vertices.groupBy("graph_id").agg(F.max("id").alias("id"))


@query(f"{_GRAPH} SELECT graph_id, id, 'source' AS side FROM v WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.graph_id = v.graph_id AND dst = id) UNION ALL SELECT graph_id, id, 'sink' FROM v WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.graph_id = v.graph_id AND src = id)")
def graph_sources_sinks(spark, d):
    v, e = conversation_graph(spark, d)
    return graph.sources(v, e).withColumn("side", F.lit("source")).unionByName(graph.sinks(v, e).withColumn("side", F.lit("sink")))


@query(f"{_GRAPH} SELECT graph_id, id, (SELECT count(*) FROM e WHERE e.graph_id = v.graph_id AND src = id)::BIGINT AS out_degree, (SELECT count(*) FROM e WHERE e.graph_id = v.graph_id AND dst = id)::BIGINT AS in_degree FROM v")
def graph_degree(spark, d):
    return _longs(graph.degrees(*conversation_graph(spark, d)), "out_degree", "in_degree")


@query(f"{_GRAPH} SELECT graph_id, dst AS src, src AS dst, 'added' AS change FROM e UNION ALL SELECT graph_id, src, dst, 'removed' FROM e")
def graph_transpose_diff(spark, d):
    _, e = conversation_graph(spark, d)
    return graph.diff(e, graph.transpose(e))


@query(f"{_GRAPH} SELECT e.* FROM e WHERE src % 2 = 0 AND dst % 2 = 0")
def graph_induced(spark, d):
    v, e = conversation_graph(spark, d)
    return graph.induced(e, v.where("id % 2 = 0")).select("graph_id", "src", "dst")


@query(f"{_GRAPH} SELECT graph_id, src, string_agg(dst::VARCHAR, ',' ORDER BY dst) AS next FROM e GROUP BY graph_id, src")
def graph_adjacency(spark, d):
    _, e = conversation_graph(spark, d)
    return graph.adjacency(e).select("graph_id", "src", F.array_join(F.transform("next", lambda x: x.cast("string")), ",").alias("next"))


@query(f"{_GRAPH} SELECT a.graph_id, 'path' AS kind, count(*)::BIGINT AS n FROM v a JOIN v b ON a.graph_id = b.graph_id AND b.id = a.id + 1 GROUP BY 1 UNION ALL SELECT a.graph_id, 'clique', count(*) FROM v a JOIN v b ON a.graph_id = b.graph_id AND a.id < b.id GROUP BY 1 UNION ALL SELECT graph_id, 'star', count(*) - 1 FROM v GROUP BY 1 HAVING count(*) > 1")
def graph_constructors(spark, d):
    v, _ = conversation_graph(spark, d)
    parts = [x.select("graph_id", F.lit(k).alias("kind")) for k, x in (("path", graph.path(v)), ("clique", graph.clique(v)), ("star", graph.star(v)))]
    return parts[0].unionAll(parts[1]).unionAll(parts[2]).groupBy("graph_id", "kind").agg(F.count("*").alias("n"))


@query(f"{_GRAPH} SELECT graph_id, src, dst FROM e WHERE src <> 1 AND dst <> 1 UNION SELECT graph_id, 0, 99 FROM v")
def graph_modify(spark, d):
    v, e = conversation_graph(spark, d)
    extra = v.select("graph_id", F.lit(0).cast("long").alias("src"), F.lit(99).cast("long").alias("dst")).distinct()
    return graph.add_edge(graph.remove_vertices(e, v.where("id = 1")), extra)


@query(f"{_GRAPH} SELECT DISTINCT graph_id, src // 2 AS src, dst // 2 AS dst FROM e")
def graph_quotient(spark, d):
    _, e = conversation_graph(spark, d)
    return graph.quotient(e, lambda x: F.floor(x / 2))


@query(f"{_GRAPH}, w AS (SELECT graph_id, id, 0 AS hops FROM v WHERE id = 0 UNION ALL SELECT e.graph_id, e.dst, w.hops + 1 FROM w JOIN e ON e.graph_id = w.graph_id AND e.src = w.id) SELECT graph_id, id, min(hops)::BIGINT AS hops FROM w GROUP BY 1, 2")
def graph_bfs_hops(spark, d):
    v, e = conversation_graph(spark, d)
    return _longs(graph.bfs_distance(e, v.where("id = 0")), "hops")


@query(f"{_GRAPH}, {_LAST}, w AS (SELECT graph_id, id FROM o UNION SELECT e.graph_id, e.src FROM w JOIN e ON e.graph_id = w.graph_id AND e.dst = w.id) SELECT graph_id, count(*)::BIGINT AS reached FROM w GROUP BY 1")
def graph_reachable(spark, d):
    v, e = conversation_graph(spark, d)
    return graph.bfs_distance(graph.transpose(e), _last_turns(v)).groupBy("graph_id").agg(F.count("*").alias("reached"))


@query(f"{_GRAPH}, w AS (SELECT graph_id, id, 1 AS level FROM v WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.graph_id = v.graph_id AND dst = id) UNION ALL SELECT e.graph_id, e.dst, w.level + 1 FROM w JOIN e ON e.graph_id = w.graph_id AND e.src = w.id) SELECT graph_id, id, max(level)::BIGINT AS level FROM w GROUP BY 1, 2")
def graph_levels(spark, d):
    return _longs(graph.levels(*conversation_graph(spark, d)), "level")


@query(f"{_GRAPH}, w AS (SELECT graph_id, id, 1 AS n FROM v WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.graph_id = v.graph_id AND dst = id) UNION ALL SELECT e.graph_id, e.dst, w.n FROM w JOIN e ON e.graph_id = w.graph_id AND e.src = w.id) SELECT graph_id, id, count(*)::BIGINT AS paths FROM w GROUP BY 1, 2")
def graph_fold_paths(spark, d):
    """A fold over each graph: how many ways lead to a vertex."""
    v, e = conversation_graph(spark, d)
    out = graph.fold_dag(v, e, F.lit(1).cast("long"), F.sum)
    return out.select("graph_id", "id", F.col("value").alias("paths"))


_MASS = "n AS (SELECT graph_id, {a} AS src, count(*) AS out FROM e GROUP BY 1, 2), {w} AS (SELECT graph_id, id, 1.0::DOUBLE AS mass, 0 AS hops FROM {o} UNION ALL SELECT e.graph_id, e.{b}, w.mass * 0.85 / n.out, w.hops + 1 FROM {w} w JOIN e ON e.graph_id = w.graph_id AND e.{a} = w.id JOIN n ON n.graph_id = w.graph_id AND n.src = w.id)"


@query(f"{_GRAPH}, z AS (SELECT graph_id, id FROM v WHERE id = 0), {_MASS.format(a='src', b='dst', w='w', o='z')} SELECT graph_id, id, round(sum(mass), 9) AS mass FROM w GROUP BY 1, 2")
def graph_influence(spark, d):
    v, e = conversation_graph(spark, d)
    return graph.influence(v, e, v.where("id = 0").select("graph_id", "id")).select("graph_id", "id", F.round("mass", 9).alias("mass"))


_CYCLIC = "c AS (SELECT * FROM e UNION SELECT graph_id, id, id - 2 FROM v WHERE id >= 2 AND id % 2 = 0 AND graph_id % 10 > 0)"


def _with_cycles(spark, d):
    """Conversations, nine of ten with edges back."""
    v, e = conversation_graph(spark, d)
    back = v.where("id >= 2 AND id % 2 = 0 AND graph_id % 10 > 0").select("graph_id", F.col("id").alias("src"), (F.col("id") - 2).alias("dst"))
    return v, graph.overlay(e, back)


@query(f"{_GRAPH}, {_CYCLIC}, r AS (SELECT graph_id, id AS a, id AS b FROM v UNION SELECT r.graph_id, r.a, c.dst FROM r JOIN c ON c.graph_id = r.graph_id AND c.src = r.b) SELECT x.graph_id, x.a AS id, min(x.b) AS component FROM r x JOIN r y ON x.graph_id = y.graph_id AND x.a = y.b AND x.b = y.a GROUP BY 1, 2")
def graph_scc(spark, d):
    return graph.scc(*_with_cycles(spark, d))


@query(f"{_GRAPH}, {_CYCLIC}, r AS (SELECT graph_id, src AS a, dst AS b FROM c UNION SELECT r.graph_id, r.a, c.dst FROM r JOIN c ON c.graph_id = r.graph_id AND c.src = r.b), k AS (SELECT graph_id, a FROM r WHERE a = b), x AS (SELECT graph_id, a AS id FROM k UNION SELECT r.graph_id, r.b FROM r JOIN k ON r.graph_id = k.graph_id AND r.a = k.a) SELECT graph_id, count(*)::BIGINT AS unsorted FROM x GROUP BY 1")
def graph_cycle_detect(spark, d):
    return graph.cyclic_graphs(*_with_cycles(spark, d))


@query(f"{_GRAPH} SELECT graph_id, id, id // 3 * 3 AS root FROM v")
def graph_weak_components(spark, d):
    """Conversations cut into pieces of three turns, each of which the edges from turn to turn hold together."""
    v, e = conversation_graph(spark, d)
    return graph.weak_components(v, e.where("src div 3 = dst div 3"))


@query(f"{_GRAPH} SELECT graph_id, sha256(string_agg(DISTINCT id::VARCHAR, ',' ORDER BY id) || '|' || coalesce((SELECT string_agg(src || '>' || dst, ',' ORDER BY src, dst) FROM e WHERE e.graph_id = v.graph_id), '')) AS hash FROM (SELECT graph_id, id FROM v) v GROUP BY graph_id".replace("DISTINCT id::VARCHAR", "id::VARCHAR"))
def graph_topology_hash(spark, d):
    return graph.topology_hash(*conversation_graph(spark, d))


@query()
def graph_visit_orders(spark, d):
    v, e = conversation_graph(spark, d)
    roots = v.where("id = 0")
    return graph.visit_order(e, roots, "dfs").withColumn("kind", F.lit("dfs")).unionByName(graph.visit_order(e, roots, "pfs", 3).withColumn("kind", F.lit("pfs")))


# --- memory query --------------------------------------------------------------------------------------------------

NOW_HOURS = 10


def _ranked_sql(weights, ways, key=None, text=None, limit=None, most=None):
    parts, walks = [], []
    for k, (a, b) in enumerate(ways):
        walks.append(_MASS.format(a=a, b=b, w=f"w{k}", o="o").replace("n AS", f"n{k} AS").replace("JOIN n ON n.", f"JOIN n{k} ON n{k}.").replace("n.src", f"n{k}.src").replace("n.out", f"n{k}.out"))
        parts.append(f"SELECT graph_id, id, min(hops) AS hops, sum(mass) AS mass FROM w{k} GROUP BY 1, 2")
    g, t, s = weights
    jaccard = "0.0"
    if text:
        words = "list_distinct(list_filter(regexp_split_to_array(lower({}), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> ''))"
        x, y = words.format(f"'{text}'"), words.format("output")
        jaccard = f"coalesce(len(list_intersect({x}, {y}))::DOUBLE / nullif(len(list_distinct(list_concat({x}, {y}))), 0), 0)"
    return f"""{_GRAPH}, {_LAST}, {', '.join(walks)}, f AS (SELECT graph_id, id, min(hops) AS hops, max(mass) AS mass FROM ({' UNION ALL '.join(parts)}) GROUP BY 1, 2),
      m AS (SELECT f.graph_id, f.id, status, hops::BIGINT AS hops, round(least(1.0, {g} * least(1.0, mass) + {t} * (1.0 / (1.0 + greatest(0, {NOW_HOURS} - hours) * 3600.0 / 3600.0)) + {s} * ({jaccard})), 12) AS score
        FROM f JOIN v ON v.graph_id = f.graph_id AND v.id = f.id WHERE status IN ('completed', 'skipped', 'rewritten') AND (f.graph_id, f.id) NOT IN (SELECT graph_id, id FROM o) {f"AND key = '{key}'" if key else ''} {f"AND hops <= {most}" if most else ''}),
      r AS (SELECT *, row_number() OVER (PARTITION BY graph_id ORDER BY score DESC, hops, id)::BIGINT AS rank FROM m) SELECT * REPLACE (round(score, 9) AS score) FROM r {f'WHERE rank <= {limit}' if limit else ''}"""


def _ranked(spark, d, request):
    v, e = conversation_graph(spark, d)
    return _longs(memory.ranked(v, e, _last_turns(v), NOW_HOURS, memory.from_request(request)), "hops", "rank")


_UP, _DOWN = ("dst", "src"), ("src", "dst")


@query(_ranked_sql((1.0, 1.0, 1.0), [_UP]))
def memory_causal(spark, d):
    return _ranked(spark, d, {"preset": "causal"})


@query(_ranked_sql((1.5, 1.0, 1.0), [_UP], limit=2))
def memory_influence_biased(spark, d):
    return _ranked(spark, d, {"preset": "reviewer", "limit": 2})


@query(_ranked_sql((1.0, 1.5, 1.0), [_UP, _DOWN], key="user"))
def memory_recent_bidirectional(spark, d):
    return _ranked(spark, d, {"preset": "recent_bidirectional", "routingKey": "user"})


@query(_ranked_sql((1.0, 1.0, 1.0), [_UP], most=1))
def memory_classic(spark, d):
    """Direct inputs only."""
    return _ranked(spark, d, {"preset": "causal", "strategy": "classic"})


@query(_ranked_sql((0.1, 0.1, 1.0), [_UP], text="the and of to in"))
def memory_semantic(spark, d):
    v, e = conversation_graph(spark, d)
    return _longs(memory.ranked(v, e, _last_turns(v), NOW_HOURS, memory.Query(weights=(0.1, 0.1, 1.0), text="the and of to in")), "hops", "rank")


# --- run state -----------------------------------------------------------------------------------------------------

_DONE = "('completed', 'skipped', 'rewritten')"
_READY = f"q AS (SELECT graph_id, id FROM v WHERE status = 'pending' AND NOT EXISTS (SELECT 1 FROM e JOIN v p ON p.graph_id = e.graph_id AND p.id = e.src WHERE e.graph_id = v.graph_id AND e.dst = v.id AND p.status NOT IN {_DONE}))"


@query(f"{_GRAPH}, {_READY} SELECT * FROM q")
def state_ready_frontier(spark, d):
    return state.ready(*conversation_graph(spark, d))


def _hurt(spark, d):
    v, e = conversation_graph(spark, d)
    return v.withColumn("status", F.when((F.col("id") == 1) & (F.col("graph_id") % 3 == 0), "failed").otherwise(F.col("status"))), e


_HURT = "h AS (SELECT graph_id, id, CASE WHEN id = 1 AND graph_id % 3 = 0 THEN 'failed' ELSE status END AS status FROM v)"


@query(f"{_GRAPH}, {_HURT}, w AS (SELECT graph_id, id FROM h WHERE status = 'failed' UNION SELECT e.graph_id, e.dst FROM w JOIN e ON e.graph_id = w.graph_id AND e.src = w.id) SELECT h.graph_id, h.id, CASE WHEN status IN ('pending', 'waiting') AND w.id IS NOT NULL THEN 'failed' ELSE status END AS status FROM h LEFT JOIN w ON w.graph_id = h.graph_id AND w.id = h.id")
def state_propagate_failure(spark, d):
    return state.propagated(*_hurt(spark, d))


@query(f"{_GRAPH}, {_READY}, g AS (SELECT v.graph_id, count(*) AS n, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status IN {_DONE}) AS done, count(*) FILTER (status = 'waiting') AS waiting, count(q.id) AS ready FROM v LEFT JOIN q ON q.graph_id = v.graph_id AND q.id = v.id GROUP BY 1) SELECT graph_id, CASE WHEN failed > 0 THEN 'failed' WHEN ready > 0 THEN 'progressing' WHEN done = n THEN 'completed' WHEN waiting > 0 THEN 'suspended' ELSE 'stuck' END AS state, ready::BIGINT AS ready FROM g")
def state_classify(spark, d):
    return state.classified(*conversation_graph(spark, d))


@query(f"{_GRAPH}, h AS (SELECT * REPLACE (CASE WHEN id % 3 = 1 THEN 'pending' ELSE status END AS status) FROM v), s AS (SELECT e.graph_id, e.dst AS id, count(*) FILTER (p.status = 'failed') AS failed, count(*) FILTER (p.status NOT IN {_DONE}) AS open FROM e JOIN h p ON p.graph_id = e.graph_id AND p.id = e.src GROUP BY 1, 2) SELECT h.graph_id, h.id, CASE WHEN failed > 0 THEN 'failed' ELSE 'waits' END AS reason, CASE WHEN failed > 0 THEN failed ELSE open END::BIGINT AS by FROM h JOIN s ON s.graph_id = h.graph_id AND s.id = h.id WHERE h.status = 'pending' AND open > 0")
def state_blocked_reasons(spark, d):
    v, e = conversation_graph(spark, d)
    v = v.withColumn("status", F.when(F.col("id") % 3 == 1, "pending").otherwise(F.col("status")))
    return _longs(state.blocked(v, e), "by")


@query(f"{_GRAPH}, w AS (SELECT graph_id, id, 1 AS level FROM v WHERE id = 0 UNION ALL SELECT e.graph_id, e.dst, w.level + 1 FROM w JOIN e ON e.graph_id = w.graph_id AND e.src = w.id) SELECT graph_id, id, 'completed' AS status, max(level)::BIGINT AS wave FROM w GROUP BY 1, 2")
def state_simulate_waves(spark, d):
    v, e = conversation_graph(spark, d)
    return _longs(state.simulated(v.withColumn("status", F.lit("pending")), e, F.lit("completed")), "wave")


@query(f"""{_GRAPH}, h AS (SELECT graph_id, id, CASE WHEN id = 3 AND graph_id % 4 = 0 THEN 'odd' WHEN id = 0 AND graph_id % 4 = 1 THEN 'pending' ELSE status END AS status, CASE WHEN id = 0 AND graph_id % 4 = 3 THEN NULL ELSE output END AS output
  FROM v, (SELECT unnest([1, 2]) AS k) WHERE (k = 1 OR (id = 2 AND graph_id % 4 = 2)) AND NOT (id = 1 AND graph_id % 4 = 3))
  SELECT graph_id, id, 'unknown_status' AS fault FROM h WHERE status = 'odd'
  UNION ALL SELECT DISTINCT graph_id, id, 'missing_vertex' FROM (SELECT graph_id, src AS id FROM e UNION SELECT graph_id, dst FROM e) WHERE (graph_id, id) NOT IN (SELECT graph_id, id FROM h)
  UNION ALL SELECT graph_id, id, 'duplicate_vertex' FROM h GROUP BY graph_id, id HAVING count(*) > 1
  UNION ALL SELECT DISTINCT e.graph_id, e.dst, 'done_too_early' FROM e JOIN h p ON p.graph_id = e.graph_id AND p.id = e.src JOIN h c ON c.graph_id = e.graph_id AND c.id = e.dst WHERE p.status NOT IN {_DONE} AND c.status = 'completed'
  UNION ALL SELECT graph_id, id, 'no_output' FROM h WHERE status = 'completed' AND output IS NULL""")
def state_recovery_faults(spark, d):
    """Each fault is planted in a quarter of the graphs."""
    v, e = conversation_graph(spark, d)
    g, i = F.col("graph_id") % 4, F.col("id")
    v = v.where(~((i == 1) & (g == 3))).unionAll(v.where((i == 2) & (g == 2)))
    status = F.when((i == 3) & (g == 0), "odd").when((i == 0) & (g == 1), "pending").otherwise(F.col("status"))
    return state.recovery_faults(v.withColumn("status", status).withColumn("output", F.when(~((i == 0) & (g == 3)), F.col("output"))), e)


@query(f"{_GRAPH} SELECT v.graph_id, v.id, coalesce(string_agg(p.id || '=' || sha256(p.output), ',' ORDER BY p.id), '-1=' || sha256('')) AS inputs FROM v LEFT JOIN e ON e.graph_id = v.graph_id AND e.dst = v.id LEFT JOIN v p ON p.graph_id = e.graph_id AND p.id = e.src GROUP BY v.graph_id, v.id")
def state_inputs(spark, d):
    each = F.transform(F.array_sort(F.map_entries("inputs")), lambda x: F.concat(x["key"].cast("string"), F.lit("="), F.sha2(x["value"], 256)))
    return state.inputs(*conversation_graph(spark, d)).select("graph_id", "id", F.array_join(each, ",").alias("inputs"))


@query("SELECT l_orderkey, l_linenumber::BIGINT AS attempt, least(300.0::DOUBLE, 7.0::DOUBLE * pow(2.0, l_linenumber - 1)) AS delay FROM lineitem")
def state_retry_delay(spark, d):
    n = F.col("l_linenumber")
    return table(spark, d, "lineitem").select("l_orderkey", n.cast("long").alias("attempt"), state.retry_delay(F.lit(7.0), n).alias("delay"))


# --- rewrites and iteration ----------------------------------------------------------------------------------------


def _append(spark, d):
    v, e = conversation_graph(spark, d)
    anchors = v.where("id = 1").select("graph_id", "id")
    ends = lambda k: anchors.select("graph_id", F.lit(k).cast("long").alias("id"))
    inner = anchors.select("graph_id", F.lit(100).cast("long").alias("src"), F.lit(101).cast("long").alias("dst"))
    return e, rewrite.rewritten(e, anchors, inner, ends(100), ends(101), "append")


_APPEND = "x AS (SELECT graph_id, src, dst FROM e WHERE src <> 1 UNION SELECT graph_id, 100, 101 FROM v WHERE id = 1 UNION SELECT graph_id, 1, 100 FROM v WHERE id = 1 UNION SELECT graph_id, 101, dst FROM e WHERE src = 1)"


@query(f"{_GRAPH}, {_APPEND} SELECT * FROM x")
def rewrite_append_after(spark, d):
    return _append(spark, d)[1]


@query(f"{_GRAPH}, {_APPEND}, n AS (SELECT graph_id, count(*) AS edges FROM (SELECT * FROM x EXCEPT SELECT * FROM e) GROUP BY 1) SELECT graph_id, 2::BIGINT AS nodes, edges::BIGINT AS edges, 1::BIGINT AS ops FROM n")
def rewrite_cost(spark, d):
    return _longs(rewrite.cost(*_append(spark, d)), "nodes", "edges", "ops").select("graph_id", "nodes", "edges", "ops")


@query("""WITH j AS (SELECT o_custkey AS graph_id, o_orderkey AS rewrite_id, (o_orderkey % 5 + 1) AS nodes, (o_orderkey % 3) AS edges, CASE WHEN o_orderstatus = 'P' THEN 'witnessed' ELSE 'gassed' END AS mode FROM orders),
  k AS (SELECT graph_id, rewrite_id, CASE WHEN mode = 'gassed' THEN nodes ELSE 0 END AS a, CASE WHEN mode = 'gassed' THEN edges ELSE 0 END AS b, row_number() OVER (PARTITION BY graph_id ORDER BY rewrite_id) AS n FROM j),
  f AS (SELECT DISTINCT graph_id, NULL::BIGINT AS rewrite_id, 0::BIGINT AS n, 16::BIGINT AS nodes_left, 32::BIGINT AS edges_left, NULL::VARCHAR AS exceeded FROM k
    UNION ALL SELECT k.graph_id, k.rewrite_id, k.n, CASE WHEN a <= nodes_left AND b <= edges_left THEN nodes_left - a ELSE nodes_left END, CASE WHEN a <= nodes_left AND b <= edges_left THEN edges_left - b ELSE edges_left END,
      CASE WHEN a > nodes_left THEN 'nodes' WHEN b > edges_left THEN 'edges' END FROM f JOIN k ON k.graph_id = f.graph_id AND k.n = f.n + 1)
  SELECT graph_id, rewrite_id, nodes_left, edges_left, exceeded FROM f WHERE n > 0""".replace("WITH j", "WITH RECURSIVE j", 1))
def rewrite_budget(spark, d):
    o = table(spark, d, "orders")
    journal = o.select(F.col("o_custkey").alias("graph_id"), F.col("o_orderkey").alias("rewrite_id"), (F.col("o_orderkey") % 5 + 1).alias("nodes"), (F.col("o_orderkey") % 3).alias("edges"), F.when(F.col("o_orderstatus") == "P", "witnessed").otherwise("gassed").alias("mode"))
    return rewrite.admitted(journal).select("graph_id", "rewrite_id", "nodes_left", "edges_left", "exceeded")


@query("""WITH e AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n, event_id FROM events)
  SELECT user_id, count(*)::BIGINT AS emitted, string_agg(event_type, ',' ORDER BY n) FILTER (n <= 3) AS kept FROM e GROUP BY 1""")
def iter_emitted_accumulate(spark, d):
    out = rewrite.emitted(table(spark, d, "events"), "user_id", "event_id", "event_type", "accumulate", 3)
    return out.select("user_id", "emitted", F.array_join("kept", ",").alias("kept"))


@query("SELECT user_id, count(*)::BIGINT AS emitted, arg_max(event_type, event_id) AS kept FROM events GROUP BY 1")
def iter_reduce_last(spark, d):
    return rewrite.emitted(table(spark, d, "events"), "user_id", "event_id", "event_type", "reduce_last")


@query("""SELECT user_id, least(count(*), 20)::BIGINT AS bound, CASE WHEN bool_or(event_type = 'purchase') THEN 'finished' WHEN count(*) >= 20 THEN 'partial' ELSE 'running' END AS outcome FROM events GROUP BY 1""")
def iter_outcome(spark, d):
    by = table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("steps"), F.bool_or(F.col("event_type") == "purchase").alias("terminal"))
    return by.select("user_id", rewrite.admitted_bound(F.col("steps"), F.lit(20)).cast("long").alias("bound"), rewrite.outcome(F.col("steps"), F.lit(20), F.col("terminal")).alias("outcome"))


# --- run history ---------------------------------------------------------------------------------------------------

_HISTORY = """WITH runs AS (SELECT o_orderkey AS run_id, o_custkey AS task_id, CASE o_orderstatus WHEN 'O' THEN 'pending' WHEN 'P' THEN 'running' ELSE 'completed' END AS status, o_orderdate AS created_at, o_orderdate + INTERVAL 30 DAY AS lease_until, 'w' || (o_orderkey % 4) AS lease_owner FROM orders),
  tasks AS (SELECT c_custkey AS task_id, c_mktsegment AS task_type, c_nationkey AS priority, TIMESTAMP '1995-01-01' + to_days((c_custkey % 900)::INTEGER) AS next_run_at, c_acctbal > 0 AS enabled FROM customer),
  stages AS (SELECT l_orderkey AS run_id, l_linenumber AS stage_no, l_shipdate AS started_at, l_linestatus AS state FROM lineitem)"""


def _history(spark, d):
    status = F.when(F.col("o_orderstatus") == "O", "pending").when(F.col("o_orderstatus") == "P", "running").otherwise("completed")
    runs = table(spark, d, "orders").select(F.col("o_orderkey").alias("run_id"), F.col("o_custkey").alias("task_id"), status.alias("status"), F.col("o_orderdate").alias("created_at"), (F.col("o_orderdate") + F.expr("INTERVAL 30 DAYS")).alias("lease_until"), F.concat(F.lit("w"), (F.col("o_orderkey") % 4).cast("string")).alias("lease_owner"))
    due = F.expr("TIMESTAMP_NTZ '1995-01-01 00:00:00' + make_dt_interval(cast(c_custkey % 900 as int))")
    tasks = table(spark, d, "customer").select(F.col("c_custkey").alias("task_id"), F.col("c_mktsegment").alias("task_type"), F.col("c_nationkey").alias("priority"), due.alias("next_run_at"), (F.col("c_acctbal") > 0).alias("enabled"))
    stages = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("run_id"), F.col("l_linenumber").alias("stage_no"), F.col("l_shipdate").alias("started_at"), F.col("l_linestatus").alias("state"))
    return runs, tasks, stages


_NOW = "TIMESTAMP '1996-06-01'"


def _now():
    return F.expr("TIMESTAMP_NTZ '1996-06-01 00:00:00'")


@query(f"{_HISTORY}, n AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY started_at DESC, stage_no DESC, state DESC) AS k FROM stages) SELECT run_id, stage_no, state FROM n WHERE k = 1")
def hist_latest_stage_per_run(spark, d):
    return history.latest(_history(spark, d)[2], "run_id", "started_at", "stage_no").select("run_id", "stage_no", "state")


@query(f"{_HISTORY}, n AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY started_at DESC, stage_no DESC, state DESC) AS k, count(*) OVER (PARTITION BY run_id) AS c FROM stages) SELECT r.run_id, r.task_id, task_type, priority, status, n.stage_no AS last_stage, n.state AS last_state, coalesce(c, 0)::BIGINT AS stages FROM runs r JOIN tasks USING (task_id) LEFT JOIN n ON n.run_id = r.run_id AND k = 1")
def hist_admin_view(spark, d):
    return history.admin_view(*_history(spark, d))


@query(f"{_HISTORY} SELECT task_id, task_type, priority FROM tasks WHERE enabled AND next_run_at <= {_NOW} ORDER BY priority DESC, CASE WHEN task_type = 'BUILDING' THEN 1 ELSE 0 END, next_run_at, task_id LIMIT 5")
def hist_next_due_task(spark, d):
    return history.due_tasks(_history(spark, d)[1], _now(), "BUILDING", 5).select("task_id", "task_type", "priority")


@query(f"{_HISTORY} SELECT run_id, task_id, priority FROM runs JOIN tasks USING (task_id) WHERE status = 'pending' AND task_type <> 'MACHINERY' ORDER BY priority DESC, CASE WHEN task_type = 'BUILDING' THEN 1 ELSE 0 END, created_at, run_id LIMIT 10")
def hist_pending_claim_order(spark, d):
    runs, tasks, _ = _history(spark, d)
    return history.claim_order(runs, tasks, "BUILDING", ("MACHINERY",), 10).select("run_id", "task_id", "priority")


@query(f"{_HISTORY} SELECT run_id, lease_owner FROM runs WHERE status = 'running' AND lease_until < {_NOW} AND lease_owner IS DISTINCT FROM 'w1'")
def hist_expired_leases(spark, d):
    return history.expired(_history(spark, d)[0], _now(), "w1").select("run_id", "lease_owner")


@query(f"{_HISTORY} SELECT count(*) FILTER (status = 'pending')::BIGINT AS pending, count(*) FILTER (status = 'running')::BIGINT AS running, max(CASE WHEN status = 'pending' THEN (epoch({_NOW}) - epoch(created_at)) END)::BIGINT AS oldest_s FROM runs")
def hist_backpressure(spark, d):
    return history.backpressure(_history(spark, d)[0], _now().cast("timestamp"))


@query(f"{_HISTORY} SELECT task_id, count(*)::BIGINT AS open_runs FROM runs WHERE status IN ('pending', 'running') GROUP BY 1 HAVING count(*) > 1")
def hist_open_run_violations(spark, d):
    return history.open_run_violations(_history(spark, d)[0])


@query("SELECT l_orderkey AS run_id, (max(l_linenumber) + 1)::BIGINT AS next_attempt FROM lineitem GROUP BY 1")
def hist_next_attempt(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("run_id"), F.col("l_linenumber").alias("attempt"))
    return _longs(history.next_attempt(rows, "run_id"), "next_attempt")


@query(f"{_HISTORY}, g AS (SELECT run_id, task_id, (epoch(created_at) - epoch(lag(created_at) OVER (PARTITION BY task_id ORDER BY created_at, run_id)))::BIGINT AS gap_s FROM runs) SELECT run_id, task_id, gap_s FROM g WHERE gap_s < 864000")
def hist_cooldown(spark, d):
    runs = _history(spark, d)[0].withColumn("created_at", F.col("created_at").cast("timestamp"))
    return history.cooled(runs, 864000).select("run_id", "task_id", "gap_s")


@query(f"{_HISTORY} SELECT c_custkey + 1 AS task_id FROM customer WHERE (c_custkey + 1) NOT IN (SELECT task_id FROM runs WHERE status IN ('pending', 'running'))")
def hist_insert_guard(spark, d):
    new = table(spark, d, "customer").select((F.col("c_custkey") + 1).alias("task_id"))
    return history.insertable(new, _history(spark, d)[0])


@query(f"{_HISTORY} SELECT task_type, count(*)::BIGINT AS running, 10::BIGINT AS cap FROM runs JOIN tasks USING (task_id) WHERE status = 'running' GROUP BY 1 HAVING count(*) >= 10")
def hist_types_at_cap(spark, d):
    runs, tasks, _ = _history(spark, d)
    return history.types_at_cap(runs, tasks, tasks.select("task_type", F.lit(10).cast("long").alias("cap")).distinct())


@query(f"{_HISTORY} SELECT run_id, CASE WHEN run_id % 2 = 0 AND status <> 'completed' THEN 'cancelled' ELSE status END AS status FROM runs")
def hist_terminal_update(spark, d):
    runs = _history(spark, d)[0]
    return history.finished(runs, runs.where("run_id % 2 = 0").select("run_id", F.lit("cancelled").alias("to"))).select("run_id", "status")


@query(f"{_HISTORY}, w AS (SELECT run_id, run_id * 10 + n AS write_id, n AS expected FROM runs, (SELECT unnest([0, 1]) AS n)) SELECT write_id, w.run_id, expected = w.run_id % 2 AND write_id % 10 = 0 AS won FROM w")
def hist_compare_and_swap(spark, d):
    runs = _history(spark, d)[0]
    writes = runs.select("run_id", F.explode(F.array(F.lit(0), F.lit(1))).alias("expected")).withColumn("write_id", F.col("run_id") * 10 + F.col("expected"))
    return history.swapped(runs.select("run_id", (F.col("run_id") % 2).alias("revision")), writes)


@query("""WITH w AS (SELECT event_id AS wait_id, user_id AS run_id, event_type AS name, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS n FROM events WHERE event_id % 3 = 0),
  s AS (SELECT DISTINCT user_id AS run_id, event_type AS name FROM events WHERE event_id % 3 <> 0)
  SELECT wait_id, w.run_id, w.name, CASE WHEN n > 1 THEN 'invalid' WHEN s.run_id IS NOT NULL THEN 'resolved' ELSE 'parked' END AS settled FROM w LEFT JOIN s ON s.run_id = w.run_id AND s.name = w.name""")
def signal_settlement(spark, d):
    e = table(spark, d, "events")
    waits = e.where("event_id % 3 = 0").select(F.col("event_id").alias("wait_id"), F.col("user_id").alias("run_id"), F.col("event_type").alias("name"))
    sent = e.where("event_id % 3 <> 0").select(F.col("user_id").alias("run_id"), F.col("event_type").alias("name"), F.col("ts").alias("at"))
    return history.settled_signals(waits, sent)


@query("SELECT event_id, user_id AS waits_for FROM events WHERE user_id IN (SELECT user_id FROM events WHERE event_type = 'purchase')")
def signal_fanout(spark, d):
    e = table(spark, d, "events")
    return history.fan_out(e.where("event_type = 'purchase'").select(F.col("user_id").alias("run_id")), e.select("event_id", F.col("user_id").alias("waits_for")))


# --- audits, artifacts, masking ------------------------------------------------------------------------------------


@query("SELECT l_partkey, l_suppkey, count(*)::BIGINT AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def audit_duplicates(spark, d):
    return history.duplicates(table(spark, d, "lineitem"), "l_partkey", "l_suppkey")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def audit_referential_closure(spark, d):
    return history.unreferenced(table(spark, d, "lineitem"), "l_orderkey", table(spark, d, "orders").where("o_orderstatus = 'F'"), "o_orderkey").select("l_orderkey", "l_linenumber")


@query(f"{_GRAPH}, p AS (SELECT graph_id, src, dst FROM e WHERE dst % 4 <> 3) SELECT e.graph_id, e.src, e.dst FROM e LEFT JOIN p USING (graph_id, src, dst) WHERE p.src IS NULL")
def audit_endpoint_linearity(spark, d):
    """Rows that lack their mirror, either way."""
    _, e = conversation_graph(spark, d)
    mirror = graph.transpose(e.where("dst % 4 <> 3"))
    return graph.diff(graph.transpose(mirror), e).select("graph_id", "src", "dst")


@query("WITH f AS (SELECT o_orderkey AS run_id, 1 AS stage_no, o_orderstatus FROM orders) SELECT f.run_id, CASE WHEN s.l_orderkey IS NULL THEN 'ok' WHEN o_orderstatus = 'F' THEN 'block' ELSE 'warn' END AS gate FROM f LEFT JOIN (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem WHERE l_linestatus = 'F') s ON s.l_orderkey = run_id AND s.l_linenumber = 1")
def audit_replay_gate(spark, d):
    front = table(spark, d, "orders").select(F.col("o_orderkey").alias("run_id"), F.lit(1).alias("stage_no"), "o_orderstatus")
    past = table(spark, d, "lineitem").where("l_linestatus = 'F'").select(F.col("l_orderkey").alias("run_id"), F.col("l_linenumber").alias("stage_no"))
    return history.replay_gate(front, past, F.col("o_orderstatus") == "F").select("run_id", "gate")


@query("SELECT o_orderkey AS run_id, CASE WHEN o_orderkey % 5 = 0 THEN 'missing' WHEN o_orderkey % 5 = 1 THEN 'corrupt' WHEN o_orderkey % 5 = 2 THEN 'incompatible' ELSE 'ok' END AS state FROM orders")
def audit_checkpoints(spark, d):
    runs = table(spark, d, "orders").select(F.col("o_orderkey").alias("run_id"))
    kept = runs.where("run_id % 5 <> 0").select("run_id", F.when(F.col("run_id") % 5 == 1, "other").otherwise("graph").alias("kind"), F.when(F.col("run_id") % 5 == 2, 1).otherwise(2).alias("version"))
    return history.checkpoint_state(kept, runs.select("run_id", F.lit("graph").alias("kind"), F.lit(2).alias("version"))).select("run_id", "state")


@query("SELECT page_id, regexp_replace('arn:x:' || lpad(page_id::VARCHAR, 12, '0') || ':' || url, ':[0-9]{12}:', ':***:', 'g') AS masked FROM pages")
def mask_identifiers(spark, d):
    name = F.concat(F.lit("arn:x:"), F.lpad(F.col("page_id").cast("string"), 12, "0"), F.lit(":"), "url")
    return table(spark, d, "pages").select("page_id", history.masked(name).alias("masked"))


@query("SELECT DISTINCT source, regexp_replace('1 ' || source || '.x', '[^a-zA-Z0-9]', '_', 'g') AS plain, 'item_' || regexp_replace('1 ' || source || '.x', '[^a-zA-Z0-9]', '_', 'g') AS label FROM documents")
def sanitize_label(spark, d):
    raw = F.concat(F.lit("1 "), "source", F.lit(".x"))
    return table(spark, d, "documents").select("source", F.regexp_replace(raw, "[^a-zA-Z0-9]", "_").alias("plain"), sanitised(raw).alias("label")).distinct()


_ADDRESS = """'sha256:' || sha256('{"contract":null,"mediaType":"text/plain","payloadKind":"text","value":' || length(text) || sha256(text) || '}')"""


def _artifacts(spark, d):
    body = F.concat(F.length("text").cast("string"), F.sha2("text", 256))
    made = history.address(F.lit(None).cast("string"), F.lit("text"), F.lit("text/plain"), body)
    return table(spark, d, "documents").select("doc_id", "source", made.alias("hash"))


@query(f"SELECT DISTINCT {_ADDRESS} AS hash FROM documents WHERE {_ADDRESS} NOT IN (SELECT {_ADDRESS} FROM documents WHERE doc_id % 3 = 0)")
def artifact_dedupe(spark, d):
    rows = _artifacts(spark, d)
    return history.stored_artifacts(rows, rows.where("doc_id % 3 = 0").select("hash").distinct()).select("hash")


@query(f"WITH a AS (SELECT doc_id, source, {_ADDRESS} AS hash FROM documents) SELECT source, hash, count(*)::BIGINT AS n FROM a GROUP BY 1, 2")
def artifact_list_for_run(spark, d):
    rows = _artifacts(spark, d)
    return history.listed_artifacts(rows, rows, "source")


@query(f"WITH a AS (SELECT doc_id, {_ADDRESS} AS hash FROM documents) SELECT DISTINCT hash FROM a WHERE hash NOT IN (SELECT hash FROM a WHERE doc_id % 2 = 0)")
def artifact_orphans(spark, d):
    rows = _artifacts(spark, d)
    return history.orphans(rows.select("hash").distinct(), rows.where("doc_id % 2 = 0").select("hash"))


@query("SELECT c_custkey, CASE WHEN c_nationkey < 8 THEN CASE WHEN c_acctbal > 0 THEN 'complete' ELSE 'restore' END WHEN c_nationkey < 16 THEN 'advance' ELSE 'keep' END AS decision FROM customer")
def audit_schedule_decision(spark, d):
    kind = F.when(F.col("c_nationkey") < 8, "one_off").when(F.col("c_nationkey") < 16, "recurring").otherwise("manual")
    return table(spark, d, "customer").select("c_custkey", history.schedule_decision(kind, F.when(F.col("c_acctbal") > 0, "completed").otherwise("failed")).alias("decision"))


# --- flows ---------------------------------------------------------------------------------------------------------


@query("SELECT l_orderkey, l_linenumber, l_quantity, l_tax FROM lineitem WHERE l_quantity > 40")
def flow_gather_scatter(spark, d):
    r = flow.Registry(contracts={"Line": {}, "Packed": {}})
    pack = r.node("pack", {"rows": "Line"}, {"packed": "Packed"}, lambda x: {"packed": flow.gathered(x["rows"].where("l_quantity > 40"), "rec", "l_quantity", "l_tax")})
    open_ = r.node("open", {"packed": "Packed"}, {"out": "Line"}, lambda x: {"out": flow.scattered(x["packed"], "rec")})
    return (pack >> open_).run(rows=table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_tax"))["out"]


@query("SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'open' ELSE 'part' END AS arm FROM orders")
def flow_select_variant(spark, d):
    arm = lambda name: lambda df: df.select("o_orderkey", F.lit(name).alias("arm"))
    return flow.selected(table(spark, d, "orders"), F.col("o_orderstatus"), {"F": arm("done"), "O": arm("open"), "P": arm("part")})


@query("SELECT (o_orderkey % 4)::BIGINT AS shard, count(*)::BIGINT AS n FROM orders GROUP BY 1")
def flow_make_shards(spark, d):
    r = flow.Registry(contracts={"Rows": {}, "Count": {}})

    def shard(k: int) -> flow.Flow:
        return r.node(f"s{k}", {f"in{k}": "Rows"}, {f"out{k}": "Count"}, lambda x: {f"out{k}": x[f"in{k}"].where(F.col("o_orderkey") % 4 == k).agg(F.lit(k).cast("long").alias("shard"), F.count("*").alias("n"))})

    split = r.node("split", {"rows": "Rows"}, {f"in{k}": "Rows" for k in range(4)}, lambda x: {f"in{k}": x["rows"] for k in range(4)})
    out = (split >> flow.make(4, shard)).run(rows=table(spark, d, "orders"))
    return out["out0"].unionAll(out["out1"]).unionAll(out["out2"]).unionAll(out["out3"])


@query("SELECT * FROM (VALUES ('a', 'in', 'x', 'input'), ('a', 'out', 'y', 'edge'), ('b', 'in', 'y', 'edge'), ('b', 'in', 'w', 'input'), ('b', 'out', 'z', 'result')) t(node, way, label, used)")
def flow_endpoint_report(spark, d):
    r = flow.Registry(contracts={"C": {}}, executors={"same": lambda x: x})
    both = r.node("a", {"x": "C"}, {"y": "C"}, "same") >> r.node("b", {"y": "C", "w": "C"}, {"z": "C"}, "same")
    return spark.createDataFrame(both.endpoint_report(), "node string, way string, label string, used string")


@query("""WITH ex AS (SELECT n_regionkey % 3 AS label, n_name AS contract FROM nation WHERE n_nationkey % 2 = 0), en AS (SELECT n_regionkey % 3 AS label, n_name AS contract FROM nation WHERE n_nationkey % 3 = 0)
  SELECT coalesce(ex.label, en.label)::BIGINT AS label, coalesce(ex.contract, en.contract) AS contract, CASE WHEN ex.contract IS NULL THEN 'entry' WHEN en.contract IS NULL THEN 'exit' ELSE 'joined' END AS side FROM ex FULL JOIN en ON ex.label = en.label AND ex.contract = en.contract""")
def flow_port_match(spark, d):
    n = table(spark, d, "nation").select("n_nationkey", (F.col("n_regionkey") % 3).cast("long").alias("label"), F.col("n_name").alias("contract"))
    return flow.port_matches(n.where("n_nationkey % 2 = 0"), n.where("n_nationkey % 3 = 0"))


# --- histograms and cost -------------------------------------------------------------------------------------------

_SHOTS = "s AS (SELECT l_suppkey % 5 AS job, (l_orderkey % 2)::VARCHAR || (l_linenumber % 2)::VARCHAR || (l_partkey % 2)::VARCHAR AS bits FROM lineitem), h AS (SELECT job, bits, count(*) AS n FROM s GROUP BY 1, 2)"


def _shots(spark, d):
    rows = table(spark, d, "lineitem").select((F.col("l_suppkey") % 5).alias("job"), F.array(F.col("l_partkey") % 2, F.col("l_linenumber") % 2, F.col("l_orderkey") % 2).alias("bits"))
    return histogram.decoded(rows, "bits", [0, 1, 2], "job")


@query(f"WITH {_SHOTS} SELECT job, 'a=' || bits[3] || ',b=' || bits[2] || ',c=' || bits[1] AS label, sum(n)::BIGINT AS n FROM h GROUP BY 1, 2")
def hist_shots_labeled(spark, d):
    return histogram.labelled(_shots(spark, d), ["a", "b", "c"], "job")


@query(f"WITH {_SHOTS} SELECT lpad(bin(i), 4, '0') AS bits, coalesce((SELECT sum(n) FROM h WHERE '0' || bits = lpad(bin(i), 4, '0')), 0)::BIGINT AS n FROM range(16) r(i)")
def hist_dense(spark, d):
    return histogram.dense(_shots(spark, d).withColumn("bits", F.concat(F.lit("0"), "bits")), 4)


@query(f"WITH {_SHOTS} SELECT job, o AS output, sum(CASE WHEN bits[4 - k] = '0' THEN n ELSE 0 END)::BIGINT AS zeros, sum(CASE WHEN bits[4 - k] = '1' THEN n ELSE 0 END)::BIGINT AS ones FROM h, (VALUES (1, 'a'), (2, 'b'), (3, 'c')) t(k, o) GROUP BY 1, 2")
def hist_marginals(spark, d):
    return histogram.marginals(_shots(spark, d), ["a", "b", "c"], "job")


@query(f"WITH {_SHOTS} SELECT job, sum(n)::BIGINT AS shots, sum(CASE WHEN bits = '000' THEN n ELSE 0 END)::BIGINT AS matching, sum(CASE WHEN bits = '000' THEN 0 ELSE n END)::BIGINT AS deviating, sum(CASE WHEN bits = '000' THEN n ELSE 0 END) >= sum(n) * 0.125 AS passed FROM h GROUP BY 1")
def hist_verdicts(spark, d):
    return histogram.verdicts(_shots(spark, d), F.lit("000"), 0.125, "job")


PRICES = [(1, "steel", 0.25, 0.0004), (2, "copper", 0.25, 0.0016), (3, "", 0.25, 0.02)]


@query("""SELECT p_partkey, p_type, p_size::BIGINT AS shots, round(0.25 + p_size * CASE WHEN contains(lower(p_type), 'steel') THEN 0.0004 WHEN contains(lower(p_type), 'copper') THEN 0.0016 ELSE 0.02 END, 10)::DOUBLE AS cost FROM part""")
def cost_estimate(spark, d):
    prices = spark.createDataFrame(PRICES, "place int, pattern string, per_task double, per_shot double")
    return histogram.costed(table(spark, d, "part").select("p_partkey", "p_type", F.col("p_size").cast("long").alias("shots")), prices, "p_type")


# --- extensions that Spark brings along ----------------------------------------------------------------------------


@query("SELECT c_mktsegment, c_nationkey, count(*)::BIGINT AS n, round(sum(c_acctbal::DECIMAL(18,2))::DOUBLE, 2) AS total FROM customer GROUP BY CUBE (c_mktsegment, c_nationkey)")
def ext_cube(spark, d):
    return table(spark, d, "customer").cube("c_mktsegment", "c_nationkey").agg(F.count("*").alias("n"), F.round(F.sum(F.col("c_acctbal").cast("decimal(18,2)")).cast("double"), 2).alias("total"))


@query("""WITH g AS (SELECT *, CASE WHEN epoch(ts) - epoch(lag(ts) OVER w) <= 1800 THEN 0 ELSE 1 END AS opens FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
  s AS (SELECT user_id, sum(opens) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM g) SELECT user_id, session::BIGINT AS session, count(*)::BIGINT AS n FROM s GROUP BY 1, 2""")
def ext_sessions(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    opens = F.when(F.unix_micros("ts") - F.unix_micros(F.lag("ts").over(w)) <= 1_800_000_000, 0).otherwise(1)
    return e.withColumn("opens", opens).withColumn("session", F.sum("opens").over(w)).groupBy("user_id", "session").agg(F.count("*").alias("n"))


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*)::BIGINT AS n FROM events GROUP BY 1, 2")
def ext_event_windows(spark, d):
    from dagframe.streaming import signals

    out = signals.windowed(table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")))
    return out.withColumn("start", F.col("start").cast("timestamp_ntz"))


# --- more of the ledger, leases, ports and reports -----------------------------------------------------------------


@query("WITH n AS (SELECT event_id AS signal_id, user_id AS run_id, event_type AS name, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS k FROM events WHERE event_id % 4 <> 0) SELECT signal_id, run_id, name, 'consumed' AS state FROM n WHERE k = 1")
def signal_consumed(spark, d):
    state_ = F.when(F.col("event_id") % 4 == 0, "pending").when(F.col("event_id") % 4 == 1, "consumed").otherwise("delivered")
    rows = table(spark, d, "events").select(F.col("event_id").alias("signal_id"), F.col("user_id").alias("run_id"), F.col("event_type").alias("name"), F.col("ts").alias("at"), state_.alias("state"))
    return history.kept_consumed(rows).select("signal_id", "run_id", "name", "state")


@query(f"{_HISTORY} SELECT run_id, CASE WHEN lease_owner = 'w2' OR lease_until < {_NOW} THEN 'w2' ELSE lease_owner END AS lease_owner, CASE WHEN lease_owner = 'w2' OR lease_until < {_NOW} THEN {_NOW} + INTERVAL 60 SECOND ELSE lease_until END AS lease_until FROM runs WHERE status = 'running'")
def hist_lease_claim(spark, d):
    return history.claimed_leases(_history(spark, d)[0], "w2", _now(), 60)


@query("SELECT DISTINCT l_partkey, l_suppkey FROM lineitem l WHERE NOT EXISTS (SELECT 1 FROM lineitem m WHERE m.l_returnflag = 'R' AND m.l_partkey = l.l_partkey AND m.l_suppkey = l.l_suppkey)")
def ledger_reserve(spark, d):
    rows = table(spark, d, "lineitem").select("l_partkey", "l_suppkey", "l_returnflag")
    return history.reserved_calls(rows.select("l_partkey", "l_suppkey"), rows.where("l_returnflag = 'R'").select("l_partkey", "l_suppkey"), ("l_partkey", "l_suppkey"))


@query(f"{_HISTORY} SELECT run_id, stage_no, started_at FROM stages JOIN runs USING (run_id) WHERE state = 'O' AND status IN ('pending', 'running') ORDER BY started_at, run_id * 10 + stage_no LIMIT 20")
def ledger_submitted(spark, d):
    runs, _, stages = _history(spark, d)
    calls = stages.select("run_id", "stage_no", "started_at", F.col("started_at").alias("at"), (F.col("run_id") * 10 + F.col("stage_no")).alias("call_id"), F.when(F.col("state") == "O", "submitted").otherwise("settled").alias("state"))
    return history.submitted_calls(calls, runs, 20).select("run_id", "stage_no", "started_at")


@query("SELECT l_orderkey AS run_id, count(*)::BIGINT AS calls FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_returnflag) = 1 AND count(DISTINCT l_linestatus) = 1 AND count(*) > 1")
def ledger_fusable(spark, d):
    return history.fusable(table(spark, d, "lineitem").select(F.col("l_orderkey").alias("run_id"), F.col("l_returnflag").alias("authority"), F.col("l_linestatus").alias("strategy")))


@query("SELECT p_name, count(DISTINCT p_brand)::BIGINT AS forms FROM part GROUP BY 1 HAVING count(DISTINCT p_brand) > 1")
def audit_template_conflicts(spark, d):
    return history.conflicting_templates(table(spark, d, "part"), "p_name", "p_brand")


@query("WITH p AS (SELECT c_custkey AS node, c_nationkey % 3 + 1 AS least, c_nationkey % 3 + 12 AS most FROM customer), n AS (SELECT o_custkey AS node, count(*) AS n FROM orders GROUP BY 1) SELECT node, 'in' AS port, coalesce(n, 0)::BIGINT AS n FROM p LEFT JOIN n USING (node) WHERE coalesce(n, 0) NOT BETWEEN least AND most")
def flow_port_cardinality(spark, d):
    ports = table(spark, d, "customer").select(F.col("c_custkey").alias("node"), F.lit("in").alias("port"), (F.col("c_nationkey") % 3 + 1).alias("least"), (F.col("c_nationkey") % 3 + 12).alias("most"))
    return history.port_faults(table(spark, d, "orders").select(F.col("o_custkey").alias("node"), F.lit("in").alias("port")), ports)


@query("SELECT p_name, arg_min(p_partkey, p_partkey) AS p_partkey FROM part GROUP BY 1")
def audit_first_wins(spark, d):
    return history.first_wins(table(spark, d, "part"), "p_name", "p_partkey").select("p_name", "p_partkey")


@query("SELECT '| case | verdict |' || chr(10) || '| --- | --- |' || chr(10) || string_agg('| ' || n_name || ' | ' || CASE WHEN n_regionkey > 0 THEN 'pass' ELSE 'fail' END || ' |', chr(10) ORDER BY n_name) AS \"table\", count(*)::BIGINT AS cases, count(*) FILTER (n_regionkey = 0)::BIGINT AS failed, (count(*) FILTER (n_regionkey = 0) > 0)::INT::BIGINT AS exit_code FROM nation")
def hist_report(spark, d):
    return history.report(table(spark, d, "nation").withColumn("ok", F.col("n_regionkey") > 0), "n_name", "ok")


# --- the run store -------------------------------------------------------------------------------------------------

_STORE = """WITH runs AS (SELECT o_orderkey AS run_id, o_custkey AS task_id, CASE o_orderstatus WHEN 'O' THEN 'pending' WHEN 'P' THEN 'running' ELSE 'completed' END AS status, o_orderdate AS created_at, o_orderdate AS started_at,
    CASE WHEN o_orderkey % 3 > 0 THEN 'p' || (o_orderkey % 3) END AS profile FROM orders),
  tasks AS (SELECT c_custkey AS task_id, c_mktsegment AS task_type, TIMESTAMP '1995-01-01' + to_days((c_custkey % 900)::INTEGER) AS next_run_at, c_acctbal > 0 AS enabled, 'u' || c_nationkey AS user_id,
    CASE c_custkey % 3 WHEN 0 THEN '{"user_id":"a"}' WHEN 1 THEN '{"userId":"b"}' ELSE '{}' END AS payload FROM customer),
  stages AS (SELECT l_orderkey AS run_id, l_linenumber AS stage_no, min(l_shipdate) AS started_at, CASE WHEN l_linenumber % 3 > 0 THEN max(l_shipdate) + INTERVAL 3 DAY END AS ended_at, max(l_linestatus) AS state FROM lineitem GROUP BY l_orderkey, l_linenumber)"""


def _store(spark, d):
    status = F.when(F.col("o_orderstatus") == "O", "pending").when(F.col("o_orderstatus") == "P", "running").otherwise("completed")
    key = F.col("o_orderkey")
    found = table(spark, d, "orders").select(key.alias("run_id"), F.col("o_custkey").alias("task_id"), status.alias("status"), F.col("o_orderdate").alias("created_at"), F.col("o_orderdate").alias("started_at"), F.when(key % 3 > 0, F.concat(F.lit("p"), (key % 3).cast("string"))).alias("profile"))
    due = F.expr("TIMESTAMP_NTZ '1995-01-01 00:00:00' + make_dt_interval(cast(c_custkey % 900 as int))")
    third = F.col("c_custkey") % 3
    payload = F.when(third == 0, '{"user_id":"a"}').when(third == 1, '{"userId":"b"}').otherwise("{}")
    tasks = table(spark, d, "customer").select(F.col("c_custkey").alias("task_id"), F.col("c_mktsegment").alias("task_type"), due.alias("next_run_at"), (F.col("c_acctbal") > 0).alias("enabled"), F.concat(F.lit("u"), F.col("c_nationkey").cast("string")).alias("user_id"), payload.alias("payload"))
    stages = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("run_id"), F.col("l_linenumber").alias("stage_no")).agg(F.min("l_shipdate").alias("started_at"), (F.max("l_shipdate") + F.expr("INTERVAL 3 DAYS")).alias("ended_at"), F.max("l_linestatus").alias("state"))
    return found, tasks, stages.withColumn("ended_at", F.when(F.col("stage_no") % 3 > 0, F.col("ended_at")))


@query(f"{_STORE} SELECT run_id, status FROM runs WHERE task_id = 7 ORDER BY created_at DESC, run_id DESC LIMIT 5")
def hist_runs_of_task(spark, d):
    return runs.runs_of(_store(spark, d)[0], "task_id", 7, 5).select("run_id", "status")


@query(f"{_STORE} SELECT run_id FROM runs ORDER BY created_at DESC, run_id DESC LIMIT 1")
def hist_newest_run(spark, d):
    """A limit below 1 counts as 1."""
    return runs.listed(_store(spark, d)[0], F.desc("created_at"), F.desc("run_id"), limit=0).select("run_id")


@query(f"{_STORE} SELECT run_id, stage_no, started_at FROM stages WHERE run_id IN (SELECT run_id FROM runs WHERE task_id < 50)")
def hist_stage_details(spark, d):
    found, _, stages = _store(spark, d)
    return runs.listed(stages.join(found.where("task_id < 50").select("run_id"), "run_id"), "run_id", "stage_no").select("run_id", "stage_no", "started_at")


@query(f"{_STORE} SELECT r.run_id, status, started_at FROM runs r JOIN tasks t ON t.task_id = r.task_id WHERE 'u' || (r.run_id % 25) = t.user_id")
def hist_status_lookup(spark, d):
    """Runs asked for by one user each; only its own runs answer."""
    found, tasks, _ = _store(spark, d)
    owned = found.join(tasks.select("task_id", "user_id"), "task_id")
    return runs.statuses(owned, found.select("run_id", F.concat(F.lit("u"), (F.col("run_id") % 25).cast("string")).alias("user_id")), user=True)


@query(f"{_STORE}, n AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY started_at DESC, stage_no DESC) AS k FROM stages WHERE ended_at IS NULL) SELECT run_id, stage_no FROM n WHERE k = 1")
def hist_open_stage(spark, d):
    return runs.open_stage(_store(spark, d)[2]).select("run_id", "stage_no")


@query(f"{_STORE} SELECT run_id, stage_no, CASE WHEN ended_at IS NULL AND run_id % 2 = 0 THEN {_NOW} ELSE ended_at END AS ended_at, CASE WHEN ended_at IS NULL AND run_id % 2 = 0 THEN 'X' ELSE state END AS state FROM stages UNION ALL SELECT run_id, 99, NULL, 'N' FROM runs")
def hist_stage_writes(spark, d):
    """New stages come, and facts end those of even runs that are open."""
    found, _, stages = _store(spark, d)
    new = found.select("run_id", F.lit(99).cast("int").alias("stage_no"), "started_at", F.lit(None).cast("timestamp_ntz").alias("ended_at"), F.lit("N").alias("state"))
    old = stages.select("run_id", F.col("stage_no").cast("int").alias("stage_no"), "started_at", "ended_at", "state")
    facts = old.where("run_id % 2 = 0").select("run_id", "stage_no", _now().alias("at"), F.lit("X").alias("state"))
    return runs.completed(runs.appended(old, new.unionByName(old.withColumn("state", F.lit("again")))), facts).select("run_id", F.col("stage_no").cast("long").alias("stage_no"), "ended_at", "state")


@query(f"{_STORE} SELECT task_id, 'pending' AS status, CASE task_id % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'b' ELSE user_id END AS user_id FROM tasks WHERE enabled AND next_run_at <= {_NOW} AND task_id NOT IN (SELECT task_id FROM runs WHERE status IN ('pending', 'running'))")
def hist_create_runs(spark, d):
    found, tasks, _ = _store(spark, d)
    return runs.created(tasks, found, _now())


@query(f"{_STORE} SELECT run_id, coalesce(profile, 'p1') AS profile, coalesce(profile <> 'p1', false) AS conflict FROM runs")
def hist_profile_freeze(spark, d):
    found = _store(spark, d)[0]
    return runs.frozen(found, found.select("run_id", F.lit("p1").alias("profile")))


@query(f"{_STORE} SELECT run_id, CASE WHEN run_id % 2 = 1 AND status = 'pending' THEN 'cancelled' ELSE status END AS status, run_id % 2 = 1 AND status = 'running' AS to_cancel FROM runs")
def hist_cancel(spark, d):
    found = _store(spark, d)[0]
    return runs.cancelled(found, found.where("run_id % 2 = 1"))


@query(f"{_STORE} SELECT task_id, CASE WHEN task_id IN (SELECT task_id FROM runs WHERE run_id % 50 = 1) THEN false ELSE enabled END AS enabled FROM tasks")
def hist_disable_tasks(spark, d):
    found, tasks, _ = _store(spark, d)
    return runs.tasks_after(tasks, found, found.where("run_id % 50 = 1"), False)


@query(f"{_STORE} SELECT task_id, task_type FROM tasks WHERE task_id = (SELECT task_id FROM runs WHERE run_id = 1)")
def hist_task_of_run(spark, d):
    found, tasks, _ = _store(spark, d)
    return runs.task_of(found, tasks, 1).select("task_id", "task_type")


@query(f"{_STORE} SELECT task_id, task_type FROM tasks UNION ALL SELECT max(task_id) + 1, 'NEW' FROM tasks")
def hist_define_tasks(spark, d):
    tasks = _store(spark, d)[1].select("task_id", "task_type")
    new = tasks.agg((F.max("task_id") + 1).alias("task_id"), F.lit("NEW").alias("task_type")).unionByName(tasks.withColumn("task_type", F.lit("AGAIN")))
    return runs.defined(tasks, new)


@query(f"{_STORE} SELECT run_id, task_type FROM runs LEFT JOIN (SELECT * FROM tasks WHERE enabled) USING (task_id) WHERE status = 'running'")
def hist_recovered(spark, d):
    found, tasks, _ = _store(spark, d)
    return runs.recovered(found.where("status = 'running'"), tasks.where("enabled")).select("run_id", "task_type")


@query(f"{_STORE} SELECT run_id, stage_no::BIGINT AS stage_no, max(ended_at) AS completed_at FROM stages WHERE ended_at IS NOT NULL GROUP BY 1, 2")
def hist_node_times(spark, d):
    return _longs(runs.node_times(_store(spark, d)[2]), "stage_no")


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 3 > 0 THEN (l_linenumber % 3)::BIGINT WHEN l_orderkey % 2 > 0 THEN 60 END AS timeout FROM lineitem")
def hist_timeouts(spark, d):
    own, default = (F.col("l_linenumber") % 3).cast("long"), F.when(F.col("l_orderkey") % 2 > 0, 60).otherwise(0).cast("long")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", runs.effective_timeout(own, default).alias("timeout"))


@query("SELECT event_id FROM events WHERE ts + INTERVAL 1 DAY < (SELECT max(ts) FROM events)")
def signal_expired_waits(spark, d):
    e = table(spark, d, "events").withColumn("expires_at", F.expr("ts + INTERVAL 1 DAY"))
    return runs.expired_waits(e, e.select(F.max("ts")).scalar()).select("event_id")


@query(f"WITH a AS (SELECT DISTINCT {_ADDRESS} AS hash FROM documents) SELECT hash, true AS there FROM a UNION ALL SELECT 'sha256:none', false")
def artifact_get(spark, d):
    rows = _artifacts(spark, d).select("hash").distinct()
    asked = rows.unionAll(spark.range(1).select(F.lit("sha256:none").alias("hash")))
    return history.at_address(rows.withColumn("there", F.lit(True)), asked).select("hash", F.coalesce("there", F.lit(False)).alias("there"))


@query(f"SELECT doc_id, 'artifact_ref' AS kind, {_ADDRESS} AS address, 'text/plain' AS media FROM documents")
def artifact_reference(spark, d):
    made = history.reference(F.col("hash"), F.lit(None).cast("string"), F.lit("text/plain"))
    return _artifacts(spark, d).select("doc_id", made.alias("r")).select("doc_id", "r.kind", "r.address", F.col("r.mediaType").alias("media"))


@query("SELECT 'brand' AS kind, p_brand AS name, count(DISTINCT p_size)::BIGINT AS packages FROM part GROUP BY p_brand HAVING count(DISTINCT p_size) > 1 UNION ALL SELECT 'type', p_type, count(DISTINCT p_size) FROM part GROUP BY p_type HAVING count(DISTINCT p_size) > 1")
def audit_package_conflicts(spark, d):
    p = table(spark, d, "part")
    rows = p.select(F.col("p_size").alias("package"), F.lit("brand").alias("kind"), F.col("p_brand").alias("name")).unionAll(p.select("p_size", F.lit("type"), "p_type")).unionAll(p.select("p_size", F.lit("none"), "p_name"))
    return history.package_conflicts(rows, ("brand", "type"))


# --- more of graphs, rewrites, loops and ports ---------------------------------------------------------------------


@query(f"{_GRAPH} SELECT graph_id, src AS id, dst AS next, 'after' AS side FROM e WHERE src = 2 UNION ALL SELECT graph_id, dst, src, 'before' FROM e WHERE dst = 2")
def graph_neighbours(spark, d):
    v, e = conversation_graph(spark, d)
    of = v.where("id = 2")
    return graph.successors(e, of).withColumn("side", F.lit("after")).unionByName(graph.predecessors(e, of).withColumn("side", F.lit("before")))


@query(f"{_GRAPH} SELECT * FROM e WHERE dst - src <> 1")
def graph_remove_edges(spark, d):
    _, e = conversation_graph(spark, d)
    return graph.remove_edges(e, e.where("dst - src = 1"))


@query(f"{_GRAPH}, w AS (SELECT graph_id, id, 1 AS n FROM v WHERE id = 1 UNION ALL SELECT e.graph_id, e.dst, w.n + 1 FROM w JOIN e ON e.graph_id = w.graph_id AND e.src = w.id), {_LAST} SELECT w.graph_id, max(n)::BIGINT AS nodes FROM w JOIN o ON o.graph_id = w.graph_id AND o.id = w.id GROUP BY 1")
def graph_longest_path(spark, d):
    v, e = conversation_graph(spark, d)
    return _longs(graph.longest_path(v, e, v.where("id = 1"), _last_turns(v)), "nodes")


@query()
def graph_cycle_witness(spark, d):
    return graph.cycle_witness(*_with_cycles(spark, d))


@query(f"{_GRAPH} SELECT graph_id, (graph_id % 2 = 0 OR max(id) < 1) AND (max(id) < 3 OR graph_id % 4 > 0) AND (graph_id % 2 = 0 OR max(id) = 0) AS linear FROM v GROUP BY graph_id")
def graph_linear(spark, d):
    """Chains in even graphs (every fourth lacks an edge), all vertices loose in odd ones."""
    v, e = conversation_graph(spark, d)
    return graph.linear_graphs(v, e.where("dst = src + 1 and graph_id % 2 = 0 and not (graph_id % 4 = 0 and src = 2)"))


@query(f"{_GRAPH} SELECT graph_id, a.id AS src, b.id AS dst FROM v a JOIN v b USING (graph_id) WHERE a.id = 0 AND b.id > 0 UNION SELECT graph_id, a.id, b.id FROM v a JOIN v b USING (graph_id) WHERE a.id = 1 AND b.id = 2")
def graph_relation(spark, d):
    """0 before (1 before 2, beside all others)."""
    v, _ = conversation_graph(spark, d)
    at = lambda k: ("vertex", v.where(k))
    inner = ("overlay", ("connect", at("id = 1"), at("id = 2")), at("id > 2"))
    return graph.relation(("connect", at("id = 0"), inner), v.select("graph_id", "id"))[1].select("graph_id", "src", "dst")


@query(f"{_GRAPH} SELECT graph_id, id, 'orphan' AS fault FROM v WHERE id = 0 UNION ALL SELECT graph_id, 77, 'unknown_exit' FROM v WHERE id = 0 UNION ALL SELECT graph_id, 0, 'no_entry' FROM v WHERE id = 0 AND graph_id NOT IN (SELECT graph_id FROM v WHERE id = 1) UNION ALL SELECT graph_id, 0, 'loop' FROM v WHERE id = 0 AND graph_id % 2 = 0 UNION ALL SELECT graph_id, id, 'cycle' FROM v WHERE graph_id % 2 = 0")
def rewrite_faults(spark, d):
    """Sub-graphs entered at 1 and left at their last turn and at one that isn't there; even ones have a loop at 0."""
    v, e = conversation_graph(spark, d)
    zero, last = v.where("id = 0").select("graph_id", "id"), _last_turns(v)
    ends = last.unionAll(zero.select("graph_id", F.lit(77).cast("long").alias("id")))
    loops = zero.where("graph_id % 2 = 0").select("graph_id", F.col("id").alias("src"), F.col("id").alias("dst"))
    return rewrite.spec_faults(v, e.unionAll(loops), v.where("id = 1").select("graph_id", "id"), ends).select("graph_id", F.coalesce("id", F.lit(0).cast("long")).alias("id"), "fault")


@query(f"{_GRAPH} SELECT graph_id, id, status, 'kept' AS part FROM v WHERE id <> 1 UNION ALL SELECT graph_id, 100, 'pending', 'kept' FROM v WHERE id = 1 UNION ALL SELECT graph_id, 100, 'r7', 'new' FROM v WHERE id = 1")
def rewrite_materialise(spark, d):
    v, _ = conversation_graph(spark, d)
    gone = v.where("id = 1")
    kept, new = rewrite.materialised(v, gone, gone.select("graph_id", F.lit(100).cast("long").alias("id")).unionAll(v.where("id = 0").select("graph_id", "id")), "r7")
    return kept.withColumn("part", F.lit("kept")).unionByName(new.select("graph_id", "id", F.col("rewrite").alias("status"), F.lit("new").alias("part")))


@query(f"{_GRAPH} SELECT graph_id, id, CASE WHEN id % 2 = 0 THEN status ELSE 'pending' END AS status, NULL::VARCHAR AS fault FROM v UNION ALL SELECT graph_id, id + 1000, status, 'no_vertex' FROM v WHERE id % 2 = 0")
def rewrite_reconcile(spark, d):
    v, _ = conversation_graph(spark, d)
    even = v.where("id % 2 = 0").select("graph_id", "id", "status")
    return rewrite.reconciled(v, even.unionAll(even.withColumn("id", F.col("id") + 1000)))


@query("SELECT rewrite_id, graph_id, CASE WHEN rewrite_id <= 3000 THEN 'materialised' ELSE 'pending' END AS part FROM (SELECT o_orderkey AS rewrite_id, o_custkey AS graph_id FROM orders)")
def rewrite_replay(spark, d):
    return rewrite.replayed(table(spark, d, "orders").select(F.col("o_orderkey").alias("rewrite_id"), F.col("o_custkey").alias("graph_id")), 3000)


@query("""WITH s AS (SELECT user_id, event_id, row_number() OVER w AS n, coalesce(max((event_type = 'purchase')::INT) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ended FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
  SELECT user_id, event_id, greatest(0, 6 - n)::BIGINT AS remaining, n <= 6 AND ended = 0 AS admitted FROM s""")
def iter_control(spark, d):
    return _longs(rewrite.controlled(table(spark, d, "events"), 6, "user_id", "event_id", F.col("event_type") == "purchase"), "remaining")


@query("SELECT n_nationkey AS loop, p AS pass, l AS local, n_nationkey || ':iter_' || p || ':' || l AS id, CASE WHEN p + 1 < n_regionkey THEN n_nationkey || ':iter_' || (p + 1) || ':' || l END AS next FROM nation, (SELECT unnest(range(4))::BIGINT AS p), (SELECT unnest(['read', 'join']) AS l) WHERE p < n_regionkey")
def iter_self_append(spark, d):
    loops = table(spark, d, "nation").select(F.col("n_nationkey").alias("loop"), F.col("n_regionkey").cast("long").alias("passes"))
    return _longs(rewrite.self_appended(loops, spark.createDataFrame([("read",), ("join",)], "local string")), "pass")


@query("WITH k AS (SELECT DISTINCT n_nationkey AS sink, unnest(['R' || (n_nationkey % 7), 'R' || (n_nationkey % 3)]) AS contract FROM nation), n AS (SELECT k.sink, count(*) AS n FROM k JOIN nation s ON k.contract = 'R' || s.n_regionkey GROUP BY 1) SELECT n_nationkey AS sink, coalesce(n, 0)::BIGINT AS n, CASE WHEN coalesce(n, 0) = 0 THEN 'none' WHEN n = 1 THEN 'one' ELSE 'many' END AS fit FROM nation LEFT JOIN n ON sink = n_nationkey")
def flow_compatible(spark, d):
    n = table(spark, d, "nation")
    r = lambda x: F.concat(F.lit("R"), x.cast("string"))
    key = F.col("n_nationkey")
    return flow.compatible(n.select(key.alias("source"), r(F.col("n_regionkey")).alias("contract")), n.select(key.alias("sink"), F.array(r(key % 7), r(key % 3)).alias("accepts")))


@query("SELECT c_custkey AS node FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def flow_unused_nodes(spark, d):
    return flow.unused_nodes(table(spark, d, "customer").select(F.col("c_custkey").alias("node")), table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("node")))


@query("SELECT n_regionkey AS contract, string_agg(n_name, ',' ORDER BY n_nationkey) AS held FROM nation GROUP BY 1")
def flow_grouped_values(spark, d):
    rows = table(spark, d, "nation").select(F.col("n_regionkey").alias("contract"), "n_name", "n_nationkey")
    return flow.grouped_values(rows, "contract", "n_name", "n_nationkey").select("contract", F.array_join("held", ",").alias("held"))


@query(f"{_GRAPH} SELECT graph_id, id, CASE WHEN id % 2 = 0 THEN 'failed' ELSE 'pending' END AS status FROM v")
def state_facts(spark, d):
    """All vertices pending at first; of two facts about an even one the last counts."""
    v, _ = conversation_graph(spark, d)
    even = v.where("id % 2 = 0").select("graph_id", "id")
    facts = even.select("*", F.lit("running").alias("to"), F.lit(1).alias("seq")).unionAll(even.select("*", F.lit("failed"), F.lit(2)))
    return state.applied(state.initial(v), facts)


@query(f"{_GRAPH} SELECT graph_id, id, CASE status WHEN 'running' THEN 'pending' ELSE status END AS status FROM v")
def state_resume(spark, d):
    v, _ = conversation_graph(spark, d)
    return state.resumed(v).select("graph_id", "id", "status")


@query(f"{_GRAPH} SELECT graph_id, id, status, 'completed' AS to FROM v WHERE status <> 'running'")
def state_illegal_moves(spark, d):
    v, _ = conversation_graph(spark, d)
    return state.illegal_moves(v.select("graph_id", "id", F.lit("completed").alias("to")), v)


@query("SELECT event_id, CASE event_id % 4 WHEN 0 THEN event_type WHEN 1 THEN NULL WHEN 2 THEN NULL ELSE 's' END AS key, CASE event_id % 4 WHEN 3 THEN event_type ELSE '' END AS text FROM events")
def memory_extract(spark, d):
    """Keys under an envelope, keys that aren't texts, and the second name of a key."""
    kind, n = F.col("event_type"), F.col("event_id") % 4
    q = lambda x: F.concat(F.lit('"'), x, F.lit('"'))
    output = F.when(n == 0, F.concat(F.lit('{"value":{"routingKey":'), q(kind), F.lit("}}"))).when(n == 1, '{"routingKey":5,"slot":"s"}').when(n == 2, "{}").otherwise(F.concat(F.lit('{"slot":"s","body":'), q(kind), F.lit("}")))
    key, text = memory.extracted(output)
    return table(spark, d, "events").select("event_id", key.alias("key"), text.alias("text"))


@query("""SELECT event_id, CASE event_id % 4 WHEN 1 THEN 'TYPE' WHEN 2 THEN 'MISSING' END AS code, CASE event_id % 4 WHEN 1 THEN '$.n' WHEN 2 THEN '$.a.b' END AS path FROM events""")
def contract_odd_values(spark, d):
    """Whole numbers of any size and names with a dot."""
    schema = {"type": "object", "required": ["a.b"], "properties": {"n": {"type": "integer"}}}
    n = F.col("event_id") % 4
    payload = F.when(n == 0, '{"a.b":1,"n":123456789012345678901234567890}').when(n == 1, '{"a.b":1,"n":2.5}').when(n == 2, '{"a":{"b":1}}').otherwise('{"a.b":1,"n":3.0}')
    found = contracts.validated(payload, schema)
    return table(spark, d, "events").select("event_id", found.alias("f")).select("event_id", F.col("f.code").alias("code"), F.col("f.path").alias("path"))


@query("SELECT event_id, '[null,true,' || event_id || ',\"a\",[1],{\"k\":1}]' AS sorted FROM events")
def expr_total_order(spark, d):
    """Values of all types in one order."""
    text = F.concat(F.lit('[{"k":1},[1],"a",'), F.col("event_id").cast("string"), F.lit(",true,null]"))
    items = F.variant_get(F.parse_json(text), "$", "array<variant>")
    return table(spark, d, "events").select("event_id", F.to_json(B.sort_any(items)).alias("sorted"))


@query(f"WITH {_ARRAYS} SELECT l_orderkey, array_to_string(list_transform(xs, lambda x, i: (i - 1) || '=' || x), ';') AS numbered, array_to_string(list_transform(range(1, len(xs)), lambda i: xs[i] || '-' || xs[i + 1]), ';') AS paired FROM a")
def expr_zip_enumerate(spark, d):
    xs = F.col("xs")
    numbered = F.transform(B.enumerate_(xs), lambda e: B.concat(F.array(e["index"].cast("string"), F.lit("="), B.to_string(e["value"]))))
    paired = F.transform(B.zip_(xs, B.drop(1, xs)), lambda e: B.concat(F.array(B.to_string(e["fst"]), F.lit("-"), B.to_string(e["snd"]))))
    return _order_arrays(spark, d).select("l_orderkey", F.array_join(numbered, ";").alias("numbered"), F.array_join(paired, ";").alias("paired"))
