import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from dagframe.operators import graph, memory, rewrite, state
from dagframe.operators.memory import clamp01, jaccard, temporal
from pyspark.sql import functions as F


def made(spark, pairs, vertices=()):
    ids = sorted({x for p in pairs for x in p} | set(vertices))
    return spark.createDataFrame([(0, i) for i in ids], "graph_id long, id long"), spark.createDataFrame([(0, a, b) for a, b in pairs], "graph_id long, src long, dst long")


def origin(spark, i):
    return spark.createDataFrame([(0, i)], "graph_id long, id long")


@pytest.mark.parametrize(
    ("pairs", "expected"),
    [([(1, 2), (2, 3)], {1: 1, 2: 0.85, 3: 0.7225}), ([(1, 2), (1, 3)], {1: 1, 2: 0.425, 3: 0.425}), ([(1, 2), (1, 3), (2, 4), (3, 4)], {1: 1, 2: 0.425, 3: 0.425, 4: 0.7225}), ([(1, 2), (2, 1)], {})],
)
def test_influence(spark, pairs, expected):
    got = {r.id: round(r.mass, 9) for r in graph.influence(*made(spark, pairs), origin(spark, 1)).collect()}
    assert got == pytest.approx(expected)


@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.sets(st.tuples(st.integers(0, 5), st.integers(0, 5)), max_size=9))
def test_components_against_reachability(spark, pairs):
    v, e = made(spark, pairs, [0])
    ids = [r.id for r in v.collect()]
    reach = {i: {i} for i in ids}
    for _ in ids:
        for a, b in pairs:
            for i in ids:
                if a in reach[i]:
                    reach[i].add(b)
    expected = {i: min(j for j in ids if j in reach[i] and i in reach[j]) for i in ids}
    assert {r.id: r.component for r in graph.scc(v, e).collect()} == expected


def test_levels_leave_cycles_out(spark):
    v, e = made(spark, [(0, 1), (1, 2), (2, 1), (2, 3)])
    assert {r.id: r.level for r in graph.levels(v, e).collect()} == {0: 1}
    assert graph.cyclic_graphs(v, e).first().unsorted == 3


def test_cycles_of_every_conversation(spark):
    from dagframe.plans.catalog import QUERIES
    from dagframe.sources.tables import conversation_graph

    folder = "/root/testdata/sf0.001"
    v, e = conversation_graph(spark, folder)
    following = {(r.graph_id, r.id): set() for r in v.collect()}
    for r in e.collect():
        following[r.graph_id, r.src].add(r.dst)
    for g, i in following:
        if i >= 2 and i % 2 == 0 and g % 10 > 0:
            following[g, i].add(i - 2)
    reach = {}
    for g, i in following:
        todo, seen = list(following[g, i]), set()
        while todo:
            k = todo.pop()
            if k not in seen:
                seen.add(k)
                todo += following[g, k]
        reach[g, i] = seen
    scc = {(g, i): min([i, *(j for j in seen if i in reach[g, j])]) for (g, i), seen in reach.items()}
    cyclic = {}
    for g, i in {(g, i) for g, i in reach if i in reach[g, i]} | {(g, j) for (g, i), seen in reach.items() if i in seen for j in seen}:
        cyclic[g] = cyclic.get(g, 0) + 1
    assert {(r.graph_id, r.id): r.component for r in QUERIES["graph_scc"](spark, folder).collect()} == scc
    assert {r.graph_id: r.unsorted for r in QUERIES["graph_cycle_detect"](spark, folder).collect()} == cyclic
    found = {r.graph_id: r.cycle for r in QUERIES["graph_cycle_witness"](spark, folder).collect()}
    assert set(found) == set(cyclic)
    assert all(len(c) > 1 and c[0] == c[-1] and all(b in following[g, a] for a, b in zip(c, c[1:])) for g, c in found.items())


def test_bidirectional_bridge(spark):
    v, e = made(spark, [(1, 2), (3, 2)])
    assert [r.id for r in memory.walk(v, e, origin(spark, 1), "bidirectional").collect()] == [2]


def test_scores(spark):
    row = spark.range(1).select(clamp01(F.lit(float("nan"))).alias("nan"), jaccard(F.lit("rain, on a roof"), F.lit("A roof; on rain")).alias("same"), jaccard(F.lit(""), F.lit("")).alias("none"), temporal(F.lit(3600)).alias("hour"), temporal(F.lit(-5)).alias("ahead")).first()
    assert row.asDict() == {"nan": 0.0, "same": 1.0, "none": 0.0, "hour": 0.5, "ahead": 1.0}


def test_states(spark):
    v = spark.createDataFrame([(0, 1, "completed"), (0, 2, "pending"), (0, 3, "pending"), (1, 1, "failed"), (1, 2, "waiting")], "graph_id long, id long, status string")
    e = spark.createDataFrame([(0, 1, 2), (0, 2, 3), (1, 1, 2)], "graph_id long, src long, dst long")
    assert [(r.graph_id, r.id) for r in state.ready(v, e).collect()] == [(0, 2)]
    assert {r.graph_id: r.state for r in state.classified(v, e).collect()} == {0: "progressing", 1: "failed"}
    assert {(r.graph_id, r.id): r.status for r in state.propagated(v, e).collect()}[1, 2] == "failed"
    facts = spark.createDataFrame([(0, 1, "running"), (0, 2, "running")], "graph_id long, id long, to string")
    assert [r.id for r in state.illegal_moves(facts, v).collect()] == [1]


def test_rewrites_and_emissions(spark):
    _, e = made(spark, [(1, 2), (2, 3)])
    end = lambda i: origin(spark, i)
    inner = spark.createDataFrame([(0, 10, 11)], "graph_id long, src long, dst long")
    edges = lambda kind: {(r.src, r.dst) for r in rewrite.rewritten(e, end(2), inner, end(10), end(11), kind).collect()}
    assert edges("replace") == {(1, 10), (10, 11), (11, 3)}
    assert edges("append") == {(1, 2), (2, 10), (10, 11), (11, 3)}
    rows = spark.createDataFrame([(1, 0, "a"), (1, 1, "b"), (1, 2, "c")], "k int, i int, v string")
    assert rewrite.emitted(rows, "k", "i", "v", "accumulate", 2).first().asDict() == {"k": 1, "emitted": 3, "kept": ["a", "b"]}
    assert rewrite.emitted(rows, "k", "i", "v", "reduce_last").first().kept == "c"


def plain_order(pairs, roots, kind, h=None, most=None):
    """A search over a list, the next one picked by a look at all of it."""
    front, seen, out = [(r, 0) for r in sorted(roots)], set(), []
    while front and (most is None or len(out) < most):
        by = {"bfs": lambda: 0, "dfs": lambda: len(front) - 1, "pfs": lambda: min(range(len(front)), key=lambda k: (h(front[k][0]), front[k])), "max": lambda: min(range(len(front)), key=lambda k: (-h(front[k][0]), front[k]))}
        v, depth = front.pop(by[kind]())
        if v not in seen:
            seen.add(v)
            out.append((v, depth))
            front += [(d, depth + 1) for s, d in sorted(pairs) if s == v]
    return out


@pytest.mark.parametrize("kind", ["bfs", "dfs", "pfs", "max"])
def test_visit_orders(spark, kind):
    pairs = [(0, 3), (0, 1), (3, 2), (1, 2), (2, 4), (1, 5), (5, 0)]
    v, e = made(spark, pairs)
    h = lambda x: (x * 5) % 7
    priority = spark.createDataFrame([(0, i, float(h(i))) for i in range(6)], "graph_id long, id long, h double")
    for most in (None, 3):
        got = sorted(graph.visit_order(e, origin(spark, 0), kind, most, priority).collect(), key=lambda r: r.place)
        assert [(r.id, r.depth) for r in got] == plain_order(pairs, [0], kind, h, most)


def test_long_chains(spark):
    n = 12
    v, e = made(spark, [(k, k + 1) for k in range(n)])
    found = graph.levels(v, e)
    assert {r.id: r.level for r in found.collect()} == {k: k + 1 for k in range(n + 1)}
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Relation") == 1  # one scan however many levels
    mass = {r.id: r.mass for r in graph.influence(v, e, origin(spark, 0)).collect()}
    assert mass == pytest.approx({k: 0.85**k for k in range(n + 1)})


def test_budgets_skip_what_they_refuse(spark):
    rows = [(0, 1, 99, "gassed"), (0, 2, 1, "gassed"), (0, 3, 99, "external"), (0, 4, 16, "gassed"), (0, 5, 15, "gassed")]
    got = {r.rewrite_id: (r.nodes_left, r.exceeded) for r in rewrite.admitted(spark.createDataFrame(rows, "graph_id long, rewrite_id long, nodes long, mode string")).collect()}
    assert got == {1: (16, "nodes"), 2: (15, None), 3: (15, None), 4: (15, "nodes"), 5: (0, None)}


def test_costs(spark):
    _, old = made(spark, [(1, 2)])
    _, new = made(spark, [(1, 2), (2, 3), (2, 4), (2, 5)])
    row = rewrite.cost(old, new).first()
    assert (row.nodes, row.edges, row.depth, row.frontier, row.ops) == (3, 3, 1, 2, 1)


def test_envelope_rewrite(spark):
    _, e = made(spark, [(1, 2), (2, 3)])
    inner = spark.createDataFrame([(0, 10, 11)], "graph_id long, src long, dst long")
    got = {(r.src, r.dst) for r in rewrite.rewritten(e, origin(spark, 2), inner, origin(spark, 10), origin(spark, 11), "envelope").collect()}
    assert got == {(1, 2), (2, 10), (10, 11), (11, 3)}
    assert spark.range(1).select(rewrite.namespaced(F.lit("p"), F.lit("x")).alias("n")).first().n == "p:x"
