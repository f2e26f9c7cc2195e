import importlib
import sys

import pytest
from pyspark.sql import functions as F

from dagframe.operators import contracts, histogram, history
from dagframe.plans import flow

SEARCH = {
    "type": "object", "additionalProperties": False, "required": ["query", "filters", "tags"],
    "properties": {
        "query": {"type": "string", "minLength": 1, "maxLength": 40}, "limit": {"type": "integer", "minimum": 1, "maximum": 100}, "category": {"enum": ["news", "filings"]},
        "filters": {"type": "object", "required": ["region"], "properties": {"region": {"type": "string"}}}, "tags": {"type": "array", "items": {"type": "string", "minLength": 1}},
    },
}


@pytest.mark.parametrize(
    ("payload", "expected"),
    [
        ('{"query":"a","filters":{"region":"eu"},"tags":["x"],"limit":2.0}', None),
        ('{"query":"a","filters":{},"tags":["x"]}', ("MISSING", "$.filters.region")),
        ('{"query":"a","filters":{"region":"eu"},"tags":["x"],"private":1}', ("UNEXPECTED", "$.private")),
        ('{"query":"a","category":"blog","filters":{"region":"eu"},"tags":["x"]}', ("ENUM", "$.category")),
        ('{"query":"a","filters":{"region":"eu"},"tags":["x",""]}', ("TOO_SHORT", "$.tags[1]")),
        ('{"query":1,"filters":{"region":"eu"},"tags":[]}', ("TYPE", "$.query")),
        ("{", ("JSON_PARSE", "$")),
    ],
)
def test_contracts(spark, payload, expected):
    got = spark.createDataFrame([(payload,)], "p string").select(contracts.validated(F.col("p"), SEARCH).alias("e")).first().e
    assert (tuple(got) if got else None) == expected


def test_histograms(spark):
    shots = spark.createDataFrame([([0, 1],), ([1, 0],)], "b array<int>")
    h = histogram.decoded(shots, "b", [0, 1])
    assert {r.bits: r.n for r in h.collect()} == {"01": 1, "10": 1}
    assert {r.bits: r.n for r in histogram.dense(h, 2).collect()} == {"00": 0, "01": 1, "10": 1, "11": 0}
    assert {r.label for r in histogram.labelled(h, ["a", "b"]).collect()} == {"a=1,b=0", "a=0,b=1"}


def test_flows():
    r = flow.Registry(contracts={"C": {}}, executors={"same": lambda x: x})
    a, b = r.node("a", {"x": "C"}, {"y": "C"}, "same"), r.node("b", {"y": "C"}, {"z": "C"}, "same")
    assert [p[0] for _, p in (a >> b).entries] == ["x"] and [p[0] for _, p in (a >> b).exits] == ["z"]
    with pytest.raises(flow.FlowError, match="twice"):
        a | a
    with pytest.raises(flow.FlowError, match="ambiguous"):
        (a | r.node("c", {"w": "C"}, {"y": "C"}, "same")) >> b
    with pytest.raises(flow.FlowError, match="unknown contract"):
        r.node("d", {"x": "D"}, {}, "same")
    with pytest.raises(flow.FlowError, match="not connected"):
        (a | r.node("e", {"q": "C"}, {"v": "C"}, "same")).checked()


def test_flows_with_several_exits(spark):
    r = flow.Registry(contracts={"C": {}})
    one = lambda k: lambda x: {"y": x[f"x{k}"].withColumn("by", F.lit(k))}
    both = r.node("a", {"x0": "C"}, {"y": "C", }, one(0)) | r.node("b", {"x1": "C"}, {"y": "C"}, one(1))
    split = r.node("s", {"rows": "C"}, {"x0": "C", "x1": "C"}, lambda x: {"x0": x["rows"], "x1": x["rows"]})
    assert (split >> both).run(rows=spark.range(1))["y"].first().by == 0  # the leftmost of them
    assert [f.nodes[0].name for f in flow.family(2, lambda k: r.node(f"n{k}", {"x": "C"}, {"z": "C"}, one(0)))] == ["n0", "n1"]
    with pytest.raises(flow.FlowError, match="are both"):
        flow.make_each({"a b": 1, "a-b": 2}, lambda label, item: r.node(label, {"x": "C"}, {"z": "C"}, one(0)))
    assert flow.make_each({"9 x": 1}, lambda label, item: r.node(label, {"x": "C"}, {"z": "C"}, one(0))).nodes[0].name == "item_9_x"


def test_rows_of_no_arm_fail(spark):
    df = spark.createDataFrame([("F",), ("Q",), (None,)], "tag string")
    arms = {"F": lambda x: x.select(F.lit(1).alias("n")), "Q": lambda x: x.select(F.lit(2).alias("n"))}
    assert sorted(r.n for r in flow.selected(df.where("tag is not null"), F.col("tag"), arms).collect()) == [1, 2]
    for bad in (df, df.withColumn("tag", F.lit("Z"))):
        with pytest.raises(Exception, match="no arm"):
            flow.selected(bad, F.col("tag"), arms).collect()


def test_envelopes(spark):
    e = contracts.envelope("c", F.lit(5))
    row = spark.range(1).select(contracts.unwrapped(e).alias("one"), contracts.unwrapped(e, e).alias("two"), contracts.egress({"a": ("c", F.lit(1))}).alias("out"), contracts.egress({"a": ("c", F.lit(1)), "b": ("c", F.lit(2))}, "b").alias("chosen")).first()
    assert row.one == 5 and row.two == [5, 5] and row.out.port == "a" and row.chosen.value == 2
    with pytest.raises(contracts.MalformedSchema):
        contracts.egress({"a": ("c", F.lit(1)), "b": ("c", F.lit(2))}, variant=True)
    bad = contracts.invalid_examples(spark, {"c": ({"type": "integer"}, [1, "x", 2.0])}).collect()
    assert [(r.contract, r.number, r.code) for r in bad] == [("c", 1, "TYPE")]


def test_lines_files_and_manifests(spark, tmp_path):
    import io

    from dagframe.sources import tables

    assert [r.line for r in tables.from_lines(spark, io.StringIO("a\nb\n")).collect()] == ["a", "b"]
    out = io.StringIO()
    tables.to_console(spark.createDataFrame([("x",)], "t string"), "t", out, 5)
    tables.to_console(spark.range(1).select(F.struct(F.lit(1).alias("k")).alias("r")), "r", out, 5, newline=False)
    assert out.getvalue() == 'x\n{\n  "k": 1\n}'
    tables.write_text(spark.createDataFrame([("one\ntwo",)], "text string"), str(tmp_path / "out"))
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "b c.txt").write_text("hello\nworld")
    assert [r.text for r in tables.whole_files(spark, str(tmp_path / "in")).collect()] == ["hello\nworld"]
    row = tables.listing(spark, str(tmp_path / "in")).first()
    assert (row.name, row.stem, row.extension, row.label) == ("b c.txt", "b c", "txt", "b_c")
    assert tables.included_text(str(tmp_path / "in" / "b c.txt")) == "hello\nworld"
    assert tables.manifest('[contracts]\nA = "a.json"')["contracts"] == {"A": "a.json"}
    spark.range(1).createOrReplaceTempView("there")
    lacking = tables.drift(spark, spark.createDataFrame([("there", "id"), ("there", "x")], "table string, column string"))
    assert [r.column for r in lacking.collect()] == ["x"]


def test_signals_once(spark):
    from dagframe.streaming import signals

    rows = spark.createDataFrame([(1, "go", "2024-01-01"), (1, "go", "2024-01-02"), (1, "sys.x", "2024-01-01"), (2, "go", "2024-01-01")], "user_id long, event_type string, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    assert sorted((r.run_id, r.name) for r in signals.delivered(rows).collect()) == [(1, "go"), (2, "go")]


def test_addresses_escape(spark):
    at = lambda c: history.address(F.lit(c), F.lit("json"), F.lit("a/b"), F.lit("1"))
    row = spark.range(1).select(at('x","mediaType":"y').alias("a"), at("x").alias("b")).first()
    assert row.a != row.b
    shots = spark.createDataFrame([([1, 2], {"0": 5}), (None, {"0": 5, "1": 2}), (None, None)], "r array<int>, c map<string,long>")
    assert [r.n for r in shots.select(histogram.shots_seen(F.col("r"), F.col("c")).alias("n")).collect()] == [2, 7, 0]


def test_masking_and_addresses(spark):
    row = spark.range(1).select(history.masked(F.lit("arn:aws:x:123456789012:y")).alias("m"), history.address(F.lit(None).cast("string"), F.lit("json"), F.lit("a/b"), F.lit("1")).alias("h")).first()
    assert row.m == "arn:aws:x:***:y" and row.h.startswith("sha256:")


def test_streams_equal_batches(spark):
    from dagframe.streaming import signals

    folder = "/root/testdata/sf0.001"
    batch = spark.read.parquet(f"{folder}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    counts = signals.drained(signals.windowed(signals.event_stream(spark, folder), late="0 seconds"), "windows", "append")
    whole = {(r.start, r.event_type): r.n for r in signals.windowed(batch).collect()}
    got = {(r.start, r.event_type): r.n for r in counts.collect()}
    assert got and all(whole[k] == n for k, n in got.items())


def test_entry_without_the_other_folder(monkeypatch):
    find = importlib.util.find_spec
    monkeypatch.setattr(importlib.util, "find_spec", lambda name, *a: None if name in ("dagframe.llm", "corpus_pipeline") else find(name, *a))
    sys.modules.pop("__spark_entry__", None)
    entry = importlib.import_module("__spark_entry__")
    assert not any(q.startswith("op") for q in entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
    sys.modules.pop("__spark_entry__", None)


def test_every_query_has_a_plan(spark):
    """Plans of those that are one lazy frame; the others run in the query check."""
    from dagframe.plans.catalog import QUERIES

    for name, f in QUERIES.items():
        if name.split("_")[0] in ("expr", "contract", "hist", "flow", "audit", "ext", "iter"):
            assert f(spark, "/root/testdata/sf0.001").columns, name
