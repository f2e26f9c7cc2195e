"""Run state of graphs: vertices (graph_id, id, status) and edges. Readiness, failure, classification, waves, recovery."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dagframe.operators import graph
from dagframe.sources.tables import written

DONE = ("completed", "skipped", "rewritten")
ON = ["graph_id", "id"]
#: Legal moves.
MOVES = (("pending", "running"), ("running", "completed"), ("running", "failed"), ("running", "interrupted"), ("running", "waiting"), ("running", "rewritten"), ("waiting", "pending"))


def ready(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """Pending vertices whose predecessors are all done."""
    open_ = vertices.where(~F.col("status").isin(*DONE)).select("graph_id", F.col("id").alias("src"))
    held = edges.join(open_, ["graph_id", "src"]).select("graph_id", F.col("dst").alias("id"))
    return vertices.where("status = 'pending'").join(held, ON, "left_anti").select(*ON)


def initial(vertices: DataFrame) -> DataFrame:
    """Every vertex pending."""
    return vertices.select(*ON, F.lit("pending").alias("status")).distinct()


def illegal_moves(facts: DataFrame, vertices: DataFrame) -> DataFrame:
    """Of (graph_id, id, to): those that the vertex's status doesn't allow."""
    legal = facts.sparkSession.createDataFrame(list(MOVES), "status string, to string")
    return facts.join(vertices.select(*ON, "status"), ON).join(F.broadcast(legal), ["status", "to"], "left_anti").select(*ON, "status", "to")


def applied(vertices: DataFrame, facts: DataFrame) -> DataFrame:
    """Statuses after facts (graph_id, id, to, and seq where several may be about one vertex: the last one counts)."""
    order = F.col("seq") if "seq" in facts.columns else F.lit(0)
    last = facts.groupBy(*ON).agg(F.max(F.struct(order.alias("seq"), "to"))["to"].alias("to"))
    return vertices.join(last, ON, "left").select(*ON, F.coalesce("to", "status").alias("status"))


def propagated(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """Pending and waiting descendants of failed vertices fail; the way there goes through any status."""
    reached = graph.bfs_distance(edges, vertices.where("status = 'failed'")).select(*ON).withColumn("hit", F.lit(True))
    hit = F.coalesce("hit", F.lit(False)) & F.col("status").isin("pending", "waiting")
    return vertices.join(reached, ON, "left").select(*ON, F.when(hit, F.lit("failed")).otherwise(F.col("status")).alias("status"))


def classified(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """A state for each graph."""
    front = ready(vertices, edges).withColumn("go", F.lit(1))
    all_ = vertices.select(*ON, "status").join(front, ON, "left").groupBy("graph_id").agg(
        F.count_if(F.col("status") == "failed").alias("failed"), F.count("go").alias("ready"),
        F.count_if(F.col("status").isin(*DONE)).alias("done"), F.count_if(F.col("status") == "waiting").alias("waiting"), F.count("*").alias("n"),
    )
    kind = F.when(F.col("failed") > 0, "failed").when(F.col("ready") > 0, "progressing").when(F.col("done") == F.col("n"), "completed").when(F.col("waiting") > 0, "suspended").otherwise("stuck")
    return all_.select("graph_id", kind.alias("state"), "ready")


def blocked(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """Why pending vertices wait: failed predecessors, else those not done, else unknown."""
    before = edges.join(vertices.select("graph_id", F.col("id").alias("src"), F.col("status").alias("was")), ["graph_id", "src"])
    sums = before.groupBy("graph_id", F.col("dst").alias("id")).agg(F.count_if(F.col("was") == "failed").alias("failed"), F.count_if(~F.col("was").isin(*DONE)).alias("open"))
    rest = vertices.where("status = 'pending'").select(*ON).join(ready(vertices, edges), ON, "left_anti").join(sums, ON, "left")
    reason = F.when(F.col("failed") > 0, "failed").when(F.col("open") > 0, "waits").otherwise("unknown")
    return rest.select(*ON, reason.alias("reason"), F.coalesce(F.when(F.col("failed") > 0, F.col("failed")).otherwise(F.col("open")), F.lit(0)).alias("by"))


def simulated(vertices: DataFrame, edges: DataFrame, outcome: Column, most_waves: int | None = None) -> DataFrame:
    """(graph_id, id, status, wave) after running ready vertices wave by wave, until none is ready or after `most_waves`; `outcome` names what a vertex comes to."""
    edges = written(edges.select(*graph.EDGE), "wave-edges")
    now = written(vertices.select(*ON, "status", F.lit(0).alias("wave")), "wave")
    wave = 0
    while most_waves is None or wave < most_waves:
        wave += 1
        front = written(ready(now, edges).withColumn("to", outcome), "front")
        if front.isEmpty():
            break
        now = written(now.join(front, ON, "left").select(*ON, F.coalesce("to", "status").alias("status"), F.when(F.col("to").isNotNull(), wave).otherwise(F.col("wave")).alias("wave")), "wave")
    return now


def resumed(vertices: DataFrame) -> DataFrame:
    """After a restart, what was running or interrupted is pending."""
    return vertices.withColumn("status", F.when(F.col("status").isin("running", "interrupted"), "pending").otherwise(F.col("status")))


def recovery_faults(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """What keeps a stored state from being resumed, with a kind each."""
    known = ("pending", "running", "completed", "failed", "skipped", "interrupted", "rewritten", "waiting")
    bad = vertices.where(~F.col("status").isin(*known)).select(*ON, F.lit("unknown_status").alias("fault"))
    missing = edges.select("graph_id", F.explode(F.array("src", "dst")).alias("id")).distinct().join(vertices, ON, "left_anti").select(*ON, F.lit("missing_vertex").alias("fault"))
    twice = vertices.groupBy(*ON).count().where("count > 1").select(*ON, F.lit("duplicate_vertex").alias("fault"))
    early = edges.join(vertices.where(~F.col("status").isin(*DONE)).select("graph_id", F.col("id").alias("src")), ["graph_id", "src"]).select("graph_id", F.col("dst").alias("id")).distinct()
    early = early.join(vertices.where("status = 'completed'"), ON, "left_semi").select(*ON, F.lit("done_too_early").alias("fault"))
    silent = vertices.where("status = 'completed' and output is null").select(*ON, F.lit("no_output").alias("fault")) if "output" in vertices.columns else bad.limit(0)
    return bad.unionByName(missing).unionByName(twice).unionByName(early).unionByName(silent)


def inputs(vertices: DataFrame, edges: DataFrame, default: str = "") -> DataFrame:
    """Predecessors' outputs of each vertex, as a map by id; roots get the default under -1."""
    outputs = vertices.select("graph_id", F.col("id").alias("src"), "output")
    made = edges.join(outputs, ["graph_id", "src"]).groupBy("graph_id", F.col("dst").alias("id")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("src", "output")))).alias("inputs"))
    return vertices.select(*ON).join(made, ON, "left").select(*ON, F.coalesce("inputs", F.create_map(F.lit(-1).cast("long"), F.lit(default))).alias("inputs"))


def retry_delay(base_seconds: Column, attempt: Column, exponential: bool = True) -> Column:
    factor = F.pow(F.lit(2.0), F.least(F.lit(30), attempt - 1)) if exponential else F.lit(1.0)
    return F.least(F.lit(300.0), base_seconds * factor)
