"""Run history: decisions and listings over tables of runs, tasks, stages, attempts, events, signals and artifacts.

A statement that changes a store is here the frame of rows that it would write. Ties are broken, so that reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FINAL = ("completed", "failed", "cancelled", "timed_out")


def _one(rows: DataFrame, key: str, order: tuple[str, ...], pick) -> DataFrame:
    """One row a key by an aggregate that combines before the shuffle. Columns that the order doesn't name settle ties, as they come."""
    rest = [c for c in rows.columns if c != key and c not in order]
    held = rows.groupBy(key).agg(pick(F.struct(*(F.col(f"`{c}`") for c in (*order, *rest)))).alias("_row"))
    return held.select(*(F.col(key) if c == key else F.col("_row")[c].alias(c) for c in rows.columns))


def latest(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """One row a key, the greatest in the order."""
    return _one(rows, key, order, F.max)


def earliest(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """One row a key, the least in the order."""
    return _one(rows, key, order, F.min)


def fairness(kind: Column, last_kind: str | None) -> Column:
    return F.when(kind == last_kind, 1).otherwise(0) if last_kind else F.lit(0)


def due_tasks(tasks: DataFrame, now: Column, last_kind: str | None = None, limit: int = 1) -> DataFrame:
    due = tasks.where("enabled").where(F.col("next_run_at") <= now)
    return due.orderBy(F.desc("priority"), fairness(F.col("task_type"), last_kind), "next_run_at", "task_id").limit(limit)


def claim_order(runs: DataFrame, tasks: DataFrame, last_kind: str | None = None, capped: tuple[str, ...] = (), limit: int = 1) -> DataFrame:
    """Pending runs in the order of claiming, without types at their cap. One writer claims; there are no row locks."""
    joined = runs.where("status = 'pending'").join(tasks, "task_id").where(~F.col("task_type").isin(*capped) if capped else F.lit(True))
    return joined.orderBy(F.desc("priority"), fairness(F.col("task_type"), last_kind), "created_at", "run_id").limit(limit)


def types_at_cap(runs: DataFrame, tasks: DataFrame, caps: DataFrame) -> DataFrame:
    live = runs.where("status = 'running'").join(tasks, "task_id").groupBy("task_type").agg(F.count("*").alias("running"))
    return live.join(caps, "task_type").where("running >= cap")


def insertable(new: DataFrame, runs: DataFrame) -> DataFrame:
    """New runs of tasks that have no open one."""
    return new.join(runs.where(~F.col("status").isin(*FINAL)), "task_id", "left_anti")


def open_run_violations(runs: DataFrame) -> DataFrame:
    return runs.where(~F.col("status").isin(*FINAL)).groupBy("task_id").agg(F.count("*").alias("open_runs")).where("open_runs > 1")


def finished(runs: DataFrame, facts: DataFrame) -> DataFrame:
    """Runs after facts (run_id, to); a final status stays."""
    keep = F.col("status").isin(*FINAL) | F.col("to").isNull()
    return runs.join(facts, "run_id", "left").withColumn("status", F.when(keep, F.col("status")).otherwise(F.col("to"))).drop("to")


def admin_view(runs: DataFrame, tasks: DataFrame, stages: DataFrame) -> DataFrame:
    """Each run with its task, its latest stage and how many it has."""
    last = stages.groupBy("run_id").agg(F.max(F.struct("started_at", "stage_no", "state")).alias("last"), F.count("*").alias("stages"))
    out = runs.join(tasks.select("task_id", "task_type", "priority"), "task_id").join(last, "run_id", "left")
    return out.select("run_id", "task_id", "task_type", "priority", "status", F.col("last.stage_no").alias("last_stage"), F.col("last.state").alias("last_state"), F.coalesce("stages", F.lit(0)).alias("stages"))


def next_attempt(attempts: DataFrame, key: str) -> DataFrame:
    return attempts.groupBy(key).agg((F.coalesce(F.max("attempt"), F.lit(0)) + 1).alias("next_attempt"))


def expired(runs: DataFrame, now: Column, owner: str | None = None) -> DataFrame:
    """Running runs whose lease ran out, but for those of this owner."""
    return runs.where("status = 'running'").where(F.col("lease_until") < now).where(~F.col("lease_owner").eqNullSafe(F.lit(owner)))


def backpressure(runs: DataFrame, now: Column) -> DataFrame:
    return runs.agg(F.count_if(F.col("status") == "pending").alias("pending"), F.count_if(F.col("status") == "running").alias("running"), F.max(F.when(F.col("status") == "pending", F.unix_timestamp(now) - F.unix_timestamp("created_at"))).alias("oldest_s"))


def cooled(runs: DataFrame, least_seconds: int) -> DataFrame:
    """Runs that came too soon after the one before of their task."""
    w = Window.partitionBy("task_id").orderBy("created_at", "run_id")
    gap = F.unix_timestamp("created_at") - F.unix_timestamp(F.lag("created_at").over(w))
    return runs.withColumn("gap_s", gap).where(F.col("gap_s") < least_seconds)


def settled_signals(waits: DataFrame, delivered: DataFrame) -> DataFrame:
    """Of waits (run_id, name): resolved where a signal is there already, invalid for a repeated wait, else parked."""
    w = Window.partitionBy("run_id", "name").orderBy("wait_id")
    first = delivered.groupBy("run_id", "name").agg(F.min("at").alias("at"))
    out = waits.withColumn("_n", F.row_number().over(w)).join(first, ["run_id", "name"], "left")
    return out.select("wait_id", "run_id", "name", F.when(F.col("_n") > 1, "invalid").when(F.col("at").isNotNull(), "resolved").otherwise("parked").alias("settled"))


def fan_out(ended: DataFrame, waits: DataFrame) -> DataFrame:
    """Waiters of each run that ended."""
    return waits.join(ended.select(F.col("run_id").alias("waits_for")).distinct(), "waits_for", "left_semi")


def swapped(state: DataFrame, writes: DataFrame) -> DataFrame:
    """Compare and swap by revision: each write with whether it takes effect. Of equal writes to a run, the first does."""
    w = Window.partitionBy("run_id").orderBy("write_id")
    out = writes.withColumn("_n", F.row_number().over(w)).join(state.select("run_id", "revision"), "run_id", "left")
    return out.select("write_id", "run_id", ((F.col("expected") == F.col("revision")) & (F.col("_n") == 1)).alias("won"))


def address(contract: Column, kind: Column, media: Column, value: Column) -> Column:
    """Content address: SHA-256 of the JSON of what describes the content, its strings escaped; a null contract is written out; `value`
    is a canonical JSON text."""
    head = F.to_json(F.struct(contract.alias("contract"), media.alias("mediaType"), kind.alias("payloadKind")), {"ignoreNullFields": "false"})
    body = F.concat(F.left(head, F.length(head) - 1), F.lit(',"value":'), value, F.lit("}"))
    return F.concat(F.lit("sha256:"), F.sha2(body, 256))


def stored_artifacts(rows: DataFrame, known: DataFrame) -> DataFrame:
    """Contents to add: each address once, without those that are there."""
    return rows.dropDuplicates(["hash"]).join(known, "hash", "left_anti")


def listed_artifacts(provenance: DataFrame, contents: DataFrame, run: str) -> DataFrame:
    """How often each run made each content that is there."""
    return provenance.join(contents.select("hash").distinct(), "hash").groupBy(run, "hash").agg(F.count("*").alias("n"))


def at_address(contents: DataFrame, asked: DataFrame) -> DataFrame:
    """Contents by address; an address that isn't there gives a row without content."""
    return asked.select("hash").distinct().join(contents, "hash", "left")


def reference(hash_: Column, contract: Column, media: Column) -> Column:
    """What stands for a content in an output."""
    return F.struct(F.lit("artifact_ref").alias("kind"), hash_.alias("address"), contract.alias("contract"), media.alias("mediaType"))


def orphans(contents: DataFrame, provenance: DataFrame) -> DataFrame:
    return contents.join(provenance, "hash", "left_anti")


def schedule_decision(kind: Column, outcome: Column) -> Column:
    """What becomes of a task after a run: a one-off that completed ends, one that failed is restored, a recurring one moves on."""
    return F.when(kind == "one_off", F.when(outcome == "completed", "complete").otherwise("restore")).when(kind == "recurring", "advance").otherwise("keep")


def replay_gate(frontier: DataFrame, stages: DataFrame, irreversible: Column) -> DataFrame:
    """Stages about to run that ran before: blocked if they can't be undone, else a warning."""
    past = stages.groupBy("run_id", "stage_no").agg(F.count("*").alias("past"))
    out = frontier.join(past, ["run_id", "stage_no"], "left").withColumn("past", F.coalesce("past", F.lit(0)))
    return out.withColumn("gate", F.when(F.col("past") == 0, "ok").when(irreversible, "block").otherwise("warn"))


def checkpoint_state(stored: DataFrame, expected: DataFrame) -> DataFrame:
    """Each run's checkpoint against what it should be."""
    both = expected.join(stored.select("run_id", F.col("kind").alias("had"), F.col("version").alias("had_version")), "run_id", "left")
    state = F.when(F.col("had").isNull(), "missing").when(F.col("had") != F.col("kind"), "corrupt").when(F.col("had_version") != F.col("version"), "incompatible").otherwise("ok")
    return both.withColumn("state", state)


def duplicates(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def unreferenced(rows: DataFrame, key: str, parents: DataFrame, parent_key: str) -> DataFrame:
    """Rows whose key names no parent."""
    return rows.join(parents.select(F.col(parent_key).alias(key)), key, "left_anti")


def masked(text: Column) -> Column:
    """The 12-digit account field of colon-separated resource names, hidden."""
    return F.regexp_replace(text, r"(?<=:)[0-9]{12}(?=:)", "***")


def kept_consumed(signals: DataFrame) -> DataFrame:
    """Delivered signals become consumed; of consumed ones of a run and name only the newest stays."""
    return latest(signals.where("state in ('delivered', 'consumed')").withColumn("_key", F.concat_ws("\u0001", "run_id", "name")), "_key", "at", "signal_id").drop("_key").withColumn("state", F.lit("consumed"))


def claimed_leases(runs: DataFrame, owner: str, now: Column, seconds: int) -> DataFrame:
    """Running leases after an owner's renewal: its own are longer, the others' that ran out are its own now, live ones stay."""
    until = now + F.make_dt_interval(secs=F.lit(seconds))
    mine, out = F.col("lease_owner").eqNullSafe(F.lit(owner)), F.col("lease_until") < now
    rows = runs.where("status = 'running'")
    return rows.select("run_id", F.when(mine | out, F.lit(owner)).otherwise(F.col("lease_owner")).alias("lease_owner"), F.when(mine | out, until).otherwise(F.col("lease_until")).alias("lease_until"))


def reserved_calls(asked: DataFrame, ledger: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Calls to add to a ledger: each key once, without those that are there."""
    return asked.dropDuplicates(list(keys)).join(ledger, list(keys), "left_anti")


def submitted_calls(calls: DataFrame, runs: DataFrame, limit: int) -> DataFrame:
    """Submitted calls of runs that may still take an answer, oldest first."""
    return calls.where("state = 'submitted'").join(runs.where(F.col("status").isin("pending", "running")).select("run_id"), "run_id").orderBy("at", "call_id").limit(limit)


def fusable(frontier: DataFrame) -> DataFrame:
    """Runs whose ready calls all have one authority and one strategy."""
    sums = frontier.groupBy("run_id").agg(F.countDistinct("authority").alias("a"), F.countDistinct("strategy").alias("s"), F.count("*").alias("calls"))
    return sums.where("a = 1 and s = 1 and calls > 1").select("run_id", "calls")


def conflicting_templates(templates: DataFrame, key: str, fingerprint: str) -> DataFrame:
    """Names given to things that aren't the same."""
    return templates.groupBy(key).agg(F.countDistinct(fingerprint).alias("forms")).where("forms > 1")


def port_faults(edges: DataFrame, ports: DataFrame) -> DataFrame:
    """Of ports (node, port, least, most): those that have fewer or more incoming edges."""
    n = edges.groupBy("node", "port").agg(F.count("*").alias("n"))
    return ports.join(n, ["node", "port"], "left").withColumn("n", F.coalesce("n", F.lit(0))).where("n < least or n > most").select("node", "port", "n")


def package_conflicts(rows: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """Names of (package, kind, name) that several packages give, by kind."""
    n = rows.where(F.col("kind").isin(*kinds)).groupBy("kind", "name").agg(F.countDistinct("package").alias("packages"))
    return n.where("packages > 1")


def first_wins(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Of packages that name the same thing, the first one's."""
    return earliest(rows, key, order)


def report(rows: DataFrame, key: str, verdict: str) -> DataFrame:
    """A Markdown table of verdicts, their numbers, and an exit code."""
    lines = F.array_sort(F.collect_list(F.struct(key, F.concat(F.lit("| "), F.col(key).cast("string"), F.lit(" | "), F.when(F.col(verdict), "pass").otherwise("fail"), F.lit(" |")).alias("line"))))
    text = F.concat(F.lit("| case | verdict |\n| --- | --- |\n"), F.array_join(F.transform(lines, lambda x: x["line"]), "\n"))
    failed = F.count_if(~F.col(verdict))
    return rows.agg(text.alias("table"), F.count("*").alias("cases"), failed.alias("failed"), F.when(failed > 0, 1).otherwise(0).cast("long").alias("exit_code"))
