"""Reads and writes of the run store: listings, lookups, claims, profiles, stages, cancellation, tasks.

A write is the frame of rows that the store has after it, or that it adds; every listing has an order that no tie leaves open."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dagframe.operators.history import FINAL, latest


def listed(rows: DataFrame, *order: str | Column, limit: int | None = None) -> DataFrame:
    """Rows in an order; a limit below 1 counts as 1."""
    out = rows.orderBy(*order)
    return out if limit is None else out.limit(max(1, limit))


def runs_of(runs: DataFrame, owner: str, key, limit: int) -> DataFrame:
    """The newest runs of a task or a user (`owner` names the column)."""
    return listed(runs.where(F.col(owner) == key), F.desc("created_at"), F.desc("run_id"), limit=limit)


def statuses(runs: DataFrame, asked: DataFrame, user: bool = False) -> DataFrame:
    """Status and start of each run asked for (run_id, and user_id where only its user may see it)."""
    return asked.join(runs, ["run_id", "user_id"] if user else ["run_id"]).select("run_id", "status", "started_at")


def open_stage(stages: DataFrame) -> DataFrame:
    """The latest stage of each run that has no end yet."""
    return latest(stages.where("ended_at is null"), "run_id", "started_at", "stage_no")


def appended(stages: DataFrame, new: DataFrame) -> DataFrame:
    """Stages or attempts after new ones came; one that is there already stays as it is."""
    return stages.unionByName(new.join(stages, ["run_id", "stage_no"], "left_anti"))


def completed(stages: DataFrame, facts: DataFrame) -> DataFrame:
    """Stages after facts (run_id, stage_no, at, state); an ended one stays as it is."""
    open_ = F.col("ended_at").isNull() & F.col("at").isNotNull()
    out = stages.join(facts.withColumnRenamed("state", "to"), ["run_id", "stage_no"], "left")
    return out.select("run_id", "stage_no", "started_at", F.when(open_, F.col("at")).otherwise(F.col("ended_at")).alias("ended_at"), F.when(open_, F.col("to")).otherwise(F.col("state")).alias("state"))


def created(tasks: DataFrame, runs: DataFrame, now: Column) -> DataFrame:
    """Runs to add for due tasks that have no open one; the user is the payload's (under either name), else the task's."""
    due = tasks.where("enabled").where(F.col("next_run_at") <= now).join(runs.where(~F.col("status").isin(*FINAL)), "task_id", "left_anti")
    user = F.coalesce(F.get_json_object("payload", "$.user_id"), F.get_json_object("payload", "$.userId"), "user_id")
    return due.select("task_id", F.lit("pending").alias("status"), user.alias("user_id"))


def frozen(runs: DataFrame, offered: DataFrame) -> DataFrame:
    """Execution profiles: the first one stays, and a different later offer is a conflict."""
    out = runs.select("run_id", "profile").join(offered.select("run_id", F.col("profile").alias("offer")), "run_id", "left")
    return out.select("run_id", F.coalesce("profile", "offer").alias("profile"), F.coalesce(F.col("profile") != F.col("offer"), F.lit(False)).alias("conflict"))


def cancelled(runs: DataFrame, asked: DataFrame) -> DataFrame:
    """Requests for an end: pending runs end at once, running ones are marked, others stay."""
    out = runs.join(asked.select("run_id").distinct().withColumn("asked", F.lit(True)), "run_id", "left")
    hit = F.coalesce("asked", F.lit(False))
    return out.select("run_id", F.when(hit & (F.col("status") == "pending"), "cancelled").otherwise(F.col("status")).alias("status"), (hit & (F.col("status") == "running")).alias("to_cancel"))


def tasks_after(tasks: DataFrame, runs: DataFrame, ended: DataFrame, enabled: bool) -> DataFrame:
    """Tasks after those of some runs (run_id) were released or disabled."""
    of = runs.join(ended.select("run_id").distinct(), "run_id").select("task_id").distinct().withColumn("hit", F.lit(True))
    return tasks.join(of, "task_id", "left").select("task_id", F.when(F.col("hit"), F.lit(enabled)).otherwise(F.col("enabled")).alias("enabled"))


def task_of(runs: DataFrame, tasks: DataFrame, run_id) -> DataFrame:
    """The task of one run, by a scalar subquery."""
    return tasks.where(F.col("task_id") == runs.where(F.col("run_id") == run_id).select("task_id").scalar())


def defined(tasks: DataFrame, new: DataFrame) -> DataFrame:
    """Task definitions after new ones; an id that is taken stays as it is."""
    return tasks.unionByName(new.join(tasks, "task_id", "left_anti"))


def recovered(expired: DataFrame, tasks: DataFrame) -> DataFrame:
    """Expired runs with their task's type, where the task is still there."""
    return expired.join(tasks.select("task_id", "task_type"), "task_id", "left")


def expired_waits(waits: DataFrame, now: Column) -> DataFrame:
    return waits.where(F.col("expires_at") < now)


def node_times(stages: DataFrame, key: str = "stage_no") -> DataFrame:
    """When each node of a run was last completed."""
    return stages.where("ended_at is not null").groupBy("run_id", key).agg(F.max("ended_at").alias("completed_at"))


def effective_timeout(own: Column, default: Column) -> Column:
    """A stage's own timeout if it is above 0, else the default if that is, else none."""
    return F.coalesce(F.when(own > 0, own), F.when(default > 0, default))
