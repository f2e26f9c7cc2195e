"""Histograms of bit strings and a cost model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bitstring(bits: Column, order: list[int]) -> Column:
    """Bits in the order of outputs, output 0 rightmost."""
    return F.array_join(F.reverse(F.array(*(F.get(bits, F.lit(k)).cast("string") for k in order))), "")


def decoded(shots: DataFrame, bits: str, order: list[int], *keys: str) -> DataFrame:
    return shots.groupBy(*keys, bitstring(F.col(bits), order).alias("bits")).agg(F.count("*").alias("n"))


def labelled(histogram: DataFrame, names: list[str], *keys: str) -> DataFrame:
    """Counts by label a=0,b=1; name k reads the bit k places from the right."""
    width = len(names)
    label = F.concat_ws(",", *(F.concat(F.lit(f"{n}="), F.substring("bits", width - k, 1)) for k, n in enumerate(names)))
    return histogram.groupBy(*keys, label.alias("label")).agg(F.sum("n").alias("n"))


def marginals(histogram: DataFrame, names: list[str], *keys: str) -> DataFrame:
    """Zeros and ones of each output."""
    width = len(names)
    each = histogram.select(*keys, "n", F.explode(F.array(*(F.struct(F.lit(n).alias("output"), F.substring("bits", width - k, 1).alias("bit")) for k, n in enumerate(names)))).alias("e"))
    return each.groupBy(*keys, F.col("e.output").alias("output")).agg(F.sum(F.when(F.col("e.bit") == "0", F.col("n")).otherwise(0)).alias("zeros"), F.sum(F.when(F.col("e.bit") == "1", F.col("n")).otherwise(0)).alias("ones"))


def dense(histogram: DataFrame, width: int) -> DataFrame:
    every = histogram.sparkSession.range(1 << width).select(F.lpad(F.bin("id"), width, "0").alias("bits"))
    return every.join(histogram.groupBy("bits").agg(F.sum("n").alias("n")), "bits", "left").select("bits", F.coalesce("n", F.lit(0)).alias("n"))


def verdicts(histogram: DataFrame, expected: Column, threshold: float, *keys: str) -> DataFrame:
    sums = histogram.groupBy(*keys).agg(F.sum("n").alias("shots"), F.sum(F.when(F.col("bits") == expected, F.col("n")).otherwise(0)).alias("matching"))
    return sums.withColumn("deviating", F.col("shots") - F.col("matching")).withColumn("passed", F.col("matching") >= F.col("shots") * threshold)


def shots_seen(rows: Column, counts: Column) -> Column:
    """Rows if there are any listed, else the counts' sum, else none."""
    return F.coalesce(F.size(rows), F.aggregate(F.map_values(counts), F.lit(0).cast("long"), lambda a, x: a + x), F.lit(0)).cast("long")


def costed(jobs: DataFrame, prices: DataFrame, device: str = "device", shots: str = "shots") -> DataFrame:
    """Each job with the first price row (by place) whose pattern its device's name contains; the price list is a short table."""
    found = jobs.join(F.broadcast(prices), F.contains(F.lower(device), F.col("pattern")), "left")
    first = found.groupBy(*jobs.columns).agg(F.min(F.struct("place", "per_task", "per_shot")).alias("p"))
    total = F.col("p.per_task") + F.col("p.per_shot") * F.col(shots)
    return first.select(*jobs.columns, F.round(total.cast("decimal(38,12)"), 10).cast("double").alias("cost"))
