"""Connected components of a links table, by rounds of least labels over links and label jumping.

Every round reads and writes tables in the shared folder; a vertex of very many links is split by Spark's skew join, its
labels are reduced before they are shuffled, and nothing is collected but a count."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dagframe.llm.shared import released, stored


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root), a stored table: of every node of a link, the least node reachable. Loops and repeated links do no harm.

    Labels fall in every round but the last, so that the rounds end; jumping makes them few."""
    pairs = links.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b")
    both = stored(pairs.unionAll(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least")).select("node", F.least("node", "least").alias("root")), "labels")
    while True:
        heard = both.join(labels, both.b == labels.node).groupBy(F.col("a").alias("node")).agg(F.min("root").alias("heard"))
        low = labels.join(heard, "node").select("node", F.least("root", "heard").alias("root"), F.col("root").alias("was"))
        up = labels.select(F.col("node").alias("up"), F.col("root").alias("above"))
        after = stored(low.join(up, low.root == up.up, "left").select("node", F.least("root", F.coalesce("above", "root")).alias("root"), "was"), "labels")
        settled = after.where("root <> was").isEmpty()
        released(labels)
        labels = after.select("node", "root")
        labels.stored_at = after.stored_at
        if settled:
            released(both)
            return labels
