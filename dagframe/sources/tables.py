"""Frames from Parquet, from files and from the test tables, and tables written on the way."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, name: str = "step") -> DataFrame:
    """df as a table in the folder that all executors share (spark.checkpoint.dir; a temporary one only on one machine).

    Loops cut their lineage here: a lost executor costs one step, not the whole loop."""
    path = _new_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def _new_path(spark: SparkSession, name: str) -> str:
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not (spark.conf.get("spark.master", "local") or "").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = f"{tempfile.gettempdir()}/checkpoints"
    return f"{folder.rstrip('/')}/dagframe/{name}-{uuid.uuid4().hex}"


def released(*tables: DataFrame) -> None:
    """Deletes tables made by written(), once nothing that is still to run reads them."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.stored_at)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


class Growing:
    """One table that a loop adds to, a part a step: a step reads its own part, and the plan of the whole is one scan however many steps."""

    def __init__(self, spark: SparkSession, schema, name: str, step: str):
        from pyspark.sql import types as T

        self.spark, self.step, self.path = spark, step, _new_path(spark, name)
        self.schema = T.StructType([*schema, T.StructField(step, T.IntegerType())])

    def add(self, df: DataFrame) -> None:
        """Rows with their step."""
        df.write.mode("append").partitionBy(self.step).parquet(self.path)

    def part(self, step: int) -> DataFrame:
        return self.whole().where(F.col(self.step) == step).drop(self.step)

    def whole(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path)


def from_lines(spark: SparkSession, lines, prompt: str | None = None) -> DataFrame:
    """Lines of an open text (standard input, say) as rows; a prompt is printed first."""
    if prompt is not None:
        print(prompt, end="", flush=True)
    return spark.createDataFrame([(k, x.rstrip("\n")) for k, x in enumerate(lines)], "number long, line string")


def to_console(df: DataFrame, column: str, out, limit: int, newline: bool = True) -> None:
    """The first rows of a column: texts as they are, other values as indented JSON."""
    import json

    for (x,) in df.select(column if dict(df.dtypes)[column] == "string" else F.to_json(F.col(column)).alias(column)).limit(limit).collect():
        text = x if dict(df.dtypes)[column] == "string" else json.dumps(json.loads(x), indent=2, ensure_ascii=False)
        out.write(text + ("\n" if newline else ""))


def included_text(path: str) -> str:
    """A text file as a value of the plan, read while planning."""
    with open(path, encoding="utf-8") as f:
        return f.read()


def whole_files(spark: SparkSession, path: str) -> DataFrame:
    """Each file as one row: path and text."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def listing(spark: SparkSession, path: str) -> DataFrame:
    """Entries of a folder by name: name, path, stem, extension, label, entry type. Contents are not read."""
    files = spark.read.format("binaryFile").load(path).select("path")
    name = F.element_at(F.split("path", "/"), -1)
    stem = F.regexp_replace(name, r"\.[^.]*$", "")
    extension = F.regexp_extract(name, r"\.([^.]*)$", 1)
    return files.select(name.alias("name"), "path", stem.alias("stem"), extension.alias("extension"), sanitised(stem).alias("label"), F.lit("file").alias("entryType")).orderBy("name")


def sanitised(text):
    """A label: anything but letters and digits becomes _, leading ones go, and an empty one or a digit gets a prefix."""
    plain = F.regexp_replace(F.regexp_replace(text, "[^a-zA-Z0-9]", "_"), "^_+", "")
    return F.when(plain.rlike("^[a-zA-Z]"), plain).otherwise(F.concat(F.lit("item_"), plain))


def write_text(df: DataFrame, path: str, column: str = "text") -> None:
    """One row a line; a frame of one row gives one file with its whole text."""
    df.select(column).write.mode("overwrite").text(path)


def drift(spark: SparkSession, expected: DataFrame) -> DataFrame:
    """Of (table, column): what the session's catalog lacks."""
    actual = [(t.name, c.name) for t in spark.catalog.listTables() for c in spark.catalog.listColumns(t.name)]
    return expected.join(spark.createDataFrame(actual, "table string, column string"), ["table", "column"], "left_anti")


def manifest(text: str) -> dict:
    """A package manifest (TOML): namespaces, executors, contracts and modules by name; a name given twice is an error."""
    import tomllib

    found = tomllib.loads(text)
    return {kind: found.get(kind, {}) for kind in ("namespaces", "executors", "contracts", "modules")}


def conversation_graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Vertices (graph_id, id, status, output, key, hours) and edges (graph_id, src, dst) of the conversations.

    A turn leads to the next one, and to later ones that a fixed rule on the numbers picks."""
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("graph_id"), F.col("turn").alias("id"), "role", "text").dropDuplicates(["graph_id", "id"])
    names = F.array(*(F.lit(s) for s in ("completed", "completed", "skipped", "completed", "pending", "rewritten", "running", "failed")))
    vertices = turns.select("graph_id", "id", F.element_at(names, (F.col("id") % 8 + 1).cast("int")).alias("status"), F.col("text").alias("output"), F.col("role").alias("key"), F.col("id").alias("hours"))
    a, b = turns.select("graph_id", F.col("id").alias("src")), turns.select("graph_id", F.col("id").alias("dst"))
    pick = (F.col("graph_id") + F.col("src") * 37 + F.col("dst") * 101 + F.col("src") * F.col("dst") * 13) % 7 < 2
    edges = a.join(b, "graph_id").where(F.col("src") < F.col("dst")).where((F.col("dst") == F.col("src") + 1) | pick)
    return vertices, edges.select("graph_id", "src", "dst")
