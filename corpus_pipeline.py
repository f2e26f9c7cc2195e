"""From raw documents to token ids: quality, line dedup, near-copy removal, mixing and encoding, each by its operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dagframe.llm import bpe, linededup, mixing, ngram_join, quality
from dagframe.llm.queries import table, tokenizer_path
from dagframe.llm.shared import stored

#: A document stays if the classifier finds it more likely good than bad.
LEAST_QUALITY = 0.5


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without those that the quality classifier rejects."""
    labels = table(spark, sf_dir, "labels").where(quality.remainder("doc_id", 4) != 2)
    scored = quality.score(docs, quality.train(docs, labels), score_col="_quality")
    return scored.where(F.col("_quality") >= LEAST_QUALITY).drop("_quality")


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that match a line before; n_chars counts what is left."""
    return linededup.dedup(docs).withColumn("n_chars", F.length("text").cast("long"))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return ngram_join.one_of_each(docs)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target takes them, in whole texts."""
    return mixing.materialised(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids (little-endian 32-bit integers), their number, and the text that they decode to."""
    coded = bpe.encode_decode(docs.select("doc_id", "lang", "source", "text"), tokenizer_path())
    return coded.select("doc_id", "lang", "source", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids", "decoded")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", good_documents),
    ("line_dedup", without_repeated_lines),
    ("near_copies", one_of_each_group),
    ("mixing", mixed_sources),
    ("encoding", encoded),
]

#: The classifier and the encoder aren't SQL; tests/llm holds run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
