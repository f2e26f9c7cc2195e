"""The registered queries opN_<name>: each applies its operator to the whole of its table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from dagframe.llm import quality

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").where(quality.remainder("doc_id", 4) != 2)
    scored = quality.score(docs, quality.train(docs, labels))
    return scored.select(
        "doc_id",
        (quality.remainder("doc_id", 4) == 2).alias("held_out"),
        "score",
        (F.col("score") >= 0.7).cast("int").alias("predicted"),
    )


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from dagframe.llm import bpe

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = bpe.encode_decode(docs, tokenizer_path())
    return coded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from dagframe.llm import mixing

    return mixing.mix(table(spark, sf_dir, "documents"))


def op4_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from dagframe.llm import ctw
    from dagframe.llm.quality import remainder

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return ctw.score(docs, remainder("doc_id", 7) != 2)


def op5_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from dagframe.llm import embedding_dups

    return embedding_dups.near_copies(table(spark, sf_dir, "embeddings"))


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from dagframe.llm import ngram_join

    return ngram_join.near_copies(table(spark, sf_dir, "documents"))


def op7_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    from dagframe.llm import html

    found = html.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op8_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    from dagframe.llm import imatch

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return imatch.compared(docs, imatch.lexicon(docs))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from dagframe.llm import linededup

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return linededup.dedup(docs, count_col="n_removed")


OP9_SQL = r"""
WITH l AS (
  SELECT doc_id, u.pos, u.line, list_filter(regexp_split_to_array(lower(u.line), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w
  FROM (SELECT doc_id, unnest(list_transform(string_split(text, chr(10)), lambda x, i: {'pos': i, 'line': x})) AS u FROM documents)
), s AS (SELECT doc_id, pos, line, CASE WHEN len(w) >= 5 THEN list_sort(list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], chr(31))))) WHEN len(w) > 0 THEN [array_to_string(w, chr(31))] ELSE [] END AS t FROM l),
c AS (SELECT t, min((doc_id, pos)) AS earliest, len(t) AS n, row_number() OVER () AS cls FROM s WHERE len(t) > 0 GROUP BY t),
e AS (SELECT cls, earliest, n, unnest(t) AS token FROM c),
m AS (
  SELECT y.cls FROM e x JOIN e y ON x.token = y.token AND x.earliest < y.earliest
  GROUP BY x.cls, y.cls, x.n, y.n HAVING 100 * count(*) >= 75 * (x.n + y.n - count(*))
), g AS (SELECT s.doc_id, s.pos, s.line, coalesce((s.doc_id, s.pos) > c.earliest OR c.cls IN (SELECT cls FROM m), false) AS gone FROM s LEFT JOIN c ON s.t = c.t)
SELECT doc_id, coalesce(string_agg(CASE WHEN NOT gone THEN line END, chr(10) ORDER BY pos), '') AS text, count(*) FILTER (gone)::BIGINT AS n_removed FROM g GROUP BY doc_id
UNION ALL SELECT doc_id, text, 0 FROM documents WHERE text IS NULL
"""


def op10_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    from dagframe.llm import langid
    from dagframe.llm.quality import remainder

    docs = table(spark, sf_dir, "documents")
    net = langid.train(docs.where(remainder("doc_id", 4) != 2).select("doc_id", "text", "lang"))
    found = langid.identify(docs.select("doc_id", "text"), net)
    return found.select("doc_id", (remainder("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


OP1_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce('1' || source, '2') AS sk, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents
), k AS (SELECT *, md5(coalesce(doc_id::VARCHAR, '') || ':' || size) AS key FROM d),
s AS (SELECT sk, sum(size)::BIGINT AS total FROM k GROUP BY sk),
r AS (SELECT *, CASE (row_number() OVER (ORDER BY sk) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w, total * 2.0::DOUBLE AS cap, sum(total) OVER () * 1.5::DOUBLE AS everything FROM s),
f AS (
  SELECT *, everything - coalesce(sum(cap) OVER o, 0) AS words_left, sum(w) OVER () - coalesce(sum(w) OVER o, 0) AS sharers
  FROM r WINDOW o AS (ORDER BY cap / w, sk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), g AS (SELECT *, words_left / sharers * w > cap AS is_full FROM f),
t AS (
  SELECT sk, total, CASE WHEN is_full THEN cap ELSE
    (everything - coalesce(sum(CASE WHEN is_full THEN cap END) OVER (), 0)) / sum(CASE WHEN NOT is_full THEN w END) OVER () * w END AS target FROM g
), p AS (SELECT *, CASE WHEN total > 0 THEN floor(floor(target + 0.5) / total) ELSE 0 END::BIGINT AS passes FROM t),
q AS (SELECT *, (floor(target + 0.5) - passes * total)::BIGINT AS rest FROM p),
c AS (SELECT sk, key, size, count(*) AS n FROM k GROUP BY sk, key, size),
b AS (SELECT *, coalesce(sum(size * n) OVER (PARTITION BY sk ORDER BY key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS at FROM c)
SELECT k.doc_id, k.size, q.total AS source_size, q.target,
  (q.passes * k.size + least(k.size, greatest(0, floor((q.rest - b.at) / b.n)))::BIGINT)::BIGINT AS taken
FROM k JOIN q USING (sk) JOIN b ON b.sk = k.sk AND b.key = k.key AND b.size = k.size
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_mixing": op1_mixing,
        "op2_quality": op2_quality,
        "op3_bpe": op3_bpe,
        "op4_lm": op4_lm,
        "op5_embedding": op5_embedding,
        "op6_ngram_join": op6_ngram_join,
        "op7_html": op7_html,
        "op8_imatch": op8_imatch,
        "op9_line_dedup": op9_line_dedup,
        "op10_langid": op10_langid,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_mixing": OP1_SQL, "op9_line_dedup": OP9_SQL}
