"""Queries of the llm operators over the tables of a data directory, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkseek.llm.boilerplate import MainContent
from sparkseek.llm.encodings import Garbled
from sparkseek.llm.leaks import Rules, leaks
from sparkseek.llm.mail import NewText
from sparkseek.llm.ocr import ScannedText
from sparkseek.llm.packing import containers, filling, token_counts
from sparkseek.llm.spans import SharedSpans
from sparkseek.session import cut, read_table


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = read_table(spark, sf_dir, "content_items").where(F.col("source") == "web_archive")
    return MainContent(items).lines().withColumnRenamed("id", "item_id")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = read_table(spark, sf_dir, "content_items").where(F.col("source").isin("gmail", "outlook", "icloud"))
    return NewText(items).lines().withColumnRenamed("id", "item_id")


def _scanned(spark: SparkSession, sf_dir: str) -> ScannedText:
    items = read_table(spark, sf_dir, "content_items")
    plain = items.where(F.col("source").isin("file", "git", "onedrive", "registry"))
    return ScannedText(items.where(F.col("source") == "ocr"), other=plain)


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scanned(spark, sf_dir).cases().withColumnRenamed("id", "item_id")


def p6_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The repaired texts."""
    return _scanned(spark, sf_dir).repaired().withColumnRenamed("id", "item_id")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Garbled(read_table(spark, sf_dir, "content_items")).found().select(F.col("id").alias("item_id"), "field")


def p7_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fields found with their true text."""
    fields = Garbled(read_table(spark, sf_dir, "content_items")).restored()
    return fields.select(F.col("id").alias("item_id"), "field", "restored")


def p8_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in containers of 8192 tokens."""
    return containers(token_counts(read_table(spark, sf_dir, "documents")), 8192).withColumnRenamed("id", "doc_id")


def p8_filling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the containers keep the rules, and whether at least 97 % of their space is in use."""
    counts = cut(token_counts(read_table(spark, sf_dir, "documents")))
    row = filling(containers(counts, 8192), counts, 8192)
    return row.select("items", "over", "lost", "divided", (F.col("share") >= 0.97).alias("well_filled"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "test_items")).select("doc_id", "test_id")


def p9_verbatim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the leaks those that stand there word for word."""
    return leaks(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "test_items"), Rules(edits=0)).select("doc_id", "test_id")


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return SharedSpans(read_table(spark, sf_dir, "documents")).pairs()


def p10_shared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document how many of its characters lie in stretches shared with others."""
    return SharedSpans(read_table(spark, sf_dir, "documents")).coverage().withColumnRenamed("id", "doc_id")


QUERIES = {f.__name__: f for f in (p3_found, p5_found, p6_found, p6_repaired, p7_found, p7_restored, p8_containers, p8_filling, p9_found, p9_verbatim, p10_found, p10_shared)}

_WINDOWS = """c AS (SELECT doc_id, n_chars, text FROM documents WHERE n_chars >= 300),
w AS (SELECT doc_id, i, md5_number(substr(text, i, 300)) AS m FROM (SELECT doc_id, text, unnest(range(1, n_chars - 298)) AS i FROM c))"""

ORACLE_SQL: dict[str, str] = {
    "p8_filling": "SELECT count(*) AS items, 0 AS over, 0 AS lost, 0 AS divided, true AS well_filled FROM documents",
    "p9_verbatim": r"""WITH d AS (SELECT doc_id, regexp_extract_all(strip_accents(lower(text)), '[\p{L}\p{N}]+') AS w FROM documents),
t AS (SELECT test_id, regexp_extract_all(strip_accents(lower(text)), '[\p{L}\p{N}]+') AS w FROM test_items),
a AS (SELECT DISTINCT test_id, array_to_string(w[i : i + 13], ' ') AS p FROM (SELECT test_id, w, unnest(range(1, CAST(len(w) - 12 AS BIGINT))) AS i FROM t WHERE len(w) > 13)),
b AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 13], ' ') AS p FROM (SELECT doc_id, w, unnest(range(1, CAST(len(w) - 12 AS BIGINT))) AS i FROM d WHERE len(w) > 13))
SELECT DISTINCT doc_id, test_id FROM a JOIN b USING (p)""",
    "p10_found": f"""WITH {_WINDOWS}, d AS (SELECT DISTINCT doc_id, m FROM w)
SELECT DISTINCT a.doc_id AS doc_a, b.doc_id AS doc_b FROM d a JOIN d b ON a.m = b.m AND a.doc_id < b.doc_id""",
    "p10_shared": f"""WITH {_WINDOWS}, s AS (SELECT m FROM w GROUP BY m HAVING count(DISTINCT doc_id) > 1),
p AS (SELECT doc_id, least(300, coalesce(lead(i) OVER (PARTITION BY doc_id ORDER BY i) - i, 300)) AS n FROM w WHERE m IN (SELECT m FROM s)),
t AS (SELECT doc_id, sum(n) AS n FROM p GROUP BY doc_id)
SELECT c.doc_id, c.n_chars, CAST(coalesce(t.n, 0) AS BIGINT) AS shared_chars FROM c LEFT JOIN t USING (doc_id)""",
}
