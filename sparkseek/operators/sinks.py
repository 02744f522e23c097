"""Where results go."""

from __future__ import annotations

import getpass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkseek.functions.text import sanitize_log


def json_lines(hits: DataFrame) -> DataFrame:
    """One JSON object per hit: path, size, mtime, score."""
    path = F.concat_ws("\\", "parent", "name")
    return hits.select("rec_id", F.to_json(F.struct(path.alias("path"), "size", "mtime", "score")).alias("json"))


def text_lines(hits: DataFrame) -> DataFrame:
    """One line per hit."""
    path = F.concat_ws("\\", "parent", "name")
    return hits.select("rec_id", F.format_string("%s\t%s\t%s\t%.3f", path, F.col("size"), F.coalesce(F.col("mtime").cast("string"), F.lit("")), F.col("score")).alias("line"))


def audit(spark: SparkSession, folder: str, query: str, principal: str | None = None) -> None:
    """Append who asked what, and when, without control characters."""
    row = spark.createDataFrame([(principal or getpass.getuser(), query)], "principal string, query string")
    row.select(F.current_timestamp().alias("at"), sanitize_log("principal").alias("principal"), sanitize_log("query").alias("query")).write.mode("append").parquet(folder)
