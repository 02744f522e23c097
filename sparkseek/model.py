"""The record model and its views over tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkseek.functions.text import extension, normalize_name
from sparkseek.session import read_table

RECORD = T.StructType(
    [
        T.StructField("rec_id", T.LongType()),
        *[T.StructField(c, T.StringType()) for c in ("parent", "name", "name_norm", "ext", "kind")],
        T.StructField("size", T.LongType()),
        *[T.StructField(c, T.TimestampNTZType()) for c in ("ctime", "mtime", "atime")],
        T.StructField("attributes", T.IntegerType()),
        *[T.StructField(c, T.StringType()) for c in ("content", "author", "title", "camera", "lens", "artist", "album", "preview", "content_hash", "source", "level")],
    ]
)
CHANGE = T.StructType(
    [
        *[T.StructField(c, T.StringType()) for c in ("parent", "name")],
        *[T.StructField(c, T.IntegerType()) for c in ("op", "stage")],
        T.StructField("size", T.LongType()),
        T.StructField("mtime", T.TimestampNTZType()),
        T.StructField("content", T.StringType()),
        T.StructField("seq", T.LongType()),
        T.StructField("event_time", T.TimestampType()),
    ]
)


def as_records(df: DataFrame) -> DataFrame:
    """df with every column of RECORD, in order: missing ones are NULL, name_norm and ext are derived from name where missing."""
    have = set(df.columns)
    if "name_norm" not in have and "name" in have:
        df = df.withColumn("name_norm", normalize_name(F.col("name")))
    if "ext" not in have and "name" in have:
        df = df.withColumn("ext", extension(F.col("name")))
    have = set(df.columns)
    return df.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in RECORD])


def document_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records over the documents table."""
    d = read_table(spark, sf_dir, "documents")
    return as_records(
        d.select(
            F.col("doc_id").alias("rec_id"), F.col("parent_path").alias("parent"), "name", F.lit("file").alias("kind"), F.col("n_chars").alias("size"),
            F.col("modified_time").alias("mtime"), F.col("text").alias("content"), F.col("lang").alias("author"), "source",
        )
    )


def item_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records over the content_items table."""
    d = read_table(spark, sf_dir, "content_items")
    return as_records(
        d.select(
            F.col("item_id").alias("rec_id"), F.col("parent_path").alias("parent"), "name", F.lit("file").alias("kind"), F.col("file_size").alias("size"), F.col("creation_time").alias("ctime"),
            F.col("modified_time").alias("mtime"), F.col("access_time").alias("atime"), "attributes", "content", "preview", F.col("hash_crc").cast("string").alias("content_hash"), "source",
        )
    )


def part_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records over the part table: short ASCII names."""
    d = read_table(spark, sf_dir, "part")
    return as_records(
        d.select(F.col("p_partkey").alias("rec_id"), F.col("p_brand").alias("parent"), F.col("p_name").alias("name"), F.col("p_type").alias("ext"), F.lit("file").alias("kind"), F.col("p_size").alias("size"))
    )
