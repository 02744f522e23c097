"""Duplicate records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def content_key(content: str = "content") -> Column:
    return F.sha2(F.col(content), 256)


def duplicate_groups(records: DataFrame, keys: Sequence[str] = ("size", "content_hash")) -> DataFrame:
    """keys, n, first_id of every group of two or more records equal in the keys; rows with a NULL key are in none.

    A group is one row, however many members it has; members() lists them.
    """
    known = records.dropna(subset=list(keys))
    return known.groupBy(*keys).agg(F.count("*").alias("n"), F.min("rec_id").alias("first_id")).where("n > 1")


def members(records: DataFrame, keys: Sequence[str] = ("size", "content_hash")) -> DataFrame:
    """rec_id, first_id, n of every record in a group of duplicates: a row per record."""
    groups = duplicate_groups(records, keys)
    return records.join(groups, list(keys)).select("rec_id", "first_id", "n", *keys)


def keep_first(records: DataFrame, keys: Sequence[str] = ("size", "content_hash")) -> DataFrame:
    """One record of each group, the one with the least rec_id, and all records with a NULL key."""
    extra = members(records, keys).where(F.col("rec_id") != F.col("first_id")).select("rec_id")
    return records.join(extra, "rec_id", "left_anti")


def latest(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last row of each key, whole; of equal ones the one greatest in all columns. Combined on the map side, without a window."""
    rest = [c for c in rows.columns if c not in (*keys, *order)]
    best = rows.groupBy(*keys).agg(F.max(F.struct(*order, *rest)).alias("__r"))
    return best.select(*keys, "__r.*").select(*rows.columns)


def runs(records: DataFrame, keys: Sequence[str] = ("size", "content_hash"), order: Sequence[str] = ("parent", "name", "rec_id")) -> DataFrame:
    """Members of duplicate groups numbered within their group, by path."""
    w = W.partitionBy(*keys)
    found = members(records, keys).join(records.select("rec_id", *[c for c in order if c != "rec_id"]), "rec_id")
    return found.withColumn("number", F.row_number().over(w.orderBy(*order)))
