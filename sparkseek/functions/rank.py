"""Relevance as Column arithmetic."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparkseek.functions.text import occurrences

K1, B = 1.5, 0.75
NAME_LENGTH, CONTENT_LENGTH = 16.0, 1000.0  # average lengths assumed in compat mode
WEIGHTS = {"name": 0.4, "content": 0.4, "metadata": 0.1, "recency": 0.1}


def bm25(tf: Column, length: Column, average: Column | float, total: Column | int, df: Column | int) -> Column:
    """BM25 of one term; 0 if any input is not positive or is NULL."""
    col = lambda x: x if isinstance(x, Column) else F.lit(x)
    average, total, df = (col(x).cast("double") for x in (average, total, df))
    idf = F.log((total - df + 0.5) / (df + 0.5) + 1.0)
    score = idf * (tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / average)))
    return F.coalesce(F.when((tf > 0) & (length > 0) & (average > 0) & (total > 0) & (df > 0), score), F.lit(0.0))


def name_bonus(name: Column, pattern: str) -> Column:
    """2 for the whole name, 1 for its beginning, without regard to case."""
    low, p = F.lower(name), F.lit(pattern.lower())
    return F.coalesce(F.when(low == p, 2.0).when(F.startswith(low, p), 1.0), F.lit(0.0))


def recency(mtime: Column, as_of: dt.date) -> Column:
    """1 for the last 7 days, 0.5 for the last 30; times in the future or unset count nothing."""
    age = F.datediff(F.lit(as_of), mtime)
    return F.coalesce(F.when(age < 0, 0.0).when(age < 7, 1.0).when(age < 30, 0.5), F.lit(0.0))


def relevance(
    as_of: dt.date,
    total: Column | int,
    df: Column | int,
    name: str | None = None,
    content: str | None = None,
    metadata: dict[str, str] | None = None,
    averages: tuple[Column | float, Column | float] = (NAME_LENGTH, CONTENT_LENGTH),
) -> Column:
    """The full relevance of a record, from columns name, content, mtime and the metadata columns.

    metadata counts equal values without regard to case. averages are the fixed lengths in compat mode or the corpus' own.
    """
    score = F.lit(0.0)
    if name:
        tf = occurrences(F.col("name"), name)
        score = score + WEIGHTS["name"] * (bm25(tf, F.octet_length("name"), averages[0], total, df) + name_bonus(F.col("name"), name))
    if content:
        score = score + WEIGHTS["content"] * bm25(occurrences(F.col("content"), content), F.octet_length("content"), averages[1], total, df)
    for field, value in (metadata or {}).items():
        same = F.coalesce(F.lower(F.col(field)) == F.lit(value.lower()), F.lit(False))
        score = score + WEIGHTS["metadata"] * F.when(same, 1.0).otherwise(0.0)
    return score + WEIGHTS["recency"] * recency(F.col("mtime"), as_of)


def corpus_relevance(as_of: dt.date, total: Column, counted: Sequence[tuple[str, str, Column]], metadata: dict[str, str], averages: dict[str, Column]) -> Column:
    """The relevance with every term of the query: counted holds (field, term, its document frequency) of name and content terms; BM25 adds
    up over them, the bonus for a name's beginning is that of the term that gives most."""
    score, bonuses = F.lit(0.0), []
    for field, term, df in counted:
        score = score + WEIGHTS[field] * bm25(occurrences(F.col(field), term), F.octet_length(field), averages[field], total, df)
        if field == "name":
            bonuses.append(name_bonus(F.col("name"), term))
    if bonuses:
        score = score + WEIGHTS["name"] * (F.greatest(*bonuses) if len(bonuses) > 1 else bonuses[0])
    for field, value in metadata.items():
        same = F.coalesce(F.lower(F.col(field)) == F.lit(value.lower()), F.lit(False))
        score = score + WEIGHTS["metadata"] * F.when(same, 1.0).otherwise(0.0)
    return score + WEIGHTS["recency"] * recency(F.col("mtime"), as_of)


def simple_relevance(as_of: dt.date, total: Column | int, df: Column | int, name: str | None = None) -> Column:
    """3 for the whole name, 2 for its beginning, 1 for a part; a tenth of the term's rarity; 1/(1 + age in years)."""
    col = lambda x: (x if isinstance(x, Column) else F.lit(x)).cast("double")
    score = F.lit(0.0)
    if name:
        low, p = F.lower("name"), F.lit(name.lower())
        match = F.when(low == p, 3.0).when(F.startswith(low, p), 2.0).when(F.contains(low, p), 1.0)
        score = F.coalesce(match, F.lit(0.0)) + F.when(col(df) > 0, 0.1 * F.log((col(total) + 1) / (col(df) + 1))).otherwise(0.0)
    age = F.datediff(F.lit(as_of), F.col("mtime"))
    return score + F.coalesce(F.when(age > 0, 1.0 / (1.0 + age / 365.0)), F.lit(0.0))
