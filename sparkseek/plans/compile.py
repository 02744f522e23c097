"""Syntax tree to a predicate over records."""

from __future__ import annotations

import datetime as dt
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparkseek.functions.text import fuzzy
from sparkseek.plans.ast import And, Date, Fuzzy, Node, Not, Or, Size, Term, applied

METADATA = ("author", "camera", "lens", "artist", "album", "title")


def normalized(name: str) -> str:
    """normalize_name() of a plain string."""
    cut = re.sub(r"\.[^.]*$", "", name)
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in cut).translate(str.maketrans("_-.", "   "))


def name_contains(term: str, whole: bool = False) -> Column:
    norm = normalized(term)
    if whole:
        quoted = "\\Q" + norm.replace("\\E", "") + "\\E"
        return F.col("name_norm").rlike(rf"(?<![\p{{L}}\p{{N}}_]){quoted}(?![\p{{L}}\p{{N}}_])")
    return F.contains("name_norm", F.lit(norm))


def content_contains(term: str) -> Column:
    return F.contains(F.lower("content"), F.lit(term.lower()))


def field_equals(field: str, value: str) -> Column:
    return F.col(field) == F.lit(value)


def ext_is(ext: str) -> Column:
    return F.lower("ext") == F.lit(ext.lower())


def in_range(column: Column, low, high) -> Column:
    """low <= column <= high; None leaves a side open. NULL is not in it."""
    bounds = ([column >= F.lit(low)] if low is not None else []) + ([column <= F.lit(high)] if high is not None else [])
    p = column.isNotNull() if not bounds else bounds[0]
    for b in bounds[1:]:
        p = p & b
    return p


def on_days(column: Column, low: dt.date | None, high: dt.date | None) -> Column:
    """Days low to high, both inclusive, as bounds on the time itself, which a scan can use."""
    day = lambda d: F.lit(dt.datetime(d.year, d.month, d.day)).cast("timestamp_ntz")
    p = column.isNotNull()
    if low is not None:
        p = p & (column >= day(low))
    if high is not None:
        p = p & (column < day(high + dt.timedelta(days=1)))
    return p


def path_starts(prefix: str) -> Column:
    return F.startswith(F.lower("parent"), F.lit(prefix.lower()))


def path_contains(part: str) -> Column:
    return F.contains(F.lower("parent"), F.lit(part.lower()))


def name_matches(pattern: str) -> Column:
    return F.col("name").rlike(pattern)


def has_attributes(mask: int) -> Column:
    return F.col("attributes").bitwiseAND(F.lit(mask)) == F.lit(mask)


def leaf(node: Node, path: str = "prefix") -> Column:
    match node:
        case Term("name", value, whole):
            return name_contains(value, whole)
        case Term("content", value):
            return content_contains(value)
        case Term("ext", value):
            return ext_is(value)
        case Term("path", value):
            return path_starts(value) if path == "prefix" else path_contains(value)
        case Term("regex", value):
            return name_matches(value)
        case Term(field, value):
            return field_equals(field, value)
        case Size(low, high):
            return in_range(F.col("size"), low, high)
        case Date(low, high):
            return on_days(F.col("mtime"), low, high)
        case Fuzzy(value, distance):
            return fuzzy(F.col("name_norm"), normalized(value), distance)
    raise TypeError(node)


def predicate(node: Node | None, path: str = "prefix") -> Column:
    """The predicate of a query, for a filter: NULL is no match. None matches all.

    NOT is the complement among all records, so what it negates is made false where it is NULL; elsewhere leaves stay bare, so that the
    scan can use them.
    """
    node = applied(node)

    def build(n: Node) -> Column:
        match n:
            case And(left, right):
                return build(left) & build(right)
            case Or(left, right):
                return build(left) | build(right)
            case Not(child):
                return ~F.coalesce(build(child), F.lit(False))
        return leaf(n, path)

    return F.lit(True) if node is None else build(node)


def filters(ext: str | None = None, megabytes: tuple[float | None, float | None] = (None, None), days: tuple[dt.date | None, dt.date | None] = (None, None), path_part: str | None = None) -> Column:
    """The filters of a search form as one predicate: extension, size in MB and days modified (both inclusive, None leaves a side open), and a
    part of the path. What is not given or empty does not filter; a NULL column fails a filter on it."""
    p = F.lit(True)
    if ext:
        p = p & ext_is(ext.lstrip("."))
    if any(m is not None for m in megabytes):
        p = p & in_range(F.col("size"), *(None if m is None else int(m * (1 << 20)) for m in megabytes))
    if any(d is not None for d in days):
        p = p & on_days(F.col("mtime"), *days)
    if path_part:
        p = p & path_contains(path_part)
    return p
