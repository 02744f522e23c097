"""Path functions as Column expressions."""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column
from pyspark.sql import functions as F


def lowercase_ascii(text: Column) -> Column:
    """A-Z only; other letters keep their case. NULL stays NULL."""
    return F.translate(text, ascii_uppercase, ascii_lowercase)


def canonical_path(path: Column) -> Column:
    """One spelling per folder: ASCII lower case, backslashes, no leading extended-length prefix, no trailing separators.

    NULL stays NULL; a path of separators only becomes the empty string.
    """
    p = F.translate(lowercase_ascii(path), "/", "\\")
    p = F.when(p.startswith("\\\\?\\"), F.substr(p, F.lit(5))).otherwise(p)
    return F.rtrim(p, F.lit("\\"))


def path_join(parent: Column, child: Column) -> Column:
    """parent + backslash + child; an empty or NULL parent gives the child alone, no doubled separator."""
    joined = F.concat(F.regexp_replace(parent, r"[\\/]+$", ""), F.lit("\\"), child)
    return F.when(F.coalesce(parent, F.lit("")) == "", child).otherwise(joined)


def path_dirname(path: Column) -> Column:
    """Everything before the last separator; a path without one gives the empty string."""
    return F.regexp_extract(path, r"(?s)^(.*)[\\/][^\\/]*$", 1)


def path_basename(path: Column) -> Column:
    return F.regexp_extract(path, r"([^\\/]*)$", 1)


def drive_root(path: Column) -> Column:
    """`C:\\` or the UNC share `\\\\server\\share`; empty for other paths."""
    drive = F.regexp_extract(path, r"^([A-Za-z]:)[\\/]?", 1)
    share = F.regexp_extract(path, r"^(\\\\[^\\/]+\\[^\\/]+)", 1)
    return F.when(drive != "", F.concat(drive, F.lit("\\"))).otherwise(share)
