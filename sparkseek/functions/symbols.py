"""Symbols of source code, line by line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What a line may begin with, the kind it declares, where its name stands. The first that matches holds.
RULES = (
    ("function", r"^def \s*(\w*)"),
    ("class", r"^class \s*(\w*)"),
    ("class", r"^(?:struct|enum|interface|trait) \s*(\w*)"),
    ("class", r"^type \s*(\w*)\s*(?:struct|interface)"),
    ("function", r"^fn \s*(\w*)"),
    ("function", r"^func (?:\([^)]*\))?\s*(\w*)"),
    ("function", r"^(?:Function|Sub) \s*(\w*)"),
    ("var", r"^(?:let|var|const|Dim) \s*(\w*)"),
    ("function", r"^[^(]*?\b(?!(?:if|for|while|switch|catch)\s*\()(\w+)\s*\([^{]*\{"),
    ("var", r"^.*?(\w+)\s*:="),
    ("var", r"^[^=]*?(\w+)\s*(?<![=!<>])=(?!=)"),
)


def symbol(line: Column) -> Column:
    """struct(kind, name) a line declares, NULL if it declares nothing. Lines that begin like comments never do."""
    t = F.regexp_replace(line, r"^\s+", "")
    chosen = F.lit(None).cast("struct<kind:string,name:string>")
    for kind, pattern in reversed(RULES):
        found = F.regexp_extract(t, pattern, 1)
        chosen = F.when(t.rlike(pattern), F.struct(F.lit(kind).alias("kind"), found.alias("name"))).otherwise(chosen)
    return F.when((t != "") & ~t.rlike(r"^(?:#|//|/\*|\*)"), chosen)


def code_symbols(files: DataFrame, id: str = "rec_id", content: str = "content") -> DataFrame:
    """id, line_no, kind, name of every symbol; NULL contents have none."""
    lines = files.select(F.col(id), F.posexplode(F.split(F.col(content), r"\r?\n")).alias("line_no", "line"))
    found = lines.select(id, (F.col("line_no") + 1).alias("line_no"), symbol(F.col("line")).alias("s")).where("s.name != ''")
    return found.select(id, "line_no", "s.kind", "s.name")
