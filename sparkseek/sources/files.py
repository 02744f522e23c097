"""Files and archives as records."""

from __future__ import annotations

import re
import tarfile
import zipfile
from collections.abc import Iterator
from io import BytesIO
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkseek.functions.paths import path_basename, path_dirname
from sparkseek.functions.text import extension
from sparkseek.model import as_records
from sparkseek.sources.extract import extracted
from sparkseek.sources.registry import source


@source("files")
def files(spark: SparkSession, root: str, content: bool = False, pattern: str | None = None, most: int | None = None) -> DataFrame:
    """A record per file below root, on any file system Spark reads (a mounted share among them). Without content only names, sizes and
    times are read; with it, texts and metadata are extracted, whole or the first `most` characters."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    found = reader.load(root)
    path = F.regexp_replace("path", r"^file:/*", "/")
    base = found.select("path", path_dirname(path).alias("parent"), path_basename(path).alias("name"), F.lit("file").alias("kind"), F.col("length").alias("size"), F.col("modificationTime").cast("timestamp_ntz").alias("mtime"))
    base = base.withColumn("rec_id", F.xxhash64("path")).withColumn("ext", extension(F.col("name"))).withColumn("source", F.lit("file"))
    if content:
        texts = extracted(found.select("path", "content", extension(path).alias("ext")), most=most)
        base = base.join(texts, "path")
    return as_records(base)


def safe_member(name: str) -> str | None:
    """A member's path with %XX decoded and slashes forward; None for absolute names, drives, parent steps and control characters."""
    n = unquote(name)
    if not n or n[0] in "/\\" or "\\" in n or ":" in n or re.search(r"[\x00-\x1f]", n):
        return None
    parts = [p for p in n.split("/") if p and p != "."]
    return None if ".." in parts or not parts else "/".join(parts)


def _list(data: bytes) -> Iterator[tuple[str, int]]:
    if zipfile.is_zipfile(BytesIO(data)):
        with zipfile.ZipFile(BytesIO(data)) as z:
            for i in z.infolist():
                if not i.is_dir():
                    yield i.filename, i.file_size
    else:
        with tarfile.open(fileobj=BytesIO(data)) as t:
            for m in t:
                if m.isfile():
                    yield m.name, m.size


def archive_members(archives: DataFrame, path: str = "path", data: str = "content") -> DataFrame:
    """path, member, size of all files in zip and tar archives; unsafe names are left out, as are damaged archives."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for p, d in zip(batch.column("path").to_pylist(), batch.column("data").to_pylist()):
                try:
                    for name, size in _list(bytes(d or b"")):
                        if (safe := safe_member(name)) is not None:
                            rows.append((p, safe, size))
                except (tarfile.TarError, zipfile.BadZipFile, EOFError, OSError):
                    continue
            columns = list(zip(*rows)) or [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.string(), pa.int64()))], names=["path", "member", "size"])

    return archives.selectExpr(f"`{path}` AS path", f"`{data}` AS data").mapInArrow(run, "path string, member string, size bigint")


@source("archives")
def archives(spark: SparkSession, root: str, pattern: str = "*.{zip,tar,tgz,gz}") -> DataFrame:
    """A record per archive member; its parent is the archive."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    members = archive_members(found)
    slash = F.translate("member", "/", "\\")
    return as_records(
        members.select(F.xxhash64("path", "member").alias("rec_id"), F.concat_ws("\\", "path", F.nullif(path_dirname(slash), F.lit(""))).alias("parent"), path_basename(slash).alias("name"), F.lit("file").alias("kind"), "size", F.lit("archive").alias("source"))
    )
