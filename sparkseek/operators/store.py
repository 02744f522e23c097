"""A versioned table of records on shared storage: changes in any order, deletes, commits and compaction."""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkseek.operators.shared import SharedFolder, file_name

UPSERT, DELETE = 0, 1


class RecordStore:
    """A table as sorted-out layers under one folder: per bucket of keys a base, and above it the changes committed since.

    A commit writes only its own changes, one row per key with its place in the order and, for a delete, a tombstone, in folders by
    bucket; then it publishes a pointer of the next generation that lists the layers. The pointer appears whole or not at all, and its
    name must be free: of two writers one publishes first and the other publishes after it. Readers keep the generation they opened.

    Reading takes the last change of each key over the layers, so batches may be applied in any order and more than once: what is older than a
    key's row or tombstone changes nothing. A batch whose name was committed before is not written again; a file per batch
    remembers that for good. merge() folds the layers of the buckets that have any into new bases; apply() calls it
    once `layers` of them lie above one another, so that a batch costs what it touches and reading stays cheap.
    """

    def __init__(self, spark: SparkSession, folder: str, keys: Sequence[str] = ("parent", "name"), order: Sequence[str] = ("event_time", "seq"), buckets: int = 16, layers: int = 8):
        self.spark, self.keys, self.order, self.buckets, self.layers = spark, list(keys), list(order), buckets, layers
        self.files = SharedFolder(spark, folder)
        self.folder = self.files.folder

    @property
    def generation(self) -> int:
        return max((int(n) for n in self.files.names("meta")), default=0)

    def header(self, generation: int | None = None) -> dict:
        """A generation: its layers (the bases by bucket, then changes in the order they were committed), the schema's columns and the greatest place in the order."""
        g = self.generation if generation is None else generation
        found = self.files.read(f"meta/{g:012d}") if g else None
        return found or {"generation": 0, "bases": {}, "changes": [], "columns": {}, "newest": None}

    def _bucket(self, values: Sequence[Column] | None = None) -> Column:
        of = [F.col(k) for k in self.keys] if values is None else list(values)
        return F.pmod(F.xxhash64(*of, *[x.isNull() for x in of]), F.lit(self.buckets)).cast("int")

    def _layer(self, root: str, paths: Sequence[str], columns: dict[str, str]) -> DataFrame:
        df = self.spark.read.option("basePath", self.files.at(root)).parquet(*[self.files.at(p) for p in paths])
        return df.select(*[(F.col(f"`{c}`") if c in df.columns else F.lit(None)).cast(t).alias(c) for c, t in columns.items()], "__deleted", "__bucket")

    def _images(self, head: dict, only: Column | None = None) -> DataFrame | None:
        """The last row or tombstone of each key over the layers, of the buckets for which `only` holds."""
        roots: dict[str, list[str]] = {c: [c] for c in head["changes"]}
        for p in head["bases"].values():
            roots.setdefault(p.rpartition("/")[0], []).append(p)
        rows = None
        for root, paths in roots.items():
            layer = self._layer(root, paths, head["columns"])
            rows = layer if rows is None else rows.unionAll(layer)
        if rows is None:
            return None
        return self._last(rows if only is None else rows.where(only))

    def _last(self, rows: DataFrame) -> DataFrame:
        """Of the rows of a key the one last in order, a tombstone before a row of the same place, then the greatest in all columns."""
        rest = [c for c in rows.columns if c not in (*self.keys, *self.order)]
        rest.sort(key=lambda c: c != "__deleted")
        best = rows.groupBy(*self.keys).agg(F.max(F.struct(*[c for c in self.order if c in rows.columns], *rest)).alias("__r"))
        return best.select(*self.keys, "__r.*")

    def read(self, generation: int | None = None, with_order: bool = False) -> DataFrame | None:
        """The rows of a generation; None if nothing was ever committed."""
        images = self._images(self.header(generation))
        if images is None:
            return None
        return self._shown(images, with_order)

    def _shown(self, images: DataFrame, with_order: bool = False) -> DataFrame:
        return images.where(~F.col("__deleted")).drop("__deleted", "__bucket", *([] if with_order else self.order))

    def apply(self, changes: DataFrame, batch: str, op: str = "op") -> int:
        """Apply adds and updates (op 0) and deletes (op 1) at their places in the order; other ops are ignored, NULL places come first.
        A batch that was applied before does nothing."""
        if self.files.exists(f"batches/{file_name(batch)}"):
            return self.generation
        usable = changes.where(F.col(op).isin(UPSERT, DELETE)).withColumn("__deleted", F.col(op) == DELETE).drop(op)
        for c in self.order:
            if c not in usable.columns:
                usable = usable.withColumn(c, F.lit(None).cast("bigint"))
        return self._commit(self._last(usable), batch)

    def _write(self, images: DataFrame, path: str) -> None:
        keyed = images.withColumn("__bucket", self._bucket()).repartition(self.buckets, "__bucket").sortWithinPartitions("__bucket", *self.keys)
        keyed.write.mode("overwrite").option("compression", "zstd").partitionBy("__bucket").parquet(self.files.at(path))

    def _commit(self, images: DataFrame, batch: str) -> int:
        path = f"data/{file_name(batch)}"
        self._write(images, path)
        wrote = bool(self._touched(path))  # an empty batch leaves no files and adds no layer
        newest = self._newest(path) if wrote else [None] * len(self.order)
        # the type of an order column that holds no value yet is left open
        known = [f for f in images.schema if f.name != "__deleted" and (f.name not in self.order or newest[self.order.index(f.name)] is not None)]
        types = {f.name: f.dataType.simpleString() for f in known} if wrote else {}
        while True:
            head = self.header()
            content = {
                "generation": head["generation"] + 1,
                "bases": head["bases"],
                "changes": [c for c in head["changes"] if c != path] + ([path] if wrote else []),
                "columns": {**types, **head["columns"]},
                "newest": max(head["newest"] or [None] * len(self.order), newest, key=lambda x: [v or "" for v in x]),
            }
            if self.files.create(f"meta/{content['generation']:012d}", content):
                break
        self.files.create(f"batches/{file_name(batch)}", {"generation": content["generation"]})
        return self.merge() if len(content["changes"]) >= self.layers else content["generation"]

    def _touched(self, path: str) -> list[int]:
        """The buckets a layer has rows in."""
        return [int(n.partition("=")[2]) for n in self.files.names(path, hidden=True) if n.startswith("__bucket=")]

    def _newest(self, path: str) -> list[str | None]:
        row = self.spark.read.parquet(self.files.at(path)).agg(F.max(F.struct(*self.order)).alias("m")).select("m.*").first()
        text = lambda v: v.isoformat(" ") if isinstance(v, dt.datetime) else f"{v:020d}" if isinstance(v, int) else str(v)
        return [None if v is None else text(v) for v in row]

    def merge(self) -> int:
        """Fold the changes into new bases of the buckets they touch, tombstones kept, so that older changes that come later still find them."""
        head = self.header()
        touched = sorted({b for c in head["changes"] for b in self._touched(c)})
        if not touched:
            return head["generation"]
        generation = head["generation"] + 1
        path = f"base/{generation:012d}-{uuid.uuid4().hex}"
        self._write(self._images(head, F.col("__bucket").isin(*touched)), path)
        bases = {**head["bases"], **{str(b): f"{path}/__bucket={b}" for b in touched}}
        content = {**head, "generation": generation, "bases": bases, "changes": []}
        # where a commit came between, this merge is dropped and the next one takes its layer as well
        return generation if self.files.create(f"meta/{generation:012d}", content) else self.generation

    def _now(self, rows: DataFrame, columns: dict[str, str]) -> DataFrame:
        """rows at a place after all that was applied so far."""
        newest = self.header()["newest"] or [None] * len(self.order)
        for i, (c, v) in enumerate(zip(self.order, newest)):
            kind = columns.get(c, "bigint" if i else "timestamp")
            last = i == len(self.order) - 1
            value = F.lit(v if v is None or not v.isdigit() else int(v)).cast(kind)
            if last and kind in ("bigint", "int"):
                value = F.coalesce(value, F.lit(0).cast(kind)) + F.lit(1).cast(kind)
            rows = rows.withColumn(c, value)
        return rows

    def upsert(self, rows: DataFrame, batch: str) -> int:
        """Insert rows or replace those of the same key, whatever was applied before."""
        placed = self._now(rows.drop(*self.order), self.header()["columns"])
        return self.apply(placed.withColumn("op", F.lit(UPSERT)), batch)

    def delete(self, paths: DataFrame, batch: str) -> int:
        """Remove the rows with these keys; others, of the same name elsewhere too, stay. Unknown keys and repeated batches do nothing."""
        placed = self._now(paths.select(*self.keys), self.header()["columns"])
        return self.apply(placed.withColumn("op", F.lit(DELETE)), batch)

    def get(self, *values: str) -> DataFrame:
        """The record at a key, from the files of its bucket."""
        head = self.header()
        if not head["columns"]:
            raise LookupError("the store is empty")
        wanted = [F.lit(v).cast(head["columns"][k]) for k, v in zip(self.keys, values)]
        rows = self._images(head, F.col("__bucket") == self._bucket(wanted))
        for k, v in zip(self.keys, wanted):
            rows = rows.where(F.col(k).eqNullSafe(v))
        return self._shown(rows)

    def compact(self, target: str, files: int) -> None:
        """Copy the current rows into so many files."""
        rows = self.read()
        if rows is not None:
            rows.repartition(files).write.mode("overwrite").option("compression", "zstd").parquet(target)


def counters(records: DataFrame) -> DataFrame:
    """One row: records, distinct strings in names and parents, total size, newest time."""
    strings = records.select(F.explode(F.array("parent", "name")).alias("s")).where("s IS NOT NULL")
    one = records.agg(F.count("*").alias("records"), F.sum("size").alias("bytes"), F.max("mtime").alias("newest"))
    return one.crossJoin(strings.agg(F.countDistinct("s").alias("strings")))  # one row by one row


def intern(records: DataFrame, column: str) -> DataFrame:
    """Each distinct value once with an id that depends on the value alone."""
    return records.select(F.col(column).alias("value")).where("value IS NOT NULL").distinct().select(F.xxhash64("value").alias("string_id"), "value")
