"""Trigram postings and the index mode of search: set operations over posting lists instead of a scan."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkseek.operators.shared import SharedFolder, file_name
from sparkseek.plans.ast import And, Node, Not, Or, Term, applied, terms
from sparkseek.plans.compile import normalized, predicate

GRAM_FIELDS = {"name": "name_norm", "content": "content"}
FEW = 2_000
BUCKETS = 32
SCHEMAS = {"postings": "gram string, rec_id bigint, field string, bucket int", "grams": "field string, gram string, df bigint", "ids": "rec_id bigint"}
LAYOUT = 2  # of a stored index; raised when the files change


def bucket_of(gram: Column) -> Column:
    """The folder of a stored index that holds a gram's postings."""
    return F.pmod(F.xxhash64(gram), F.lit(BUCKETS)).cast("int")


def _codes(text: str) -> np.ndarray:
    """The distinct three-character windows of a text, 21 bits a character."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    return np.unique((c[:-2] << np.uint64(42)) | (c[1:-1] << np.uint64(21)) | c[2:]) if len(c) > 2 else np.empty(0, np.uint64)


def _texts(codes: np.ndarray) -> pa.Array:
    """The windows as strings, their UTF-8 laid out at once."""
    mask = np.uint64(0x1FFFFF)
    chars = np.stack([codes >> np.uint64(42), (codes >> np.uint64(21)) & mask, codes & mask], 1).astype(np.uint32).ravel()
    data = chars.tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass")
    widths = 1 + (chars > 0x7F) + (chars > 0x7FF) + (chars > 0xFFFF)
    offsets = np.concatenate([[0], np.cumsum(widths.reshape(-1, 3).sum(1))]).astype(np.int32)
    return pa.StringArray.from_buffers(len(codes), pa.py_buffer(offsets.tobytes()), pa.py_buffer(data))


def _lowered(records: DataFrame, field: str) -> DataFrame:
    """rec_id, text: lower case as the predicates take it, in the JVM."""
    return records.select(F.col("rec_id").cast("bigint").alias("rec_id"), F.lower(GRAM_FIELDS[field]).alias("text")).where(F.char_length("text") > 2)


def _postings(batches: Iterator[pa.RecordBatch], field: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, texts = batch.column("rec_id").to_numpy(zero_copy_only=False), batch.column("text")
        for at in range(0, len(ids), 500):
            found = [_codes(t.as_py()) for t in texts[at : at + 500]]
            codes = np.concatenate(found)
            owner = np.repeat(ids[at : at + 500], [len(c) for c in found])
            yield pa.RecordBatch.from_arrays([pa.array([field]).take(pa.array(np.zeros(len(codes), np.int32))), _texts(codes), pa.array(owner, pa.int64())], names=["field", "gram", "rec_id"])


def _counts(batches: Iterator[pa.RecordBatch], field: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        codes, n = np.unique(np.concatenate([_codes(t.as_py()) for t in batch.column("text")] or [np.empty(0, np.uint64)]), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array([field] * len(codes), pa.string()), _texts(codes), pa.array(n, pa.int64())], names=["field", "gram", "df"])


def build_postings(records: DataFrame, fields: Sequence[str] = ("name", "content")) -> DataFrame:
    """field, gram, rec_id: a row for each distinct trigram of each record's field. NULL and shorter texts have none."""
    out = None
    for f in fields:
        part = _lowered(records, f).mapInArrow(lambda it, f=f: _postings(it, f), "field string, gram string, rec_id bigint")
        out = part if out is None else out.unionAll(part)
    return out


def gram_stats(postings: DataFrame) -> DataFrame:
    """field, gram, df."""
    return postings.groupBy("field", "gram").agg(F.count("*").alias("df"))


def count_grams(records: DataFrame, fields: Sequence[str] = ("name", "content")) -> DataFrame:
    """gram_stats() of the records' postings without making them: counted batch by batch where the texts lie, so that only counts move."""
    out = None
    for f in fields:
        part = _lowered(records, f).mapInArrow(lambda it, f=f: _counts(it, f), "field string, gram string, df bigint")
        out = part if out is None else out.unionAll(part)
    return out.groupBy("field", "gram").agg(F.sum("df").alias("df"))


class GramIndex:
    """Postings kept in a folder: parts, each with a folder per field and bucket of grams and files sorted by gram, so that a lookup reads few row
    groups of one folder. Large buckets are split over tasks, small ones share one.

    add() indexes the records of a batch, remove() takes records out; each writes one part and the ids it is about, which hide those
    ids in all earlier parts, so upkeep costs what it touches. A batch that was entered before does nothing. merge() folds all parts
    into one. The list of parts is published whole or not at all, under the number of its generation.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.files = spark, SharedFolder(spark, folder)

    @property
    def generation(self) -> int:
        return max((int(n) for n in self.files.names("meta")), default=0)

    def parts(self) -> list[str]:
        g = self.generation
        return self.files.read(f"meta/{g:012d}")["parts"] if g else []

    def _publish(self, change: Callable[[list[str]], list[str]]) -> int:
        while True:
            g = self.generation + 1
            if self.files.create(f"meta/{g:012d}", {"parts": change(self.parts())}):
                return g

    def _write(self, part: str, postings: DataFrame, ids: DataFrame) -> None:
        placed = postings.select("field", bucket_of(F.col("gram")).alias("bucket"), "gram", "rec_id").hint("rebalance", "field", "bucket")
        placed.sortWithinPartitions("field", "bucket", "gram", "rec_id").write.mode("overwrite").partitionBy("field", "bucket").parquet(self.files.at(f"{part}/postings"))
        ids.write.mode("overwrite").parquet(self.files.at(f"{part}/ids"))
        written = self._read(part, "postings")
        if written is not None:
            gram_stats(written).write.mode("overwrite").parquet(self.files.at(f"{part}/grams"))

    def add(self, records: DataFrame, batch: str, fields: Sequence[str] = ("name", "content")) -> int:
        part = f"parts/{file_name(batch)}"
        if self.files.exists(f"batches/{file_name(batch)}"):
            return self.generation
        self._write(part, build_postings(records, fields), records.select("rec_id"))
        return self._entered(part, batch)

    def remove(self, ids: DataFrame, batch: str) -> int:
        part = f"parts/{file_name(batch)}"
        if self.files.exists(f"batches/{file_name(batch)}"):
            return self.generation
        ids.select("rec_id").write.mode("overwrite").parquet(self.files.at(f"{part}/ids"))
        return self._entered(part, batch)

    def _entered(self, part: str, batch: str) -> int:
        g = self._publish(lambda parts: [p for p in parts if p != part] + [part])
        self.files.create(f"batches/{file_name(batch)}", {"generation": g})
        return g

    def _read(self, part: str, what: str) -> DataFrame | None:
        path = f"{part}/{what}"
        if not any(n.endswith(".parquet") or n.startswith("field=") for n in self.files.names(path)):
            return None
        # the schema is given, so that no footer has to be read to know it
        return self.spark.read.schema(SCHEMAS[what]).parquet(self.files.at(path))

    def postings(self) -> DataFrame:
        """field, bucket, gram, rec_id of what is indexed now."""
        out = later = None
        for part in reversed(self.parts()):
            rows = self._read(part, "postings")
            if rows is not None:
                rows = (rows if later is None else rows.join(later, "rec_id", "left_anti")).select("field", "bucket", "gram", "rec_id")
                out = rows if out is None else out.unionAll(rows)
            ids = self._read(part, "ids")
            if ids is not None:
                later = ids if later is None else later.unionAll(ids)
        return self.spark.createDataFrame([], "field string, bucket int, gram string, rec_id bigint") if out is None else out

    def stats(self) -> DataFrame:
        """field, gram, df over all parts; an upper bound where a part hides ids of earlier ones, which serves for the order of lookups."""
        found = [rows for part in self.parts() if (rows := self._read(part, "grams")) is not None]
        if not found:
            return self.spark.createDataFrame([], "field string, gram string, df bigint")
        out = found[0]
        for rows in found[1:]:
            out = out.unionAll(rows)
        return out if len(found) == 1 else out.groupBy("field", "gram").agg(F.sum("df").alias("df"))

    def merge(self) -> int:
        parts = self.parts()
        if len(parts) < 2:
            return self.generation
        part = f"parts/merged-{self.generation + 1:012d}"
        rows = self.postings()
        self._write(part, rows, rows.select("rec_id").distinct())
        return self._publish(lambda now: [part] + [p for p in now if p not in parts])


def grams_of(term: str) -> list[str]:
    t = term.lower()
    return sorted({t[i : i + 3] for i in range(len(t) - 2)})


def rarest_first(terms: Sequence[tuple[str, str]], stats: DataFrame | None) -> dict[tuple[str, str], list[str]]:
    """The grams of each (field, term) by ascending frequency, one that no record has first. All are looked up at once."""
    grams = {t: grams_of(t[1]) for t in terms}
    wanted = sorted({(f, g) for (f, _), gs in grams.items() for g in gs})
    if stats is None or not wanted:
        return grams
    fields = sorted({f for f, _ in wanted})
    asked = stats.where(F.col("field").isin(*fields) & F.col("gram").isin(*sorted({g for _, g in wanted})))
    df = {(r["field"], r["gram"]): r["df"] for r in asked.select("field", "gram", "df").collect()}  # at most as many rows as grams in the query
    return {(f, t): sorted(gs, key=lambda g: (df.get((f, g), 0), g)) for (f, t), gs in grams.items()}


def candidates(postings: DataFrame, field: str, grams: Sequence[str], most: int = 8) -> DataFrame:
    """rec_id of the records that have the first `most` of the grams: a superset of a term's matches, exactly them for one gram that is the term.

    The grams go into the scan as a pushed-down IN filter, and of a stored index only their folders are read.
    """
    used = list(grams)[:most]
    hits = postings.where((F.col("field") == field) & F.col("gram").isin(*used))
    if "bucket" in postings.columns:
        hits = hits.where(F.col("bucket").isin(*[bucket_of(F.lit(g)) for g in used]))
    if len(used) == 1:
        return hits.select("rec_id")
    return hits.groupBy("rec_id").agg(F.count("*").alias("n")).where(F.col("n") == len(used)).select("rec_id")


def index_search(
    records: DataFrame, postings: DataFrame, node: Node | None, stats: DataFrame | None = None, keep: Callable[[str, Callable[[], DataFrame]], DataFrame] | None = None, few: int = FEW
) -> DataFrame:
    """rec_id of the records that match, by set operations: AND intersects, OR unites, NOT is the complement among all records.

    Name and content terms of three characters or more come from the postings. Where the sets are exact (terms of three characters)
    differences and complements are taken of them too; where they hold too much, what the rest of the query asks is verified in the
    end, on the records that are left: up to `few` of them go into the scan as a pushed-down filter, more are joined. Only a query of which
    no part can use the postings scans all records. keep(key, make) may hold the sets of single terms for later queries. Gives the
    same as a scan with predicate().
    """
    node = applied(node)
    ids = records.select("rec_id")
    keep = keep or (lambda _, make: make())
    as_stored = lambda t: normalized(t.value) if t.field == "name" else t.value
    grams = rarest_first(list(dict.fromkeys((t.field, as_stored(t)) for t in terms(node) if t.field in GRAM_FIELDS and len(as_stored(t).lower()) >= 3)), stats)

    def run(n: Node) -> tuple[DataFrame | None, bool]:
        """(ids that may match, None for any; whether they all do)"""
        match n:
            case And(left, Not(child)):
                (a, sure), (b, exact) = run(left), run(child)
                if a is None or b is None or not exact:
                    return a, False
                return a.join(b, "rec_id", "left_anti"), sure
            case And(left, right):
                (a, sure), (b, exact) = run(left), run(right)
                if a is None or b is None:
                    return (b if a is None else a), False
                return a.join(b, "rec_id", "left_semi"), sure and exact
            case Or(left, right):
                (a, sure), (b, exact) = run(left), run(right)
                return (None, False) if a is None or b is None else (a.unionAll(b).distinct(), sure and exact)
            case Not(child):
                a, sure = run(child)
                return (ids.join(a, "rec_id", "left_anti"), True) if a is not None and sure else (None, False)
            case Term(field, _, whole) if (field, as_stored(n)) in grams:
                term = as_stored(n)
                found = keep(f"{field}:{term}", lambda: candidates(postings, field, grams[field, term]))
                return found, len(term.lower()) == 3 and not whole
        return None, False

    if node is None:
        return ids
    found, sure = run(node)
    if found is None:
        return records.where(predicate(node)).select("rec_id")
    if sure:
        return ids.join(found, "rec_id", "left_semi")
    sample = [r["rec_id"] for r in found.limit(few + 1).collect()]  # at most few + 1 ids
    left = records.where(F.col("rec_id").isin(*sample)) if len(sample) <= few else records.join(found, "rec_id", "left_semi")
    return left.where(predicate(node)).select("rec_id")
