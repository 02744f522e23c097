"""Search over records: predicate, permission, relevance, top k."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkseek.config import Config
from sparkseek.functions.rank import CONTENT_LENGTH, NAME_LENGTH, corpus_relevance, relevance, simple_relevance
from sparkseek.functions.text import file_class, snippet
from sparkseek.operators.cache import ResultCache
from sparkseek.operators.postings import index_search
from sparkseek.plans.ast import Node, Term, canonical, positive, terms
from sparkseek.plans.compile import METADATA, predicate
from sparkseek.plans.parser import parse

LIMIT, WIDE_LIMIT = 200, 1000
STAGES = {"name": (0, 60), "metadata": (1, 75), "content": (2, 95)}  # stage and confidence of a hit
SORTS = ("name", "path", "size", "modified", "score")


def allowed(records: DataFrame, acl: DataFrame, principal: str) -> DataFrame:
    """The records the principal may see: those whose parent begins with one of its path prefixes, in any case. No prefix, no record.

    acl: principal, path_prefix. Paths are cut into their leading folders, so the semi-join is by equality.
    A prefix stands for the folder it names and what is below it.
    """
    norm = lambda c: F.regexp_replace(F.translate(F.lower(c), "/", "\\"), r"\\+$", "")
    mine = acl.where((F.col("principal") == principal) & F.col("path_prefix").isNotNull()).select(norm(F.col("path_prefix")).alias("__prefix")).distinct()
    parts = F.split(norm(F.col("parent")), r"\\")
    folders = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "\\"))
    heads = records.select("rec_id", F.explode(F.array_distinct(folders)).alias("__prefix")).join(mine, "__prefix", "left_semi")
    return records.join(heads.select("rec_id").distinct(), "rec_id", "left_semi")


def first_term(node: Node | None, field: str) -> str | None:
    return next((t.value for t in terms(node) if t.field == field), None)


def statistics(records: DataFrame, hits: DataFrame | Column) -> DataFrame:
    """One row: total records, hits, average lengths of names and contents in bytes. hits as a predicate is counted in the same pass."""
    wanted = [F.count("*").alias("total"), F.avg(F.octet_length("name")).alias("avg_name"), F.avg(F.octet_length("content")).alias("avg_content")]
    if isinstance(hits, Column):
        return records.agg(*wanted, F.count(F.when(hits, 1)).alias("df"))
    return records.agg(*wanted).crossJoin(hits.agg(F.count("*").alias("df")))  # one row by one row


def score(records: DataFrame, hits: DataFrame | Column, node: Node | None, as_of: dt.date, rank: str = "full", mode: str = "compat") -> DataFrame:
    """hits (rows, or a predicate over the records) with their score. compat: the first name and content term count, with fixed average lengths and the number of
    hits as document frequency. corpus: every name and content term not under NOT counts, with the corpus' average lengths and
    its own document frequency, whatever else the query asks."""
    found = records.where(hits) if isinstance(hits, Column) else hits
    metadata = {f: v for f in (*METADATA, "ext") if (v := first_term(node, f)) is not None}
    if rank == "full" and mode == "corpus":
        counted = list(dict.fromkeys(t for t in positive(node) if t.field in ("name", "content")))
        dfs = [F.count(F.when(predicate(t), 1)).alias(f"__df{i}") for i, t in enumerate(counted)]
        one = records.agg(F.count("*").alias("__total"), F.avg(F.octet_length("name")).alias("__name"), F.avg(F.octet_length("content")).alias("__content"), *dfs)
        value = corpus_relevance(as_of, F.col("__total"), [(t.field, t.value, F.col(f"__df{i}")) for i, t in enumerate(counted)], metadata, {"name": F.col("__name"), "content": F.col("__content")})
        return found.crossJoin(F.broadcast(one)).select(*found.columns, F.round(value, 6).alias("score"))  # a single row
    joined = found.crossJoin(F.broadcast(statistics(records, hits)))  # a single row
    if rank == "simple":
        value = simple_relevance(as_of, F.col("total"), F.col("df"), first_term(node, "name"))
    else:
        value = relevance(as_of, F.col("total"), F.col("df"), first_term(node, "name"), first_term(node, "content"), metadata, (NAME_LENGTH, CONTENT_LENGTH))
    return joined.withColumn("score", F.round(value, 6)).drop("total", "df", "avg_name", "avg_content")


def search(
    records: DataFrame,
    query: str,
    as_of: dt.date,
    rank: str = "full",
    limit: int | None = LIMIT,
    mode: str = "scan",
    postings: DataFrame | None = None,
    stats: DataFrame | None = None,
    acl: DataFrame | None = None,
    principal: str | None = None,
    bm25: str = "compat",
    where: Column | None = None,
    cache: ResultCache | None = None,
    generation: int = 0,
    config: Config | None = None,
) -> DataFrame:
    """The best hits of a query: the record's columns, score, in descending order of score, ties by rec_id.

    mode "scan" filters the records, "index" goes by the postings, "auto" by the postings if they are given and the query has a term
    they serve. where filters the hits further (see plans.compile.filters). Permissions come before the limit. With a cache, results of
    whole queries and, in index mode, of single terms are kept under the generation, which must rise with the records and the permissions, and used again; queries with
    filters of their own are not kept. config gives the limit. A query that cannot be parsed raises QueryError, an empty one matches all.
    """
    node = parse(query, as_of)
    if config is not None and limit == LIMIT:
        limit = config.limit

    def find() -> DataFrame:
        pool = records if acl is None else allowed(records, acl, principal or "")
        chosen = mode
        if mode == "auto":
            chosen = "index" if postings is not None and any(t.field in ("name", "content") and len(t.value) >= 3 for t in terms(node)) else "scan"
        asked = predicate(node) if where is None else predicate(node) & where
        hits = asked
        if chosen == "index":
            if postings is None:
                raise ValueError("index mode needs postings")
            keep = None if cache is None else lambda key, make: cache.get(generation, f"term {key}", make)
            hits = pool.join(index_search(pool, postings, node, stats, keep), "rec_id", "left_semi")
            hits = hits if where is None else hits.where(where)
        ranked = score(pool, hits, node, as_of, rank, bm25).orderBy(F.desc("score"), "rec_id")
        return ranked if limit is None else ranked.limit(limit)

    if cache is None or where is not None:
        return find()
    return cache.get(generation, f"query {canonical(node)} {as_of} {rank} {bm25} {limit} {principal if acl is not None else '*'}", find)


def presented(hits: DataFrame) -> DataFrame:
    """Hits as they are shown: path, size, mtime, score, class and snippet."""
    path = F.concat_ws("\\", "parent", "name")
    return hits.select("rec_id", path.alias("path"), "size", "mtime", "score", file_class(F.col("ext")).alias("type"), snippet(F.col("content")).alias("snippet"))


def sort_hits(hits: DataFrame, by: str = "score", descending: bool = True) -> DataFrame:
    """Hits in the order of name, path, size, modified or score; ties by rec_id, NULLs last."""
    if by not in SORTS:
        raise ValueError(f"sort by one of {SORTS}")
    columns = {"name": [F.col("name")], "path": [F.col("parent"), F.col("name")], "size": [F.col("size")], "modified": [F.col("mtime")], "score": [F.col("score")]}[by]
    return hits.orderBy(*[c.desc_nulls_last() if descending else c.asc_nulls_last() for c in columns], "rec_id")


def staged(records: DataFrame, query: str, as_of: dt.date, cache: ResultCache | None = None, generation: int = 0) -> DataFrame:
    """rec_id, stage, confidence of each hit: the best stage in which one of the query's positive terms finds it (name 0, metadata 1, content 2)."""
    node = parse(query, as_of)
    hits = records.where(predicate(node))
    by_stage = []
    for t in terms(node):
        kind = "name" if t.field in ("name", "regex", "ext") else "content" if t.field == "content" else "metadata"
        stage, confidence = STAGES[kind]
        by_stage.append(F.when(predicate(Term(t.field, t.value)), F.struct(F.lit(stage).alias("stage"), F.lit(confidence).alias("confidence"))))
    none = F.struct(F.lit(0).alias("stage"), F.lit(0).alias("confidence"))
    best = F.coalesce(F.greatest(*by_stage) if len(by_stage) > 1 else by_stage[0], none) if by_stage else none
    found = hits.select("rec_id", best.alias("b")).select("rec_id", "b.stage", "b.confidence")
    return found if cache is None else cache.get(generation, f"stages {canonical(node)} {as_of}", lambda: found)


def best_stage(staged_hits: DataFrame) -> DataFrame:
    """Of several rows per rec_id the one with the highest stage, then confidence."""
    return staged_hits.groupBy("rec_id").agg(F.max(F.struct("stage", "confidence")).alias("b")).select("rec_id", "b.stage", "b.confidence")


def children(records: DataFrame, parent: str | None = None) -> DataFrame:
    """parent, n: how many records lie directly in each folder, or in one."""
    pool = records if parent is None else records.where(F.col("parent") == parent)
    return pool.groupBy("parent").agg(F.count("*").alias("n"))


def two_tiers(hits: DataFrame, details: DataFrame, hot: int = WIDE_LIMIT) -> DataFrame:
    """The first `hot` hits by score, joined with their details only after the cut."""
    top = hits.select("rec_id", "score").orderBy(F.desc("score"), "rec_id").limit(hot)
    return details.join(top, "rec_id")
