"""Queries of the search engine's operators, with their SQL."""

from __future__ import annotations

import datetime as dt
import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkseek.functions import hashes, paths, rank, symbols, text
from sparkseek.model import document_records, item_records, part_records
from sparkseek.operators import dedup, postings, search, sinks, store
from sparkseek.operators.shared import SharedFolder
from sparkseek.plans.compile import has_attributes, predicate
from sparkseek.plans.parser import parse
from sparkseek.session import read_table, shared_dir, work_folder
from sparkseek.sources.dumps import unseen
from sparkseek.streaming import changes as streams

AS_OF = dt.date(2026, 4, 1)
QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def stored_index(spark: SparkSession, sf_dir: str) -> postings.GramIndex:
    """The index of the documents below the shared folder; made if there is none for the files as they are."""
    fs = SharedFolder(spark, sf_dir)
    seen = [(str(f.getPath()), f.getLen(), f.getModificationTime()) for f in fs._fs.globStatus(fs._path(fs.at("documents.parquet")))]
    folder = f"{shared_dir(spark).rstrip('/')}/grams-{postings.LAYOUT}-{hashlib.sha256(repr(sorted(seen)).encode()).hexdigest()[:24]}"
    index = postings.GramIndex(spark, folder)
    if index.generation == 0:
        index.add(document_records(spark, sf_dir), "all")
    return index


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _matches(name: str, q: str, condition: str, records=document_records, table: str = "documents", id_: str = "doc_id") -> None:
    """A query that gives the rec_id of all matches of a query text, and its SQL."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return records(spark, sf_dir).where(predicate(parse(q, AS_OF))).select("rec_id")

    run.__name__, run.__doc__ = name, f"All matches of {q}"
    QUERIES[name] = run
    ORACLE_SQL[name] = f"SELECT {id_} AS rec_id FROM {table} WHERE {condition}"


_C = "contains(lower(text), '{}')".format
_NORM = r"translate(translate(regexp_replace({}, '\.[^.]*$', ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '_-.', '   ')".format
_EXT = r"lower(regexp_extract({}, '\.([^.]+)$', 1))".format

_matches("q_content_term", "content:fertiliser", _C("fertiliser"))
_matches("q_content_and_not", "content:fertiliser AND NOT content:museum size:>1k", f"{_C('fertiliser')} AND NOT {_C('museum')} AND n_chars > 1024")
_matches("q_content_or", "content:fertiliser OR content:película", f"{_C('fertiliser')} OR {_C('película')}")
_matches("q_content_phrase", 'content:"Nobody restored the"', _C("nobody restored the"))
_matches("q_paren_precedence", "(content:fertiliser OR content:museum) AND content:orchard", f"({_C('fertiliser')} OR {_C('museum')}) AND {_C('orchard')}")
_matches("q_precedence", "content:fertiliser OR content:museum AND content:orchard", f"{_C('fertiliser')} OR ({_C('museum')} AND {_C('orchard')})")
_matches("q_not_not", "NOT NOT content:orchard", _C("orchard"))
_matches("q_not_null_name", "NOT name:budget", f"NOT coalesce(contains({_NORM('name')}, 'budget'), false)")
_matches("q_name_term", "name:budget OR ledger", f"contains({_NORM('name')}, 'budget') OR contains({_NORM('name')}, 'ledger')")
_matches("q_ext", "ext:PDF", f"{_EXT('name')} = 'pdf'")
_matches("q_field_exact", "author:de", "lang = 'de'")
_matches("q_field_not", "NOT author:en", "lang IS DISTINCT FROM 'en'")
_matches("q_size_range", "size:1k..4k", "n_chars BETWEEN 1024 AND 4096")
_matches("q_size_bounds", "size:>2.5k size:<10k", "n_chars > 2560 AND n_chars < 10240")
_matches("q_size_equal", "size:302 OR size:300", "n_chars = 302 OR n_chars = 300")
_matches("q_date_range", "dm:2025-01..2025-06-30", "CAST(modified_time AS DATE) BETWEEN DATE '2025-01-01' AND DATE '2025-06-30'")
_matches("q_date_bounds", "dm:>90d dm:<yesterday", "CAST(modified_time AS DATE) > DATE '2026-01-01' AND CAST(modified_time AS DATE) < DATE '2026-03-31'")
_matches("q_path_prefix", r"path:GIT\docs", r"starts_with(lower(parent_path), 'git\docs')")
_matches("q_regex", r'regex:"^[a-m]\w+[ _-]\d{3}\."', r"regexp_matches(name, '^[a-m]\w+[ _-]\d{3}\.')")
_matches("q_whole_word", "name:mail whole:yes OR name:budget", rf"regexp_matches({_NORM('name')}, '(^|[^a-z0-9_])mail($|[^a-z0-9_])') OR regexp_matches({_NORM('name')}, '(^|[^a-z0-9_])budget($|[^a-z0-9_])')")
_matches("q_implicit_and", "content:museum content:orchard", f"{_C('museum')} AND {_C('orchard')}")
_matches("q_empty", "", "true")
_matches("q_part_term", "name:a size:<20", f"contains({_NORM('p_name')}, 'a') AND p_size < 20", part_records, "part", "p_partkey")


def _windows(name: str, p: str, d: int) -> str:
    m = len(p)
    return f"""CASE WHEN length({name}) <= {m} THEN levenshtein({name}, '{p}') <= {d} ELSE len(list_filter(range({max(1, m - d)}, {m + d + 1}),
      lambda l: len(list_filter(range(1, greatest(1, length({name}) - l + 1) + 1), lambda i: levenshtein(substr({name}, CAST(i AS INTEGER), CAST(l AS INTEGER)), '{p}') <= {d})) > 0)) > 0 END"""


@query(f"SELECT p_partkey AS rec_id FROM part WHERE {_windows(_NORM('p_name'), 'rimg', 1)}")
def q_fuzzy_name(spark, sf_dir):
    return part_records(spark, sf_dir).where(predicate(parse("fuzzy:rimg~1"))).select("rec_id")


@query("SELECT a.n_name AS a, b.n_name AS b, levenshtein(a.n_name, b.n_name) AS d FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
def q_levenshtein(spark, sf_dir):
    n = read_table(spark, sf_dir, "nation")
    a, b = (n.select(F.col("n_nationkey").alias(f"k{x}"), F.col("n_name").alias(x), F.col("n_regionkey").alias("r")) for x in "ab")
    return a.join(b, "r").where("ka < kb").select("a", "b", F.levenshtein("a", "b").cast("bigint").alias("d"))


@query(f"SELECT p_partkey AS rec_id, {_NORM('p_name')} AS name_norm, {_EXT('p_name')} AS ext FROM part")
def q_name_norm(spark, sf_dir):
    p = read_table(spark, sf_dir, "part")
    return p.select(F.col("p_partkey").alias("rec_id"), text.normalize_name(F.col("p_name")).alias("name_norm"), text.extension(F.col("p_name")).alias("ext"))


@query(f"SELECT {_EXT('name')} AS ext, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS size FROM documents GROUP BY 1")
def q_ext_counts(spark, sf_dir):
    return document_records(spark, sf_dir).groupBy("ext").agg(F.count("*").alias("n"), F.sum("size").alias("size"))


@query("SELECT doc_id AS rec_id, CAST((length(lower(text)) - length(replace(lower(text), 'museum', ''))) / 6 AS INTEGER) AS tf FROM documents")
def q_tf(spark, sf_dir):
    return document_records(spark, sf_dir).select("rec_id", text.occurrences(F.col("content"), "museum").alias("tf"))


_BM25 = "ln((CAST(s.total AS DOUBLE) - h.df + 0.5) / (h.df + 0.5) + 1.0) * ({tf} * 2.5 / ({tf} + 1.5 * (0.25 + 0.75 * {dl} / {avg})))".format
_TF = "(length(lower({c})) - length(replace(lower({c}), '{t}', ''))) / {n}".format
_RECENCY = "CASE WHEN age < 0 THEN 0.0 WHEN age < 7 THEN 1.0 WHEN age < 30 THEN 0.5 ELSE 0.0 END"


def _ranked(avg: str, where: str, score: str, limit: str = "LIMIT 200") -> str:
    return f"""WITH s AS (SELECT count(*) AS total, avg(strlen(name)) AS avg_name, avg(strlen(text)) AS avg_content FROM documents),
m AS (SELECT *, datediff('day', CAST(modified_time AS DATE), DATE '2026-04-01') AS age FROM documents WHERE {where}), h AS (SELECT count(*) AS df FROM m)
SELECT doc_id AS rec_id, round({score}, 6) AS score FROM m, s, h ORDER BY score DESC, rec_id {limit}""".replace("{avg}", avg)


_CONTENT = f"0.4 * coalesce(CASE WHEN {_TF(c='text', t='museum', n=6)} > 0 THEN {_BM25(tf=_TF(c='text', t='museum', n=6), dl='strlen(text)', avg='{avg}')} END, 0) + 0.1 * coalesce({_RECENCY}, 0.0)"


@query(_ranked("1000.0", _C("museum"), _CONTENT))
def q_bm25_compat(spark, sf_dir):
    return search.search(document_records(spark, sf_dir), "content:museum", AS_OF).select("rec_id", "score")


@query(_ranked("s.avg_content", _C("museum"), _CONTENT))
def q_bm25_corpus(spark, sf_dir):
    return search.search(document_records(spark, sf_dir), "content:museum", AS_OF, bm25="corpus").select("rec_id", "score")


_NAME = f"""0.4 * (coalesce(CASE WHEN {_TF(c='name', t='budget', n=6)} > 0 THEN {_BM25(tf=_TF(c='name', t='budget', n=6), dl='strlen(name)', avg='16.0')} END, 0)
  + CASE WHEN lower(name) = 'budget' THEN 2.0 WHEN starts_with(lower(name), 'budget') THEN 1.0 ELSE 0.0 END)
  + 0.1 * CASE WHEN lower(lang) = 'en' THEN 1.0 ELSE 0.0 END + 0.1 * coalesce({_RECENCY}, 0.0)"""


@query(_ranked("16.0", f"contains({_NORM('name')}, 'budget') AND lang = 'en'", _NAME))
def q_rank_full(spark, sf_dir):
    return search.search(document_records(spark, sf_dir), "name:budget author:en", AS_OF).select("rec_id", "score")


@query(
    _ranked(
        "16.0",
        f"contains({_NORM('name')}, 'budget')",
        """coalesce(CASE WHEN lower(name) = 'budget' THEN 3.0 WHEN starts_with(lower(name), 'budget') THEN 2.0 WHEN contains(lower(name), 'budget') THEN 1.0 END, 0.0)
  + 0.1 * ln((CAST(s.total AS DOUBLE) + 1) / (h.df + 1)) + coalesce(CASE WHEN age > 0 THEN 1.0 / (1.0 + age / 365.0) END, 0.0)""",
    )
)
def q_rank_simple(spark, sf_dir):
    return search.search(document_records(spark, sf_dir), "name:budget", AS_OF, rank="simple").select("rec_id", "score")


@query("SELECT doc_id AS rec_id, name, n_chars AS size FROM documents WHERE contains(lower(text), 'orchard') ORDER BY n_chars DESC NULLS LAST, doc_id LIMIT 50")
def q_topk_sorted(spark, sf_dir):
    hits = search.search(document_records(spark, sf_dir), "content:orchard", AS_OF, limit=None)
    return search.sort_hits(hits, "size").select("rec_id", "name", "size").limit(50)


@query(
    r"""WITH d AS (SELECT doc_id, string_split(lower(name), '') AS c FROM (SELECT doc_id, translate(translate(regexp_replace(name, '\.[^.]*$', ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '_-.', '   ') AS name FROM documents WHERE name IS NOT NULL))
SELECT DISTINCT 'name' AS field, g AS gram, doc_id AS rec_id FROM (SELECT doc_id, unnest(list_transform(range(1, CAST(len(c) - 1 AS BIGINT)), lambda i: c[i] || c[i + 1] || c[i + 2])) AS g FROM d WHERE len(c) > 2)"""
)
def q_trigram_index(spark, sf_dir):
    return postings.build_postings(document_records(spark, sf_dir), ["name"])


@query(
    r"""WITH d AS (SELECT doc_id, string_split(lower(text), '') AS c FROM documents)
SELECT 'content' AS field, g AS gram, count(DISTINCT doc_id) AS df FROM (SELECT doc_id, unnest(list_transform(range(1, CAST(len(c) - 1 AS BIGINT)), lambda i: c[i] || c[i + 1] || c[i + 2])) AS g FROM d WHERE len(c) > 2) GROUP BY g"""
)
def q_gram_stats(spark, sf_dir):
    return postings.count_grams(document_records(spark, sf_dir), ["content"])


@query(f"SELECT doc_id AS rec_id FROM documents WHERE {_C('museum')} AND NOT {_C('orchard')} OR coalesce(contains({_NORM('name')}, 'budget'), false)")
def q_index_search(spark, sf_dir):
    """From the stored index, which is made when it is asked for the first time."""
    index = stored_index(spark, sf_dir)
    return postings.index_search(document_records(spark, sf_dir), index.postings(), parse("content:museum AND NOT content:orchard OR name:budget"), index.stats())


@query(
    r"""WITH d AS (SELECT doc_id, string_split(lower(text), '') AS c FROM documents)
SELECT 'content' AS field, count(DISTINCT g) AS grams, count(DISTINCT (doc_id, g)) AS postings FROM (SELECT doc_id, unnest(list_transform(range(1, CAST(len(c) - 1 AS BIGINT)), lambda i: c[i] || c[i + 1] || c[i + 2])) AS g FROM d WHERE len(c) > 2)"""
)
def q_index_build(spark, sf_dir):
    """Makes the stored index and counts what it holds."""
    stats = stored_index(spark, sf_dir).stats().where("field = 'content'")
    return stats.groupBy("field").agg(F.count("*").alias("grams"), F.sum("df").alias("postings"))


@query("SELECT n_chars AS size, sha256(text) AS content_hash, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY 1, 2 HAVING count(*) > 1")
def q_duplicates(spark, sf_dir):
    return dedup.duplicate_groups(document_records(spark, sf_dir).withColumn("content_hash", dedup.content_key()))


@query("SELECT item_id AS rec_id, min(item_id) OVER w AS first_id, count(*) OVER w AS n, content_hash FROM (SELECT item_id, sha256(content) AS content_hash FROM content_items WHERE content IS NOT NULL) WINDOW w AS (PARTITION BY content_hash) QUALIFY n > 1")
def q_dup_members(spark, sf_dir):
    return dedup.members(item_records(spark, sf_dir).withColumn("content_hash", dedup.content_key()), ["content_hash"])


@query("SELECT item_id AS rec_id FROM (SELECT item_id, content, row_number() OVER (PARTITION BY content ORDER BY item_id) AS rn FROM content_items) WHERE rn = 1 OR content IS NULL")
def q_dup_keep_first(spark, sf_dir):
    return dedup.keep_first(item_records(spark, sf_dir).withColumn("content_hash", dedup.content_key()), ["content_hash"]).select("rec_id")


@query("SELECT item_id AS rec_id, row_number() OVER (PARTITION BY content ORDER BY parent_path, name, item_id) AS number FROM content_items WHERE content IS NOT NULL QUALIFY count(*) OVER (PARTITION BY content) > 1")
def q_dup_runs(spark, sf_dir):
    return dedup.runs(item_records(spark, sf_dir).withColumn("content_hash", dedup.content_key()), ["content_hash"]).select("rec_id", F.col("number").cast("bigint").alias("number"))


_PAGE = "'<html><head><title>' || n_name || '</title><style>p {x}</style></head><body><script>var a = 1;</script><p>In ' || n_name || '</p><p>' || n_regionkey || '</p></body></html>'"


def _pages(spark, sf_dir):
    return read_table(spark, sf_dir, "nation").select("n_nationkey", F.expr(_PAGE).alias("html"))


@query(r"SELECT n_nationkey, n_name || ' In ' || n_name || ' ' || n_regionkey AS text, n_name AS title, n_name || 'p {x}var a = 1;In ' || n_name || n_regionkey AS naive FROM nation")
def q_html(spark, sf_dir):
    h = F.col("html")
    return _pages(spark, sf_dir).select("n_nationkey", text.html_text(h).alias("text"), text.html_title(h).alias("title"), text.strip_tags(h).alias("naive"))


@query(r"SELECT doc_id AS rec_id, trim(regexp_extract(text, '(?i)author:[ \t]*([^\r\n]{0,255})', 1)) AS author, trim(regexp_extract(text, '(?i)subject:[ \t]*([^\r\n]{0,255})', 1)) AS subject FROM documents")
def q_author_title_sniff(spark, sf_dir):
    d = document_records(spark, sf_dir)
    return d.select("rec_id", F.trim(text.sniffed(F.col("content"), "author")).alias("author"), F.trim(text.sniffed(F.col("content"), "subject")).alias("subject"))


_LINES = r"""WITH l AS (SELECT doc_id AS rec_id, unnest(string_split_regex(text, '\r?\n')) AS line, generate_subscripts(string_split_regex(text, '\r?\n'), 1) AS line_no FROM documents),
t AS (SELECT rec_id, CAST(line_no AS INTEGER) AS line_no, regexp_replace(line, '^\s+', '') AS t FROM l),
s AS (SELECT *, regexp_extract(t, '^[^(]*?\b(\w+)\s*\([^{]*\{', 1) AS called FROM t WHERE t <> '' AND NOT regexp_matches(t, '^(#|//|/\*|\*)'))"""
_DECLARES = (
    ("function", r"^def \s*(\w*)"), ("class", r"^class \s*(\w*)"), ("class", r"^(?:struct|enum|interface|trait) \s*(\w*)"), ("class", r"^type \s*(\w*)\s*(?:struct|interface)"),
    ("function", r"^fn \s*(\w*)"), ("function", r"^func (?:\([^)]*\))?\s*(\w*)"), ("function", r"^(?:Function|Sub) \s*(\w*)"), ("var", r"^(?:let|var|const|Dim) \s*(\w*)"),
)
_SETS = (("var", r"^.*?(\w+)\s*:="), ("var", r"^[^=]*?(\w+)\s*=(?:[^=]|$)"))


def _symbol_case(kinds: bool) -> str:
    cases = [f"WHEN regexp_matches(t, '{p}') THEN " + (f"'{k}'" if kinds else f"regexp_extract(t, '{p}', 1)") for k, p in _DECLARES]
    cases += ["WHEN called <> '' AND called NOT IN ('if', 'for', 'while', 'switch', 'catch') THEN " + ("'function'" if kinds else "called")]
    cases += [f"WHEN regexp_matches(t, '{p}') THEN " + (f"'{k}'" if kinds else f"regexp_extract(t, '{p}', 1)") for k, p in _SETS]
    return "CASE " + " ".join(cases) + " END"


@query(f"{_LINES} SELECT rec_id, line_no, {_symbol_case(True)} AS kind, {_symbol_case(False)} AS name FROM s WHERE coalesce({_symbol_case(False)}, '') <> ''")
def q_code_symbols(spark, sf_dir):
    return symbols.code_symbols(document_records(spark, sf_dir))


@query(
    r"""SELECT DISTINCT parent_path, regexp_extract(parent_path, '(?s)^(.*)[\\/][^\\/]*$', 1) AS dirname, regexp_extract(parent_path, '([^\\/]*)$', 1) AS basename,
CASE WHEN regexp_matches(parent_path, '^[A-Za-z]:') THEN regexp_extract(parent_path, '^([A-Za-z]:)', 1) || '\' ELSE regexp_extract(parent_path, '^(\\\\[^\\/]+\\[^\\/]+)', 1) END AS root FROM work_items WHERE parent_path IS NOT NULL"""
)
def q_path_parts(spark, sf_dir):
    p = F.col("parent_path")
    w = read_table(spark, sf_dir, "work_items").where(p.isNotNull()).select("parent_path").distinct()
    return w.select("parent_path", paths.path_dirname(p).alias("dirname"), paths.path_basename(p).alias("basename"), paths.drive_root(p).alias("root"))


@query("SELECT doc_id AS rec_id FROM documents WHERE source NOT IN (SELECT source FROM content_items WHERE source IS NOT NULL)")
def q_seen_anti_join(spark, sf_dir):
    seen = read_table(spark, sf_dir, "content_items").select("source").where("source IS NOT NULL")
    new = unseen(document_records(spark, sf_dir).select("source"), seen, "source")
    return document_records(spark, sf_dir).join(new, "source", "left_semi").select("rec_id")


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def q_json_props(spark, sf_dir):
    return read_table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").cast("bigint").alias("k"))


@query("SELECT user_id, event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1")
def q_latest_version(spark, sf_dir):
    e = read_table(spark, sf_dir, "events").select("user_id", "event_type", "ts", "event_id", "value")
    return dedup.latest(e, ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id", "value")


_APPLIED = "SELECT event_type AS parent, CAST(user_id AS VARCHAR) AS name, event_id AS size FROM (SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY event_type, user_id ORDER BY ts DESC, event_id DESC) = 1) WHERE event_id % 7 <> 0"


def _event_changes(e: DataFrame) -> DataFrame:
    return e.select(
        F.col("event_type").alias("parent"), F.col("user_id").cast("string").alias("name"), F.when(F.col("event_id") % 7 == 0, 1).otherwise(0).alias("op"),
        F.col("event_id").alias("size"), F.col("event_id").alias("seq"), F.col("ts").alias("event_time"),
    )


def _thirds(e: DataFrame) -> list[DataFrame]:
    """The changes in three parts of which the first holds the newest, each with deletes."""
    cuts = e.selectExpr("percentile_approx(event_id, array(0.34, 0.67)) AS c").first()["c"] or [0, 0]
    changes, at = _event_changes(e), F.col("seq")
    return [changes.where(at > cuts[1]), changes.where(at <= cuts[0]), changes.where((at > cuts[0]) & (at <= cuts[1]))]


@query(_APPLIED)
def q_apply_changes(spark, sf_dir):
    """Three batches into a store, the newest first, and the oldest again under another name at last."""
    s = store.RecordStore(spark, work_folder(spark, "store"), layers=3)
    parts = _thirds(read_table(spark, sf_dir, "events"))
    for i, part in enumerate([*parts, parts[1]]):
        s.apply(part, f"batch {i}")
    return s.read().select("parent", "name", "size")


@query(_APPLIED)
def q_stream_apply(spark, sf_dir):
    """The feed as a stream of three files, the newest changes first, a file a batch, which stops at its end."""
    log, folder = work_folder(spark, "log"), work_folder(spark, "stream")
    for part in _thirds(read_table(spark, sf_dir, "events")):
        part.coalesce(1).write.mode("append").parquet(log)
    feed = streams.read_changes(spark, log, spark.read.parquet(log).schema, files_per_trigger=1)
    streams.apply_stream(feed, f"{folder}/store", f"{folder}/checkpoint").awaitTermination()
    return store.RecordStore(spark, f"{folder}/store").read().select("parent", "name", "size")


@query(r"SELECT doc_id AS rec_id FROM documents WHERE starts_with(lower(parent_path) || '\', 'git\docs\') OR starts_with(lower(parent_path) || '\', 'gmail\')")
def q_acl_semi(spark, sf_dir):
    acl = spark.createDataFrame([("ann", "git/docs/"), ("ann", "GMAIL"), ("bob", "file")], "principal string, path_prefix string")
    return search.allowed(document_records(spark, sf_dir), acl, "ann").select("rec_id")


@query(
    f"""SELECT doc_id AS rec_id, CASE WHEN {_C('museum')} THEN 2 WHEN lang = 'en' THEN 1 ELSE 0 END AS stage, CASE WHEN {_C('museum')} THEN 95 WHEN lang = 'en' THEN 75 ELSE 60 END AS confidence
FROM documents WHERE {_C('museum')} OR lang = 'en' OR contains({_NORM('name')}, 'budget')"""
)
def q_staged_best(spark, sf_dir):
    return search.best_stage(search.staged(document_records(spark, sf_dir), "name:budget OR author:en OR content:museum", AS_OF))


@query("SELECT n_nationkey, n_name, sha1(n_name) AS sha1 FROM nation")
def q_sha1(spark, sf_dir):
    return read_table(spark, sf_dir, "nation").select("n_nationkey", "n_name", F.sha1("n_name").alias("sha1"))


@query(
    """WITH b AS (SELECT n_nationkey, list_transform(range(1, CAST(length(n_name) + 1 AS BIGINT)), lambda i: ord(substr(n_name, CAST(i AS INTEGER), 1))) AS b FROM nation)
SELECT n_nationkey,
  lower(lpad(to_hex(CAST(list_reduce(list_prepend(CAST(1469598103934665603 AS UHUGEINT), list_transform(b, lambda x: CAST(x AS UHUGEINT))), lambda h, x: ((h - h % 256 + CAST(xor(CAST(h % 256 AS INTEGER), CAST(x AS INTEGER)) AS UHUGEINT)) * 1099511628211) % 18446744073709551616) AS UBIGINT)), 16, '0')) AS fnv64,
  lower(lpad(to_hex(CAST(list_reduce(list_prepend(CAST(0 AS BIGINT), list_transform(b, lambda x: CAST(x AS BIGINT))), lambda r, x: list_reduce(list_prepend(xor(r, x), [CAST(1 AS BIGINT) FOR i IN range(8)]), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c // 2, CAST(2197175160 AS BIGINT)) ELSE c // 2 END)) AS UBIGINT)), 8, '0')) AS crc32c FROM b"""
)
def q_hashes(spark, sf_dir):
    return read_table(spark, sf_dir, "nation").select("n_nationkey", hashes.hash64(F.col("n_name")).alias("fnv64"), hashes.crc32c(F.col("n_name")).alias("crc32c"))


@query("SELECT count(*) AS records, CAST(sum(n_chars) AS BIGINT) AS bytes, max(modified_time) AS newest, (SELECT count(DISTINCT s) FROM (SELECT name AS s FROM documents UNION ALL SELECT parent_path FROM documents)) AS strings FROM documents")
def q_counters(spark, sf_dir):
    return store.counters(document_records(spark, sf_dir))


@query(r"""SELECT doc_id AS rec_id, concat_ws('\', parent_path, name) AS path, n_chars AS size FROM documents WHERE contains(lower(text), 'orchard')""")
def q_json_sink(spark, sf_dir):
    """The JSON objects of all hits, read back."""
    lines = sinks.json_lines(search.search(document_records(spark, sf_dir), "content:orchard", AS_OF, limit=None))
    return lines.select("rec_id", F.get_json_object("json", "$.path").alias("path"), F.get_json_object("json", "$.size").cast("bigint").alias("size"))


@query("SELECT delivery_id AS rec_id FROM work_items WHERE attributes & 33 = 33")
def q_attributes(spark, sf_dir):
    return read_table(spark, sf_dir, "work_items").where(has_attributes(33)).select(F.col("delivery_id").alias("rec_id"))


@query("SELECT parent_path AS parent, count(*) AS n FROM documents GROUP BY 1")
def q_children(spark, sf_dir):
    return search.children(document_records(spark, sf_dir))


@query("SELECT doc_id AS rec_id, name FROM documents WHERE parent_path = 'git\\docs\\Fleirud' AND name = 'budget-4717.txt'".replace("\\\\", "\\"))
def q_point_lookup(spark, sf_dir):
    """The record at a path, from a store of all documents that have a name."""
    s = store.RecordStore(spark, work_folder(spark, "store"))
    d = document_records(spark, sf_dir).where(F.col("name").isNotNull())
    s.upsert(d.groupBy("parent", "name").agg(F.min("rec_id").alias("rec_id")), "all")
    return s.get("git\\docs\\Fleirud", "budget-4717.txt").select("rec_id", "name")


@query("SELECT o_orderkey, CAST((epoch_us(o_orderdate) + 11644473600000000) * 10 AS BIGINT) AS ticks, CAST((epoch_us(o_orderdate) + 11644473600000000) // 86400000000 AS BIGINT) AS day FROM orders")
def q_filetime(spark, sf_dir):
    o = read_table(spark, sf_dir, "orders").select("o_orderkey", text.timestamp_to_filetime(F.col("o_orderdate")).alias("ticks"))
    return o.select("o_orderkey", "ticks", text.filetime_day(F.col("ticks")).alias("day"))


@query(
    r"""SELECT doc_id AS rec_id, substr(text, 1, 500) AS snippet, regexp_replace(substr(text, 1, 500), '(?i)(museum)', '[\1]', 'g') AS marked,
CASE WHEN ext IN ('jpg', 'jpeg', 'png', 'gif', 'bmp', 'tif', 'tiff', 'webp', 'heic') THEN 'image' WHEN ext IN ('mp3', 'wav', 'flac', 'ogg', 'm4a') THEN 'audio' WHEN ext IN ('mp4', 'mkv', 'avi', 'mov', 'webm') THEN 'video'
  WHEN ext IN ('zip', 'tar', 'gz', '7z', 'rar') THEN 'archive' WHEN ext IN ('c', 'h', 'cpp', 'hpp', 'py', 'js', 'ts', 'go', 'rs', 'java', 'cs', 'vb') THEN 'code'
  WHEN ext IN ('pdf', 'doc', 'docx', 'xls', 'xlsx', 'ppt', 'pptx', 'odt', 'epub', 'txt', 'md', 'csv') THEN 'document' ELSE 'other' END AS type
FROM (SELECT *, lower(regexp_extract(name, '\.([^.]+)$', 1)) AS ext FROM documents)"""
)
def q_presented(spark, sf_dir):
    d = document_records(spark, sf_dir)
    cut = text.snippet(F.col("content"))
    return d.select("rec_id", cut.alias("snippet"), text.highlight(cut, "museum").alias("marked"), text.file_class(F.col("ext")).alias("type"))


@query("SELECT DISTINCT source AS value FROM documents WHERE source IS NOT NULL")
def q_intern(spark, sf_dir):
    return store.intern(document_records(spark, sf_dir), "source").select("value")


# Beyond the reference: analytics over the star schema and the events


@query(
    """SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 6) AS avg_disc, count(*) AS n
FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2"""
)
def x_pricing_summary(spark, sf_dir):
    lines = read_table(spark, sf_dir, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    return lines.groupBy("l_returnflag", "l_linestatus").agg(
        F.sum("l_quantity").alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"),
        F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count("*").alias("n"),
    )


@query(
    """SELECT r_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1"""
)
def x_revenue_by_region(spark, sf_dir):
    t = lambda n: read_table(spark, sf_dir, n)
    lines = t("lineitem").select("l_orderkey", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("v")).groupBy("l_orderkey").agg(F.sum("v").alias("v"))
    places = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "r_name")
    orders = t("orders").select("o_orderkey", "o_custkey").join(t("customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    joined = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(places, F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.groupBy("r_name").agg(F.round(F.sum("v"), 2).alias("revenue"))


@query("SELECT o_custkey, o_orderkey, rank() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS place FROM orders QUALIFY place <= 3")
def x_top_orders(spark, sf_dir):
    w = W.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    o = read_table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice").withColumn("place", F.rank().over(w))
    return o.where("place <= 3").select("o_custkey", "o_orderkey", F.col("place").cast("bigint").alias("place"))


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
def x_rollup(spark, sf_dir):
    return read_table(spark, sf_dir, "orders").rollup("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def x_windowed_counts(spark, sf_dir):
    return streams.windowed_counts(read_table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))).select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")


@query(
    """WITH e AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE OR lag(ts) OVER (PARTITION BY user_id ORDER BY ts) IS NULL THEN 1 ELSE 0 END AS b FROM events),
s AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts RANGE UNBOUNDED PRECEDING) AS k FROM e)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", count(*) AS n FROM s GROUP BY user_id, k"""
)
def x_sessions(spark, sf_dir):
    s = streams.sessions(read_table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")))
    return s.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "n")


@query("SELECT doc_id AS rec_id, round(0.1 * CASE WHEN d < 0 THEN 0 WHEN d < 7 THEN 1 WHEN d < 30 THEN 0.5 ELSE 0 END, 6) AS recency FROM (SELECT doc_id, coalesce(datediff('day', CAST(modified_time AS DATE), DATE '2026-04-01'), 999) AS d FROM documents)")
def q_recency(spark, sf_dir):
    return document_records(spark, sf_dir).select("rec_id", F.round(0.1 * rank.recency(F.col("mtime"), AS_OF), 6).alias("recency"))
