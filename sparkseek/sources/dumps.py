"""Records from JSON dumps of mail services, cloud drives and browsers, and from text exports."""

from __future__ import annotations

import plistlib
import sqlite3
from collections.abc import Iterator
from xml.parsers.expat import ExpatError

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkseek.functions.text import from_rfc3339
from sparkseek.model import as_records
from sparkseek.session import cut
from sparkseek.sources.registry import source

GMAIL = "id string, snippet string, internalDate string, payload struct<headers:array<struct<name:string,value:string>>>"
GRAPH_MAIL = "id string, subject string, bodyPreview string, receivedDateTime string, `from` struct<emailAddress:struct<name:string,address:string>>"
CLOUDKIT = "records array<struct<recordName:string,fields:struct<subject:struct<value:string>,preview:struct<value:string>,sentDate:struct<value:bigint>>>>"
DRIVE = "value array<struct<id:string,name:string,size:bigint,lastModifiedDateTime:string,parentReference:struct<path:string>,folder:struct<childCount:int>>>"
GDRIVE = "files array<struct<id:string,name:string,size:string,modifiedTime:string,parents:array<string>,mimeType:string>>"
# The tables browsers keep visited pages in.
HISTORY = {
    "urls": "SELECT url, title FROM urls",
    "moz_places": "SELECT url, title FROM moz_places",
    "history_items": "SELECT i.url, (SELECT v.title FROM history_visits v WHERE v.history_item = i.id ORDER BY v.visit_time DESC LIMIT 1) FROM history_items i",
}
DROPBOX = "entries array<struct<`.tag`:string,id:string,name:string,size:bigint,server_modified:string,path_display:string>>"


def _ntz(c: Column) -> Column:
    return c.cast("timestamp_ntz")


def _record(df: DataFrame, source_: str, id_: Column, **columns: Column) -> DataFrame:
    made = df.select(F.xxhash64(F.lit(source_), id_).alias("rec_id"), F.lit("file").alias("kind"), F.lit(source_).alias("source"), *[c.alias(n) for n, c in columns.items()])
    return as_records(made)


def gmail_records(messages: DataFrame) -> DataFrame:
    """Rows of GMAIL shape: subject, snippet, date. Headers are found by name in any case."""
    header = lambda name: F.get(F.filter("payload.headers", lambda h: F.lower(h["name"]) == name), F.lit(0))["value"]
    when = F.timestamp_millis(F.expr("try_cast(internalDate AS bigint)"))
    return _record(messages, "gmail", F.col("id"), parent=F.lit("gmail"), name=header("subject"), author=header("from"), content=F.col("snippet"), mtime=_ntz(when))


def graph_mail_records(messages: DataFrame) -> DataFrame:
    who = F.coalesce(F.col("from.emailAddress.name"), F.col("from.emailAddress.address"))
    return _record(messages, "outlook", F.col("id"), parent=F.lit("outlook"), name=F.col("subject"), author=who, content=F.col("bodyPreview"), mtime=_ntz(from_rfc3339(F.col("receivedDateTime"))))


def cloudkit_records(answers: DataFrame) -> DataFrame:
    r = answers.select(F.explode("records").alias("r")).select("r.recordName", "r.fields")
    return _record(r, "icloud", F.col("recordName"), parent=F.lit("icloud"), name=F.col("fields.subject.value"), content=F.col("fields.preview.value"), mtime=_ntz(F.timestamp_millis("fields.sentDate.value")))


def drive_records(answers: DataFrame) -> DataFrame:
    """Folder listings, a page a row; every page is read."""
    v = answers.select(F.explode("value").alias("v")).select("v.*")
    kind = F.when(F.col("folder").isNotNull(), "dir").otherwise("file")
    return as_records(
        v.select(
            F.xxhash64(F.lit("onedrive"), "id").alias("rec_id"), F.col("parentReference.path").alias("parent"), "name", kind.alias("kind"), "size",
            _ntz(from_rfc3339(F.col("lastModifiedDateTime"))).alias("mtime"), F.lit("onedrive").alias("source"),
        )
    )


def gdrive_records(answers: DataFrame) -> DataFrame:
    f = answers.select(F.explode("files").alias("f")).select("f.*")
    kind = F.when(F.col("mimeType") == "application/vnd.google-apps.folder", "dir").otherwise("file")
    return as_records(
        f.select(
            F.xxhash64(F.lit("gdrive"), "id").alias("rec_id"), F.get("parents", F.lit(0)).alias("parent"), "name", kind.alias("kind"), F.expr("try_cast(size AS bigint)").alias("size"),
            _ntz(from_rfc3339(F.col("modifiedTime"))).alias("mtime"), F.lit("gdrive").alias("source"),
        )
    )


def dropbox_records(answers: DataFrame) -> DataFrame:
    e = answers.select(F.explode("entries").alias("e")).select("e.*")
    kind = F.when(F.col("`.tag`") == "folder", "dir").otherwise("file")
    parent = F.regexp_replace("path_display", r"/[^/]*$", "")
    return as_records(
        e.select(F.xxhash64(F.lit("dropbox"), "id").alias("rec_id"), parent.alias("parent"), "name", kind.alias("kind"), "size", _ntz(from_rfc3339(F.col("server_modified"))).alias("mtime"), F.lit("dropbox").alias("source"))
    )


def pcloud_records(answers: DataFrame) -> DataFrame:
    """Nested listings (column json): folders hold contents, to any depth; level by level, without recursion in a task."""
    item = "name STRING, isfolder BOOLEAN, size BIGINT, fileid BIGINT, folderid BIGINT, modified STRING, contents ARRAY<STRING>"
    level = cut(answers.select(F.lit("").alias("parent"), F.get_json_object("json", "$.metadata").alias("j")))
    found = None
    while found is None or not level.isEmpty():
        parsed = level.select("parent", F.from_json("j", item).alias("i")).where("i IS NOT NULL").select("parent", "i.*")
        rows = parsed.where("name IS NOT NULL")
        found = rows.drop("contents") if found is None else found.unionAll(rows.drop("contents"))
        level = cut(rows.where("isfolder").select(F.concat_ws("/", F.nullif("parent", F.lit("")), "name").alias("parent"), F.explode("contents").alias("j")))
    kind = F.when(F.col("isfolder"), "dir").otherwise("file")
    mail_time = F.try_to_timestamp(F.regexp_replace("modified", r"^\w{3},\s*", ""), F.lit("dd MMM yyyy HH:mm:ss Z"))
    return as_records(
        found.select(
            F.xxhash64(F.lit("pcloud"), "parent", "name").alias("rec_id"), "parent", "name", kind.alias("kind"), "size",
            _ntz(F.coalesce(mail_time, from_rfc3339(F.col("modified")))).alias("mtime"), F.lit("pcloud").alias("source"),
        )
    )


def history_tables(databases: DataFrame) -> DataFrame:
    """url, title of the history in browsers' SQLite files (column content): the tables of Chromium, Firefox and Safari. Files of other kinds
    and damaged ones give nothing. A database is opened in memory."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for data in batch.column("content").to_pylist():
                book = sqlite3.connect(":memory:")
                try:
                    book.deserialize(bytes(data or b""))
                    names = {r[0] for r in book.execute("SELECT name FROM sqlite_master WHERE type = 'table'")}
                    for table, select in HISTORY.items():
                        if table in names:
                            rows += book.execute(select).fetchall()
                except sqlite3.Error:
                    pass
                finally:
                    book.close()
            columns = list(zip(*rows)) or [[], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], names=["url", "title"])

    return databases.select("content").mapInArrow(run, "url string, title string")


def history_records(urls: DataFrame) -> DataFrame:
    """Browser history: url, title."""
    return as_records(urls.select(F.xxhash64("url").alias("rec_id"), F.parse_url("url", F.lit("HOST")).alias("parent"), F.col("title").alias("name"), F.col("url").alias("content"), F.lit("file").alias("kind"), F.lit("web_archive").alias("source")))


def bookmark_records(trees: DataFrame) -> DataFrame:
    """Bookmark trees (column json, one root each): nodes of type url; folders hold children, to any depth."""
    node = "type STRING, name STRING, url STRING, children ARRAY<STRING>"
    level = cut(trees.select(F.lit("").alias("folder"), F.col("json").alias("j")))
    found = None
    while found is None or not level.isEmpty():
        parsed = level.select("folder", F.from_json("j", node).alias("n")).where("n IS NOT NULL").select("folder", "n.*")
        urls = parsed.where("url IS NOT NULL").select("folder", "name", "url")
        found = urls if found is None else found.unionAll(urls)
        level = cut(parsed.where("children IS NOT NULL").select(F.concat_ws("/", F.nullif("folder", F.lit("")), "name").alias("folder"), F.explode("children").alias("j")))
    return _bookmarks(found)


def _bookmarks(urls: DataFrame) -> DataFrame:
    return as_records(urls.select(F.xxhash64("url", "folder").alias("rec_id"), F.col("folder").alias("parent"), "name", F.col("url").alias("content"), F.lit("file").alias("kind"), F.lit("web_archive").alias("source")))


def bookmark_lists(files: DataFrame) -> DataFrame:
    """Records of Safari's property lists (column content): leaves with their title, below their folders. Damaged files give nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for data in batch.column("content").to_pylist():
                try:
                    todo = [("", plistlib.loads(bytes(data or b"")))]
                except (plistlib.InvalidFileException, ValueError, ExpatError):
                    continue
                while todo:
                    folder, node = todo.pop()
                    if not isinstance(node, dict):
                        continue
                    if node.get("URLString"):
                        rows.append((folder, (node.get("URIDictionary") or {}).get("title"), node["URLString"]))
                    inside = "/".join(x for x in (folder, node.get("Title")) if x)
                    todo += [(inside, child) for child in node.get("Children") or ()]
            columns = list(zip(*rows)) or [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], names=["folder", "name", "url"])

    return _bookmarks(files.select("content").mapInArrow(run, "folder string, name string, url string"))


def unseen(urls: DataFrame, seen: DataFrame, key: str = "url") -> DataFrame:
    """The distinct rows whose key was not seen before."""
    return urls.dropDuplicates([key]).join(seen.select(key), key, "left_anti")


def commit_records(log: DataFrame, column: str = "value") -> DataFrame:
    """Commits of `git log --all -p --format=raw` dumps (whole dumps in `column`, with `repo`): a record per distinct commit, its
    content author, message and diff."""
    parts = log.select("repo", F.explode(F.split(column, r"(?m)^(?=commit [0-9a-f]{40})")).alias("c")).where(F.col("c").startswith("commit "))
    sha = F.regexp_extract("c", r"^commit ([0-9a-f]{40})", 1)
    author = F.regexp_extract("c", r"(?m)^author (.*?) <", 1)
    message = F.trim(F.regexp_replace(F.regexp_extract("c", r"(?s)\n\n((?: {4}[^\n]*\n?)+)", 1), r"(?m)^ {4}", ""))
    diff = F.regexp_extract("c", r"(?s)(\ndiff --git .*)$", 1)
    rows = parts.select("repo", sha.alias("sha"), author.alias("author"), F.regexp_extract("c", r"(?m)^author .*> (\d+) ", 1).try_cast("bigint").alias("at"), message.alias("message"), diff.alias("diff"))
    rows = rows.dropDuplicates(["repo", "sha"])
    return as_records(
        rows.select(
            F.xxhash64("repo", "sha").alias("rec_id"), F.col("repo").alias("parent"), F.col("sha").alias("name"), "author", F.element_at(F.split("message", "\n"), 1).alias("title"),
            F.concat_ws("\n", "author", "message", "diff").alias("content"), _ntz(F.timestamp_seconds("at")).alias("mtime"), F.lit("file").alias("kind"), F.lit("git").alias("source"),
        )
    )


def registry_records(exports: DataFrame, column: str = "value") -> DataFrame:
    """Values of registry exports (whole .reg texts in `column`): parent is the key, name the value's name, content its data."""
    sections = exports.select(F.explode(F.split(column, r"(?m)^(?=\[)")).alias("s")).where(F.col("s").startswith("["))
    key = F.regexp_extract("s", r"^\[-?([^\]\r\n]+)\]", 1)
    joined = F.regexp_replace("s", r"\\\r?\n\s*", "")
    lines = F.filter(F.split(joined, r"\r?\n"), lambda x: x.rlike(r'^(?:"(?:[^"\\]|\\.)*"|@)='))
    values = sections.select(key.alias("parent"), F.explode(lines).alias("line"))
    name = F.regexp_replace(F.regexp_extract("line", r'^(?:"((?:[^"\\]|\\.)*)"|@)=', 1), r"\\(.)", "$1")
    data = F.regexp_replace(F.regexp_replace(F.regexp_extract("line", r'^(?:"(?:[^"\\]|\\.)*"|@)=(.*)$', 1), r'^"(.*)"$', "$1"), r"\\(.)", "$1")
    return as_records(values.select(F.xxhash64("parent", name).alias("rec_id"), "parent", name.alias("name"), data.alias("content"), F.lit("file").alias("kind"), F.lit("registry").alias("source")))


def _json_source(name: str, schema: str, build) -> None:
    @source(name)
    def scan(spark: SparkSession, path: str) -> DataFrame:
        return build(spark.read.schema(schema).json(path, multiLine=True))

    scan.__doc__ = f"Records of the JSON answers below path, of shape {schema}."


for _name, _schema, _build in (
    ("gmail", GMAIL, gmail_records), ("outlook", GRAPH_MAIL, graph_mail_records), ("icloud", CLOUDKIT, cloudkit_records),
    ("onedrive", DRIVE, drive_records), ("gdrive", GDRIVE, gdrive_records), ("dropbox", DROPBOX, dropbox_records),
):
    _json_source(_name, _schema, _build)


@source("pcloud")
def pcloud(spark: SparkSession, path: str) -> DataFrame:
    return pcloud_records(spark.read.text(path, wholetext=True).withColumnRenamed("value", "json"))


@source("bookmarks")
def bookmarks(spark: SparkSession, path: str) -> DataFrame:
    return bookmark_records(spark.read.text(path, wholetext=True).withColumnRenamed("value", "json"))


@source("history")
def history(spark: SparkSession, path: str) -> DataFrame:
    """The SQLite files in which browsers keep their history."""
    return history_records(history_tables(spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)))


@source("history_export")
def history_export(spark: SparkSession, path: str) -> DataFrame:
    """Parquet exports of a browser's url and title."""
    return history_records(spark.read.parquet(path).select("url", "title"))


@source("bookmark_lists")
def safari_bookmarks(spark: SparkSession, path: str) -> DataFrame:
    return bookmark_lists(spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path))


@source("git")
def git(spark: SparkSession, path: str) -> DataFrame:
    """Dumps of `git log --all -p --format=raw`, one file a repository."""
    return commit_records(spark.read.text(path, wholetext=True).withColumn("repo", F.input_file_name()))


@source("registry")
def registry(spark: SparkSession, path: str) -> DataFrame:
    return registry_records(spark.read.text(path, wholetext=True))
