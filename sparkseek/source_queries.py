"""Queries of sources, extraction, sinks, caches and streams over rows that they make of the tables, with their SQL."""

from __future__ import annotations

import datetime as dt
import io
import plistlib
import sqlite3
import struct
import tarfile
import zipfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkseek import config as settings
from sparkseek.functions import codecs, paths, text
from sparkseek.model import as_records, document_records
from sparkseek.operators import cache, postings, search, sinks, store
from sparkseek.plans.compile import filters, predicate
from sparkseek.plans.parser import parse
from sparkseek.session import read_table, work_folder
from sparkseek.sources import dumps, extract, files, registry
from sparkseek.streaming import changes as streams

AS_OF = dt.date(2026, 4, 1)
QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLE_SQL[f.__name__] = f, sql
        return f

    return add


def _nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "nation")


def _made(df: DataFrame, make: Callable[[dict], list[tuple[str, bytes]]]) -> DataFrame:
    """path, content: files that make() builds of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [x for r in batch.to_pylist() for x in make(r)]
            columns = list(zip(*rows)) or [[], []]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.binary())], names=["path", "content"])

    return df.mapInArrow(run, "path string, content binary")


# Mail services, drives, browsers


@query("SELECT 'gmail' AS parent, n_name AS name, 'From ' || n_nationkey AS author, 'About ' || n_name AS content, make_timestamp(CAST(n_nationkey AS BIGINT) * 86400000000) AS mtime FROM nation")
def q_source_gmail(spark, sf_dir):
    json = F.expr("""concat('{"id":"', n_nationkey, '","snippet":"About ', n_name, '","internalDate":"', n_nationkey * 86400000L, '","payload":{"headers":[{"name":"Subject","value":"', n_name, '"},{"name":"FROM","value":"From ', n_nationkey, '"}]}}')""")
    rows = _nations(spark, sf_dir).select(F.from_json(json, dumps.GMAIL).alias("m")).select("m.*")
    return dumps.gmail_records(rows).select("parent", "name", "author", "content", "mtime")


@query("SELECT 'outlook' AS parent, n_name AS name, CASE WHEN n_nationkey % 2 = 0 THEN 'Who ' || n_nationkey ELSE 'w' || n_nationkey || '@x' END AS author, 'Body ' || n_name AS content, TIMESTAMP '2026-01-02 03:04:05' AS mtime FROM nation")
def q_source_outlook(spark, sf_dir):
    json = F.expr(
        """concat('{"id":"', n_nationkey, '","subject":"', n_name, '","bodyPreview":"Body ', n_name, '","receivedDateTime":"2026-01-02T05:04:05+02:00","from":{"emailAddress":{"name":',
        CASE WHEN n_nationkey % 2 = 0 THEN concat('"Who ', n_nationkey, '"') ELSE 'null' END, ',"address":"w', n_nationkey, '@x"}}}')"""
    )
    rows = _nations(spark, sf_dir).select(F.from_json(json, dumps.GRAPH_MAIL).alias("m")).select("m.*")
    return dumps.graph_mail_records(rows).select("parent", "name", "author", "content", "mtime")


@query("SELECT 'icloud' AS parent, n_name AS name, 'Preview ' || n_name AS content, make_timestamp(CAST(n_nationkey AS BIGINT) * 1000000) AS mtime FROM nation")
def q_source_icloud(spark, sf_dir):
    json = F.expr("""concat('{"records":[{"recordName":"r', n_nationkey, '","fields":{"subject":{"value":"', n_name, '"},"preview":{"value":"Preview ', n_name, '"},"sentDate":{"value":', n_nationkey * 1000, '}}}]}')""")
    rows = _nations(spark, sf_dir).select(F.from_json(json, dumps.CLOUDKIT).alias("m")).select("m.*")
    return dumps.cloudkit_records(rows).select("parent", "name", "content", "mtime")


@query("SELECT '/drive/root:/r' || n_regionkey AS parent, n_name AS name, CASE WHEN n_nationkey % 5 = 0 THEN 'dir' ELSE 'file' END AS kind, CAST(n_nationkey * 10 AS BIGINT) AS size, TIMESTAMP '2026-01-02 03:04:05' AS mtime FROM nation")
def q_source_onedrive(spark, sf_dir):
    json = F.expr(
        """concat('{"value":[{"id":"', n_nationkey, '","name":"', n_name, '","size":', n_nationkey * 10, ',"lastModifiedDateTime":"2026-01-02T03:04:05Z","parentReference":{"path":"/drive/root:/r', n_regionkey, '"}',
        CASE WHEN n_nationkey % 5 = 0 THEN ',"folder":{"childCount":1}' ELSE '' END, '}]}')"""
    )
    rows = _nations(spark, sf_dir).select(F.from_json(json, dumps.DRIVE).alias("m")).select("m.*")
    return dumps.drive_records(rows).select("parent", "name", "kind", "size", "mtime")


@query("SELECT 'p' || n_regionkey AS parent, n_name AS name, CASE WHEN n_nationkey % 5 = 0 THEN 'dir' ELSE 'file' END AS kind, CAST(CASE WHEN n_nationkey % 5 <> 0 THEN n_nationkey ELSE -1 END AS BIGINT) AS size, TIMESTAMP '2026-01-02 03:04:05' AS mtime FROM nation")
def q_source_gdrive(spark, sf_dir):
    json = F.expr(
        """concat('{"files":[{"id":"', n_nationkey, '","name":"', n_name, '",', CASE WHEN n_nationkey % 5 = 0 THEN '' ELSE concat('"size":"', n_nationkey, '",') END,
        '"modifiedTime":"2026-01-02T03:04:05Z","parents":["p', n_regionkey, '"],"mimeType":"', CASE WHEN n_nationkey % 5 = 0 THEN 'application/vnd.google-apps.folder' ELSE 'text/plain' END, '"}]}')"""
    )
    rows = _nations(spark, sf_dir).select(F.from_json(json, dumps.GDRIVE).alias("m")).select("m.*")
    return dumps.gdrive_records(rows).select("parent", "name", "kind", F.coalesce("size", F.lit(-1)).alias("size"), "mtime")


@query("SELECT '/team/r' || n_regionkey AS parent, n_name AS name, CASE WHEN n_nationkey % 5 = 0 THEN 'dir' ELSE 'file' END AS kind, CAST(n_nationkey AS BIGINT) AS size, TIMESTAMP '2026-01-02 03:04:05' AS mtime FROM nation")
def q_source_dropbox(spark, sf_dir):
    json = F.expr(
        """concat('{"entries":[{".tag":"', CASE WHEN n_nationkey % 5 = 0 THEN 'folder' ELSE 'file' END, '","id":"', n_nationkey, '","name":"', n_name, '","size":', n_nationkey,
        ',"server_modified":"2026-01-02T03:04:05Z","path_display":"/team/r', n_regionkey, '/', n_name, '"}]}')"""
    )
    rows = _nations(spark, sf_dir).select(F.from_json(json, dumps.DROPBOX).alias("m")).select("m.*")
    return dumps.dropbox_records(rows).select("parent", "name", "kind", "size", "mtime")


@query("SELECT 'root' AS parent, n_name AS name, 'file' AS kind, CAST(n_nationkey AS BIGINT) AS size, TIMESTAMP '2026-01-02 03:04:05' AS mtime FROM nation UNION ALL SELECT '', 'root', 'dir', -1, NULL FROM nation")
def q_source_pcloud(spark, sf_dir):
    json = F.expr("""concat('{"metadata":{"name":"root","isfolder":true,"contents":[{"name":"', n_name, '","isfolder":false,"size":', n_nationkey, ',"modified":"Fri, 02 Jan 2026 03:04:05 +0000"}]}}')""")
    return dumps.pcloud_records(_nations(spark, sf_dir).select(json.alias("json"))).select("parent", "name", "kind", F.coalesce("size", F.lit(-1)).alias("size"), "mtime")


@query("SELECT 'h' || n_regionkey || '.example' AS parent, n_name AS name, 'https://h' || n_regionkey || '.example/' || n_nationkey AS content FROM nation")
def q_source_history(spark, sf_dir):
    """Three kinds of browser databases, made in memory, one a nation."""

    def make(r: dict) -> list[tuple[str, bytes]]:
        url, title = f"https://h{r['n_regionkey']}.example/{r['n_nationkey']}", r["n_name"]
        book = sqlite3.connect(":memory:")
        kind = r["n_nationkey"] % 3
        if kind < 2:
            table = ("urls", "moz_places")[kind]
            book.execute(f"CREATE TABLE {table} (url TEXT, title TEXT)")
            book.execute(f"INSERT INTO {table} VALUES (?, ?)", (url, title))
        else:
            book.execute("CREATE TABLE history_items (id INTEGER, url TEXT)")
            book.execute("CREATE TABLE history_visits (history_item INTEGER, title TEXT, visit_time REAL)")
            book.execute("INSERT INTO history_items VALUES (1, ?)", (url,))
            book.executemany("INSERT INTO history_visits VALUES (1, ?, ?)", [("old", 1.0), (title, 2.0)])
        book.commit()
        return [("db", book.serialize())]

    return dumps.history_records(dumps.history_tables(_made(_nations(spark, sf_dir), make))).select("parent", "name", "content")


@query("SELECT 'Bar/r' || n_regionkey AS parent, n_name AS name, 'https://x/' || n_nationkey AS content FROM nation")
def q_source_bookmarks(spark, sf_dir):
    json = F.expr("""concat('{"type":"folder","name":"Bar","children":[{"type":"folder","name":"r', n_regionkey, '","children":[{"type":"url","name":"', n_name, '","url":"https://x/', n_nationkey, '"}]}]}')""")
    return dumps.bookmark_records(_nations(spark, sf_dir).select(json.alias("json"))).select("parent", "name", "content")


@query("SELECT 'Bar' AS parent, n_name AS name, 'https://x/' || n_nationkey AS content FROM nation")
def q_source_bookmark_lists(spark, sf_dir):
    def make(r: dict) -> list[tuple[str, bytes]]:
        leaf = {"URLString": f"https://x/{r['n_nationkey']}", "URIDictionary": {"title": r["n_name"]}}
        return [("list", plistlib.dumps({"Title": "", "Children": [{"Title": "Bar", "Children": [leaf]}]}, fmt=plistlib.FMT_BINARY))]

    return dumps.bookmark_lists(_made(_nations(spark, sf_dir), make)).select("parent", "name", "content")


@query("SELECT DISTINCT n_name AS url FROM nation WHERE n_regionkey <> 1")
def q_unseen_urls(spark, sf_dir):
    """Each URL comes twice; those of one region were seen."""
    n = _nations(spark, sf_dir).select(F.col("n_name").alias("url"), "n_regionkey")
    return dumps.unseen(n.unionAll(n), n.where("n_regionkey = 1")).select("url")


@query(r"""SELECT 'repo' || n_regionkey AS parent, lpad(hex(n_nationkey), 40, '0') AS name, 'Ann ' || n_nationkey AS author, 'Fix ' || n_name AS title,
'Ann ' || n_nationkey || chr(10) || 'Fix ' || n_name || chr(10) || chr(10) || 'more' || chr(10) || chr(10) || 'diff --git a/x b/x' || chr(10) || '+' || n_name || chr(10) AS content, make_timestamp((1700000000 + n_nationkey) * CAST(1000000 AS BIGINT)) AS mtime FROM nation""")
def q_source_git(spark, sf_dir):
    """Dumps of a log per region, each commit twice, as when two branches hold it."""
    commit = F.expr(
        r"""concat('commit ', lower(lpad(hex(n_nationkey), 40, '0')), '\ntree 0\nauthor Ann ', n_nationkey, ' <a@x> ', 1700000000 + n_nationkey, ' +0000\ncommitter B <b@x> 1 +0000\n\n    Fix ', n_name,
        '\n    \n    more\n\ndiff --git a/x b/x\n+', n_name, '\n')"""
    )
    n = _nations(spark, sf_dir)
    logs = n.unionAll(n).groupBy(F.concat(F.lit("repo"), "n_regionkey").alias("repo")).agg(F.concat_ws("", F.collect_list(commit)).alias("value"))
    found = dumps.commit_records(logs).select("parent", F.upper("name").alias("name"), "author", "title", "content", "mtime")
    return found.withColumn("content", F.regexp_replace("content", r"\n\n+", "\n\n"))


@query(r"""SELECT 'HKEY_X\r' || n_regionkey AS parent, n_name AS name, 'C:\' || n_nationkey AS content FROM nation""")
def q_source_registry(spark, sf_dir):
    text_ = F.expr(r"""concat('Windows Registry Editor\r\n\r\n[HKEY_X\\r', n_regionkey, ']\r\n"', n_name, '"="C:\\\\', n_nationkey, '"\r\n')""")
    return dumps.registry_records(_nations(spark, sf_dir).select(text_.alias("value"))).select("parent", "name", "content")


# Files and archives


def _written(spark: SparkSession, sf_dir: str) -> str:
    """A folder with a text file per region, in a folder of its own."""
    folder = work_folder(spark, "files")
    _nations(spark, sf_dir).select(F.col("n_name").alias("value"), F.col("n_regionkey").alias("r")).repartition(1).sortWithinPartitions("r", "value").write.partitionBy("r").text(folder)
    return folder


@query("SELECT 'r=' || n_regionkey AS folder, 'txt' AS ext, CAST(sum(strlen(n_name) + 1) AS BIGINT) AS size FROM nation GROUP BY n_regionkey")
def q_source_files(spark, sf_dir):
    """A tree is scanned for names and sizes; a mounted share is one."""
    found = registry.scan(spark, "files", root=_written(spark, sf_dir), pattern="*.txt")
    return found.select(paths.path_basename(F.col("parent")).alias("folder"), "ext", "size")


@query("SELECT 'r=' || n_regionkey AS folder, string_agg(n_name, chr(10) ORDER BY n_name) || chr(10) AS content FROM nation GROUP BY n_regionkey")
def q_source_files_content(spark, sf_dir):
    found = registry.scan(spark, "files", root=_written(spark, sf_dir), pattern="*.txt", content=True)
    return found.select(paths.path_basename(F.col("parent")).alias("folder"), "content")


@query("SELECT CAST(n_nationkey % 2 AS INTEGER) AS kind, 'd/' || n_name || '.txt' AS member, CAST(strlen(n_name) AS BIGINT) AS size FROM nation")
def q_archive_members(spark, sf_dir):
    """Zip and tar files, each with a member of an unsafe name, which is left out."""

    def make(r: dict) -> list[tuple[str, bytes]]:
        out, data = io.BytesIO(), r["n_name"].encode()
        if r["n_nationkey"] % 2 == 0:
            with zipfile.ZipFile(out, "w") as z:
                z.writestr(f"d/{r['n_name']}.txt", data)
                z.writestr("../evil", data)
        else:
            with tarfile.open(fileobj=out, mode="w") as t:
                for name in (f"d/{r['n_name']}.txt", "/etc/evil"):
                    info = tarfile.TarInfo(name)
                    info.size = len(data)
                    t.addfile(info, io.BytesIO(data))
        return [(str(r["n_nationkey"] % 2), out.getvalue())]

    return files.archive_members(_made(_nations(spark, sf_dir), make)).select(F.col("path").cast("int").alias("kind"), "member", "size")


@query("SELECT name FROM (VALUES ('files'), ('archives'), ('gmail'), ('outlook'), ('icloud'), ('onedrive'), ('gdrive'), ('dropbox'), ('pcloud'), ('bookmarks'), ('bookmark_lists'), ('history'), ('history_export'), ('git'), ('registry')) t(name)")
def q_source_names(spark, sf_dir):
    """The sources that are registered."""
    return spark.createDataFrame([(n,) for n in registry.names()], "name string")


# Extraction


def _zip(members: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, content in members.items():
            z.writestr(name, content)
    return out.getvalue()


def _core(r: dict) -> str:
    return f'<cp:coreProperties xmlns:dc="x"><dc:title>About {r["n_name"]}</dc:title><dc:creator>Ann {r["n_nationkey"]}</dc:creator></cp:coreProperties>'


def _extracted(spark: SparkSession, sf_dir: str, ext: str, make: Callable[[dict], bytes], *columns: str) -> DataFrame:
    made = _made(_nations(spark, sf_dir), lambda r: [(str(r["n_nationkey"]), make(r))])
    found = extract.extracted(made.withColumn("ext", F.lit(ext)))
    return found.select(F.col("path").cast("int").alias("n_nationkey"), *columns)


@query("SELECT n_nationkey, 'Ann ' || n_nationkey || ' <a@x>' AS author, 'About ' || n_name AS title, 'Hello ' || n_name || chr(10) AS content FROM nation")
def q_extract_mail(spark, sf_dir):
    return _extracted(spark, sf_dir, "eml", lambda r: f"From: Ann {r['n_nationkey']} <a@x>\nSubject: About {r['n_name']}\n\nHello {r['n_name']}\n".encode(), "author", "title", "content")


@query("SELECT n_nationkey, 'Ann' AS author, n_name AS subject, 'Hello' AS body FROM nation")
def q_mail_headers(spark, sf_dir):
    mail = F.expr(r"concat('From: Ann\r\nSUBJECT:  ', n_name, '\r\nX: Subject: no\r\n\r\nHello')")
    m = _nations(spark, sf_dir).select("n_nationkey", mail.alias("m"))
    return m.select("n_nationkey", text.header_field(F.col("m"), "from").alias("author"), text.header_field(F.col("m"), "subject").alias("subject"), text.mail_body(F.col("m")).alias("body"))


@query("SELECT n_nationkey, 'Ann ' || n_nationkey AS author, 'About ' || n_name AS title, 'one' || chr(10) || 'two & ' || n_name AS content FROM nation")
def q_extract_office(spark, sf_dir):
    """Documents with 3 000 pictures before their text, as no member but those with text counts."""

    def make(r: dict) -> bytes:
        pictures = {f"word/media/{i}.png": "" for i in range(3000 if r["n_nationkey"] == 0 else 3)}
        return _zip({**pictures, "docProps/core.xml": _core(r), "word/document.xml": f"<w:p><w:t>one</w:t></w:p><w:p><w:t>two &amp; {r['n_name']}</w:t></w:p>"})

    return _extracted(spark, sf_dir, "docx", make, "author", "title", "content")


@query("SELECT n_nationkey, 'Ann ' || n_nationkey AS author, 'About ' || n_name AS title, 'Page of ' || n_name AS content FROM nation")
def q_extract_epub(spark, sf_dir):
    make = lambda r: _zip({"META-INF/container.xml": '<rootfile full-path="c.opf"/>', "c.opf": _core(r), "1.xhtml": f"<style>p</style><p>Page of {r['n_name']}</p>"})
    return _extracted(spark, sf_dir, "epub", make, "author", "title", "content")


@query("SELECT n_nationkey, 'Cam ' || n_name AS camera, 'L' || n_nationkey AS lens FROM nation")
def q_extract_exif(spark, sf_dir):
    def make(r: dict) -> bytes:
        camera, lens = f"Cam {r['n_name']}".encode() + b"\0", f"L{r['n_nationkey']}".encode() + b"\0"
        sub = 8 + 2 + 2 * 12 + 4
        at = sub + 2 + 12 + 4
        first = struct.pack("<H", 2) + struct.pack("<HHII", 0x0110, 2, len(camera), at) + struct.pack("<HHII", 0x8769, 4, 1, sub) + struct.pack("<I", 0)
        value = lens.ljust(4, b"\0") if len(lens) <= 4 else struct.pack("<I", at + len(camera))
        second = struct.pack("<H", 1) + struct.pack("<HHI", 0xA434, 2, len(lens)) + value + struct.pack("<I", 0)
        return b"\xff\xd8\xff\xe1Exif\0\0" + b"II*\0" + struct.pack("<I", 8) + first + second + camera + lens

    return _extracted(spark, sf_dir, "jpg", make, "camera", "lens")


@query("SELECT n_nationkey, 'Artist ' || n_name AS artist, 'Album ' || n_nationkey AS album FROM nation")
def q_extract_id3(spark, sf_dir):
    """Tags of both versions."""

    def make(r: dict) -> bytes:
        artist, album = f"Artist {r['n_name']}", f"Album {r['n_nationkey']}"
        if r["n_nationkey"] % 2:
            return b"\xff\xfb" + b"TAG" + b"\0" * 30 + artist.encode().ljust(30, b"\0") + album.encode().ljust(30, b"\0") + b"\0" * 35
        frames = b"".join(k + struct.pack(">I", len(v) + 1) + b"\0\0\0" + v.encode() for k, v in ((b"TPE1", artist), (b"TALB", album)))
        n = len(frames)
        return b"ID3\x03\0\0" + bytes((n >> s) & 0x7F for s in (21, 14, 7, 0)) + frames

    return _extracted(spark, sf_dir, "mp3", make, "artist", "album")


@query("SELECT n_nationkey, 'Name ' || n_name || chr(10) || 'über' AS content FROM nation")
def q_extract_rtf(spark, sf_dir):
    return _extracted(spark, sf_dir, "rtf", lambda r: rf"{{\rtf1\ansi{{\fonttbl{{\f0 Arial;}}}}\f0 Name {r['n_name']}\par \'fcber}}".encode(), "content")


@query(
    """SELECT doc_id AS rec_id, CASE WHEN ext IN ('txt', 'md', 'csv', 'log', 'nfo', 'json', 'xml', 'ini', 'conf', 'yml', 'yaml', 'toml', 'tex', 'c', 'h', 'cpp', 'hpp', 'py', 'js', 'ts', 'go', 'rs', 'java', 'cs', 'vb', 'sql', 'sh', 'r') THEN 'text'
WHEN ext = 'rtf' THEN 'rtf' WHEN ext IN ('html', 'htm', 'xhtml') THEN 'html' WHEN ext IN ('docx', 'xlsx', 'pptx') THEN 'office' WHEN ext IN ('eml', 'emlx') THEN 'mail' WHEN ext = 'epub' THEN 'epub'
WHEN ext IN ('jpg', 'jpeg', 'tif', 'tiff') THEN 'image' WHEN ext = 'mp3' THEN 'audio' ELSE 'none' END AS reader FROM (SELECT doc_id, lower(regexp_extract(name, '\\.([^.]+)$', 1)) AS ext FROM documents)"""
)
def q_content_dispatch(spark, sf_dir):
    return document_records(spark, sf_dir).select("rec_id", F.coalesce(extract.reader_of(F.col("ext")), F.lit("none")).alias("reader"))


@query("SELECT doc_id AS rec_id, doc_id % 3 <> 0 AS is_text, CASE WHEN doc_id % 3 <> 0 THEN substr(text, 1, 1000) END AS readable FROM documents")
def q_text_guard(spark, sf_dir):
    """A third of the texts is given a NUL character."""
    d = document_records(spark, sf_dir).select("rec_id", F.when(F.col("rec_id") % 3 == 0, F.concat("content", F.expr("chr(0)"))).otherwise(F.col("content")).alias("c"))
    return d.select("rec_id", text.is_text(F.col("c")).alias("is_text"), text.readable(F.col("c"), 1000).alias("readable"))


@query("SELECT o_orderkey, o_orderdate - INTERVAL 2 HOUR AS at, CAST(NULL AS TIMESTAMP) AS none FROM orders")
def q_rfc3339(spark, sf_dir):
    o = read_table(spark, sf_dir, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'+02:00'").alias("t"))
    at = lambda c: text.from_rfc3339(c).cast("timestamp_ntz")
    return o.select("o_orderkey", at(F.col("t")).alias("at"), at(F.concat(F.lit("x"), "t")).alias("none"))


@query("SELECT n_nationkey, sha256(CAST(n_nationkey AS VARCHAR) || ':' || n_name || ':' || CAST(n_regionkey AS VARCHAR)) AS signature FROM nation")
def q_drive_signature(spark, sf_dir):
    return _nations(spark, sf_dir).select("n_nationkey", text.drive_signature(F.col("n_nationkey"), F.col("n_name"), F.col("n_regionkey")).alias("signature"))


@query("SELECT n_nationkey, n_name || ' a b c' AS line FROM nation")
def q_sanitized(spark, sf_dir):
    return _nations(spark, sf_dir).select("n_nationkey", text.sanitize_log(F.expr(r"concat(n_name, '\na\tb\rc', chr(7), chr(127))")).alias("line"))


@query("SELECT doc_id AS rec_id, coalesce(contains(translate(lower(name), '_-.', '   '), 'budget 4'), false) AS hit FROM documents")
def q_folded_contains(spark, sf_dir):
    return document_records(spark, sf_dir).select("rec_id", text.contains_folded(F.col("name"), "Budget-4").alias("hit"))


@query(r"SELECT doc_id AS rec_id, CASE WHEN coalesce(parent_path, '') = '' THEN name ELSE regexp_replace(parent_path, '[\\/]+$', '') || '\' || name END AS path FROM documents")
def q_path_join(spark, sf_dir):
    return document_records(spark, sf_dir).select("rec_id", paths.path_join(F.col("parent"), F.col("name")).alias("path"))


# Fields, filters, orders of search


def _tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records with metadata, over the part table."""
    p = read_table(spark, sf_dir, "part")
    return as_records(p.select(F.col("p_partkey").alias("rec_id"), F.col("p_name").alias("name"), F.col("p_brand").alias("camera"), F.col("p_type").alias("lens"), F.col("p_brand").alias("artist"), F.col("p_type").alias("album"), F.col("p_name").alias("title")))


def _field(name: str, q: str, condition: str) -> None:
    def run(spark, sf_dir):
        return _tagged(spark, sf_dir).where(predicate(parse(q, AS_OF))).select("rec_id")

    run.__name__, run.__doc__ = name, f"All matches of {q}"
    QUERIES[name], ORACLE_SQL[name] = run, f"SELECT p_partkey AS rec_id FROM part WHERE {condition}"


_field("q_field_camera", "camera:Brand#2", "p_brand = 'Brand#2'")
_field("q_field_lens", "lens:ECONOMY", "p_type = 'ECONOMY'")
_field("q_field_artist", "artist:Brand#4 OR artist:Brand#5", "p_brand IN ('Brand#4', 'Brand#5')")
_field("q_field_album", "NOT album:SMALL", "p_type <> 'SMALL'")
_field("q_field_title", 'title:"red widget"', "p_name = 'red widget'")
_field("q_whole_negated", "name:ring NOT whole:yes", "regexp_matches(lower(p_name), '(^|[^a-z0-9_])ring($|[^a-z0-9_])')")


@query(r"SELECT doc_id AS rec_id FROM documents WHERE lower(regexp_extract(name, '\.([^.]+)$', 1)) = 'txt' AND n_chars >= 1048 AND contains(lower(parent_path), 'docs') AND CAST(modified_time AS DATE) BETWEEN DATE '2024-01-01' AND DATE '2026-12-31'")
def q_form_filters(spark, sf_dir):
    """Extension, megabytes, days and a part of the path, as a search form sets them."""
    f = filters(ext=".TXT", megabytes=(0.001, None), days=(dt.date(2024, 1, 1), dt.date(2026, 12, 31)), path_part="DOCS")
    return search.search(document_records(spark, sf_dir), "", AS_OF, limit=None, where=f).select("rec_id")


@query("SELECT doc_id AS rec_id, name FROM documents ORDER BY name ASC NULLS LAST, doc_id LIMIT 1000")
def q_wide_limit(spark, sf_dir):
    """The first thousand by name."""
    return search.sort_hits(document_records(spark, sf_dir).withColumn("score", F.lit(0.0)), "name", False).select("rec_id", "name").limit(search.WIDE_LIMIT)


@query("SELECT doc_id AS rec_id, parent_path AS parent, name FROM documents ORDER BY parent_path DESC NULLS LAST, name DESC NULLS LAST, doc_id LIMIT 40")
def q_sort_path(spark, sf_dir):
    return search.sort_hits(document_records(spark, sf_dir).withColumn("score", F.lit(0.0)), "path").select("rec_id", "parent", "name").limit(40)


@query("SELECT doc_id AS rec_id, modified_time AS mtime FROM documents ORDER BY modified_time ASC NULLS LAST, doc_id LIMIT 40")
def q_sort_modified(spark, sf_dir):
    return search.sort_hits(document_records(spark, sf_dir).withColumn("score", F.lit(0.0)), "modified", False).select("rec_id", "mtime").limit(40)


@query("SELECT doc_id AS rec_id, name, n_chars AS size FROM documents WHERE contains(lower(text), 'museum') ORDER BY n_chars DESC, doc_id LIMIT 25")
def q_hot_window(spark, sf_dir):
    """The best hits first, their details joined only afterwards."""
    d = document_records(spark, sf_dir)
    hits = d.where(predicate(parse("content:museum", AS_OF))).select("rec_id", F.col("size").alias("score"))
    return search.two_tiers(hits, d.select("rec_id", "name", "size"), 25).select("rec_id", "name", "size")


_SCORES = """WITH s AS (SELECT count(*) AS total, avg(strlen(text)) AS len, count(*) FILTER (contains(lower(text), 'museum')) AS a, count(*) FILTER (contains(lower(text), 'orchard')) AS b FROM documents),
t AS (SELECT doc_id, strlen(text) AS n, datediff('day', CAST(modified_time AS DATE), DATE '2026-04-01') AS age, (length(lower(text)) - length(replace(lower(text), 'museum', ''))) / 6 AS ta, (length(lower(text)) - length(replace(lower(text), 'orchard', ''))) / 7 AS tb FROM documents)
SELECT doc_id AS rec_id, round(0.4 * (CASE WHEN ta > 0 THEN ln((total - a + 0.5) / (a + 0.5) + 1.0) * (ta * 2.5 / (ta + 1.5 * (0.25 + 0.75 * n / len))) ELSE 0 END + CASE WHEN tb > 0 THEN ln((total - b + 0.5) / (b + 0.5) + 1.0) * (tb * 2.5 / (tb + 1.5 * (0.25 + 0.75 * n / len))) ELSE 0 END)
  + 0.1 * coalesce(CASE WHEN age < 0 THEN 0.0 WHEN age < 7 THEN 1.0 WHEN age < 30 THEN 0.5 ELSE 0.0 END, 0.0), 6) AS score FROM t, s WHERE ta > 0 OR tb > 0"""


@query(_SCORES)
def q_bm25_terms(spark, sf_dir):
    """Two terms, each with its own document frequency."""
    return search.search(document_records(spark, sf_dir), "content:museum OR content:orchard", AS_OF, bm25="corpus", limit=None).select("rec_id", "score")


# The stored index


def _index(spark: SparkSession, sf_dir: str) -> postings.GramIndex:
    """The index of the documents in three batches: all, then a tenth taken out, then those entered again."""
    index = postings.GramIndex(spark, work_folder(spark, "index"))
    d = document_records(spark, sf_dir)
    index.add(d, "all")
    some = d.where(F.col("rec_id") % 10 == 3)
    index.remove(some.select("rec_id"), "out")
    index.add(some, "again")
    return index


@query("SELECT doc_id AS rec_id FROM documents WHERE (contains(lower(text), 'museum') OR contains(lower(text), 'the')) AND NOT contains(lower(text), 'orchard') AND doc_id % 10 <> 3")
def q_index_upkeep(spark, sf_dir):
    """A stored index from which a tenth of the records was taken out again."""
    index = postings.GramIndex(spark, work_folder(spark, "index"))
    d = document_records(spark, sf_dir)
    index.add(d, "all")
    index.remove(d.where(F.col("rec_id") % 10 == 3).select("rec_id"), "out")
    index.merge()
    known = d.where(F.col("rec_id") % 10 != 3)
    return postings.index_search(known, index.postings(), parse("(content:museum OR content:the) AND NOT content:orchard"), index.stats())


@query(r"""WITH d AS (SELECT doc_id, string_split(lower(text), '') AS c FROM documents)
SELECT g AS gram, count(DISTINCT doc_id) AS df FROM (SELECT doc_id, unnest(list_transform(range(1, CAST(len(c) - 1 AS BIGINT)), lambda i: c[i] || c[i + 1] || c[i + 2])) AS g FROM d WHERE len(c) > 2) GROUP BY g""")
def q_index_postings(spark, sf_dir):
    """What the index holds after records were taken out and entered again: the same as at first."""
    return _index(spark, sf_dir).postings().where("field = 'content'").groupBy("gram").agg(F.count("*").alias("df"))


# Sinks, store, caches


@query(r"SELECT doc_id AS rec_id, concat_ws('\', parent_path, name) || chr(9) || n_chars || chr(9) || coalesce(CAST(modified_time AS VARCHAR), '') || chr(9) || '0.500' AS line FROM documents WHERE contains(lower(text), 'orchard')")
def q_text_sink(spark, sf_dir):
    hits = document_records(spark, sf_dir).where(predicate(parse("content:orchard"))).withColumn("score", F.lit(0.5))
    return sinks.text_lines(hits).select("rec_id", F.regexp_replace("line", r"(\.\d*?)0+\t", "$1\t").alias("line"))


@query("SELECT 'ann' AS principal, 'content:a b' AS query UNION ALL SELECT 'bob', 'name:x'")
def q_audit(spark, sf_dir):
    """What was asked is appended to a log, without control characters."""
    folder = work_folder(spark, "audit")
    sinks.audit(spark, folder, "content:a\nb", "ann")
    sinks.audit(spark, folder, "name:x", "bob\x07")
    return spark.read.parquet(folder).select("principal", "query")


_EVENTS = "SELECT event_type AS parent, CAST(user_id AS VARCHAR) AS name, max(event_id) AS size FROM events GROUP BY 1, 2"


def _stored(spark: SparkSession, sf_dir: str) -> store.RecordStore:
    s = store.RecordStore(spark, work_folder(spark, "store"))
    e = read_table(spark, sf_dir, "events")
    s.upsert(e.groupBy(F.col("event_type").alias("parent"), F.col("user_id").cast("string").alias("name")).agg(F.max("event_id").alias("size")), "all")
    return s


@query(f"SELECT * FROM ({_EVENTS}) WHERE parent <> 'click'")
def q_store_delete(spark, sf_dir):
    """Deleting paths leaves others of the same name alone."""
    s = _stored(spark, sf_dir)
    s.delete(s.read().where("parent = 'click'").select("parent", "name"), "clicks")
    return s.read().select("parent", "name", "size")


@query(_EVENTS)
def q_store_compact(spark, sf_dir):
    """A copy of the store in two files, compressed."""
    s, target = _stored(spark, sf_dir), work_folder(spark, "compact")
    s.compact(target, 2)
    return spark.read.parquet(target).select("parent", "name", "size")


@query(f"SELECT * FROM ({_EVENTS}) WHERE parent = 'click' AND name = '1'")
def q_store_get(spark, sf_dir):
    """A point lookup in the store."""
    return _stored(spark, sf_dir).get("click", "1").select("parent", "name", "size")


@query("SELECT doc_id AS rec_id, n AS times FROM (SELECT doc_id FROM documents WHERE contains(lower(text), 'museum')), (VALUES (1), (2)) t(n)")
def q_cached_search(spark, sf_dir):
    """The same query twice: the second time from the cache, in index mode with its terms kept as well."""
    d, kept = document_records(spark, sf_dir), cache.ResultCache.of(settings.load("cache_entries=8"))
    index = postings.build_postings(d.where(F.col("content").isNotNull()), ["content"])
    ask = lambda: search.search(d, "content:museum", AS_OF, limit=None, mode="index", postings=index, cache=kept, generation=1).select("rec_id")
    first, second = ask(), ask()
    if kept.hits < 1:
        raise RuntimeError("the cache was not used")
    return first.withColumn("times", F.lit(1)).unionAll(second.withColumn("times", F.lit(2)))


@query("SELECT doc_id AS rec_id FROM documents WHERE contains(lower(text), 'orchard')")
def q_cache_files(spark, sf_dir):
    """A result kept as files, found by a second cache over the same folder."""
    d, folder = document_records(spark, sf_dir), work_folder(spark, "cache")
    found = None
    for _ in range(2):
        kept = cache.ResultCache(spark=spark, folder=folder)
        found = search.search(d, "content:orchard", AS_OF, limit=None, cache=kept, generation=7)
    if kept.hits != 1:
        raise RuntimeError("the files were not used")
    return found.select("rec_id")


@query("SELECT * FROM (VALUES ('batch', 100), ('cache_entries', 64), ('limit', 300), ('max_content', 1048576), ('threads', 1024)) t(setting, value)")
def q_config(spark, sf_dir):
    """Settings of a file, kept within their bounds."""
    c = settings.load("# note\nthreads = 9999\nbatch=5\nlimit=300\nunknown=1\nmax_content=lots\n")
    return spark.createDataFrame([(k, int(v)) for k, v in vars(c).items()], "setting string, value int")


@query("SELECT doc_id AS rec_id, round(0.4 * 0.0, 6) AS s FROM documents ORDER BY doc_id LIMIT 30")
def q_config_limit(spark, sf_dir):
    """The limit comes from the settings."""
    d = document_records(spark, sf_dir).withColumn("mtime", F.lit(None).cast("timestamp_ntz"))
    return search.search(d, "", AS_OF, config=settings.load("limit=30")).select("rec_id", F.col("score").alias("s"))


# Changes


def _two_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A light change with a size and a later full one with a content for each part; every fifth is deleted at last."""
    p = read_table(spark, sf_dir, "part").select(F.col("p_brand").alias("parent"), F.concat("p_name", F.lit("-"), "p_partkey").alias("name"), F.col("p_partkey").alias("k"), F.col("p_size").cast("bigint").alias("size"), "p_type")
    at = lambda n: F.timestamp_seconds(F.col("k") * 10 + n).alias("event_time")
    light = p.select("parent", "name", F.lit(0).alias("op"), "size", F.lit(None).cast("string").alias("content"), F.lit(1).cast("bigint").alias("seq"), at(1))
    full = p.select("parent", "name", F.lit(0).alias("op"), F.lit(None).cast("bigint").alias("size"), F.col("p_type").alias("content"), F.lit(2).cast("bigint").alias("seq"), at(2))
    gone = p.where("k % 5 = 0").select("parent", "name", F.lit(1).alias("op"), F.lit(None).cast("bigint").alias("size"), F.lit(None).cast("string").alias("content"), F.lit(3).cast("bigint").alias("seq"), at(3))
    return full.unionAll(gone).unionAll(light)


@query("SELECT p_brand AS parent, p_name || '-' || p_partkey AS name, CAST(p_size AS BIGINT) AS size, p_type AS content FROM part WHERE p_partkey % 5 <> 0")
def q_enriched(spark, sf_dir):
    """The stages of a path joined into one row on their way into a store."""
    folder, log = work_folder(spark, "enriched"), work_folder(spark, "log")
    _two_stages(spark, sf_dir).coalesce(1).write.parquet(log)
    feed = streams.read_changes(spark, log, spark.read.parquet(log).schema, settings.Config().batch)
    streams.apply_stream(feed, f"{folder}/store", f"{folder}/checkpoint", enrich=True).awaitTermination()
    return store.RecordStore(spark, f"{folder}/store").read().select("parent", "name", "size", "content")


@query(r"SELECT p_brand || '\' || p_name || '-' || p_partkey AS path, what, CAST(n AS BIGINT) AS n FROM part, (VALUES ('changed', 2), ('removed', 1)) t(what, n) WHERE what = 'changed' OR p_partkey % 5 = 0")
def q_live_feed(spark, sf_dir):
    return streams.live_feed(_two_stages(spark, sf_dir)).groupBy("path", "what").agg(F.count("*").alias("n"))


# Codecs and small functions


@query("SELECT p_partkey, repeat('a', p_size) || p_name AS text FROM part")
def q_packbits(spark, sf_dir):
    """Packed and unpacked again."""
    p = read_table(spark, sf_dir, "part").select("p_partkey", F.expr("encode(concat(repeat('a', p_size), p_name), 'utf-8')").alias("b"))
    return p.select("p_partkey", F.decode(codecs.unpacked(codecs.packed(F.col("b"))), "utf-8").alias("text"))


@query("SELECT c_nationkey, string_agg(c_custkey, ',' ORDER BY c_custkey) AS ids FROM customer GROUP BY 1")
def q_delta_varint(spark, sf_dir):
    """Posting lists as differences and back."""
    c = read_table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.collect_list("c_custkey").alias("ids"))
    return c.select("c_nationkey", F.array_join(F.transform(codecs.undeltas(codecs.deltas(F.col("ids"))), lambda x: x.cast("string")), ",").alias("ids"))


@query("SELECT p_partkey, true AS own, false AS other FROM part")
def q_bloom(spark, sf_dir):
    """A filter of a name's trigrams holds them all, and not those of another alphabet."""
    p = read_table(spark, sf_dir, "part").select("p_partkey", text.trigrams(F.col("p_name")).alias("g"))
    p = p.select("p_partkey", "g", codecs.bloom_of(F.col("g"), 1 << 14, 4).alias("b"))
    return p.select("p_partkey", codecs.may_hold(F.col("b"), F.col("g")).alias("own"), codecs.may_hold(F.col("b"), F.array(*[F.lit(x) for x in ("ЖЗИ", "ЗИЙ", "ИЙК")])).alias("other"))


@query("SELECT user_id, round(list_reduce(v, lambda a, x: a * 0.8 + x * 0.2), 6) AS average FROM (SELECT user_id, list(value ORDER BY ts, event_id) AS v FROM events GROUP BY 1)")
def q_smoothed(spark, sf_dir):
    e = read_table(spark, sf_dir, "events").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", "value"))).alias("v"))
    return e.select("user_id", F.round(codecs.smoothed(F.col("v.value")), 6).alias("average"))


@query("SELECT p_partkey, CAST(greatest(0, 2 - (length(p_name) - length(replace(p_name, 'i', '')))) + greatest(0, 1 - (length(p_name) - length(replace(p_name, 'r', '')))) AS INTEGER) AS n FROM part")
def q_missing_characters(spark, sf_dir):
    return read_table(spark, sf_dir, "part").select("p_partkey", codecs.missing_characters(F.col("p_name"), "iri").alias("n"))
