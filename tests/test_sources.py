import io
import json
import plistlib
import sqlite3
import struct
import tarfile
import zipfile

import pytest

from sparkseek import config
from sparkseek.sources import dumps, extract, files, registry


def zipped(members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for n, c in members.items():
            z.writestr(n, c)
    return out.getvalue()


@pytest.mark.parametrize("name, safe", [("a/b", "a/b"), ("../x", None), ("/abs", None), ("C:x", None), ("a\\b", None), ("a/%2e%2e/b", None), ("%00", None), ("", None), ("a//./b", "a/b"), ("a%20b", "a b")])
def test_member_names(name, safe):
    assert files.safe_member(name) == safe


def test_archives(spark, rows, tmp_path):
    (tmp_path / "a.zip").write_bytes(zipped({"x/y.txt": "hi", "../bad": "no"}))
    with tarfile.open(tmp_path / "b.tar", "w") as t:
        info = tarfile.TarInfo("z.md")
        info.size = 3
        t.addfile(info, io.BytesIO(b"abc"))
    (tmp_path / "c.zip").write_bytes(b"PK\x03\x04 broken")
    assert rows(registry.scan(spark, "archives", root=str(tmp_path)), "name", "size") == [("y.txt", 2), ("z.md", 3)]


def test_files(spark, rows, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "A.txt").write_text("Author: Ann\nText")
    (tmp_path / "b.bin").write_bytes(b"\0\1")
    assert rows(registry.scan(spark, "files", root=str(tmp_path)), "name", "size", "ext") == [("A.txt", 16, "txt"), ("b.bin", 2, "bin")]
    assert rows(registry.scan(spark, "files", root=str(tmp_path), content=True), "name", "author") == [("A.txt", "Ann"), ("b.bin", None)]


def test_registry():
    assert {"files", "archives", "gmail", "git"} <= set(registry.names())
    with pytest.raises(ValueError):
        registry.source("files")(lambda spark: None)
    with pytest.raises(ValueError):
        registry.source("new", version=2)(lambda spark: None)
    with pytest.raises(LookupError):
        registry.scan(None, "nothing")


def test_extractors():
    assert extract.extract("html", b"<title>T</title><script>x</script><p>a b</p>") == {**extract.EMPTY, "content": "a b", "title": "T"}
    assert extract.extract("eml", b"From: Ann <a@x>\r\nSubject: S\r\n\r\nbody")["title"] == "S"
    core = '<cp:coreProperties xmlns:dc="x"><dc:title>T</dc:title><dc:creator>Ann</dc:creator></cp:coreProperties>'
    docx = zipped({"docProps/core.xml": core, "word/document.xml": "<w:p><w:t>one</w:t></w:p><w:p><w:t>two &amp; three</w:t></w:p>"})
    assert extract.extract("docx", docx) == {**extract.EMPTY, "content": "one\ntwo & three", "author": "Ann", "title": "T"}
    epub = zipped({"META-INF/container.xml": '<rootfile full-path="c.opf"/>', "c.opf": core, "1.xhtml": "<p>page</p>"})
    assert extract.extract("epub", epub)["content"] == "page" and extract.extract("epub", epub)["author"] == "Ann"
    tag = b"TAG" + b"t".ljust(30, b"\0") + b"Old".ljust(30, b"\0") + b"Alb".ljust(30, b"\0") + b"\0" * 35
    frame = lambda n, v: n + struct.pack(">I", len(v) + 1) + b"\0\0" + b"\3" + v
    body = frame(b"TPE1", b"New")
    v2 = b"ID3\3\0\0" + bytes([0, 0, 0, len(body)]) + body
    assert extract.id3(v2 + tag) == {"artist": "New", "album": "Alb"}
    model = b"CamX\0\0\0\0"
    tiff = b"II*\0" + struct.pack("<I", 8) + struct.pack("<H", 1) + struct.pack("<HHII", 0x0110, 2, 8, 26) + struct.pack("<I", 0) + model
    assert extract.extract("tif", tiff)["camera"] == "CamX"
    for ext, data in (("docx", b"broken"), ("txt", b"a\0b"), ("xyz", b"a"), ("txt", None), (None, b"a"), ("tif", b"II"), ("mp3", b"")):
        assert extract.extract(ext, data)["content"] is None


def json_file(tmp_path, name, value):
    (tmp_path / name).write_text(json.dumps(value))
    return str(tmp_path / name)


def test_json_dumps(spark, rows, tmp_path):
    gmail = {"id": "1", "snippet": "hey", "internalDate": "1704067200000", "payload": {"headers": [{"name": "Subject", "value": "S"}, {"name": "From", "value": "a"}]}}
    got = registry.scan(spark, "gmail", path=json_file(tmp_path, "g.json", [gmail, {"id": "2"}])).orderBy("content").collect()
    assert [(r["name"], r["author"], str(r["mtime"])) for r in got if r["name"]] == [("S", "a", "2024-01-01 00:00:00")] and len(got) == 2
    graph = {"id": "1", "subject": "S", "bodyPreview": "p", "receivedDateTime": "2024-01-01T00:00:00Z", "from": {"emailAddress": {"name": "Ann"}}}
    assert rows(registry.scan(spark, "outlook", path=json_file(tmp_path, "o.json", graph)), "name", "author") == [("S", "Ann")]
    cloud = {"records": [{"recordName": "r", "fields": {"subject": {"value": "S"}, "preview": {"value": "p"}, "sentDate": {"value": 0}}}]}
    assert rows(registry.scan(spark, "icloud", path=json_file(tmp_path, "i.json", cloud)), "name", "content") == [("S", "p")]
    drive = {"value": [{"id": "1", "name": "f", "size": 5, "lastModifiedDateTime": "2024-01-01T00:00:00Z"}, {"id": "2", "name": "d", "folder": {"childCount": 1}}]}
    assert rows(registry.scan(spark, "onedrive", path=json_file(tmp_path, "d.json", drive)), "name", "kind") == [("d", "dir"), ("f", "file")]
    gd = {"files": [{"id": "1", "name": "f", "size": "5", "modifiedTime": "2024-01-01T00:00:00Z", "parents": ["p"], "mimeType": "x"}]}
    assert rows(registry.scan(spark, "gdrive", path=json_file(tmp_path, "gd.json", gd)), "name", "size", "parent") == [("f", 5, "p")]
    box = {"entries": [{".tag": "file", "id": "1", "name": "f", "size": 5, "server_modified": "2024-01-01T00:00:00Z", "path_display": "/a/f"}]}
    assert rows(registry.scan(spark, "dropbox", path=json_file(tmp_path, "b.json", box)), "name", "parent") == [("f", "/a")]
    nested = {"metadata": {"name": "/", "isfolder": True, "contents": [{"name": "d", "isfolder": True, "contents": [{"name": "f", "isfolder": False, "size": 3}]}]}}
    assert ("f", "file", 3) in rows(registry.scan(spark, "pcloud", path=json_file(tmp_path, "p.json", nested)), "name", "kind", "size")
    marks = {"type": "folder", "name": "bar", "children": [{"type": "url", "name": "N", "url": "http://x"}, {"type": "folder", "name": "in", "children": [{"type": "url", "name": "M", "url": "http://y"}]}]}
    assert rows(registry.scan(spark, "bookmarks", path=json_file(tmp_path, "m.json", marks)), "parent", "name") == [("bar", "N"), ("bar/in", "M")]


def test_text_dumps(spark, rows, tmp_path):
    log = f"commit {'a' * 40}\ntree x\nauthor Ann B <a@x> 1704067200 +0000\ncommitter C <c> 1 +0000\n\n    Title line\n    more\n\ndiff --git a/f b/f\n+new\n"
    (tmp_path / "repo.log").write_text(log + log)
    got = registry.scan(spark, "git", path=str(tmp_path / "repo.log")).collect()
    assert [(r["name"], r["author"], r["title"], str(r["mtime"])) for r in got] == [("a" * 40, "Ann B", "Title line", "2024-01-01 00:00:00")] and "+new" in got[0]["content"]
    (tmp_path / "x.reg").write_text('Windows Registry Editor\n\n[HKEY\\A]\n"N"="v\\\\w"\n@="d"\n"H"=hex:01,\\\n  02\n')
    assert rows(registry.scan(spark, "registry", path=str(tmp_path / "x.reg")), "parent", "name", "content") == [("HKEY\\A", "", "d"), ("HKEY\\A", "H", "hex:01,02"), ("HKEY\\A", "N", "v\\w")]
    urls = spark.createDataFrame([("http://h/a", "A"), ("http://h/a", "A"), ("http://k/b", None)], "url string, title string")
    assert rows(dumps.unseen(urls, spark.createDataFrame([("http://k/b",)], "url string")), "url") == [("http://h/a",)]
    assert rows(dumps.history_records(urls), "parent", "name")[0] == ("h", "A")


def test_config():
    c = config.load("# x\nthreads = 0\nbatch=5\nlimit=500\nnope=1\nmax_content=abc\n")
    assert (c.threads, c.batch, c.limit, c.max_content) == (1, 100, 500, 1 << 20)


def test_nothing_is_cut(spark, rows, tmp_path):
    """Documents with thousands of members and texts above a megabyte come whole, unless a limit is asked for."""
    members = {f"word/media/{i}.png": b"\0" * 2000 for i in range(2500)}
    docx = zipped({**members, "docProps/core.xml": "<dc:creator>Ann</dc:creator>", "word/document.xml": "<w:p>" + "x" * 1_200_000 + "</w:p>"})
    got = extract.extract("docx", docx)
    assert got["author"] == "Ann" and len(got["content"]) == 1_200_000
    assert len(extract.extract("txt", b"y" * 3_000_000)["content"]) == 3_000_000 and extract.extract("txt", b"abc", 2)["content"] == "ab"
    (tmp_path / "a.txt").write_text("z" * 2_000_000)
    assert registry.scan(spark, "files", root=str(tmp_path), content=True).selectExpr("length(content)").first()[0] == 2_000_000
    limit = config.load("max_content=1000").max_content
    assert registry.scan(spark, "files", root=str(tmp_path), content=True, most=limit).selectExpr("length(content)").first()[0] == 1000


def test_deep_bookmarks(spark, rows):
    tree = {"type": "url", "name": "leaf", "url": "https://x/"}
    for i in range(66):
        tree = {"type": "folder", "name": f"f{i}", "children": [tree]}
    got = dumps.bookmark_records(spark.createDataFrame([(json.dumps(tree),), (None,), ("{",)], "json string"))
    assert [(r.name, r.parent.count("/")) for r in got.collect()] == [("leaf", 65)]


def test_browser_files(spark, rows, tmp_path):
    book = sqlite3.connect(tmp_path / "History")
    book.execute("CREATE TABLE urls (id INTEGER, url TEXT, title TEXT)")
    book.executemany("INSERT INTO urls VALUES (?, ?, ?)", [(1, "https://a.example/x", "A"), (2, "https://b.example/", None)])
    book.commit()
    book.close()
    (tmp_path / "broken.db").write_bytes(b"SQLite format 3\0 and then nothing")
    (tmp_path / "empty.db").write_bytes(b"")
    assert rows(registry.scan(spark, "history", path=str(tmp_path)), "parent", "name", "content") == [("a.example", "A", "https://a.example/x"), ("b.example", None, "https://b.example/")]
    (tmp_path / "l").mkdir()
    (tmp_path / "l" / "b.plist").write_bytes(plistlib.dumps({"Children": [{"Title": "Bar", "Children": [{"URLString": "https://x/"}, {"URLString": "https://y/", "URIDictionary": {"title": "Y"}}]}]}))
    (tmp_path / "l" / "c.plist").write_bytes(b"no list")
    assert rows(registry.scan(spark, "bookmark_lists", path=str(tmp_path / "l")), "parent", "name", "content") == [("Bar", "Y", "https://y/"), ("Bar", None, "https://x/")]


@pytest.mark.parametrize("rtf, text", [(b"{\\rtf1{\\fonttbl{\\f0 A;}}Hi \\b bold\\b0 \\par two}", "Hi bold\ntwo"), (b"{\\rtf1 \\u228?b\\'e4c}", "\xe4b\xe4c"), (b"", ""), (b"{\\rtf1 a\\{b\\}}", "a{b}"), (b"{\\*\\gen x}y", "y")])
def test_rtf(rtf, text):
    assert extract.rtf(rtf)["content"] == text


def test_emlx():
    mail = b"From: Ann <a@x>\nSubject: S\n\nbody\n"
    assert extract.extract("emlx", str(len(mail)).encode() + b"\n" + mail + b"<?xml?><plist/>")["content"].strip() == "body"
