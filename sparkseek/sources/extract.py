"""Text and metadata of file contents, by format. Plain functions over bytes, and their Arrow-batched column."""

from __future__ import annotations

import email
import email.policy
import re
import struct
import zipfile
from collections.abc import Iterator
from html.parser import HTMLParser
from io import BytesIO

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Which reader an extension goes to.
READERS = {
    "text": ("txt", "md", "csv", "log", "nfo", "json", "xml", "ini", "conf", "yml", "yaml", "toml", "tex", "c", "h", "cpp", "hpp", "py", "js", "ts", "go", "rs", "java", "cs", "vb", "sql", "sh", "r"),
    "rtf": ("rtf",),
    "html": ("html", "htm", "xhtml"),
    "office": ("docx", "xlsx", "pptx"),
    "mail": ("eml", "emlx"),
    "epub": ("epub",),
    "image": ("jpg", "jpeg", "tif", "tiff"),
    "audio": ("mp3",),
}
_BY_EXTENSION = {e: r for r, es in READERS.items() for e in es}
EMPTY = {"content": None, "author": None, "title": None, "camera": None, "lens": None, "artist": None, "album": None}
SCHEMA = "content string, author string, title string, camera string, lens string, artist string, album string"


def reader_for(ext: str) -> str | None:
    return _BY_EXTENSION.get((ext or "").lower())


def reader_of(ext: Column) -> Column:
    """reader_for() of a column: the reader's name, NULL where there is none."""
    chosen = F.lit(None).cast("string")
    for name, exts in READERS.items():
        chosen = F.when(F.lower(ext).isin(*exts), name).otherwise(chosen)
    return chosen


class _Text(HTMLParser):
    def __init__(self) -> None:
        super().__init__()
        self.parts: list[str] = []
        self.title: list[str] = []
        self.hidden = 0
        self.in_title = False

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.hidden += tag in ("script", "style")
        self.in_title = self.in_title or tag == "title"

    def handle_endtag(self, tag: str) -> None:
        self.hidden = max(0, self.hidden - (tag in ("script", "style")))
        if tag == "title":
            self.in_title = False

    def handle_data(self, data: str) -> None:
        if self.in_title:
            self.title.append(data)
        elif not self.hidden:
            self.parts.append(data)


def html(data: bytes | str) -> dict:
    p = _Text()
    p.feed(data if isinstance(data, str) else data.decode("utf-8", "replace"))
    return {"content": " ".join(" ".join(p.parts).split()), "title": " ".join("".join(p.title).split()) or None}


def _field(text: str, name: str) -> str | None:
    m = re.search(rf"{name}:[ \t]*([^\r\n]{{0,255}})", text, re.I)
    return m[1].strip() or None if m else None


def text(data: bytes) -> dict:
    if b"\0" in data:
        return {}
    t = data.decode("utf-8", "replace")
    return {"content": t, "author": _field(t, "author"), "title": _field(t, "title")}


def mail(data: bytes) -> dict:
    # an emlx file begins with the number of the message's bytes in a line of its own and ends with a property list
    if m := re.match(rb"\s*(\d+)\s*\n", data):
        data = data[m.end() : m.end() + int(m[1])]
    m = email.message_from_bytes(data, policy=email.policy.default)
    body = m.get_body(("plain", "html"))
    t = body.get_content() if body is not None else ""
    if body is not None and body.get_content_subtype() == "html":
        t = html(t)["content"]
    return {"content": t, "author": str(m["From"]) if m["From"] else None, "title": str(m["Subject"]) if m["Subject"] else None}


def _members(data: bytes, wanted: str) -> dict[str, bytes]:
    """The members of a zip whose names match, however many others there are."""
    with zipfile.ZipFile(BytesIO(data)) as z:
        return {i.filename: z.read(i) for i in z.infolist() if re.fullmatch(wanted, i.filename, re.I)}


def rtf(data: bytes) -> dict:
    """The plain text of a rich text file: control words, groups that are not shown and escapes undone."""
    out: list[str] = []
    hidden, depth, skip = 0, 0, 0
    for m in re.finditer(r"\\([a-z]+)(-?\d+)? ?|\\'([0-9a-f]{2})|\\([^a-z])|([{}])|([^\\{}]+)", data.decode("latin-1"), re.I):
        word, number, code, sign, brace, plain = m.groups()
        if brace:
            depth += 1 if brace == "{" else -1
            if hidden and depth < hidden:
                hidden = 0
        elif sign == "*" or word in ("fonttbl", "colortbl", "stylesheet", "info", "pict", "themedata", "generator"):
            hidden = hidden or depth
        elif hidden:
            continue
        elif word in ("par", "line", "tab"):
            out.append("\t" if word == "tab" else "\n")
        elif word == "u":
            out.append(chr(int(number) % 65536))
            skip = 1
        elif code or plain or sign in ("\\", "{", "}"):
            text = bytes([int(code, 16)]).decode("cp1252", "replace") if code else plain.replace("\r", "").replace("\n", "") if plain else sign
            out.append(text[skip:])
            skip = 0
    return {"content": "".join(out).strip()}


def _xml_text(data: bytes, breaks: str) -> str:
    t = re.sub(breaks, "\n", data.decode("utf-8", "replace"))
    t = re.sub(r"<[^>]*>", "", t)
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
        t = t.replace(a, b)
    return t.strip()


def _xml_element(data: bytes, name: str) -> str | None:
    m = re.search(rf"<(?:\w+:)?{name}\b[^>]*>(.*?)</(?:\w+:)?{name}>", data.decode("utf-8", "replace"), re.S)
    return _xml_text(m[1].encode(), "$^") or None if m else None


def office(data: bytes) -> dict:
    files = _members(data, r"docProps/core\.xml|word/document\.xml|xl/(sharedStrings|worksheets/sheet\d+)\.xml|ppt/slides/slide\d+\.xml")
    core = files.pop("docProps/core.xml", b"")
    parts = sorted(files, key=lambda n: [int(x) if x.isdigit() else x for x in re.split(r"(\d+)", n)])
    content = "\n".join(t for n in parts if (t := _xml_text(files[n], r"</(?:\w+:)?(?:p|si|row)>|<(?:\w+:)?br\s*/>")))
    return {"content": content, "author": _xml_element(core, "creator"), "title": _xml_element(core, "title")}


def epub(data: bytes) -> dict:
    files = _members(data, r"META-INF/container\.xml|.*\.opf|.*\.x?html?")
    container = files.get("META-INF/container.xml", b"").decode("utf-8", "replace")
    m = re.search(r'full-path="([^"]+)"', container)
    opf = files.get(m[1], b"") if m else b""
    pages = [html(c)["content"] for n, c in files.items() if n.lower().endswith((".html", ".htm", ".xhtml"))]
    return {"content": "\n".join(pages), "author": _xml_element(opf, "creator"), "title": _xml_element(opf, "title")}


def exif(data: bytes) -> dict:
    """Camera model (0x0110) and lens model (0xA434) of a TIFF structure, alone or in a JPEG."""
    at = data.find(b"Exif\0\0")
    t = data[at + 6 :] if at >= 0 else data
    if t[:2] not in (b"II", b"MM") or len(t) < 8:
        return {}
    order = "<" if t[:2] == b"II" else ">"
    tags: dict[int, str] = {}

    def directory(offset: int, seen: set[int]) -> None:
        if offset in seen or offset + 2 > len(t):
            return
        seen.add(offset)
        for i in range(struct.unpack_from(f"{order}H", t, offset)[0]):
            e = offset + 2 + 12 * i
            if e + 12 > len(t):
                return
            tag, kind, count, value = struct.unpack_from(f"{order}HHII", t, e)
            if tag == 0x8769:
                directory(value, seen)
            elif kind == 2 and tag in (0x0110, 0xA434):
                raw = t[e + 8 : e + 8 + count] if count <= 4 else t[value : value + count]
                tags[tag] = raw.split(b"\0")[0].decode("utf-8", "replace").strip()

    directory(struct.unpack_from(f"{order}I", t, 4)[0], set())
    return {"camera": tags.get(0x0110), "lens": tags.get(0xA434)}


def id3(data: bytes) -> dict:
    """Artist and album from ID3v2 frames, else from an ID3v1 tag."""
    found: dict[str, str] = {}
    if data[:3] == b"ID3" and len(data) > 10:
        size = sum((b & 0x7F) << s for b, s in zip(data[6:10], (21, 14, 7, 0)))
        at, end, version = 10, min(len(data), 10 + size), data[3]
        while at + 10 <= end and data[at : at + 4].strip(b"\0"):
            name = data[at : at + 4]
            n = sum((b & 0x7F) << s for b, s in zip(data[at + 4 : at + 8], (21, 14, 7, 0))) if version >= 4 else struct.unpack(">I", data[at + 4 : at + 8])[0]
            body = data[at + 10 : at + 10 + n]
            if name in (b"TPE1", b"TALB") and body:
                code = {0: "latin-1", 1: "utf-16", 2: "utf-16-be", 3: "utf-8"}.get(body[0], "latin-1")
                found[name.decode()] = body[1:].decode(code, "replace").strip("\0 ")
            at += 10 + n
    if data[-128:-125] == b"TAG":
        old = lambda a, b: data[-128 + a : -128 + b].split(b"\0")[0].decode("latin-1").strip()
        found.setdefault("TPE1", old(33, 63))
        found.setdefault("TALB", old(63, 93))
    return {"artist": found.get("TPE1") or None, "album": found.get("TALB") or None}


_READ = {"text": text, "rtf": rtf, "html": html, "office": office, "mail": mail, "epub": epub, "image": exif, "audio": id3}


def extract(ext: str | None, data: bytes | None, most: int | None = None) -> dict:
    """Content and metadata of a file; all None if its kind is not known, it is damaged or NULL. Content is whole, or its first `most` characters."""
    reader = reader_for(ext or "")
    if reader is None or data is None:
        return dict(EMPTY)
    try:
        found = {**EMPTY, **_READ[reader](bytes(data))}
    except (zipfile.BadZipFile, struct.error, ValueError, KeyError, LookupError, EOFError, RuntimeError, NotImplementedError, OSError):
        return dict(EMPTY)
    if found["content"] is not None and most is not None:
        found["content"] = found["content"][:most]
    return found


def extracted(files: DataFrame, id: str = "path", ext: str = "ext", data: str = "content", most: int | None = None) -> DataFrame:
    """id and the extracted fields of each file; contents are whole, or of `most` characters (Config.max_content)."""
    kind = files.schema[id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [extract(e, d, most) for e, d in zip(batch.column("ext").to_pylist(), batch.column("data").to_pylist())]
            columns = [batch.column("id"), *(pa.array([r[c] for r in rows], pa.string()) for c in EMPTY)]
            yield pa.RecordBatch.from_arrays(columns, names=["id", *EMPTY])

    picked = files.selectExpr(f"`{id}` AS id", f"`{ext}` AS ext", f"`{data}` AS data")
    return picked.mapInArrow(run, f"id {kind}, {SCHEMA}").withColumnRenamed("id", id)
