"""Scalar text functions as Column expressions; all pass NULL through unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparkseek.functions.codecs import missing_characters
from sparkseek.functions.paths import lowercase_ascii


def split_extension(name: Column) -> Column:
    """Text after the last dot, in lower case; empty if there is no dot or nothing after it."""
    return F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1))


extension = split_extension


def normalize_name(name: Column) -> Column:
    """Last extension dropped, `_`, `-` and `.` as spaces, ASCII lower case."""
    return F.translate(lowercase_ascii(F.regexp_replace(name, r"\.[^.]*$", "")), "_-.", "   ")


def fold_separators(text: Column) -> Column:
    """Lower case with `_`, `-` and `.` as spaces."""
    return F.translate(F.lower(text), "_-.", "   ")


def contains_folded(text: Column, term: str) -> Column:
    """Substring match without case and separators; NULL is no match."""
    folded = term.lower().translate(str.maketrans("_-.", "   "))
    return F.coalesce(F.contains(fold_separators(text), F.lit(folded)), F.lit(False))


def occurrences(text: Column, term: str) -> Column:
    """How often term occurs without regard to case, not overlapping; 0 for NULL."""
    if not term:
        raise ValueError("empty term")
    low = F.lower(text)
    shorter = F.char_length(low) - F.char_length(F.replace(low, F.lit(term.lower()), F.lit("")))
    return F.coalesce((shorter / F.lit(len(term.lower()))).cast("int"), F.lit(0))


def trigrams(text: Column) -> Column:
    """Distinct three-character windows of the lower-cased text, sorted; an empty array for texts of less than three characters. For names
    and other short texts: each window is cut from the text's beginning. Whole contents go through operators.postings."""
    low = F.lower(text)
    at = F.sequence(F.lit(1), F.char_length(low) - 2)
    windows = F.transform(at, lambda i: F.substr(low, i, F.lit(3)))
    return F.when(F.char_length(low) > 2, F.array_sort(F.array_distinct(windows))).when(text.isNotNull(), F.array().cast("array<string>"))


def fuzzy(text: Column, pattern: str, distance: int) -> Column:
    """Whether some window of the text lies within the edit distance of the pattern; NULL is no match.

    Windows have len(pattern) - distance .. len(pattern) + distance characters and start anywhere. A text no longer than the pattern is
    compared as a whole. Cost grows with the text, so this is for names.
    """
    m, d = len(pattern), distance
    n = F.char_length(text)
    p = F.lit(pattern)
    lengths = F.sequence(F.lit(max(1, m - d)), F.lit(m + d))
    window = F.exists(
        lengths, lambda size: F.exists(F.sequence(F.lit(1), F.greatest(F.lit(1), n - size + 1)), lambda i: F.levenshtein(F.substr(text, i, size), p, d) >= 0)
    )
    # a text that lacks more of the pattern's characters than may be edited has no such window
    near = F.when(missing_characters(text, pattern) > d, F.lit(False)).otherwise(window)
    return F.coalesce(F.when(n <= m, F.levenshtein(text, p, d) >= 0).otherwise(near), F.lit(False))


def fuzzy_distance(pattern: str) -> int:
    """The distance allowed by default: a fifth of the pattern's length, rounded up."""
    return (len(pattern) + 4) // 5


def strip_tags(html: Column) -> Column:
    """Everything between < and > dropped."""
    return F.regexp_replace(html, r"<[^>]*>", "")


def html_text(html: Column) -> Column:
    """Text of a page: script and style elements left out, tags dropped, line breaks as spaces."""
    visible = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(visible, r"(?s)<[^>]*>", " "), r"\s+", " "))


def html_title(html: Column) -> Column:
    return F.regexp_extract(html, r"(?is)<title[^>]*>([^<]*)</title>", 1)


def sniffed(text: Column, field: str) -> Column:
    """The value of the first `field:` in the text, up to 255 characters of its line; empty if there is none."""
    return F.regexp_extract(text, rf"(?i){field}:[ \t]*([^\r\n]{{0,255}})", 1)


def header_field(mail: Column, field: str) -> Column:
    """A field of a mail's headers, which end at the first empty line; empty if it is not there."""
    head = F.element_at(F.split(mail, r"\r?\n\r?\n", 2), 1)
    return F.trim(F.regexp_extract(head, rf"(?im)^{field}:[ \t]*([^\r\n]*)", 1))


def mail_body(mail: Column) -> Column:
    """What follows the first empty line; empty if there is none."""
    parts = F.split(mail, r"\r?\n\r?\n", 2)
    return F.when(F.size(parts) > 1, F.get(parts, F.lit(1))).otherwise(F.when(mail.isNotNull(), F.lit("")))


def is_text(content: Column) -> Column:
    """Whether the content is indexable text: no NUL character. NULL is not."""
    return F.coalesce(~F.contains(content, F.lit("\0")), F.lit(False))


def readable(content: Column, most: int = 1 << 20) -> Column:
    """The first `most` characters if the content is text, NULL otherwise: the limit of what is indexed is an option."""
    return F.when(is_text(content), F.substring(content, 1, most))


def from_rfc3339(text: Column) -> Column:
    """Point in time of an RFC 3339 string; NULL if it is none."""
    return F.try_to_timestamp(text)


def filetime_to_timestamp(ticks: Column) -> Column:
    """100 ns since 1601 as a timestamp; 0 and NULL give NULL."""
    return F.when(ticks != 0, F.timestamp_micros(F.floor(ticks / 10).cast("bigint") - 11644473600000000))


def timestamp_to_filetime(ts: Column) -> Column:
    return (F.unix_micros(ts.cast("timestamp")) + 11644473600000000) * 10


def filetime_day(ticks: Column) -> Column:
    """Days since 1601."""
    return F.floor(ticks / F.lit(864000000000)).cast("bigint")


def sanitize_log(text: Column) -> Column:
    """Line breaks and tabs as spaces, other control characters removed."""
    return F.regexp_replace(F.regexp_replace(text, r"[\r\n\t]", " "), r"[\x00-\x1f\x7f]", "")


def snippet(content: Column, size: int = 500) -> Column:
    return F.substring(content, 1, size)


def highlight(text: Column, term: str, before: str = "[", after: str = "]") -> Column:
    """Every occurrence of the term, in any case, between markers."""
    quoted = "\\Q" + term.replace("\\E", "\\E\\\\E\\Q") + "\\E"
    mark = lambda s: s.replace("\\", "\\\\").replace("$", "\\$")
    return F.regexp_replace(text, f"(?i)({quoted})", f"{mark(before)}$1{mark(after)}")


# Classes of files by extension.
CLASSES = {
    "image": ("jpg", "jpeg", "png", "gif", "bmp", "tif", "tiff", "webp", "heic"),
    "audio": ("mp3", "wav", "flac", "ogg", "m4a"),
    "video": ("mp4", "mkv", "avi", "mov", "webm"),
    "archive": ("zip", "tar", "gz", "7z", "rar"),
    "code": ("c", "h", "cpp", "hpp", "py", "js", "ts", "go", "rs", "java", "cs", "vb"),
    "document": ("pdf", "doc", "docx", "xls", "xlsx", "ppt", "pptx", "odt", "epub", "txt", "md", "csv"),
}


def file_class(ext: Column) -> Column:
    chosen = F.lit("other")
    for name, exts in reversed(CLASSES.items()):
        chosen = F.when(ext.isin(*exts), name).otherwise(chosen)
    return chosen


def drive_signature(serial: Column, label: Column, size: Column) -> Column:
    """Fingerprint of a source: changes if its serial number, label or size does."""
    return F.sha2(F.concat_ws(":", serial.cast("string"), label, size.cast("string")), 256)
