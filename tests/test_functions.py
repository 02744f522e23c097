import datetime as dt

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sparkseek.functions import codecs, hashes, paths, rank, symbols, text


def one(spark, column, **values):
    schema = ", ".join(f"`{k}` {'bigint' if isinstance(v, int) else 'string'}" for k, v in values.items()) or "x int"
    return spark.createDataFrame([tuple(values.values()) or (1,)], schema).select(column.alias("v")).first()["v"]


def each(spark, column, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, s string")
    return [r["v"] for r in df.select("i", column.alias("v")).orderBy("i").collect()]


S = None


@pytest.fixture(autouse=True)
def column(spark):
    """Columns can only be made once there is a session."""
    global S
    S = F.col("s")


def test_names(spark):
    assert each(spark, text.normalize_name(S), ["Example.File.txt", "multi.part.name.ext", "Test-File.NAME", "ÉCOLE", None, ""]) == ["example file", "multi part name", "test file", "École", None, ""]
    assert each(spark, text.extension(S), ["a.TXT", "a.b.C", "none", "dot.", None]) == ["txt", "c", "", "", None]
    assert each(spark, paths.lowercase_ascii(S), ["AbÉ"]) == ["abÉ"]


def test_paths(spark):
    given = ["D:\\A\\B\\", "d:/a/b", "\\\\?\\D:\\a\\B", "\\\\srv\\Share\\x//", "", None, "\\"]
    assert each(spark, paths.canonical_path(S), given) == ["d:\\a\\b", "d:\\a\\b", "d:\\a\\b", "\\\\srv\\share\\x", "", None, ""]
    assert each(spark, paths.path_join(S, F.lit("child")), ["C:\\base", "C:\\base\\", "", None]) == ["C:\\base\\child", "C:\\base\\child", "child", "child"]
    assert each(spark, paths.path_dirname(S), ["C:\\", "C:\\a\\b", "a/b", "x"]) == ["C:", "C:\\a", "a", ""]
    assert each(spark, paths.drive_root(S), ["c:\\a", "\\\\srv\\sh\\x", "a\\b"]) == ["c:\\", "\\\\srv\\sh", ""]


@pytest.mark.parametrize("t, p, d, expected", [("hello", "hello", 0, True), ("hello", "hullo", 1, True), ("hello", "world", 2, False), ("short", "longer", 1, False), ("abxd", "abcd", 1, True), ("annual repprt final", "report", 2, True), (None, "a", 1, False), ("", "ab", 1, False)])
def test_fuzzy(spark, t, p, d, expected):
    assert each(spark, text.fuzzy(S, p, d), [t]) == [expected]


def test_levenshtein(spark):
    df = spark.createDataFrame([("kitten", "sitting"), ("", "abc"), ("abc", "abc")], "a string, b string")
    assert [r[0] for r in df.select(F.levenshtein("a", "b")).collect()] == [3, 3, 0]


def test_bm25(spark):
    calls = [(3, 100, 200, 1000, 10, 8.6807229), (1, 10, 10, 100, 1, 4.2096554), (0, 1, 1, 1, 1, 0.0), (1, 0, 1, 1, 1, 0.0)]
    for tf, dl, avg, n, df, expected in calls:
        assert one(spark, rank.bm25(F.lit(tf), F.lit(dl), float(avg), n, df)) == pytest.approx(expected, abs=1e-5)


def test_recency(spark):
    day = dt.date(2026, 4, 1)
    df = spark.createDataFrame([(1, "2026-03-30"), (2, "2026-03-10"), (3, "2025-01-01"), (4, "2027-01-01"), (5, None)], "i int, s string")
    assert [r[1] for r in df.select("i", rank.recency(F.col("s").cast("timestamp_ntz"), day)).orderBy("i").collect()] == [1.0, 0.5, 0.0, 0.0, 0.0]


def test_hashes(spark):
    assert each(spark, hashes.hash64(S), ["hello", "", None, "é"])[:3] == ["005a0d15131ec7a1", f"{hashes.FNV_OFFSET:016x}", None]
    assert each(spark, hashes.crc32c(S), ["hello", "", None])[:3] == ["df03cd79", "00000000", None]
    words = ["a", "bc", "x" * 1000, "ü", ""]
    assert each(spark, hashes.hash64(S), words) == [f"{hashes.fnv64_of(w.encode()):016x}" for w in words]
    assert each(spark, hashes.crc32c(S), words) == [f"{hashes.crc32c_of(w.encode()):08x}" for w in words]


def test_trigrams_and_counts(spark):
    assert each(spark, text.trigrams(S), ["abcd", "ABCABC", "ab", "", None]) == [["abc", "bcd"], ["abc", "bca", "cab"], [], [], None]
    assert each(spark, text.occurrences(S, "aa"), ["aaaa", "AAb", None, ""]) == [2, 1, 0, 0]
    with pytest.raises(ValueError):
        text.occurrences(S, "")


def test_html_mail_and_sniffing(spark):
    page = "<html><head><title>T</title><style>x</style></head><body>a <b>b</b>\n<script>no</script>c</body></html>"
    assert each(spark, text.html_text(S), [page, None]) == ["T a b c", None]
    assert each(spark, text.html_title(S), [page, "none"]) == ["T", ""]
    assert each(spark, text.sniffed(S, "author"), ["x\r\nAuthor: Ann B\r\ny", "none"]) == ["Ann B", ""]
    mail = "From: a@x\r\nSubject: S\r\n\r\nbody\r\n\r\nmore"
    assert each(spark, text.header_field(S, "Subject"), [mail, "Subject: no blank", "text\n\nSubject: later"]) == ["S", "no blank", ""]
    assert each(spark, text.mail_body(S), [mail, "none", None]) == ["body\r\n\r\nmore", "", None]
    assert each(spark, text.is_text(S), ["a", "a\0b", None]) == [True, False, False]
    assert each(spark, text.sanitize_log(S), ["a\nb\x07c"]) == ["a bc"]
    assert each(spark, text.highlight(S, "a.b"), ["xA.By aab"]) == ["x[A.B]y aab"]


def test_times(spark):
    ticks = 133485408000000000  # 2024-01-01
    assert str(one(spark, text.filetime_to_timestamp(F.col("t")).cast("string"), t=ticks)) == "2024-01-01 00:00:00"
    assert one(spark, text.filetime_to_timestamp(F.col("t")), t=0) is None
    assert one(spark, text.timestamp_to_filetime(F.lit("2024-01-01").cast("timestamp_ntz"))) == ticks
    assert one(spark, text.from_rfc3339(F.lit("2024-01-01T01:00:00+01:00")).cast("string")) == "2024-01-01 00:00:00"


CODE = """# def no():
// class No
def run(x):
class Shape:
struct Point {
enum Kind {
interface Face {
trait Walk {
type Node struct {
type Alias int
fn go() {}
func (s *T) Serve() {
Function Calc()
Sub Main()
let a = 1
const b = 2
Dim c
int main(int argc) {
if (x) {
n := 3
total = 4
if x == 4
"""


def test_symbols(spark, rows):
    df = spark.createDataFrame([(1, CODE), (2, None), (3, "")], "rec_id bigint, content string")
    found = [(r.kind, r.name) for r in symbols.code_symbols(df).orderBy("line_no").collect()]
    assert found == [
        ("function", "run"), ("class", "Shape"), ("class", "Point"), ("class", "Kind"), ("class", "Face"), ("class", "Walk"), ("class", "Node"), ("function", "go"), ("function", "Serve"),
        ("function", "Calc"), ("function", "Main"), ("var", "a"), ("var", "b"), ("var", "c"), ("function", "main"), ("var", "n"), ("var", "total"),
    ]


@given(st.binary(max_size=600) | st.builds(lambda a, n, b: a * n + b, st.binary(min_size=1, max_size=2), st.integers(0, 400), st.binary(max_size=20)))
def test_packbits(data):
    assert codecs.unpackbits(codecs.packbits(data)) == data


@given(st.lists(st.integers(0, 2**62), max_size=60))
def test_delta_varint(numbers):
    assert codecs.undelta_varint(codecs.delta_varint(numbers)) == sorted(numbers)


@given(st.lists(st.text(max_size=5), max_size=40), st.integers(1, 5))
def test_bloom(items, hashes):
    field = codecs.bloom(items, 1 << 10, hashes)
    assert codecs.bloom_has(field, items, hashes)
    assert not codecs.bloom_has(codecs.bloom([], 1 << 10), ["x"]) and codecs.bloom_has(field, [])


def test_codecs_of_columns(spark, rows):
    df = spark.createDataFrame([(1, b"aaaab", [3, 1], ["x"], [1.0, 2.0]), (2, None, None, None, None), (3, b"", [], [], [])], "id int, b binary, n array<bigint>, g array<string>, v array<double>")
    got = df.select("id", codecs.unpacked(codecs.packed(F.col("b"))).alias("b"), codecs.undeltas(codecs.deltas(F.col("n"))).alias("n"), codecs.may_hold(codecs.bloom_of(F.col("g")), F.col("g")).alias("m"), F.round(codecs.smoothed(F.col("v")), 6).alias("v"))
    assert [(r.id, None if r.b is None else bytes(r.b), r.n, r.m, r.v) for r in got.orderBy("id").collect()] == [(1, b"aaaab", [1, 3], True, 1.2), (2, None, None, None, None), (3, b"", [], True, None)]


@pytest.mark.parametrize("text, pattern, n", [("widget", "widget", 0), ("wdgt", "widget", 2), ("", "aab", 3), ("aa", "aaa", 1)])
def test_missing_characters(spark, text, pattern, n):
    assert spark.createDataFrame([(text,)], "t string").select(codecs.missing_characters(F.col("t"), pattern)).first()[0] == n
