import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from sparkseek.model import as_records
from sparkseek.operators import dedup, postings, search, sinks, store
from sparkseek.operators.cache import ResultCache
from sparkseek.plans.ast import And, Not, Or, Term
from sparkseek.plans.compile import filters, predicate
from sparkseek.plans.parser import parse

DAY = dt.date(2026, 4, 1)
M = dt.datetime(2026, 3, 30)
DATA = [
    (1, "C:\\Docs", "Annual_Report.txt", 100, M, "the annual report of the garden", "ann"),
    (2, "C:\\docs\\old", "report-final.PDF", 2000, None, "garden garden GARDEN", None),
    (3, "D:\\x", "notes", 5, dt.datetime(2020, 1, 1), None, "bob"),
    (4, None, None, None, None, "", None),
    (5, "C:\\Docs2", "Multi.part-name_x.EXT", 7, dt.datetime(2030, 1, 1), "a" * 50_000 + " zebra", "Ann"),
    (6, "C:\\Docs", "reporter.md", 100, M, "naïve café", "ann"),
]


@pytest.fixture(scope="module")
def records(spark):
    df = spark.createDataFrame(DATA, "rec_id bigint, parent string, name string, size bigint, mtime timestamp_ntz, content string, author string")
    return as_records(df).cache()


@pytest.mark.parametrize(
    "query, ids",
    [
        ("report", [1, 2, 6]), ("report whole:yes", [1, 2]), ("NOT report", [3, 4, 5]), ("content:garden", [1, 2]), ("NOT content:garden", [3, 4, 5, 6]), ("author:ann", [1, 6]),
        ("NOT author:ann", [2, 3, 4, 5]), ("ext:pdf", [2]), ("size:100", [1, 6]), ("NOT size:>6", [3, 4]), ("dm:7d..today", [1, 6]), ("path:c:\\docs", [1, 2, 5, 6]), ("regex:^[a-z]+$", [3]),
        ("report NOT whole:yes", [1, 2]), ("whole:yes", [1, 2, 3, 4, 5, 6]), ("NOT report whole:yes", [3, 4, 5, 6]), ("fuzzy:repprt~1", [1, 2, 6]), ("", [1, 2, 3, 4, 5, 6]), ("content:CAFÉ", [6]), ("content:zebra", [5]), ("content:a", [1, 2, 5, 6]), ("multi.part.name", [5]),
    ],
)
def test_queries(records, query, ids):
    assert sorted(r.rec_id for r in search.search(records, query, DAY, limit=None).collect()) == ids


def random_tree(r, depth=3):
    if depth == 0 or r.random() < 0.3:
        return Term(r.choice(["name", "content"]), r.choice(["report", "garden", "a", "annual", "zebra", "caf", "nope", "no"]))
    kind = r.choice([And, Or, Not, And])
    return Not(random_tree(r, depth - 1)) if kind is Not else kind(random_tree(r, depth - 1), random_tree(r, depth - 1))


def test_index_equals_scan(records):
    posts = postings.build_postings(records).cache()
    stats = postings.gram_stats(posts)
    r = random.Random(7)
    for i in range(12):
        tree = random_tree(r)
        by_index = sorted(x.rec_id for x in postings.index_search(records, posts, tree, stats if i % 2 else None, few=1 if i % 3 else 2000).collect())
        assert by_index == sorted(x.rec_id for x in records.where(predicate(tree)).collect()), tree


def test_postings_are_all_windows(spark, rows):
    texts = ["abcabc", "ab", "", None, "Ünï😀cödé ẞ", "a\0b\0c", "x" * 5000 + "y"]
    df = as_records(spark.createDataFrame(list(enumerate(texts)), "rec_id bigint, content string"))
    low = dict(df.selectExpr("rec_id", "lower(content)").collect())
    plain = sorted({("content", t[i : i + 3], k) for k, t in low.items() if t for i in range(len(t) - 2)})
    assert sorted(rows(postings.build_postings(df, ["content"]))) == plain
    counts = {}
    for _, g, _k in plain:
        counts[g] = counts.get(g, 0) + 1
    for stats in (postings.count_grams(df, ["content"]), postings.gram_stats(postings.build_postings(df, ["content"]))):
        assert {r.gram: r.df for r in stats.collect()} == counts


def test_stored_index(spark, records, tmp_path, rows):
    index = postings.GramIndex(spark, f"file://{tmp_path}/index")
    assert index.postings().count() == 0 and index.stats().count() == 0 and index.merge() == 0
    assert index.add(records, "a") == 1 and index.add(records, "a") == 1
    ask = lambda q, pool=records: sorted(r.rec_id for r in postings.index_search(pool, index.postings(), parse(q, DAY), index.stats()).collect())
    assert ask("content:garden") == [1, 2] and ask("report OR content:zebra") == [1, 2, 5, 6]
    index.remove(records.where("rec_id = 2").select("rec_id"), "b")
    assert ask("content:garden") == [1]
    changed = records.where("rec_id = 1").withColumn("content", F.lit("nothing of the kind"))
    index.add(changed, "c")
    pool = records.where("rec_id not in (1, 2)").unionByName(changed)
    assert ask("content:garden", pool) == [] and ask("content:nothing", pool) == [1]
    before = rows(index.postings())
    assert index.merge() == 4 and rows(index.postings()) == before and len(index.parts()) == 1


def test_terms_keep_their_frequency(records):
    """In corpus mode what a term is worth does not depend on the rest of the query."""
    alone = {r.rec_id: r.score for r in search.search(records, "content:zebra", DAY, bm25="corpus").collect()}
    both = {r.rec_id: r.score for r in search.search(records, "content:zebra OR content:garden", DAY, bm25="corpus").collect()}
    assert alone[5] == both[5] > 0 and both[1] > 0 and both[2] > both[1]


def test_form_filters(records):
    ids = lambda f: sorted(r.rec_id for r in records.where(f).collect())
    assert ids(filters()) == [1, 2, 3, 4, 5, 6] and ids(filters(ext="TXT")) == [1] and ids(filters(path_part="DOCS")) == [1, 2, 5, 6]
    assert ids(filters(megabytes=(0.0005, None))) == [2] and ids(filters(days=(None, dt.date(2021, 1, 1)))) == [3]
    assert [r.rec_id for r in search.search(records, "report", DAY, where=filters(ext="md")).collect()] == [6]


def test_modes(records):
    posts = postings.build_postings(records)
    for mode in ("scan", "index", "auto"):
        hits = search.search(records, "content:garden", DAY, mode=mode, postings=posts).collect()
        assert [h.rec_id for h in hits] == [2, 1] or sorted(h.rec_id for h in hits) == [1, 2]
    with pytest.raises(ValueError):
        search.search(records, "a", DAY, mode="index")


def test_ranks_and_ties(records):
    hits = search.search(records, "report", DAY).collect()
    assert [h.score for h in hits] == sorted((h.score for h in hits), reverse=True)
    ties = search.search(records, "size:100", DAY).collect()
    assert [h.rec_id for h in ties] == [1, 6]
    assert search.search(records, "report", DAY, rank="simple", limit=1).count() == 1
    assert search.search(records, "content:garden", DAY, bm25="corpus").count() == 2


def test_acl_comes_before_the_limit(spark, records):
    acl = spark.createDataFrame([("ann", "c:/docs/"), ("bob", None)], "principal string, path_prefix string")
    assert sorted(r.rec_id for r in search.search(records, "", DAY, acl=acl, principal="ann", limit=2).collect()) == [1, 6]
    assert search.search(records, "", DAY, acl=acl, principal="ann", limit=None).count() == 3
    assert search.search(records, "", DAY, acl=acl, principal="bob").count() == 0
    assert search.search(records, "", DAY, acl=acl, principal=None).count() == 0


def test_presentation(records):
    hits = search.search(records, "report", DAY)
    shown = {r.rec_id: r for r in search.presented(hits).collect()}
    assert shown[1].path == "C:\\Docs\\Annual_Report.txt" and shown[2].type == "document"
    assert [r.rec_id for r in search.sort_hits(hits, "name", False).collect()] == [1, 2, 6]
    assert sinks.json_lines(hits).count() == 3 and sinks.text_lines(hits).count() == 3
    with pytest.raises(ValueError):
        search.sort_hits(hits, "colour")


def test_stages(records):
    staged = search.best_stage(search.staged(records, "report OR content:garden OR author:ann", DAY))
    assert sorted((r.rec_id, r.stage, r.confidence) for r in staged.collect()) == [(1, 2, 95), (2, 2, 95), (6, 1, 75)]
    assert search.staged(records, "size:100", DAY).count() == 2


def test_empty_table(spark, records):
    none = records.limit(0)
    assert search.search(none, "content:a NOT b", DAY).count() == 0
    assert postings.build_postings(none).count() == 0
    assert dedup.duplicate_groups(none).count() == 0


def test_duplicates(spark, rows):
    df = spark.createDataFrame([(1, 5, "x"), (2, 5, "x"), (3, 5, "y"), (4, None, "x"), (5, 5, "x"), (6, None, "x")], "rec_id bigint, size bigint, content_hash string")
    assert rows(dedup.duplicate_groups(df), "n", "first_id") == [(3, 1)]
    assert rows(dedup.members(df), "rec_id", "first_id") == [(1, 1), (2, 1), (5, 1)]
    assert rows(dedup.keep_first(df), "rec_id") == [(1,), (3,), (4,), (6,)]
    assert rows(dedup.latest(df, ["content_hash"], ["rec_id"]), "rec_id") == [(3,), (6,)]


def test_store(spark, tmp_path, rows):
    s = store.RecordStore(spark, f"file://{tmp_path}/store")
    assert s.generation == 0 and s.read() is None
    schema = "parent string, name string, size bigint, op int, event_time bigint, seq bigint"
    log = [("p", "a", 1, 0, 1, 1), ("p", "a", 2, 0, 2, 1), ("p", "b", 1, 0, 1, 1), ("p", "b", None, 1, 2, 1), ("q", "a", 9, 0, 1, 1), (None, "n", 4, 0, 1, 1), ("p", "c", 1, 5, 1, 1)]
    s.apply(spark.createDataFrame(log, schema), "one")
    assert rows(s.read(), "parent", "name", "size") == [("p", "a", 2), ("q", "a", 9), (None, "n", 4)] or rows(s.read(), "parent", "name", "size") == [(None, "n", 4), ("p", "a", 2), ("q", "a", 9)] or len(rows(s.read())) == 3
    assert s.apply(spark.createDataFrame(log, schema), "one") == 1
    s.upsert(spark.createDataFrame([("p", "a", 7)], "parent string, name string, size bigint"), "two")
    assert s.get("p", "a").first()["size"] == 7 and s.read(1).where("name = 'a' AND parent = 'p'").first()["size"] == 2
    s.delete(spark.createDataFrame([("p", "a")], "parent string, name string"), "three")
    assert s.get("p", "a").count() == 0 and s.get("q", "a").count() == 1 and s.generation == 3
    s.compact(f"file://{tmp_path}/compact", 1)
    assert spark.read.parquet(f"file://{tmp_path}/compact").count() == 2
    assert s.delete(spark.createDataFrame([("p", "zz")], "parent string, name string"), "four") == 4 and s.read().count() == 2
    assert s.get(None, "n").first()["size"] == 4


def test_store_takes_batches_in_any_order(spark, tmp_path, rows):
    schema = "parent string, name string, size bigint, op int, event_time bigint, seq bigint"
    r = random.Random(3)
    log = [("p" if i % 3 else None, r.choice("abcdef"), i, r.choice([0, 0, 1]), i // 4, i) for i in range(60)]
    last = {}
    for p, n, size, op, t, q in log:
        last[p, n] = (size, op)
    expected = sorted([(p, n, size) for (p, n), (size, op) in last.items() if op == 0], key=repr)
    r.shuffle(log)
    s = store.RecordStore(spark, f"file://{tmp_path}/any", buckets=3, layers=3)
    batches = [log[i : i + 12] for i in range(0, 60, 12)]
    for i, b in enumerate(batches):
        s.apply(spark.createDataFrame(b, schema), f"b{i}")
    assert rows(s.read(), "parent", "name", "size") == expected
    assert s.header()["bases"] and len(s.header()["changes"]) < 3  # merged on the way
    g = s.generation
    assert s.apply(spark.createDataFrame(batches[0], schema), "b0") == g
    # a batch that comes again under another name finds rows and tombstones that are newer
    s.apply(spark.createDataFrame(batches[0], schema), "again")
    assert rows(s.read(), "parent", "name", "size") == expected
    s.apply(spark.createDataFrame([], schema), "empty")
    assert rows(s.read(), "parent", "name", "size") == expected
    s.merge()
    assert s.header()["changes"] == [] and rows(s.read(), "parent", "name", "size") == expected
    late = spark.createDataFrame([("p", "a", 1, 0, -5, 0), ("z", "new", 2, 0, -5, 0)], schema)
    s.apply(late, "late")
    assert rows(s.read(), "parent", "name", "size") == sorted([*expected, ("z", "new", 2)], key=repr)


def test_store_writer_dies(spark, tmp_path, monkeypatch):
    from sparkseek.operators.shared import SharedFolder

    s = store.RecordStore(spark, f"file://{tmp_path}/dies")
    one = spark.createDataFrame([("p", "a", 1, 0, 1, 1)], "parent string, name string, size bigint, op int, event_time bigint, seq bigint")
    with monkeypatch.context() as m:
        m.setattr(SharedFolder, "_publish", lambda self, part, name: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            s.apply(one, "b")
    assert s.generation == 0 and s.read() is None
    s.apply(one, "b")
    assert s.generation == 1 and s.read().count() == 1


def test_cache(spark):
    now = [0.0]
    cache = ResultCache(entries=2, ttl=10, clock=lambda: now[0])
    make = lambda: spark.range(3)
    assert cache.get(1, "a", make) is cache.get(1, "a", make) and cache.hits == 1
    cache.get(2, "a", make)
    cache.get(2, "b", make)
    assert len(cache) == 2
    now[0] = 11
    cache.get(2, "b", make)
    assert cache.misses == 4
    cache.invalidate(3)
    assert len(cache) == 0
    assert parse("a", DAY) == parse("a", DAY)


def test_cache_holds_no_more_bytes_than_it_may(spark):
    cache = ResultCache(most_bytes=200_000)
    for i in range(5):
        cache.get(1, str(i), lambda: spark.range(10_000).withColumn("x", F.rand(1)))
    assert 0 < len(cache) < 5
    assert cache.get(1, "big", lambda: spark.range(200_000).withColumn("x", F.rand(1))).count() == 200_000 and (1, "big") not in cache._held


def test_results_larger_than_memory_allows_are_kept_on_disk(spark, records):
    cache = ResultCache(entries=2, most_bytes=200_000)
    held = lambda: sum(x.memSize() for x in spark.sparkContext._jsc.sc().getRDDStorageInfo())
    make = lambda: spark.range(200_000).withColumn("x", F.rand(1)).orderBy("x", "id")
    small = cache.get(1, "small", lambda: spark.range(3))
    before = held()
    first = cache.get(1, "big", make)
    assert cache.get(1, "big", make) is first and cache.get(1, "small", lambda: spark.range(3)) is small and (cache.hits, cache.misses) == (2, 2)
    assert first.storageLevel.useDisk and not first.storageLevel.useMemory and held() == before
    assert [r.id for r in first.collect()] == [r.id for r in make().collect()]
    cache.get(1, "bigger", lambda: spark.range(400_000).withColumn("x", F.rand(1)))
    assert len(cache) == 2 and not first.storageLevel.useDisk  # more than twice most_bytes together: only the newest stays
    assert first.count() == 200_000
    cache.invalidate(2)
    assert len(cache) == 0
    tiny, posts = ResultCache(most_bytes=0), postings.build_postings(records)
    ask = lambda kept: search.search(records, "content:garden", DAY, limit=None, mode="index", postings=posts, cache=kept, generation=1).collect()
    plain = ask(None)
    assert plain and ask(tiny) == plain and ask(tiny) == plain and tiny.hits == 1  # whole rows in their order, the second time from the cache
    tiny.clear()
    assert len(tiny) == 0


def test_cached_search(spark, records, tmp_path):
    cache = ResultCache()
    ask = lambda q, g=1, **o: [r.rec_id for r in search.search(records, q, DAY, cache=cache, generation=g, **o).collect()]
    assert ask("content:garden") == ask(" content:garden ") and cache.hits == 1
    assert ask("content:garden", 2) and cache.hits == 1  # another generation
    assert ask("content:garden", limit=1) and cache.hits == 1
    posts = postings.build_postings(records)
    ask("content:garden content:annual", mode="index", postings=posts, limit=7)
    ask("content:garden NOT content:annual", mode="index", postings=posts, limit=7)
    assert cache.hits == 3  # both terms
    assert len(search.staged(records, "report", DAY, cache, 1).collect()) == len(search.staged(records, "report", DAY, cache, 1).collect()) and cache.hits == 4
    acl = spark.createDataFrame([("ann", "c:/docs/")], "principal string, path_prefix string")
    seen = ResultCache()
    for who, n in (("ann", 3), ("bob", 0), ("ann", 3)):
        assert search.search(records, "report", DAY, cache=seen, acl=acl, principal=who).count() == n
    now = [0.0]
    for _ in range(2):
        files = ResultCache(ttl=10, clock=lambda: now[0], spark=spark, folder=f"file://{tmp_path}/cache")
        assert files.get(1, "a", lambda: spark.range(4)).count() == 4
    assert files.hits == 1
    now[0] = 11
    assert files.get(1, "a", lambda: spark.range(5)).count() == 5 and files.misses == 1
    files.invalidate(2)
    assert ResultCache(clock=lambda: now[0], spark=spark, folder=f"file://{tmp_path}/cache").get(1, "a", lambda: spark.range(6)).count() == 6
