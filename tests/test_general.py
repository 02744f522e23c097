"""Change feeds, trees and the work ledger."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from sparkseek.operators import changes, ledger, tree
from sparkseek.operators.shared import SharedFolder

FEED = "delivery_id bigint, received_at timestamp_ntz, volume_id int, journal_seq bigint, usn bigint, op int, parent_path string, name string, modified_time timestamp_ntz"
T0 = datetime(2026, 3, 1)
DONE = "item string, major bigint, minor bigint, scanned timestamp_ntz"


def feed(spark, changes_):
    """(volume, journal, usn, op, path, name, modified minutes, received minutes)"""
    rows = [(i, T0 + timedelta(minutes=c[7]), c[0], c[1], c[2], c[3], c[4], c[5], None if c[6] is None else T0 + timedelta(minutes=c[6])) for i, c in enumerate(changes_)]
    return spark.createDataFrame(rows, FEED)


def model(changes_):
    """The last change of each file, plainly."""
    last = {}
    for v, j, u, op, path, name, m, _ in changes_:
        if path is None or name is None or op not in (0, 1):
            continue
        low = lambda s: "".join(c.lower() if "A" <= c <= "Z" else c for c in s)
        p = low(path).replace("/", "\\")
        p = (p[4:] if p.startswith("\\\\?\\") else p).rstrip("\\")
        key = (v, p, low(name))
        if key not in last or (j, u) > last[key][:2]:
            last[key] = (j, u, op, m)
    return last


def random_changes(seed, n=400):
    r = random.Random(seed)
    out = []
    for u in range(n):
        v, j = r.choice([0, 0, 0, 1, None]), r.choice([1, 1, 2])
        path = r.choice(["D:\\A", "d:/a/", "\\\\?\\D:\\a", "D:\\B", None, "x"])
        c = (v, j, u * 10, r.choice([0, 0, 0, 1, 7]), path, r.choice(["F", "f", "g", "h.txt", None]), r.choice([None, u, 5]), r.randrange(1000))
        out += [c] * r.choice([1, 1, 2])
    r.shuffle(out)
    return out


@pytest.mark.parametrize("seed, batches", [(1, 4), (2, 1), (3, 7)])
def test_current_files(spark, rows, seed, batches):
    cs = random_changes(seed)
    expected = sorted([(k[0], j, u) for k, (j, u, op, _) in model(cs).items() if op == 0], key=repr)
    got = changes.current_files(feed(spark, cs), batches=batches)
    assert rows(got, "volume_id", "journal_seq", "usn") == expected


def test_current_files_edges(spark, rows):
    assert changes.current_files(feed(spark, [])).count() == 0
    hot = [(1, 1, u, 0, "D:\\a", "log", u, u) for u in range(500)] + [(1, 2, 3, 1, "D:\\b", "gone", None, 1), (1, 1, 9, 1, "D:\\never", "x", None, 1)]
    assert rows(changes.current_files(feed(spark, hot)), "journal_seq", "usn") == [(1, 499)]
    clash = feed(spark, hot).withColumn("__batch", F.lit("x")).withColumn("file_path", F.lit("y")).withColumn("__key", F.lit(1))
    assert rows(changes.current_files(clash), "usn") == [(499,)]


def test_base_rows(spark, rows):
    base = spark.createDataFrame([(1, "d:\\a", "log", 0, 0, None), (1, "d:\\keep", "k", 0, 1, None), (1, "d:\\b", "gone", 0, 2, None)], "volume_id int, file_path string, file_name string, journal_seq bigint, usn bigint, modified_time timestamp_ntz")
    cs = [(1, 1, 5, 0, "D:\\A", "LOG", 1, 1), (1, 1, 6, 1, "D:\\B", "gone", None, 1)]
    got = changes.current_files(feed(spark, cs), values=["modified_time"], base=base)
    assert rows(got, "file_path", "usn") == [("d:\\a", 5), ("d:\\keep", 1)]


def test_scope_must_be_in_key(spark):
    with pytest.raises(ValueError):
        changes.current_state(feed(spark, []), ["name"], ["journal_seq", "usn"], scope=["volume_id"])


def tree_model(links):
    parent = {f: p for f, p in links.items()}
    out, children = {}, {}
    for f, p in parent.items():
        if p and p in parent:
            children.setdefault(p, []).append(f)
    roots = [f for f, p in parent.items() if not p or p not in parent]
    for root in roots:
        stack = [(root, 0)]
        order = []
        while stack:
            f, d = stack.pop()
            order.append(f)
            out[f] = [root, d, 0]
            stack += [(c, d + 1) for c in children.get(f, [])]
        for f in reversed(order):
            out[f][2] = sum(out[c][2] + 1 for c in children.get(f, []))
    return sorted(((f, *(out[f] if f in out else [-1, -1, -1])) for f in parent), key=repr)


def entries(spark, links):
    return spark.createDataFrame([(f, p, f"n{f}") for f, p in links.items()], "frn bigint, parent bigint, name string")


def test_tree_random(spark, rows):
    r = random.Random(5)
    links = {1: 0, 2: 99999}
    for f in range(3, 250):
        links[f] = r.choice([r.randrange(1, f), f - 1, 2, 2])
    links |= {1000 + i: 1000 + i - 1 for i in range(1, 60)} | {1000: 0}  # a chain
    links |= {2000: 2001, 2001: 2002, 2002: 2000, 2003: 2003, 2004: 2003, 2005: 2001, 2006: 2005}  # loops and what hangs on them
    latest = tree.latest_entries(entries(spark, links).withColumn("usn", F.lit(1)))
    paths = {}
    # in one task, some rounds distributed, all of them, and with folders that count as busy
    for small, busy in ((1000, 50_000), (40, 50_000), (0, 50_000), (60, 5)):
        got = tree.hierarchy(latest, with_path=True, small=small, busy=busy)
        assert rows(got, "frn", "root_frn", "depth", "descendants") == tree_model(links)
        paths[small] = rows(got, "frn", "path")
    assert paths[1000] == paths[40] == paths[0] == paths[60]
    tree_ = tree.lineages(latest).cache()
    below = {}
    for r in tree.descendants(tree_).collect():
        below.setdefault(r.frn, set()).add(r.below_frn)
    assert {f: d for f, _, _, d in tree_model(links) if d > 0} == {f: len(b) for f, b in below.items()}
    assert {r.frn for r in tree.subtree(tree_, 1020).collect()} == below[1020] == set(range(1021, 1060))
    assert tree.subtree(tree_, 2001).count() == 0


def test_tree_edges(spark, rows):
    schema = "frn bigint, parent bigint, name string, usn bigint"
    assert tree.hierarchy(tree.latest_entries(spark.createDataFrame([], schema))).count() == 0
    assert tree.descendants(tree.lineages(tree.latest_entries(spark.createDataFrame([], schema)))).count() == 0
    df = spark.createDataFrame([(1, 0, "r", 1), (2, 1, None, 1), (2, 9, "old", 0), (2, 1, None, 1), (3, 2, "c", None), (None, 1, "x", 1)], schema)
    got = tree.hierarchy(tree.latest_entries(df), with_path=True)
    assert rows(got, "frn", "root_frn", "depth", "descendants", "path") == [(1, 1, 0, 2, "r"), (2, 1, 1, 1, "r\\"), (3, 1, 2, 0, "r\\\\c")]


def test_pending_files(spark, rows):
    cs = random_changes(9, 300)
    r = random.Random(4)
    runs = [(v, j, r.randrange(3000), r.randrange(1000)) for v in (0, 1) for j in (1, 2) for _ in range(6)]
    done_df = spark.createDataFrame([(str(v), j, u, T0 + timedelta(minutes=m)) for v, j, u, m in runs], DONE)
    first = {}
    for c in cs:
        first[c[:3]] = min(first.get(c[:3], 10**9), c[7])
    handled = [c for c in cs if any(c[0] == v and first[c[:3]] <= m and (c[1], c[2]) <= (j, u) for v, j, u, m in runs)]
    last, done = model(cs), model(handled)
    state = lambda x: None if x is None or x[2] == 1 else ("there", x[3])
    expected = sorted([(k[0], x[0], x[1]) for k, x in last.items() if state(x) != state(done.get(k))], key=repr)
    files = changes.file_changes(feed(spark, cs))
    assert rows(ledger.pending_files(files, done_df), "volume_id", "journal_seq", "usn") == expected
    # the way without a broadcast
    for most in (200_000, 0):
        settled = ledger.settle(files, done_df, "volume_id", ["journal_seq", "usn"], "received_at", max_steps=2, most=most, salts=3)
        states = sorted((r.delivery_id, r.state) for r in settled.select("delivery_id", "state").collect())
        if most:
            first_way = states
    assert states == first_way and len(states) == files.count()


def test_salted_batches(spark, rows):
    cs = changes.file_changes(feed(spark, random_changes(11)))
    picked = cs.select("volume_id", "journal_seq", "usn")
    a, b = (changes.order_batches(picked, ["volume_id"], "journal_seq", "usn", 4, most=m, salts=3) for m in (100, 0))
    assert rows(a) == rows(b) and {r[-1] for r in rows(a)} == {0, 1, 2, 3}
    worst = {}
    for v, j, u, n in rows(a):
        worst.setdefault((v, n), []).append((j, u))
    for (v, n), places in worst.items():
        newer = [p for (w, m), ps in worst.items() if w == v and m < n for p in ps]
        assert not newer or max(places) < min(newer) or n == 0


RUN = "run_id int, volume_id int, last_usn bigint, last_scan_time timestamp_ntz, generation bigint"
HEAD = "volume_id int, generation bigint, journal_seq bigint"


def test_enter_runs(spark, rows, tmp_path):
    state = spark.createDataFrame([(1, 0, 50, T0, 7), (1, 0, 50, T0, 7), (2, 0, 60, T0, 8), (3, 1, 70, T0, 7)], RUN)
    head = spark.createDataFrame([(0, 7, 2), (0, 7, 2), (1, 9, 1), (0, 8, None)], HEAD)
    book = ledger.WorkLedger(spark, f"file://{tmp_path}/book", Clock())
    for _ in range(2):  # entering again changes nothing
        ledger.enter_runs(book, state, head)
        assert rows(book.rows(), "item", "token", "state", "major", "minor") == [("0", 7, "done", 2, 50), ("0", 8, "done", None, 60), ("1", 7, "pending", None, 70)]
    assert rows(ledger.done_reaches(book.rows())) == [("0", 2, 50, T0)]
    none = ledger.WorkLedger(spark, f"file://{tmp_path}/none", Clock())
    assert none.rows().count() == 0 and ledger.done_reaches(none.rows()).count() == 0
    everything = changes.file_changes(feed(spark, [(0, 1, 1, 0, "a", "b", None, 1)]))
    assert ledger.pending_files(everything, ledger.done_reaches(none.rows())).count() == 1


def test_journal_gaps(spark, rows):
    cs = feed(spark, [(0, 2, 5, 0, "a", "b", 1, 1), (1, 1, 80, 0, "a", "b", 1, 1), (2, 1, 9, 0, "a", "b", 1, 1), (3, 1, 9, 0, "a", "b", 1, 1), (None, 1, 1, 0, "a", "b", 1, 1)])
    done = spark.createDataFrame([("0", 1, 50, T0), ("1", 1, 70, T0), ("2", 1, 9, T0)], DONE)
    assert rows(ledger.journal_gaps(cs, done), "volume_id", "reason") == [(0, "new journal"), (1, "lost"), (3, "never")]
    assert ledger.journal_gaps(feed(spark, []), done).count() == 0


class Clock:
    def __init__(self):
        self.now = T0

    def __call__(self):
        return self.now


def test_ledger(spark, tmp_path):
    clock = Clock()
    book = ledger.WorkLedger(spark, f"file://{tmp_path}/ledger", clock)
    assert book.add("b1", {"n": 1}) and not book.add("b1") and book.state("b1") == ledger.PENDING
    first = book.lease(60, "w1")
    assert first.token == 1 and book.state("b1") == ledger.LEASED and book.lease(60, "w2") is None
    clock.now += timedelta(seconds=61)
    assert book.state("b1") == ledger.PENDING
    second = book.lease(60, "w2")
    assert second.token == 2 and second.path != first.path
    with pytest.raises(ledger.StaleWriter):
        book.commit(first)
    assert book.commit(second) and book.commit(second) and book.state("b1") == ledger.DONE
    with pytest.raises(ledger.StaleWriter):
        book.commit(first)
    assert book.lease(60) is None and book.outputs() == [second.path]
    book.add("b2", {"n": 3})
    assert book.run(lambda b, about: spark.range(about["n"]), worker="w3") == 1
    assert spark.read.parquet(book.outputs()[1]).count() == 3


class Died(Exception):
    pass


def test_ledger_survives_deaths(spark, rows, tmp_path, monkeypatch):
    clock = Clock()
    book = ledger.WorkLedger(spark, f"file://{tmp_path}/l", clock)
    publish = SharedFolder._publish

    def die(self, part, name):
        raise Died

    state = lambda: [(r.token, r.state) for r in book.rows().orderBy("token").collect()]
    with monkeypatch.context() as m:  # while it is entered
        m.setattr(SharedFolder, "_publish", die)
        with pytest.raises(Died):
            book.add("a/b.c_d", {})
    assert book.batches() == [] and book.add("a/b.c_d", {"n": 2}) and book.batches() == ["a/b.c_d"] and state() == [(0, "pending")]
    with monkeypatch.context() as m:  # while it is leased: nothing was granted
        m.setattr(SharedFolder, "_publish", die)
        with pytest.raises(Died):
            book.lease(60, "w1")
    first = book.lease(60, "w1")
    assert first.token == 1 and state() == [(1, "leased")]
    spark.range(1).write.parquet(first.path)  # while it writes: the lease runs out
    clock.now += timedelta(seconds=61)
    assert state() == [(1, "pending")]
    second = ledger.WorkLedger(spark, book.folder, clock).lease(60, "w2")
    assert second.token == 2 and state() == [(1, "pending"), (2, "leased")]
    spark.range(2).write.parquet(second.path)
    with monkeypatch.context() as m:  # while it commits: not committed, the next one does the work again
        m.setattr(SharedFolder, "_publish", die)
        with pytest.raises(Died):
            book.commit(second)
    assert book.state("a/b.c_d") == ledger.LEASED
    clock.now += timedelta(seconds=61)
    third = book.lease(60, "w3")
    spark.range(2).write.parquet(third.path)
    with pytest.raises(ledger.StaleWriter):
        book.commit(second)
    assert book.commit(third) and book.commit(third)  # and after it: the answer was lost
    assert state() == [(1, "pending"), (2, "pending"), (3, "done")]
    assert book.outputs() == [third.path] and spark.read.parquet(*book.outputs()).count() == 2
    assert book.lease(60) is None and publish is SharedFolder._publish


def test_rivals(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    books = [ledger.WorkLedger(spark, f"file://{tmp_path}/r", Clock()) for _ in range(4)]
    for i in range(20):
        books[0].add(f"b{i}")

    def all_leases(book):
        got = []
        while (x := book.lease(60)) is not None:
            got.append(x.batch)
        return got

    with ThreadPoolExecutor(4) as pool:
        taken = [b for got in pool.map(all_leases, books) for b in got]
    assert sorted(taken) == sorted(f"b{i}" for i in range(20))
