import random

import pytest
from pyspark.sql import functions as F

from sparkseek.llm.spans import SharedSpans, chains, ends_of_runs, longest_common, stretches, winnow, window_hashes, _powers


def words(r, n):
    return " ".join("".join(r.choice("abcdefghij") for _ in range(r.randrange(2, 9))) for _ in range(n))


def corpus(seed=1, least=40):
    r = random.Random(seed)
    docs = [words(r, r.randrange(0, 60)) for _ in range(40)]
    notice, short = words(r, 12)[: least + 5].ljust(least + 5, "x"), words(r, 12)[: least - 3].ljust(least - 3, "y")
    for i in range(0, 20):
        docs[i] += r.choice([notice, short, short + "!" + notice, notice[3:], "ab" * r.randrange(5, 90), ""]) + words(r, 3)
    docs += [docs[0], docs[0], "", None, "abc", "é" * 120, "é" * 70 + "ü" + "é" * 80]
    return list(enumerate(docs))


@pytest.mark.parametrize("crowd", [200, 2])
def test_pairs_equal_brute_force(spark, crowd):
    least = 40
    docs = corpus()
    expected = {(i, j) for i, a in docs for j, b in docs if i < j and a and b and longest_common(a, b) >= least}
    df = spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("seed", F.lit(1)).withColumn("id", F.lit("clash"))
    got = [tuple(r) for r in SharedSpans(df, least=least, k=25, crowd=crowd).pairs().collect()]
    assert len(got) == len(set(got)) and set(got) == expected


def test_coverage(spark):
    a, b = "x" * 3 + "".join(map(chr, range(100, 200))), "".join(map(chr, range(100, 200))) + "yy"
    df = spark.createDataFrame([(1, a), (2, b), (3, "z" * 200), (4, b), (5, "q"), (6, None)], "doc_id bigint, text string")
    got = {r["id"]: (r["n_chars"], r["shared_chars"]) for r in SharedSpans(df, least=50, k=20).coverage().collect()}
    assert got == {1: (103, 100), 2: (102, 102), 3: (200, 0), 4: (102, 102)}


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string")
    assert SharedSpans(df).pairs().count() == 0 and SharedSpans(df).coverage().count() == 0
    with pytest.raises(ValueError):
        SharedSpans(df, least=10, k=11)


def test_fuzzy_passages(spark):
    r = random.Random(3)
    a = words(r, 120)
    b = a[:300] + "CHANGED" + a[310:]
    df = spark.createDataFrame([(1, a), (2, b)], "doc_id bigint, text string")
    rows = [x for x in SharedSpans(df, least=60, k=20).spans().collect() if not x["exact"]]
    assert max(x["a_end"] - x["a_start"] for x in rows) > 500 and max(x["same"] for x in rows) > 0.9 * len(a)


def test_chains():
    matches = [(0, 0), (10, 10), (20, 20), (5, 50), (15, 60)]
    found = chains(matches, 10)
    assert found[0] == [(0, 0), (10, 10), (20, 20)] and sorted(m for c in found for m in c) == sorted(matches)
    for c in found:
        assert all(x[0] < y[0] and x[1] < y[1] for x, y in zip(c, c[1:]))


def test_winnowing_hits_every_window():
    import numpy as np

    r = random.Random(2)
    codes = np.array([r.randrange(4) for _ in range(500)], np.uint32)
    h = window_hashes(codes, 5, _powers(1000))
    p = set(winnow(h, 7).tolist())
    assert all(p & set(range(i, i + 7)) for i in range(len(h) - 6))
    assert len(winnow(h[:3], 7)) == 0


def test_periodic_runs_out_of_phase():
    import numpy as np

    r, k, w, least = random.Random(7), 220, 81, 300
    powers = _powers(5000)

    def seeds(text):
        h = window_hashes(np.frombuffer(text.encode("utf-32-le"), np.uint32), k, powers)
        return [(int(h[p]), int(p)) for p in ends_of_runs(h, winnow(h, w), k, w)]

    def covered(text, other):
        held = {other[i : i + least] for i in range(len(other) - least + 1)}
        return {c for i in range(len(text) - least + 1) if text[i : i + least] in held for c in range(i, i + least)}

    for case in range(240):
        period = r.choice([1, 2, 3, 7, r.randrange(10, 60), r.randrange(20, 81)])
        unit = "".join(r.choice("abcdefgh") for _ in range(period)) * (2000 // period)
        texts = []
        for side in range(2):
            at, n = r.randrange(period), r.randrange(300, 340) if case % 3 else r.randrange(300, 1500)
            texts.append(words(r, 20 * (case % 2)) + "#" + unit[at : at + n] + "*+"[side] + words(r, 20))
        a, b = texts
        matches = [(p, q) for h, p in seeds(a) for g, q in seeds(b) if g == h]
        found = {x for m in matches for x in stretches(a, b, [m]) if x[2] >= least}
        assert {c for s, _, n in found for c in range(s, s + n)} == covered(a, b), (period, case)
        assert {c for _, s, n in found for c in range(s, s + n)} == covered(b, a), (period, case)
