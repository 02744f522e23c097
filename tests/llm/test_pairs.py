"""Leaks and containers."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkseek.llm import leaks, packing

WORDS = [a + b for a in "bcdfgklm" for b in ("ar", "en", "ilo", "otu", "ux", "ape", "iri")]


def sentence(r, n):
    return [r.choice(WORDS) for _ in range(n)]


def test_words():
    assert leaks.words("Größe, NAÏVE—96,520 x_y") == ["grosse", "naive", "96", "520", "x", "y"]


def test_search_equals_scoring_everything():
    r = random.Random(1)
    items = [(i, " ".join(sentence(r, 30))) for i in range(70)]
    index = leaks.ItemIndex(items, leaks.Rules(block=4))
    text = sentence(r, 400)
    text[100:120] = items[5][1].split()[4:24]
    tokens = np.array([index.vocabulary.get(w, -1) for w in text], np.int64)
    rules = index.rules
    expected = set()
    for p in range(len(tokens) // rules.stride + 1):
        window = tokens[p * rules.stride : p * rules.stride + rules.passage]
        have = {int(a * index.size + b) for a, b in zip(window, window[1:]) if a >= 0 and b >= 0}
        for i in range(len(items)):
            own = [t for t in range(len(index.terms)) if int(index.terms[t]) in have and i in index.item[index.start[t] : index.start[t + 1]]]
            s = sum(index.weight[index.start[t] : index.start[t + 1]][index.item[index.start[t] : index.start[t + 1]] == i][0] for t in own)
            if s >= index.threshold[i]:
                expected.add((p, i))
    index._in_line = lambda at, term, found: found
    got = set(zip(*(a.tolist() for a in index.search(tokens))))
    assert got == expected and any(i == 5 for _, i in got)


def _shares(a, b, n):
    return bool({tuple(a[i : i + n]) for i in range(len(a) - n + 1)} & {tuple(b[i : i + n]) for i in range(len(b) - n + 1)})


def test_leaks(spark):
    r = random.Random(4)
    items = [(i, " ".join(sentence(r, 34))) for i in range(50)] + [(90, None), (91, ""), (92, "too short")]
    docs, truth = [], set()
    for d in range(120):
        text = sentence(r, r.randrange(20, 300))
        if d % 3 == 0:
            i = r.randrange(50)
            n = r.randrange(17, 32)
            at = r.randrange(0, 34 - n + 1)
            passage = items[i][1].split()[at : at + n]
            for _ in range(n // 12):
                passage[r.randrange(2, n - 2)] = "Zzz"
            k = r.randrange(len(text))
            text[k:k] = [w.upper() + "," for w in passage]
            truth.add((d, i))
        docs.append((d, "  \n".join(text)))
    docs += [(500, None), (501, ""), (502, "x"), (503, " ".join(sentence(r, 60_000)) + " " + items[7][1])]
    truth.add((503, 7))
    df = spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("test_id", F.lit("clash"))
    its = spark.createDataFrame(items, "test_id bigint, text string").withColumn("doc_id", F.lit("clash"))
    got = {(x["doc_id"], x["test_id"]) for x in leaks.leaks(df, its).collect()}
    assert truth <= got and len(got - truth) <= 1
    assert leaks.leaks(df, its.limit(0)).count() == 0 and leaks.leaks(df.limit(0), its).count() == 0
    # the items in slices, each with an index of its own
    assert {(x["doc_id"], x["test_id"]) for x in leaks.leaks(df, its, slice_chars=50).collect()} == got
    plain = lambda t: leaks.words(t or "")
    runs = {(d["doc_id"], t["test_id"]) for d in df.collect() for t in its.collect() if d["text"] and t["text"] and _shares(plain(d["text"]), plain(t["text"]), 14)}
    assert {(x["doc_id"], x["test_id"]) for x in leaks.leaks(df, its, leaks.Rules(edits=0)).collect()} == runs


def test_alignment():
    a = np.arange(30)
    assert leaks.align(a, a) == (30, 0)
    b = np.concatenate([a[:10], [99], a[10:20], a[21:]])
    assert leaks.align(b, a) == (30, 2)
    assert leaks.align(np.array([50, 51]), a) == (0, 0)


def test_errors_near_the_ends_of_short_passages():
    r = random.Random(5)
    item = " ".join(f"w{i}" for i in range(40))
    index = leaks.ItemIndex([(1, item), (2, " ".join(sentence(r, 40)))])
    for n in (14, 15, 16):
        for wrong in [(1,), (2,), (n - 2,), (1, n - 2), (2, n - 3), (1, 2), (1, 7)]:
            words = item.split()[10 : 10 + n]
            for i in wrong:
                words[i] = "zzz"
            text = ["x"] * 30 + words + ["y"] * 30
            tokens = np.array([index.vocabulary.get(w, -1) for w in text], np.int64)
            assert 14 <= index.aligned(tokens, 0)[0] <= n and 0 in index.search(tokens)[1]
    short = np.array([index.vocabulary.get(w, -1) for w in item.split()[10:23]], np.int64)
    assert index.aligned(short, 0) == (0, 0)
    left_out, added = list(range(14)), list(range(16))
    del left_out[2]
    added.insert(2, 99)
    a = np.arange(16)
    assert leaks.longest_span(np.array(left_out), a[:14], 14, 8) == (14, 1) and leaks.longest_span(np.array(added), a, 14, 8) == (16, 1)
    assert leaks.longest_span(np.array([99, *range(1, 13), 99]), a[:14], 14, 8) == (0, 0)


def brute(sizes, capacity):
    """Fewest containers, by trying all."""
    best = [len(sizes)]

    def place(i, loads):
        if len(loads) >= best[0]:
            return
        if i == len(sizes):
            best[0] = len(loads)
            return
        for j in range(len(loads)):
            if loads[j] + sizes[i] <= capacity:
                place(i + 1, [*loads[:j], loads[j] + sizes[i], *loads[j + 1 :]])
        place(i + 1, [*loads, sizes[i]])

    place(0, [])
    return best[0]


def test_packing_near_the_optimum():
    r = random.Random(6)
    for _ in range(40):
        sizes = [r.randrange(0, 60) for _ in range(r.randrange(1, 9))]
        found = packing.pack(sizes, 60)
        assert sorted(i for w in found for i in w) == list(range(len(sizes)))
        assert all(sum(sizes[i] for i in w) <= 60 for w in found)
        assert len(found) <= brute(sizes, 60) + 1


def test_differencing_balances():
    r = random.Random(8)
    sizes = [r.randrange(1, 100) for _ in range(200)]
    sums = [sum(sizes[i] for i in w) for w in packing.differencing(sizes, 10)]
    assert max(sums) - min(sums) <= 3


def test_containers(spark):
    r = random.Random(7)
    counts = [(i, r.randrange(0, 250)) for i in range(600)] + [(1000, 1000), (1001, 2350), (1002, None), (1003, -4), (1004, 500)]
    df = spark.createDataFrame(counts, "id bigint, n_tokens bigint").withColumn("piece", F.lit("clash"))
    rows = packing.containers(df, 500, windows=16).collect()
    load, parts = {}, {}
    for x in rows:
        load[x["container"]] = load.get(x["container"], 0) + x["n_tokens"]
        parts.setdefault(x["id"], []).append((x["piece"], x["first_token"], x["n_tokens"]))
    assert max(load.values()) <= 500 and set(parts) == {i for i, _ in counts}
    for i, n in counts:
        n = max(0, n or 0)
        pieces = sorted(parts[i])
        assert sum(p[2] for p in pieces) == n and [p[1] for p in pieces] == [500 * k for k in range(len(pieces))]
        assert len(pieces) == max(1, -(-n // 500))
    assert sum(load.values()) / (500 * len(load)) > 0.93
    assert rows and sorted(map(tuple, rows)) == sorted(map(tuple, packing.containers(df, 500, windows=16).collect()))
    assert packing.containers(df.limit(0), 500).count() == 0
    with pytest.raises(ValueError):
        packing.containers(df, 0)


def test_token_counts(spark):
    df = spark.createDataFrame([(1, "hello world"), (2, None), (3, ""), (4, "é" * 10_000)], "doc_id bigint, text string")
    got = {x["id"]: x["n_tokens"] for x in packing.token_counts(df).collect()}
    assert got[1] > 1 and got[2] == got[3] == 0 and got[4] > 0
