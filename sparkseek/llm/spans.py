"""Long spans shared between records: winnowed k-mer seeds, collinear chains through a Fenwick tree, alignment of the chains."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkseek.session import cut

CHUNK = 4_000_000  # characters hashed at once
_BASE = 0x9E3779B97F4A7C15 | 1
_ODD = np.uint64(0xBF58476D1CE4E5B9)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = pow(_BASE, -1, 2**64)
    up, down = np.full(n, _BASE, np.uint64), np.full(n, inverse, np.uint64)
    up[0] = down[0] = 1
    with np.errstate(over="ignore"):
        return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


def _mix(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * _ODD
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))


def window_hashes(codes: np.ndarray, k: int, powers: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """64-bit hashes of all k-character windows."""
    n = len(codes)
    if n < k:
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_mix(codes.astype(np.uint64) + np.uint64(1)) * powers[0][:n], out=sums[1:])
        return _mix((sums[k:] - sums[:-k]) * powers[1][: n - k + 1])


def winnow(hashes: np.ndarray, w: int) -> np.ndarray:
    """Positions of the rightmost minimum of every run of w hashes: any w consecutive ones hold one, the same in every text."""
    n = len(hashes)
    if n == 0 or n < w:
        return np.empty(0, np.int64)
    bits = np.uint64(24)
    place = np.uint64(2**24 - 1) - (np.arange(n, dtype=np.uint64) & np.uint64(2**24 - 1))
    low = ((hashes >> bits) << bits) | place
    width = 1
    while width * 2 <= w:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    if width < w:
        low = np.minimum(low[: n - w + 1], low[w - width :][: n - w + 1])
    change = np.flatnonzero(np.concatenate([[True], low[1:] != low[:-1]]))
    back = (np.uint64(2**24 - 1) - (low[change] & np.uint64(2**24 - 1))).astype(np.int64)
    start = change  # the minimum lies within w after the first run it rules
    return start + ((back - start) % 2**24)


def ends_of_runs(hashes: np.ndarray, places: np.ndarray, k: int, w: int) -> np.ndarray:
    """Of seeds that repeat at overlapping places (periodic text) those that the stretches of two runs need, instead of all.

    Two runs may be out of phase, and the longer stretch then belongs to the shift one period further. So two seeds stay at the end of a
    run and two at the first window of w hashes in it, which is where a stretch that begins with either run has its seed; those between
    stay at distances below k, so that placing a short run along a long one leaves no gap.
    """
    if len(places) < 3:
        return places
    again = (hashes[places[1:]] == hashes[places[:-1]]) & (places[1:] - places[:-1] < k)
    edge = np.flatnonzero(np.diff(np.concatenate([[False], again, [False]]).astype(np.int8)))
    keep = np.ones(len(places), bool)
    for first, last in zip(edge[::2], edge[1::2]):
        run = places[first : last + 1]
        if len(run) < 5:
            continue
        period = int(np.diff(run).min())
        low = max(0, run[0] - w)
        other = np.flatnonzero(hashes[low : run[0]] != hashes[low + period : run[0] + period])
        begin = low + int(other[-1]) + 1 if len(other) else low
        star = max(0, int(np.searchsorted(run, begin + w)) - 1)
        own = np.zeros(len(run), bool)
        own[[0, 1, star, min(star + 1, len(run) - 1), -2, -1]] = True
        own[np.unique((run - run[0]) // (k // 2), return_index=True)[1]] = True
        keep[first : last + 1] = own
    return places[keep]


def _seeds(batches: Iterator[pa.RecordBatch], k: int, w: int) -> Iterator[pa.RecordBatch]:
    """cls_hi, cls_lo, n_chars, text -> a row per seed: seed, cls_hi, cls_lo, pos. Texts are hashed together, up to CHUNK characters."""
    powers = _powers(CHUNK)

    def flush(texts: list[str], hi: list[int], lo: list[int]) -> pa.RecordBatch:
        joined = "".join(texts)
        codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        hashes = np.concatenate([window_hashes(codes[i : i + CHUNK], k, powers) for i in range(0, max(len(codes), 1), CHUNK - k + 1) if len(codes) - i >= k] or [np.empty(0, np.uint64)])
        seeds, owner, places, at = [], [], [], 0
        for i, t in enumerate(texts):
            own = hashes[at : at + len(t) - k + 1]
            p = ends_of_runs(own, winnow(own, w), k, w)
            seeds.append(own[p])
            places.append(p)
            owner.append(np.full(len(p), i))
            at += len(t)
        which = np.concatenate(owner)
        arrays = [np.concatenate(seeds).view(np.int64), np.array(hi, np.int64)[which], np.array(lo, np.int64)[which], np.concatenate(places).astype(np.int32)]
        return pa.RecordBatch.from_arrays([pa.array(a) for a in arrays], names=["seed", "cls_hi", "cls_lo", "pos"])

    for batch in batches:
        texts, hi, lo, size = [], [], [], 0
        for t, a, b in zip(batch.column("text").to_pylist(), batch.column("cls_hi").to_pylist(), batch.column("cls_lo").to_pylist()):
            if len(t) < k + w - 1:
                continue
            texts.append(t), hi.append(a), lo.append(b)
            size += len(t)
            if size >= CHUNK // 2:
                yield flush(texts, hi, lo)
                texts, hi, lo, size = [], [], [], 0
        if texts:
            yield flush(texts, hi, lo)


class Fenwick:
    """Prefix maxima of (value, item)."""

    def __init__(self, n: int):
        self.best: list[tuple[float, int]] = [(float("-inf"), -1)] * (n + 1)

    def put(self, i: int, value: tuple[float, int]) -> None:
        i += 1
        while i < len(self.best):
            if value > self.best[i]:
                self.best[i] = value
            i += i & -i

    def upto(self, i: int) -> tuple[float, int]:
        """The best of items 0..i-1."""
        top = (float("-inf"), -1)
        while i > 0:
            if self.best[i] > top:
                top = self.best[i]
            i -= i & -i
        return top


def chains(matches: list[tuple[int, int]], k: int, gap: float = 0.25) -> list[list[tuple[int, int]]]:
    """Collinear chains of matches (a, b): each chain rises in a and in b, every match is in one chain, the best chain comes first.

    A chain's score is k per match less gap for each character skipped between two matches in either text. gap costs being
    linear, the best predecessor is a prefix maximum over b, kept in a Fenwick tree while the matches are read by a.
    All chains come from one such pass: from the best end on, a chain goes back until it meets a match that a better one has.
    """
    left = sorted(set(matches))
    ranks = {b: r for r, b in enumerate(sorted({b for _, b in left}))}
    tree, score, back = Fenwick(len(ranks)), [], []
    i = 0
    while i < len(left):
        j = i
        while j < len(left) and left[j][0] == left[i][0]:
            a, b = left[j]
            best, via = tree.upto(ranks[b])
            gain = best - gap * (a + b)
            score.append(k + max(0.0, gain))
            back.append(via if gain > 0 else -1)
            j += 1
        for m in range(i, j):  # matches at one place of a cannot follow one another
            a, b = left[m]
            tree.put(ranks[b], (score[m] + gap * (a + b), m))
        i = j
    found, used = [], [False] * len(left)
    for at in sorted(range(len(left)), key=score.__getitem__, reverse=True):
        chain = []
        while at >= 0 and not used[at]:
            chain.append(left[at])
            used[at] = True
            at = back[at]
        if chain:
            found.append(chain[::-1])
    return found


def _common_prefix(a: str, b: str) -> int:
    """Length of the common prefix, by bisection over slices."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    lo, hi = 0, n
    while hi - lo > 1:
        mid = (lo + hi) // 2
        if a[lo:mid] == b[lo:mid]:
            lo = mid
        else:
            hi = mid
    return lo


def stretches(a: str, b: str, chain: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """The maximal equal stretches (start in a, start in b, length) that the chain's matches lie in. False matches (hash collisions) vanish."""
    found: list[tuple[int, int, int]] = []
    for p, q in chain:
        if found and found[-1][0] - found[-1][1] == p - q and p < found[-1][0] + found[-1][2]:
            continue
        right = _common_prefix(a[p:], b[q:])
        if not right:
            continue
        left = _common_prefix(a[max(0, p - q) : p][::-1] if p >= q else a[:p][::-1], b[:q][::-1] if p >= q else b[q - p : q][::-1])
        if not found or found[-1] != (p - left, q - left, left + right):
            found.append((p - left, q - left, left + right))
    return found


def _contexts(batches: Iterator[pa.RecordBatch], k: int, least: int) -> Iterator[pa.RecordBatch]:
    """Classes with places of crowded seeds -> a row per stretch of `least` characters around each: seed, cls, pos, shift, whole (its hash)."""
    powers = _powers(CHUNK)
    for batch in batches:
        out: list[list[np.ndarray]] = [[], [], [], [], [], []]
        for r in batch.to_pylist():
            codes = np.frombuffer(r["text"].encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
            for m in r["places"]:
                low, high = max(0, m["pos"] + k - least), min(len(codes), m["pos"] + least)
                whole = window_hashes(codes[low:high], least, powers)
                n = len(whole)
                for column, values in zip(out, (np.full(n, m["seed"]), np.full(n, r["cls_hi"]), np.full(n, r["cls_lo"]), np.full(n, m["pos"]), m["pos"] - low - np.arange(n), whole.view(np.int64))):
                    column.append(values)
        arrays = [np.concatenate(c) if c else np.empty(0, np.int64) for c in out]
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(a.astype(np.int64)).cast(t) for a, t in zip(arrays, kinds)], names=["seed", "cls_hi", "cls_lo", "pos", "shift", "whole"])


def _align(batches: Iterator[pa.RecordBatch], k: int, least: int, gap: float) -> Iterator[pa.RecordBatch]:
    """Chains and aligns the matches of each pair; a row per exact stretch and one per chain (exact = false, identity = share of equal characters)."""
    names = ["a_hi", "a_lo", "b_hi", "b_lo", "exact", "a_start", "a_end", "b_start", "b_end", "same"]
    for batch in batches:
        rows: list[tuple] = []
        for r in batch.to_pylist():
            key, a, b = (r["a_hi"], r["a_lo"], r["b_hi"], r["b_lo"]), r["a_text"], r["b_text"]
            seen = set()
            for chain in chains([(m["pa"], m["pb"]) for m in r["matches"]], k, gap):
                exact = stretches(a, b, chain)
                if not exact:
                    continue
                for s, t, n in exact:
                    if n >= least and (s, t) not in seen:
                        seen.add((s, t))
                        rows.append((*key, True, s, s + n, t, t + n, n))
                rows.append((*key, False, exact[0][0], exact[-1][0] + exact[-1][2], exact[0][1], exact[-1][1] + exact[-1][2], sum(n for *_, n in exact)))
        columns = list(zip(*rows)) or [[] for _ in names]
        kinds = [pa.int64()] * 4 + [pa.bool_()] + [pa.int32()] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=names)


class SharedSpans:
    """Spans of at least `least` characters that occur, character by character, in more than one text.

    docs: one row per record with the columns named by id and text; other columns are ignored. NULL texts and texts
    shorter than least share nothing. Records with equal texts form one class and are compared once; members() says
    which records a class has.

    Winnowing k-mers of k characters over w = least - k + 1 places leaves at least one seed in every span
    of least characters, the same one in each text that holds it, so no span is lost; only seeds that two classes hold go on.
    The seeds that two classes have in common are chained per pair of classes and the chains aligned on the texts
    themselves, which makes the result exact.

    A seed that more than `crowd` places share is not paired as it is: of the stretches of least characters around its places the
    hashes are compared first, and only places with a whole stretch in common are paired. So a notice shorter than least costs in
    proportion to the records that hold it, and a longer one as many pairs as really share a stretch.
    """

    def __init__(self, docs: DataFrame, id: str = "doc_id", text: str = "text", least: int = 300, k: int = 220, gap: float = 0.25, crowd: int = 200):
        if not 0 < k <= least:
            raise ValueError("k must be between 1 and least")
        self.least, self.k, self.gap, self.crowd = least, k, gap, crowd
        t = F.col("text")
        hashed = docs.select(F.col(id).alias("id"), F.col(text).alias("text")).where(F.char_length(F.col("text")) >= least)
        self.docs = hashed.select("id", "text", F.xxhash64(t).alias("cls_hi"), F.xxhash64(F.lit(1), t, F.lit(2)).alias("cls_lo"))

    def members(self) -> DataFrame:
        """id, cls_hi, cls_lo, n_chars of every record of at least `least` characters."""
        return self.docs.select("id", "cls_hi", "cls_lo", F.char_length("text").alias("n_chars"))

    def spans(self) -> DataFrame:
        """Per pair of classes a < b: exact stretches of at least `least` characters and the chains they lie in.

        Columns a_hi, a_lo, b_hi, b_lo, exact, a_start, a_end, b_start, b_end, same. exact rows are maximal equal stretches. Rows
        with exact = false are fuzzy passages: a chain from its first to its last match, of which `same` characters are equal.
        """
        k, w, least, gap = self.k, self.least - self.k + 1, self.least, self.gap
        raw = self.docs.select("cls_hi", "cls_lo", "text").mapInArrow(lambda b: _seeds(b, k, w), "seed bigint, cls_hi bigint, cls_lo bigint, pos int")
        raw = cut(raw)
        # two classes at least: seen from the least and the greatest of each half, which hash aggregation combines on the map side
        common = raw.groupBy("seed").agg(F.min("cls_lo").alias("l"), F.max("cls_lo").alias("h")).where(F.col("l") != F.col("h")).select("seed")
        shared = cut(raw.join(common, "seed").distinct())
        needed = shared.select("cls_hi", "cls_lo").distinct()
        texts = self.docs.join(needed, ["cls_hi", "cls_lo"], "left_semi").groupBy("cls_hi", "cls_lo").agg(F.first("text").alias("text"))
        texts = cut(texts)
        crowded = shared.groupBy("seed").agg(F.count("*").alias("n")).where(F.col("n") > self.crowd).select("seed")
        pairs = self._paired(shared.join(crowded, "seed", "left_anti"), ["seed"])
        if not crowded.isEmpty():
            pairs = pairs.unionAll(self._crowded(shared.join(crowded, "seed", "left_semi"), texts))
        pairs = pairs.groupBy("a_hi", "a_lo", "b_hi", "b_lo").agg(F.collect_set(F.struct("pa", "pb")).alias("matches"))
        pairs = pairs.join(texts.select(F.col("cls_hi").alias("a_hi"), F.col("cls_lo").alias("a_lo"), F.col("text").alias("a_text")), ["a_hi", "a_lo"])
        pairs = pairs.join(texts.select(F.col("cls_hi").alias("b_hi"), F.col("cls_lo").alias("b_lo"), F.col("text").alias("b_text")), ["b_hi", "b_lo"])
        pairs = pairs.select("a_hi", "a_lo", "b_hi", "b_lo", "matches", "a_text", "b_text")
        out = "a_hi bigint, a_lo bigint, b_hi bigint, b_lo bigint, exact boolean, a_start int, a_end int, b_start int, b_end int, same int"
        return pairs.mapInArrow(lambda it: _align(it, k, least, gap), out)

    @staticmethod
    def _paired(places: DataFrame, keys: list[str]) -> DataFrame:
        """Pairs of places of two classes with equal keys."""
        a = places.select(*keys, F.col("cls_hi").alias("a_hi"), F.col("cls_lo").alias("a_lo"), F.col("pos").alias("pa"))
        b = places.select(*keys, F.col("cls_hi").alias("b_hi"), F.col("cls_lo").alias("b_lo"), F.col("pos").alias("pb"))
        return a.join(b, keys).where(F.struct("a_hi", "a_lo") < F.struct("b_hi", "b_lo")).select("a_hi", "a_lo", "b_hi", "b_lo", "pa", "pb")

    def _crowded(self, places: DataFrame, texts: DataFrame) -> DataFrame:
        """Pairs of places of crowded seeds that have a stretch of `least` characters in common.

        Places with the same common stretches form a node; nodes with any in common are paired, and their places with them.
        """
        k, least = self.k, self.least
        by_class = places.groupBy("cls_hi", "cls_lo").agg(F.collect_list(F.struct("seed", "pos")).alias("places"))
        around = by_class.join(texts, ["cls_hi", "cls_lo"]).mapInArrow(lambda it: _contexts(it, k, least), "seed bigint, cls_hi bigint, cls_lo bigint, pos int, shift int, whole bigint")
        around = cut(around)
        stretch = ["seed", "shift", "whole"]
        common = around.groupBy(*stretch).agg(F.min("cls_lo").alias("l"), F.max("cls_lo").alias("h")).where("l != h").select(*stretch)
        held = around.join(common, stretch)
        nodes = cut(held.groupBy("seed", "cls_hi", "cls_lo", "pos").agg(F.xxhash64(F.array_sort(F.collect_list(F.struct("shift", "whole")))).alias("node")))
        of_node = cut(held.join(nodes, ["seed", "cls_hi", "cls_lo", "pos"]).select(*stretch, "node").distinct())
        a, b = of_node.withColumnRenamed("node", "node_a"), of_node.withColumnRenamed("node", "node_b")
        met = a.join(b, stretch).select("seed", "node_a", "node_b").distinct()
        left = nodes.select("seed", F.col("node").alias("node_a"), F.col("cls_hi").alias("a_hi"), F.col("cls_lo").alias("a_lo"), F.col("pos").alias("pa"))
        right = nodes.select("seed", F.col("node").alias("node_b"), F.col("cls_hi").alias("b_hi"), F.col("cls_lo").alias("b_lo"), F.col("pos").alias("pb"))
        both = met.join(left, ["seed", "node_a"]).join(right, ["seed", "node_b"])
        return both.where(F.struct("a_hi", "a_lo") < F.struct("b_hi", "b_lo")).select("a_hi", "a_lo", "b_hi", "b_lo", "pa", "pb")

    def pairs(self, spans: DataFrame | None = None) -> DataFrame:
        """doc_a < doc_b for every two records that share a stretch, records with equal texts among them."""
        spans = self.spans() if spans is None else spans
        members = self.members()
        found = spans.where("exact").select("a_hi", "a_lo", "b_hi", "b_lo").distinct()
        own = members.groupBy("cls_hi", "cls_lo").agg(F.count("*").alias("n")).where("n > 1")
        found = found.unionAll(own.select("cls_hi", "cls_lo", "cls_hi", "cls_lo"))
        a = members.select(F.col("id").alias("a"), F.col("cls_hi").alias("a_hi"), F.col("cls_lo").alias("a_lo"))
        b = members.select(F.col("id").alias("b"), F.col("cls_hi").alias("b_hi"), F.col("cls_lo").alias("b_lo"))
        both = found.join(a, ["a_hi", "a_lo"]).join(b, ["b_hi", "b_lo"])
        same = (F.col("a_hi") == F.col("b_hi")) & (F.col("a_lo") == F.col("b_lo"))
        both = both.where(~same | (F.col("a") < F.col("b")))
        return both.select(F.least("a", "b").alias("doc_a"), F.greatest("a", "b").alias("doc_b"))

    def coverage(self, spans: DataFrame | None = None) -> DataFrame:
        """id, n_chars, shared_chars of every record of at least `least` characters: how much of it some other record holds as well."""
        spans = self.spans() if spans is None else spans
        exact = spans.where("exact")
        sides = [exact.select(F.col(f"{s}_hi").alias("cls_hi"), F.col(f"{s}_lo").alias("cls_lo"), F.struct(F.col(f"{s}_start").alias("s"), F.col(f"{s}_end").alias("e")).alias("i")) for s in "ab"]
        intervals = sides[0].unionAll(sides[1]).distinct().groupBy("cls_hi", "cls_lo").agg(F.array_sort(F.collect_list("i")).alias("i"))
        start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("to"))
        covered = F.aggregate(
            "i", start, lambda acc, x: F.struct((acc.n + F.greatest(F.lit(0), x.e - F.greatest(x.s, acc.to))).alias("n"), F.greatest(acc.to, x.e).alias("to")), lambda acc: acc.n
        )
        members = self.members()
        copies = members.groupBy("cls_hi", "cls_lo").agg(F.count("*").alias("copies"))
        per_class = copies.join(intervals.select("cls_hi", "cls_lo", covered.alias("n")), ["cls_hi", "cls_lo"], "left")
        full = members.join(per_class, ["cls_hi", "cls_lo"])
        shared = F.when(F.col("copies") > 1, F.col("n_chars")).otherwise(F.coalesce("n", F.lit(0)))
        return full.select("id", F.col("n_chars").cast("long").alias("n_chars"), shared.cast("long").alias("shared_chars"))


def longest_common(a: str, b: str) -> int:
    """Length of the longest common substring, plainly; for tests."""
    best, row = 0, [0] * (len(b) + 1)
    for x in a:
        new = [0] * (len(b) + 1)
        for j, y in enumerate(b, 1):
            if x == y:
                new[j] = row[j - 1] + 1
                best = max(best, new[j])
        row = new
    return best
