"""Main content of web pages: a classifier's costs and neighbourhood edges, separated by a minimum cut."""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkseek.llm.sampling import labelled
from sparkseek.session import cut

_SPACE = " \t\r\xa0  ​　"
_MARK = re.compile(r"^(?:\d{1,3}[.)]|[-*•‣·–—+])\s+")
_NUMBER = re.compile(r"\d(?:[\d.,]*\d)?")
_END = re.compile(r"[.!?…。！？][\"”’»)\]]*$")
_SEPARATOR = re.compile(r"\s[|»›>/·•]\s")
_WORD = re.compile(r"[^\W\d_]+")
# How advertisements and links put between an article's paragraphs begin, in the languages of the pages.
INSERTS = (
    "advertisement", "sponsored", "continue reading", "see also", "read also", "read more", "related:",
    "anzeige", "werbung", "weiterlesen", "lesen sie auch", "mehr dazu", "siehe auch",
    "publicité", "lire aussi", "voir aussi", "lire la suite", "à lire aussi",
    "publicidad", "lea también", "lea tambien", "ver también", "véase también", "siga leyendo", "sigue leyendo",
)
_CAPITAL = "A-ZÀ-ÖØ-ÞŁŚŻŹĆА-ЯЁ"
_NAME = re.compile(rf"(?<!^)\b[{_CAPITAL}][^\W\d_]+(?:\s+(?:&\s+)?[{_CAPITAL}][^\W\d_]+)*")


@dataclass
class Unit:
    """Lines first..last (from 1, inclusive) that were one line before the text was wrapped."""

    first: int
    last: int
    text: str
    gap: bool  # an empty line before it
    marked: bool


def wrap_width(lines: Sequence[str]) -> int:
    """The width the page was wrapped at, 0 if it was not: the longest line that certainly ends within a sentence."""
    width = 0
    for a, b in zip(lines, lines[1:]):
        if b and b[0].islower() and len(a) > width and a[-1] not in ".!?:;”\"»…" and a.count(" ") >= 3:
            width = len(a)
    return width


def units(content: str) -> list[Unit]:
    """The logical lines of a page: a break is undone where the next word would not have fitted the width the page was wrapped at."""
    lines = [x.strip(_SPACE) for x in content.split("\n")]
    width = wrap_width(lines)
    found: list[Unit] = []
    gap = True
    for i, x in enumerate(lines, 1):
        if not x:
            gap = True
            continue
        before = lines[i - 2] if not gap else ""
        marked = _MARK.match(x) is not None or x.casefold().startswith(INSERTS)
        if before and width and not marked and width * 0.6 <= len(before) <= width < len(before) + 1 + len(x.split(None, 1)[0]):
            found[-1].last, found[-1].text = i, f"{found[-1].text} {x}"
        else:
            found.append(Unit(i, i, x, gap, marked))
        gap = False
    return found


def shape(text: str) -> str:
    """What repeats of a boilerplate line have in common: no case, numbers, marks at the ends, and no names within the line."""
    t = _NUMBER.sub("0", _MARK.sub("", text).strip("[]() ▾▸»›<>|·•"))
    return _NAME.sub("N", t).casefold()


def key(text: str) -> int:
    return xxhash.xxh3_64_intdigest(shape(text).encode("utf-8", "surrogatepass")) - 2**63


FEATURES = 26
RARE = 6.0


def features(us: Sequence[Unit], title: str, site_pages: Sequence[int], pages: Sequence[int], sites: Sequence[int], site_size: int) -> np.ndarray:
    """One row per unit: its own shape, how often its shape occurs on its site and elsewhere, and its neighbours."""
    n = len(us)
    x = np.zeros((n, FEATURES))
    name = title.strip(_SPACE).casefold()
    for i, u in enumerate(us):
        t = u.text
        w = len(_WORD.findall(t))
        ends = _END.search(t) is not None
        others = max(0, site_pages[i] - 1)
        same = t.casefold() == name or (len(name) > 8 and t.casefold() in name)
        x[i, :14] = (
            min(w, 60) / 20, w >= 9, ends, w >= 9 and ends, u.marked, t[0] in "[<" or t[-1] in "]▾▸", min(3, len(_SEPARATOR.findall(t))), "©" in t or "@" in t,
            same, np.log1p(others), others / max(1, site_size - 1) if site_size > 1 else 0.0, np.log1p(max(0, sites[i] - 1)), np.log1p(max(0, pages[i] - site_pages[i])), w <= 2,
        )
        x[i, 14] = t.endswith(")") and t[-2:-1].isdigit()
        x[i, 15] = u.gap
    prose = x[:, 3]
    often = x[:, 10] + (x[:, 12] > 3)
    pad = lambda a, d: np.concatenate([np.zeros(d), a[:-d]]) if d > 0 else np.concatenate([a[-d:], np.zeros(-d)])
    x[:, 16], x[:, 17], x[:, 18], x[:, 19] = pad(prose, 1), pad(prose, -1), pad(often, 1), pad(often, -1)
    seen, left = np.cumsum(prose), prose[::-1].cumsum()[::-1]
    x[:, 20] = (seen > 0) & (left > 0)
    x[:, 21] = x[:, 13] * (1 - x[:, 20])
    x[:, 22] = (x[:, 1] == 0) & (x[:, 4] == 0) & (pad(x[:, 1], -1) == 0)
    x[:, 23] = 1
    # rare, so on a scale on which the ridge leaves its weight to the data
    x[:, 24] = [RARE * u.text.casefold().startswith(INSERTS) for u in us]
    x[:, 25] = x[:, 16] * x[:, 17] * (1 - x[:, 1]) * (1 - x[:, 4]) * (x[:, 24] == 0)
    return x


def weak_labels(x: np.ndarray, site_size: int) -> np.ndarray:
    """1 content, 0 boilerplate, -1 not sure: from repetition on sites with several pages, from prose found nowhere else, and from
    short lines in the company of either."""
    y = np.full(len(x), -1)
    prose, marked, same, share, other = x[:, 3] > 0, x[:, 4] > 0, x[:, 8] > 0, x[:, 10], x[:, 12]
    rare = (x[:, 9] < 0.7) & (other < 1.2)
    y[prose & rare] = 1
    y[marked & rare & (x[:, 20] > 0)] = 1
    short = ~prose & ~marked & ~same
    y[short & (x[:, 22] > 0) & (x[:, 18] >= 1)] = 0
    if site_size >= 5:
        y[(share >= 0.15) & (x[:, 9] > 1)] = 0
    y[~prose & (x[:, 11] > 1.9) & (other > 3) & (x[:, 16] + x[:, 17] < 2)] = 0
    y[prose & (other > 3.5)] = 0
    y[x[:, 25] > 0] = 1
    y[same & (x[:, 6] == 0) & (x[:, 13] == 0)] = 1
    y[(x[:, 24] > 0) | (x[:, 6] >= 2) | (x[:, 5] > 0) | (x[:, 7] > 0) | (x[:, 14] > 0)] = 0
    return y


def fit(x: np.ndarray, y: np.ndarray, steps: int = 400, ridge: float = 1e-3) -> np.ndarray:
    """Logistic regression by Newton steps with a ridge; balanced classes."""
    w = np.zeros(x.shape[1])
    weight = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum()))
    for _ in range(min(steps, 25)):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (weight * (p - y)) + ridge * w
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(x.shape[1])
        d = np.linalg.solve(h, g)
        w -= d
        if np.abs(d).max() < 1e-6:
            break
    return w


def min_cut(cost: Sequence[float], edges: dict[tuple[int, int], float]) -> list[bool]:
    """Labels of least energy: node i pays cost[i] > 0 for being False, -cost[i] for True if negative, an edge pays for differing ends.

    Nodes whose own cost outweighs all their edges are settled at once and become part of the terminals (that is exact); for the
    rest a maximum flow is pushed along shortest augmenting paths, and the nodes the source still reaches are True.
    """
    n = len(cost)
    around: list[dict[int, float]] = [{} for _ in range(n)]
    for (i, j), w in edges.items():
        if i != j and w > 0:
            around[i][j] = around[i].get(j, 0.0) + w
            around[j][i] = around[j].get(i, 0.0) + w
    own, label = list(map(float, cost)), [None] * n
    todo = deque(range(n))
    while todo:
        i = todo.popleft()
        if label[i] is None and abs(own[i]) >= sum(w for j, w in around[i].items() if label[j] is None):
            label[i] = own[i] > 0
            for j, w in around[i].items():
                if label[j] is None:
                    own[j] += w if label[i] else -w
                    todo.append(j)
    free = [i for i in range(n) if label[i] is None]
    if free:
        s, t = -1, -2
        cap: dict[int, dict[int, float]] = {i: {j: w for j, w in around[i].items() if label[j] is None} for i in free}
        cap[s], cap[t] = {}, {}
        for i in free:
            if own[i] > 0:
                cap[s][i], cap[i][s] = own[i], 0.0
            else:
                cap[i][t], cap[t][i] = -own[i], 0.0
        while True:
            via, queue = {s: s}, deque([s])
            while queue and t not in via:
                i = queue.popleft()
                for j, c in cap[i].items():
                    if c > 1e-12 and j not in via:
                        via[j] = i
                        queue.append(j)
            if t not in via:
                break
            path, j = [], t
            while j != s:
                path.append((via[j], j))
                j = via[j]
            flow = min(cap[i][j] for i, j in path)
            for i, j in path:
                cap[i][j] -= flow
                cap[j][i] += flow
        for i in free:
            label[i] = i in via
    return [bool(x) for x in label]


def smoothness(us: Sequence[Unit], x: np.ndarray) -> dict[tuple[int, int], float]:
    """Edges of neighbouring units: strong within a block (no empty line between), within a list, and from a short line to the prose it heads;
    units two apart in one block are tied as well, as siblings under one element would be."""
    edges: dict[tuple[int, int], float] = {}
    block = 0
    blocks = []
    for u in us:
        block += u.gap
        blocks.append(block)
    spaced = sum(u.gap for u in us) > len(us) / 6
    for i in range(len(us) - 1):
        same = blocks[i] == blocks[i + 1]
        w = 0.5
        if spaced:
            w = 1.5 if same else 0.4
        if us[i].marked and us[i + 1].marked:
            w += 1.0
        if not us[i].marked and x[i, 1] == 0 and x[i + 1, 3] > 0:
            w += 0.6
        if x[i, 1] == 0 and x[i + 1, 1] == 0 and not us[i].marked and not us[i + 1].marked:
            w += 0.8
        edges[i, i + 1] = w
        if i + 2 < len(us) and blocks[i] == blocks[i + 2]:
            edges[i, i + 2] = 0.3
    return edges


def label(us: Sequence[Unit], x: np.ndarray, w: np.ndarray) -> list[bool]:
    """The minimum cut between the classifier's log odds of content and the ties of neighbours."""
    return min_cut(np.clip(x @ w, -6, 6), smoothness(us, x))


def _site(path: str | None) -> str:
    parts = [p for p in re.split(r"[\\/]", path or "") if p]
    return parts[1] if len(parts) > 1 else (parts[0] if parts else "")


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sites, keys = [], []
        for path, text in zip(batch.column("path").to_pylist(), batch.column("text").to_pylist()):
            sites.append(_site(path))
            keys.append([key(u.text) for u in units(text)])
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(sites, pa.string()), pa.array(keys, pa.list_(pa.int64()))], names=["id", "site", "keys"])


class MainContent:
    """The lines of each page that belong to its main content.

    docs: id, path (its second part names the site), title and text columns; other columns are ignored. Lines count from 1 and split at \\n only.
    NULL and empty texts have no lines. Wrapped paragraphs are treated as one unit. How often a unit's shape occurs, on its site and on
    others, is counted over all pages. A logistic regression, fitted on weak labels of about `sample` pages (an even sample by hash
    of the id), gives each unit its cost; a minimum cut over the page's neighbourhood graph decides. A site with one page has no repetition of its own and
    relies on shapes known from other sites. The key of a repeated page counts once per page; pages sent again count again.
    """

    def __init__(self, docs: DataFrame, id: str = "item_id", path: str = "parent_path", title: str = "name", text: str = "content", sample: int = 1500):
        self.sample = sample
        self.docs = docs.select(F.col(id).alias("id"), F.col(path).alias("path"), F.coalesce(F.col(title), F.lit("")).alias("title"), F.col(text).alias("text")).where(
            F.col("text").isNotNull() & (F.col("text") != "")
        )

    def pages(self) -> DataFrame:
        """id, title, text, site_size and stats: for each unit the pages of its site, pages and sites that have its shape."""
        keyed = cut(self.docs.select("id", "path", "text").mapInArrow(_keys, "id bigint, site string, keys array<bigint>"))
        sizes = keyed.groupBy("site").agg(F.count("*").alias("site_size"))
        once = keyed.select("site", F.explode(F.array_distinct("keys")).alias("key")).groupBy("site", "key").agg(F.count("*").alias("site_pages"))
        often = once.groupBy("key").agg(F.sum("site_pages").alias("pages"), F.count("*").alias("sites"))
        # shapes met on one page only say nothing more; leaving them out keeps what is joined back small
        known = once.join(often.where("pages > 1"), "key")
        at = keyed.select("id", "site", F.posexplode("keys").alias("at", "key")).join(known, ["site", "key"])
        stats = at.groupBy("id").agg(F.collect_list(F.struct("at", "site_pages", "pages", "sites")).alias("stats"))
        placed = keyed.select("id", "site").join(sizes, "site").join(stats, "id", "left").select("id", "site_size", "stats")
        return self.docs.select("id", "title", "text").join(placed, "id")

    def model(self, pages: DataFrame, most_units: int = 400_000) -> np.ndarray:
        """Weights from the weak labels of about `sample` pages, as far as they have most_units units."""

        def label(r: dict) -> tuple[np.ndarray, np.ndarray]:
            x, _ = _page(r["text"], r["title"], r["site_size"], r["stats"])
            return x, weak_labels(x, r["site_size"])

        x, y = labelled(pages, label, self.sample, most_units)
        return fit(x, y) if len(x) else np.zeros(FEATURES)

    def lines(self) -> DataFrame:
        """id, line_no of every content line with a letter or digit."""
        pages = cut(self.pages())
        weights = self.model(pages)
        return pages.mapInArrow(lambda it: _content(it, weights), "id bigint, line_no int")


def _page(text: str, title: str, site_size: int, stats: list | None) -> tuple[np.ndarray, list[Unit]]:
    us = units(text)
    known = {s["at"]: s for s in stats or ()}
    of = lambda k: [known[i][k] if i in known else 1 for i in range(len(us))]
    return features(us, title, of("site_pages"), of("pages"), of("sites"), site_size), us


def _content(batches: Iterator[pa.RecordBatch], weights: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, numbers = [], []
        for r in batch.to_pylist():
            x, us = _page(r["text"], r["title"], r["site_size"], r["stats"])
            if not us:
                continue
            lines = r["text"].split("\n")
            for u, keep in zip(us, label(us, x, weights)):
                if keep:
                    for i in range(u.first, u.last + 1):
                        if any(map(str.isalnum, lines[i - 1])):
                            ids.append(r["id"])
                            numbers.append(i)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(numbers, pa.int32())], names=["id", "line_no"])
