"""Evaluation passages in training text: a BM25 index of the test items, searched with every passage by block-max bounds, then alignment."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_WORD = re.compile(r"[^\W_]+")
_MARKS = re.compile("[̀-ͯ]+")


def words(text: str) -> list[str]:
    """The words of a text without letter case, punctuation, spacing and accents."""
    if text.isascii():
        return _WORD.findall(text.lower())
    return _WORD.findall(_MARKS.sub("", unicodedata.normalize("NFKD", text.casefold())))


@dataclass(frozen=True)
class Rules:
    """least: consecutive words of an item that make a leak; edits: how many of so few may differ when passages are retrieved;
    error_rate: share of words that may differ in an alignment; one_in: of so many words of any span one may differ; passage, stride: words of a passage and from one to the next."""

    least: int = 14
    edits: int = 2
    error_rate: float = 0.2
    one_in: int = 8
    passage: int = 32
    stride: int = 16
    block: int = 16
    k1: float = 1.2
    b: float = 0.75


class ItemIndex:
    """Inverted BM25 index of the items over pairs of neighbouring words, its postings cut into blocks of items with their maximum weights.

    An item's threshold is the least score that any of its stretches of `least` words keeps after `edits` edits, each of which costs
    the two pairs around it, taken from the heaviest. So every passage that holds such a stretch reaches the threshold.
    """

    def __init__(self, items: list[tuple[int, str]], rules: Rules = Rules()):
        self.rules = rules
        items = sorted((i, t) for i, t in items if i is not None and t)
        self.ids = np.array([i for i, _ in items], np.int64)
        texts = [words(t) for _, t in items]
        self.vocabulary: dict[str, int] = {}
        self.tokens = [np.array([self.vocabulary.setdefault(w, len(self.vocabulary)) for w in t], np.int64) for t in texts]
        self.size = max(1, len(self.vocabulary))
        pairs = [t[:-1] * self.size + t[1:] for t in self.tokens]
        self.terms = np.unique(np.concatenate(pairs)) if pairs else np.empty(0, np.int64)
        n, lengths = len(items), np.array([max(1, len(p)) for p in pairs], float)
        term, item, freq = [], [], []
        for i, p in enumerate(pairs):
            t, f = np.unique(np.searchsorted(self.terms, p), return_counts=True)
            term.append(t), item.append(np.full(len(t), i)), freq.append(f)
        if not len(self.terms):
            term, item, freq = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0)]
        term, item, freq = np.concatenate(term), np.concatenate(item), np.concatenate(freq).astype(float)
        order = np.lexsort((item, term))
        term, item, freq = term[order], item[order], freq[order]
        df = np.bincount(term, minlength=len(self.terms))
        idf = np.log1p((n - df + 0.5) / (df + 0.5))
        norm = rules.k1 * (1 - rules.b + rules.b * lengths / lengths.mean()) if n else np.empty(0)
        self.weight = idf[term] * freq * (rules.k1 + 1) / (freq + norm[item]) if n else np.empty(0)
        self.item, self.start = item, np.concatenate([[0], np.cumsum(df)]).astype(np.int64)
        every = np.concatenate([np.searchsorted(self.terms, p) for p in pairs] or [np.empty(0, np.int64)])
        order = np.argsort(every, kind="stable")
        self.place_item = np.repeat(np.arange(n), [len(p) for p in pairs])[order]
        self.place = np.concatenate([np.arange(len(p)) for p in pairs] or [np.empty(0, np.int64)])[order]
        self.place_start = np.searchsorted(every[order], np.arange(len(self.terms) + 1))
        blocks, first = np.unique(term * (n // rules.block + 1) + item // rules.block, return_index=True)
        self.block = blocks % (n // rules.block + 1)
        self.block_max = np.maximum.reduceat(self.weight, first) if len(first) else np.empty(0)
        self.block_start = np.searchsorted(blocks // (n // rules.block + 1), np.arange(len(self.terms) + 1))
        self.term_max = np.maximum.reduceat(self.weight, self.start[:-1]) if len(self.terms) else np.empty(0)
        self.threshold = np.array([self._least_score(i, p) for i, p in enumerate(pairs)])
        count = n // rules.block + 1
        self.block_threshold = np.array([self.threshold[b * rules.block : (b + 1) * rules.block].min(initial=np.inf) for b in range(count)])

    def _least_score(self, i: int, pairs: np.ndarray) -> float:
        r = self.rules
        if len(pairs) < r.least - 1:
            return np.inf
        where = np.searchsorted(self.terms, pairs)
        own = np.array([self.weight[self.start[t] : self.start[t + 1]][self.item[self.start[t] : self.start[t + 1]] == i][0] for t in where])
        keep = max(1, r.least - 1 - 2 * r.edits)
        best = np.inf
        for at in range(len(pairs) - r.least + 2):
            _, first = np.unique(where[at : at + r.least - 1], return_index=True)
            best = min(best, np.sort(own[at : at + r.least - 1][first])[:keep].sum())
        return best * (1 - 1e-9)

    def search(self, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(passage, item) of all passages of a token sequence whose score reaches the item's threshold; -1 is a word of no item.

        Bounds come first, as in block-max WAND, over all passages at once: the sum of its terms' maximum weights must reach some
        threshold for a passage to go on, the sum of the block maxima the block's least threshold for a block of it, and only there
        the postings are scored. The bounds never fall short, so the result is that of scoring everything.
        """
        none = np.empty(0, np.int64), np.empty(0, np.int64)
        r = self.rules
        if len(tokens) < 2 or not len(self.terms):
            return none
        ok = np.flatnonzero((tokens[:-1] >= 0) & (tokens[1:] >= 0))
        key = tokens[ok] * self.size + tokens[ok + 1]
        term = np.searchsorted(self.terms, key)
        hit = self.terms[np.minimum(term, len(self.terms) - 1)] == key
        at, term = ok[hit], term[hit]
        hits = at, term
        reach = -(-r.passage // r.stride)
        n_terms = len(self.terms)
        pairs = np.concatenate([(at // r.stride - d) * n_terms + term for d in range(reach)] or [np.empty(0, np.int64)])
        inside = np.concatenate([(at - (at // r.stride - d) * r.stride + 1 < r.passage) & (at // r.stride >= d) for d in range(reach)])
        pairs = np.unique(pairs[inside])
        passage, term = pairs // n_terms, pairs % n_terms
        if not len(passage):
            return none
        bound = np.bincount(passage, self.term_max[term])
        keep = bound[passage] >= self.threshold.min(initial=np.inf)
        passage, term = passage[keep], term[keep]
        if not len(passage):
            return none
        owner, which = _expand(self.block_start, term)
        cell = passage[owner] * len(self.block_threshold) + self.block[which]
        cells, back = np.unique(cell, return_inverse=True)
        bound = np.bincount(back, self.block_max[which])
        cells = cells[bound >= self.block_threshold[cells % len(self.block_threshold)]]
        if not len(cells):
            return none
        alive = np.unique(cells // len(self.block_threshold))
        keep = np.isin(passage, alive)
        passage, term = passage[keep], term[keep]
        owner, which = _expand(self.start, term)
        block = passage[owner] * len(self.block_threshold) + self.item[which] // r.block
        keep = cells[np.minimum(np.searchsorted(cells, block), len(cells) - 1)] == block
        score_at = passage[owner[keep]] * len(self.ids) + self.item[which[keep]]
        found, back = np.unique(score_at, return_inverse=True)
        score = np.bincount(back, self.weight[which[keep]])
        found = found[score >= self.threshold[found % len(self.ids)]]
        found = self._in_line(*hits, found)
        return found // len(self.ids), found % len(self.ids)

    def _in_line(self, at: np.ndarray, term: np.ndarray, found: np.ndarray) -> np.ndarray:
        """Of the retrieved (passage, item) those with enough word pairs in line: at nearly one distance between text and item.

        `edits` edits leave least - 1 - 2 * edits pairs of a stretch whole and shift it by no more than their number, so pairs are
        counted in bands of distances, overlapping by half, that hold any such stretch.
        """
        r = self.rules
        if not len(found):
            return found
        band = 2 * (2 * r.edits + 1)
        owner, which = _expand(self.place_start, term)
        item, place, shift = self.place_item[which], self.place[which], at[owner] - self.place[which]
        cells = []
        for d in range(-(-r.passage // r.stride)):
            p = at // r.stride - d
            ok = (at - p * r.stride + 1 < r.passage) & (p >= 0)
            key = p[owner] * len(self.ids) + item
            ok = np.flatnonzero(ok[owner] & (found[np.minimum(np.searchsorted(found, key), len(found) - 1)] == key))
            cells.append((np.searchsorted(found, key[ok]), shift[ok], place[ok]))
        which, shift, place = (np.concatenate(c) for c in zip(*cells))
        low = shift.min(initial=0)
        wide = (shift.max(initial=0) - low) // (band // 2) + 3
        most, longest = np.zeros(len(found), int), int(self.place.max(initial=0)) + 1
        for half in (0, band // 2):
            cell = np.unique((which * wide + (shift - low + half) // band) * longest + place) // longest
            cell, n = np.unique(cell, return_counts=True)
            np.maximum.at(most, cell // wide, n)
        return found[most >= max(1, r.least - 1 - 2 * r.edits)]

    def aligned(self, tokens: np.ndarray, item: int) -> tuple[int, int]:
        """(words of the item, differing words) of what a stretch of text gives away of the item, (0, 0) if it is too little.

        The best local alignment ends before an error near an end of a short passage, which costs more than the words beyond it; so
        where it is too short the longest span for each number of errors is asked.
        """
        r = self.rules
        if not r.edits:
            n = longest_run(tokens, self.tokens[item])
            return (n, 0) if n >= r.least else (0, 0)
        n, wrong = align(tokens, self.tokens[item])
        if n >= r.least and wrong <= r.error_rate * n:
            return n, wrong
        return longest_span(tokens, self.tokens[item], r.least, r.one_in)


def _expand(start: np.ndarray, term: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each term all places of its postings: (index into term, place)."""
    n = start[term + 1] - start[term]
    owner = np.repeat(np.arange(len(term)), n)
    offset = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
    return owner, start[term][owner] + offset


def align(text: np.ndarray, item: np.ndarray, error: int = 2) -> tuple[int, int]:
    """Best local alignment of two word sequences, +1 an equal word, -error a replaced, omitted or added one.

    Returns the item's words within it and the number of errors. Row by row; a run of added item words within a row is settled by
    a running maximum, as each costs the same.
    """
    m = len(item)
    step = np.arange(m + 1) * error
    score, span, wrong = np.zeros(m + 1), np.zeros(m + 1, int), np.zeros(m + 1, int)
    best = (0.0, 0, 0)
    for x in text:
        same = item == x
        diag = score[:-1] + np.where(same, 1, -error)
        up = score[1:] - error
        take = diag >= up
        s = np.concatenate([[0], np.where(take, diag, up)])
        n = np.concatenate([[0], np.where(take, span[:-1] + 1, span[1:])])
        e = np.concatenate([[0], np.where(take, wrong[:-1] + ~same, wrong[1:] + 1)])
        low = s <= 0
        s[low], n[low], e[low] = 0, 0, 0
        lifted = np.maximum.accumulate(s + step)
        origin = np.maximum.accumulate(np.where(s + step >= lifted, np.arange(m + 1), 0))
        s2 = lifted - step
        better = s2 > s
        run = np.arange(m + 1) - origin
        n, e = np.where(better, n[origin] + run, n), np.where(better, e[origin] + run, e)
        score, span, wrong = np.where(better, s2, s), n, e
        top = int(score.argmax())
        if score[top] > best[0]:
            best = (score[top], int(span[top]), int(wrong[top]))
    return best[1], best[2]


def longest_span(text: np.ndarray, item: np.ndarray, least: int, one_in: int) -> tuple[int, int]:
    """(words, errors) of the longest span of an item, at least `least` words long, of which one word in `one_in`, rounded up, is replaced,
    omitted or added in the text; it begins and ends with an equal word. (0, 0) if there is none."""
    m = len(item)
    most = -(-m // one_in)
    none = -(m + 1)  # stays below 0 whatever is added
    allowed = np.arange(most + 1)[:, None]
    span = np.full((most + 1, m + 1), none)  # item words of the longest span that ends here with at most so many errors
    best = (0, 0)
    for x in text:
        same = item == x
        new = np.full((most + 1, m + 1), none)
        new[1:] = span[:-1]  # a word added
        new[1:, 1:] = np.maximum(new[1:, 1:], span[:-1, :-1] + 1)  # replaced
        equal = np.where(same, np.maximum(span[:, :-1] + 1, 1), none)
        new[:, 1:] = np.maximum(new[:, 1:], equal)
        for e in range(1, most + 1):
            new[e, 1:] = np.maximum(new[e, 1:], new[e - 1, :-1] + 1)  # omitted
        new[new < 1] = none
        ends = (equal >= least) & (allowed <= -(-equal // one_in))
        if ends.any():
            e, at = np.unravel_index(np.where(ends, equal * (most + 1) - allowed, -1).argmax(), ends.shape)
            best = max(best, (int(equal[e, at]), -int(e)))
        span = new
    return best[0], -best[1]


def longest_run(text: np.ndarray, item: np.ndarray) -> int:
    """Words of the longest run that both hold word for word."""
    run, best = np.zeros(len(item) + 1, int), 0
    for x in text:
        run[1:] = np.where(item == x, run[:-1] + 1, 0)
        best = max(best, int(run.max(initial=0)))
    return best


CHUNK_WORDS = 400_000


def _search(batches: Iterator[pa.RecordBatch], index: ItemIndex) -> Iterator[pa.RecordBatch]:
    r, get = index.rules, index.vocabulary.get
    gap = np.full(r.passage, -1, np.int64)

    def flush(ids: list, parts: list[np.ndarray]) -> pa.RecordBatch:
        starts = np.cumsum([0, *(len(p) + len(gap) for p in parts)])
        tokens = np.concatenate([x for p in parts for x in (p, gap)])
        passages, items = index.search(tokens)
        doc = np.searchsorted(starts, passages * r.stride, side="right") - 1
        # a passage that begins in the gap before a document has its words there
        late = passages * r.stride >= starts[doc] + np.array([len(p) for p in parts] or [0])[np.minimum(doc, len(parts) - 1)]
        doc = np.minimum(doc + late, len(parts) - 1)
        out: list[tuple] = []
        order = np.lexsort((passages, items, doc))
        i = 0
        while i < len(order):
            d, t, j = doc[order[i]], items[order[i]], i + 1
            while j < len(order) and doc[order[j]] == d and items[order[j]] == t and passages[order[j]] - passages[order[j - 1]] <= 2:
                j += 1
            lo = max(starts[d], passages[order[i]] * r.stride - r.stride)
            hi = min(starts[d] + len(parts[d]), passages[order[j - 1]] * r.stride + r.passage + r.stride)
            n, wrong = index.aligned(tokens[lo:hi], t)
            if n:
                out.append((ids[d], int(index.ids[t]), n, wrong))
            i = j
        columns = list(zip(*out)) or [[], [], [], []]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.int32()))], names=["doc_id", "test_id", "n_words", "n_wrong"])

    for batch in batches:
        ids, parts, size = [], [], 0
        for i, t in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
            found = words(t)
            parts.append(np.array([get(w, -1) for w in found], np.int64))
            ids.append(i)
            size += len(found) + len(gap)
            if size >= CHUNK_WORDS:
                yield flush(ids, parts)
                ids, parts, size = [], [], 0
        if ids:
            yield flush(ids, parts)


def leaks(docs: DataFrame, items: DataFrame, rules: Rules = Rules(), slice_chars: int = 20_000_000) -> DataFrame:
    """doc_id, test_id, n_words, n_wrong: documents that hold a passage of at least rules.least consecutive words of an item.

    docs: doc_id, text; items: test_id, text. Every passage of every document is a query to the index of the items; what reaches an
    item's threshold is aligned word by word. With rules.edits = 0 only passages that stand there word for word count. The index goes to each executor; items of more than slice_chars characters
    together are cut into slices of so many, each with an index of its own and a pass over the documents, so what is broadcast is bounded
    (an index takes some ten bytes a character). An item's threshold holds in any slice, so the result does not depend on the cut. NULL and empty texts
    hold nothing; of items shorter than least words nothing can be found. Of several leaks of one item in a document the longest is given.
    Documents are searched where they lie: nothing is shuffled but the matches.
    """
    texts = docs.select("doc_id", "text").where(F.col("text").isNotNull() & (F.col("text") != ""))
    found = None
    for part in _slices(items, slice_chars):
        shared = docs.sparkSession.sparkContext.broadcast(ItemIndex(part, rules))
        hits = texts.mapInArrow(lambda it, shared=shared: _search(it, shared.value), "doc_id bigint, test_id bigint, n_words int, n_wrong int")
        found = hits if found is None else found.unionAll(hits)
    best = found.groupBy("doc_id", "test_id").agg(F.max(F.struct("n_words", (-F.col("n_wrong")).alias("right"))).alias("m"))
    return best.select("doc_id", "test_id", F.col("m.n_words").alias("n_words"), (-F.col("m.right")).alias("n_wrong"))


def _slices(items: DataFrame, chars: int) -> Iterator[list[tuple[int, str]]]:
    """The items in order of their ids, in lists of about so many characters; at least one list. One partition at a time is held."""
    part, size = [], 0
    for r in items.select("test_id", "text").orderBy("test_id").toLocalIterator():
        part.append((r["test_id"], r["text"]))
        size += len(r["text"] or "")
        if size >= chars:
            yield part
            part, size = [], 0
    if part or size == 0:
        yield part
