"""Repair of text from scanned pages: page furniture, words broken at line ends, wrongly read words, reflow."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass
from functools import cached_property

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkseek.session import cut

_SPACE = " \t\r\x0c\xa0  ​　﻿"
HYPHENS = "-‐\xad¬"
_NUM = r"(?=[^\s\]]*\d|[ivxlc]+\b)[0-9lIOoSsB|ivxc]{1,5}"
_PAGE = rf"[\[(–—-]*\s*(?:(?:p|pp|page|pg|s|seite|página|pag|pág|str|стр)\b\.?\s*)?{_NUM}(?:\s*(?:of|/|von|de|sur|из|z)\s*{_NUM})?\s*[\])–—-]*\.?"
_PAGE_ONLY = re.compile(rf"^{_PAGE}$", re.I)
_PAGE_FIRST = re.compile(rf"^{_PAGE}\s{{2,}}(\S.*)$", re.I)
_PAGE_LAST = re.compile(rf"^(\S.*?)\s{{2,}}{_PAGE}$", re.I)
# Characters a scanner takes for one another, under one sign.
_ALIKE = str.maketrans({"0": "o", "O": "o", "1": "l", "|": "l", "I": "l", "i": "l", "!": "l", "5": "s", "S": "s", "8": "b", "B": "b"})
_WORD = re.compile(r"(?:[^\W_]|[|!](?=[^\W_])|(?<=[^\W\d_])[|])+")
_DAMAGED = re.compile("[\x80-\x9f�ÃÂ├┬┼√Ãâ€]")
_COMPOUND = re.compile(r"[^\W\d_]+-[^\W\d_]+")
_OPENS = re.compile(r"[.!?:…“„«\"¿¡]")
_PLAIN_WORD = re.compile(r"[^\W\d_]+")


def _key(text: str) -> str:
    return text.translate(_ALIKE).casefold().replace("rn", "m")


def near(a: str, b: str, most: int) -> bool:
    """Whether the edit distance is at most `most`; bands of the usual table."""
    if a == b:
        return True
    if abs(len(a) - len(b)) > most:
        return False
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (x != y)))
        if min(new) > most:
            return False
        row = new
    return row[-1] <= most


@dataclass
class Line:
    no: int
    raw: str
    text: str
    drop: bool = False
    indent: bool = False
    gap: bool = False  # an empty line before it


def read_lines(content: str, dropped: Sequence[int] | None = None) -> list[Line]:
    """Lines that are not empty, from 1, with the page furniture marked: found in the text, or the lines with these numbers."""
    lines: list[Line] = []
    gap = True
    for i, raw in enumerate(content.split("\n"), 1):
        t = raw.strip(_SPACE)
        if not t:
            gap = True
            continue
        lines.append(Line(i, raw, t, indent=raw[:1] in " \t\xa0", gap=gap))
        gap = False
    if dropped is None:
        _mark_furniture(lines)
    else:
        for x in lines:
            x.drop = x.no in dropped
    return lines


def _mark_furniture(lines: list[Line]) -> None:
    """Marks running headers and footers and page numbers.

    A line is furniture if it is a page number or has one set off by spaces; if it is short and recurs, but for numbers, case and
    what a scanner mistakes, some lines further; or if it is short, no sentence's part and next to another such line. A
    title that opens the text is none, unless the same line recurs and no header follows it.
    """
    if not lines:
        return
    width = sorted(len(x.text) for x in lines)[int(len(lines) * 0.9)]
    bare: list[str] = []
    number_only = []
    for x in lines:
        m = _PAGE_FIRST.match(x.text) or _PAGE_LAST.match(x.text)
        only = _PAGE_ONLY.match(x.text) is not None
        number_only.append(only)
        if only or m:
            x.drop = True
        bare.append("" if only else (m[1].strip() if m else x.text))
    short = [bool(b) and (len(b) < 0.8 * width or len(lines) < 4) and not b[0].islower() and b[-1] not in ".,;:!?”»" and b[-1] not in HYPHENS for b in bare]
    keys = [re.sub(r"\d+", "0", _key(b)) for b in bare]
    where: dict[str, list[int]] = {}
    for i, k in enumerate(keys):
        if k and (short[i] or lines[i].drop):
            where.setdefault(k, []).append(i)
    alike = _alike(list(where))
    for k, at in where.items():
        others = [j for q in alike.get(k, ()) for j in where[q]]
        both = at + others
        if max(both) - min(both) >= 3:
            for i in at:
                if i or lines[0].drop:
                    lines[i].drop = True
    changed = True
    while changed:
        changed = False
        for i, x in enumerate(lines):
            if i == 0 or x.drop or not short[i] or len(x.text) > 0.7 * width:
                continue
            beside = [j for j in (i - 1, i + 1) if 0 <= j < len(lines) and lines[j].drop]
            if beside and not (i == 1 and not lines[0].drop and beside == [0]):
                x.drop = changed = True
    first = lines[0]
    if not first.drop and short[0] and len(lines) > 1:
        header_next = lines[1].drop and not number_only[1]
        recurs = any(near(bare[0].translate(_ALIKE), b.translate(_ALIKE), 2 if len(b) > 8 else 0) for b, x in zip(bare[2:], lines[2:]) if x.drop and b)
        first.drop = recurs and not header_next


def _alike(keys: Sequence[str]) -> dict[str, list[str]]:
    """For each key of more than six characters the others within two edits. Two edits leave one third of a key whole, moved by two
    places at most, so only keys that share such a third are compared."""
    thirds: dict[tuple[int, str], list[str]] = {}
    long = [k for k in keys if len(k) > 6]
    for k in long:
        n = len(k) // 3
        for i in range(3):
            thirds.setdefault((len(k), k[i * n : (i + 1) * n]), []).append(k)
    found: dict[str, list[str]] = {}
    for q in long:
        met = set()
        for size in range(len(q) - 2, len(q) + 3):
            n = size // 3
            for i in range(3):
                for at in range(max(0, i * n - 2), i * n + 3):
                    met.update(thirds.get((size, q[at : at + n]), ()))
        met.discard(q)
        if close := [k for k in met if near(q, k, 2)]:
            found[q] = sorted(close)
    return found


class Trie:
    """A vocabulary as nested dicts; None ends a word."""

    def __init__(self, words: Iterable[tuple[str, str]]):
        """words: (spelling to walk, word); words of one spelling share its end."""
        self.root: dict = {}
        for spelling, w in words:
            node = self.root
            for c in spelling:
                node = node.setdefault(c, {})
            node.setdefault(None, []).append(w)

    def within(self, word: str, most: int) -> list[str]:
        """All words of the vocabulary within `most` edits: the trie is walked along with the Levenshtein automaton of the word.

        The automaton's states are bit masks, one per number of edits; bit i says that i characters of the word are read. A branch ends
        when no state is left, so only prefixes that can still match are visited.
        """
        m = len(word)
        at: dict[str, int] = {}
        for i, c in enumerate(word):
            at[c] = at.get(c, 0) | (1 << i)
        full, end = (1 << (m + 1)) - 1, 1 << m
        start = [1]
        for _ in range(most):
            start.append(start[-1] | (start[-1] << 1) & full)
        found: list[str] = []
        stack = [(self.root, tuple(start))]
        while stack:
            node, states = stack.pop()
            if None in node and states[most] & end:
                found.extend(node[None])
            for c, child in node.items():
                if c is None:
                    continue
                hit = at.get(c, 0)
                new = [(states[0] & hit) << 1]
                for e in range(1, most + 1):
                    # the character equal; too many in the vocabulary's word; another; too many in the word
                    new.append(((states[e] & hit) << 1 | states[e - 1] | states[e - 1] << 1 | new[e - 1] << 1) & full)
                if new[most]:
                    stack.append((child, tuple(new)))
        return found


class Words:
    """What was looked up of the words of a text: their counts in the corpus, the words of the corpus they may be misreadings of, and what
    context chose among those."""

    def __init__(self, counts: dict[str, int], near: dict[str, str], chosen: dict[tuple[str, str, str], str] | None = None, least: int = 3, common: dict[str, int] | None = None):
        """near: a word that may be a misreading with its most frequent original; a word with `least` occurrences is there only if it is one in spite of
        them. common: counts of words that are known in any case."""
        self.near, self.chosen, self.least, self.common = near, chosen or {}, least, common or {}
        self.counts = {w: n for w, n in counts.items() if n >= least and w not in near}

    def count(self, word: str) -> int:
        """Occurrences of a known word; 0 for others."""
        return self.common.get(word) or self.counts.get(word, 0)

    def correct(self, word: str, before: str = "", after: str = "") -> str | None:
        """The word a misread one stands for, None if it is known or nothing is near. Among several context decides, then frequency."""
        if self.count(word):
            return None
        return self.chosen.get((word, before, after)) or self.near.get(word)


def _shape(w: str) -> str:
    # fixed values: groups of letters a scanner takes for one another
    w = w.translate(_ALIKE).casefold()
    for a, b in (("rn", "m"), ("ri", "n"), ("rl", "n"), ("ii", "u"), ("ll", "u"), ("vv", "w"), ("cl", "d"), ("ol", "d"), ("nn", "m"), ("ﬁ", "fl"), ("ﬂ", "fl"), ("li", "h"), ("lil", "m")):
        w = w.replace(a, b)
    return w


@dataclass
class Token:
    line: int  # index into the body lines
    text: str
    start: bool  # begins a sentence
    damaged: bool
    parts: tuple[int, ...]  # body lines it lies on
    broken: bool = False


def tokens(body: Sequence[Line]) -> list[Token]:
    """Words of the body in order; a word broken at a line's end is one token. The hyphen of the break is left in (as "\\n")."""
    out: list[Token] = []
    ended, carry = True, ""
    for i, x in enumerate(body):
        raw = x.text
        end_hyphen = raw[-1] in HYPHENS and len(raw) > 1 and raw[-2].isalnum() and i + 1 < len(body)
        found, damaged, here = list(_WORD.finditer(raw)), _DAMAGED.search(raw) is not None, (i,)
        for n, m in enumerate(found):
            word, bad = m[0], damaged and _bad(raw, m)
            if n == 0 and carry and m.start() == 0:
                before = out.pop()
                out.append(Token(before.line, f"{before.text}\n{word}", before.start, before.damaged or bad, (*before.parts, i), True))
            else:
                # only of a capital it matters whether it begins a sentence
                start = word[0].isupper() and (_OPENS.search(raw, found[n - 1].end(), m.start()) is not None if n else ended or m.start() > 0 and raw[0] in "“„«¿¡\"(")
                out.append(Token(i, word, start, bad, here))
        ended = raw.rstrip("”»\"')")[-1:] in (".", "!", "?", ":", "…")
        carry = "\n" if end_hyphen and found and found[-1].end() == len(raw) - 1 else ""
    return out


def _bad(raw: str, m: re.Match) -> bool:
    """The word stands in a run of characters that shows a wrong encoding."""
    a, b = m.start(), m.end()
    while a and not raw[a - 1].isspace():
        a -= 1
    while b < len(raw) and not raw[b].isspace():
        b += 1
    return _DAMAGED.search(raw[a:b]) is not None


def compound(x: str, y: str, words: Words) -> bool:
    """Whether the hyphen between x and y at a line's end is the word's own: both are words, and together they are none."""
    a, b = x.casefold(), y.casefold()
    if any(map(str.isdigit, x)) and not any(map(str.islower, x)) or y[:1].isdigit() or (len(x) > 1 and x.isupper()):
        return True
    joined = words.count(a + b)
    whole = words.count(f"{a}-{b}")
    if joined or whole:
        return whole > joined
    if (a + b) in words.near:
        return False
    return words.count(a) >= words.least and words.count(b) >= words.least and len(b) > 2 and len(a) > 1


def _spoken(toks: Sequence[Token]) -> list[tuple[str, str]]:
    """The words before and after each token."""
    plain = [t.text.replace("\n", "").casefold() for t in toks]
    return [(plain[n - 1] if n else "", plain[n + 1] if n + 1 < len(plain) else "") for n in range(len(plain))]


def lookups(content: str, dropped: Sequence[int]) -> tuple[set[str], set[tuple[str, str, str]]]:
    """What judge() may ask of the words of a text: counts, and readings (word, before, after)."""
    toks = tokens([x for x in read_lines(content, dropped) if not x.drop])
    counts: set[str] = set()
    read: set[tuple[str, str, str]] = set()
    for t, (before, after) in zip(toks, _spoken(toks)):
        if t.broken:
            parts = t.text.split("\n")
            a, b = parts[0].casefold(), parts[1].casefold()
            counts |= {a, b, a + b, f"{a}-{b}"}
            read |= {(w, "", "") for part in parts if (w := _readable(part, t.start, t.damaged))}
        if w := _readable(t.text, t.start, t.damaged):
            read.add((w, before, after))
    return counts, read


def judge(content: str, words: Words, repair: bool = True, dropped: Sequence[int] | None = None) -> tuple[list[tuple[int, str]], str | None]:
    """(line_no, kind) of all cases, and the repaired text if wanted."""
    lines = read_lines(content, dropped)
    body = [x for x in lines if not x.drop]
    cases = [(x.no, "drop") for x in lines if x.drop and any(map(str.isalnum, x.text))]
    toks = tokens(body)
    fixes: dict[int, list[tuple[str, str]]] = {}
    splits: dict[int, bool] = {}
    misread: set[int] = set()
    for t, (before, after) in zip(toks, _spoken(toks)):
        if t.broken:
            first, *rest = t.text.split("\n")
            own = compound(first, rest[0], words)
            for i in t.parts[:-1]:
                splits[i] = not own
            if own:
                for part, i in zip((first, *rest), t.parts):
                    _read(part, t.start, t.damaged, "", "", words, (i,), misread, fixes)
                continue
        _read(t.text, t.start, t.damaged, before, after, words, t.parts, misread, fixes)
    cases += [(body[i].no, "split") for i, yes in splits.items() if yes]
    cases += [(body[i].no, "misread") for i in misread]
    return sorted(set(cases)), _reflow(body, splits, fixes) if repair else None


def _readable(text: str, start: bool, damaged: bool) -> str | None:
    """A token as a word that may have been misread; None for numbers, abbreviations, names and what another encoding damaged."""
    joined = text.replace("\n", "")
    low = joined.casefold()
    if damaged or len(low) < 2 or low.isdigit():
        return None
    letters = sum(map(str.isalpha, joined))
    if letters < len(joined) / 2 or (joined.isupper() and letters > 1) or not any(map(str.islower, joined)):
        return None
    return None if joined[0].isupper() and not start else low


def _read(text: str, start: bool, damaged: bool, before: str, after: str, words: Words, parts: tuple[int, ...], misread: set[int], fixes: dict) -> None:
    low = _readable(text, start, damaged)
    fix = words.correct(low, before, after) if low else None
    if fix is None:
        return
    capital = text[0].isupper()
    if capital and not near(_shape(low), _shape(fix), 0) and not (low[1:] == fix[1:] or low[0] == fix[0]):
        return
    pieces = text.split("\n")
    # of a broken word the piece that differs
    hit = parts[0]
    if len(pieces) > 1 and fix.startswith(pieces[0].casefold()):
        hit = parts[-1]
    misread.add(hit)
    fixes.setdefault(parts[0], []).append((text, fix.capitalize() if capital else fix))


def _reflow(body: Sequence[Line], splits: dict[int, bool], fixes: dict[int, list[tuple[str, str]]]) -> str:
    """Paragraphs as single lines: split at empty lines and indents where a sentence has ended."""
    paragraphs: list[list[str]] = []
    for i, x in enumerate(body):
        t = x.text
        for old, new in fixes.get(i, ()):
            if "\n" not in old:
                t = re.sub(rf"(?<!\w){re.escape(old)}(?!\w)", new, t, count=1)
        ended = i == 0 or body[i - 1].text.rstrip("”»\"')")[-1:] in (".", "!", "?", ":", "…") or i == 1 and not body[0].text.endswith(",") and body[1].text[:1].isupper() and len(body[0].text) < 0.8 * len(body[1].text)
        if i == 0 or ((x.gap or x.indent) and ended):
            paragraphs.append([t])
        elif i - 1 in splits:
            paragraphs[-1][-1] = (paragraphs[-1][-1].rstrip(HYPHENS) if splits[i - 1] else paragraphs[-1][-1]) + t
        else:
            paragraphs[-1].append(t)
    text = "\n".join(" ".join(p) for p in paragraphs)
    for pairs in fixes.values():
        for old, new in pairs:
            if "\n" in old:
                text = text.replace(old.replace("\n", ""), new, 1)
    return text


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """id, text -> id, text, dropped: the numbers of the lines that are page furniture."""
    for batch in batches:
        dropped = [[x.no for x in read_lines(t) if x.drop] for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("text"), pa.array(dropped, pa.list_(pa.int32()))], names=["id", "text", "dropped"])


def _counted(single: Counter, pairs: Counter) -> pa.RecordBatch:
    rows = [(w, "", n) for w, n in single.items()] + [(a, b, n) for (a, b), n in pairs.items()]
    a, b, n = zip(*rows) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(a, pa.string()), pa.array(b, pa.string()), pa.array(n, pa.int64())], names=["a", "b", "n"])


def _count_scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """text, dropped -> a, b (empty for single words), n: words and pairs of neighbours, combined by batch."""
    for batch in batches:
        single: Counter[str] = Counter()
        pairs: Counter[tuple[str, str]] = Counter()
        for text, dropped in zip(batch.column("text").to_pylist(), batch.column("dropped").to_pylist()):
            broken, gone = False, set(dropped)
            for i, raw in enumerate(text.split("\n"), 1):
                t = raw.strip(_SPACE).casefold()
                if not t or i in gone:
                    continue
                found = _WORD.findall(t)
                if broken:
                    found = found[1:]
                if broken := t[-1] in HYPHENS:
                    found = found[:-1]
                single.update(found)
                pairs.update(zip(found, found[1:]))
                if "-" in t[:-1]:
                    single.update(_COMPOUND.findall(t))
        yield _counted(single, pairs)


def _count_plain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        single: Counter[str] = Counter()
        for text in batch.column("text").to_pylist():
            single.update(_PLAIN_WORD.findall(text.casefold()))
        yield _counted(single, Counter())


def _asked(batches: Iterator[pa.RecordBatch], common: dict[str, int]) -> Iterator[pa.RecordBatch]:
    """id, text, dropped -> id, word, before, after, read: what is to be looked up for each text, but for the common words."""
    for batch in batches:
        rows = []
        for i, t, dropped in zip(*(batch.column(c).to_pylist() for c in ("id", "text", "dropped"))):
            counts, read = lookups(t, set(dropped))
            rows += [(i, w, "", "", False) for w in counts if w not in common]
            rows += [(i, *r, True) for r in read if r[0] not in common]
        columns = list(zip(*rows)) or [[], [], [], [], []]
        kinds = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.bool_())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["id", "word", "before", "after", "read"])


def _half(kind: str, size: int, spelling: str) -> tuple[int, int]:
    """The two places at which words of `size` letters are looked up: by their first and by their last letters, a little less than half of
    them. One edit leaves one of the halves whole, so words within one edit meet at one of these."""
    k = (size - 1) // 2
    key = lambda side, part: xxhash.xxh3_64_intdigest(f"{kind}{side}{size} {part}".encode("utf-8", "surrogatepass")) - 2**63
    return key("<", spelling[:k]), key(">", spelling[len(spelling) - k :])


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """word, n, enough, known -> place, asks, kind, word, n: known words at their places and words to be looked up at all places they can meet one; as they
    are spelt (kind 0) and, words of more than four letters, as they look (kind 1). n of an asking word is the least count that a word must have for it."""
    for batch in batches:
        rows = []
        for w, n, enough, known in zip(*(batch.column(c).to_pylist() for c in ("word", "n", "enough", "known"))):
            for kind, spelling in ((0, w), (1, _shape(w))):
                if known:
                    rows += [(p, False, kind, w, n) for p in set(_half(str(kind), len(spelling), spelling))]
                if enough is not None and (kind == 0 or len(w) > 4):
                    m = len(spelling)
                    rows += [(p, True, kind, w, enough) for p in {p for size in range(max(1, m - 1), m + 2) for p in _half(str(kind), size, spelling)}]
        columns = list(zip(*rows)) or [[], [], [], [], []]
        kinds = (pa.int64(), pa.bool_(), pa.int32(), pa.string(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["place", "asks", "kind", "word", "n"])


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of _places, sorted -> word, kind, v, n: the known words within one edit of each asking word that are frequent enough for it. Of every
    place a trie is built of its known words, and the automaton of each asking word walks it."""
    at, words, trie = None, {}, None
    for batch in batches:
        rows = []
        for place, asks, kind, w, n in zip(*(batch.column(c).to_pylist() for c in ("place", "asks", "kind", "word", "n"))):
            if place != at:
                at, words, trie = place, {}, None
            if not asks:
                words[w] = n
                continue
            if not words:
                continue
            spelt = _shape if kind else str
            if trie is None:
                trie = Trie((spelt(v), v) for v in words)
            rows += [(w, kind, v, words[v]) for v in trie.within(spelt(w), 1) if v != w and words[v] >= n and (not kind or near(w, v, 3))]
        columns = list(zip(*rows)) or [[], [], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.int32(), pa.string(), pa.int64()))], names=["word", "kind", "v", "n"])


def sound(counts: dict[str, int], strict: int) -> dict[str, int]:
    """Those of the words that are no misreadings of others `strict` times as frequent."""
    floor = min(counts.values(), default=0) * strict
    often = [w for w, n in counts.items() if n >= floor and len(w) > 2]
    tries = [Trie((spelt(w), w) for w in often) for spelt in (str, _shape)]

    def misread(w: str) -> bool:
        enough = lambda v, most: v != w and counts[v] >= counts[w] * strict and near(w, v, most)
        return len(w) > 2 and (any(enough(v, 1) for v in tries[0].within(w, 1)) or len(w) > 4 and any(enough(v, 3) for v in tries[1].within(_shape(w), 1)))

    return {w: n for w, n in counts.items() if not misread(w)}


class ScannedText:
    """Finds and repairs what scanning did to texts.

    docs: id and text of scanned texts; other: further texts (text) whose words count as vocabulary, may be None. Other columns are ignored. NULL
    and empty texts give nothing. Lines count from 1 and split at \\n only.

    Words are counted over all texts, every one of them. A word met less than `least` times is looked up among all words at least
    `ratio` times as frequent as itself, a more frequent one among those `strict` times as frequent: it is a misreading if one lies within
    one edit, or, if none does, within one edit once letters that look alike are written alike. For that the vocabulary is spread: a
    word lies at two places, by the first and by the last letters of its spelling; an asking word comes to all places where a word within
    one edit can be, and there its Levenshtein automaton walks the trie of that place's words. So no task and no executor holds the
    vocabulary. Where several words are near, the counts of the pairs they form with the neighbours decide, then their frequency.

    Only words with a share of at least `common` of all words (at most 1 / common of them) are broadcast, with their counts, to be left out of
    the lookups, as far as they are no misreadings themselves; that takes the few words into account that are `strict` times as frequent.
    """

    def __init__(self, docs: DataFrame, id: str = "item_id", text: str = "content", other: DataFrame | None = None, least: int = 3, ratio: int = 10, strict: int = 60, common: float = 2e-5):
        self.least, self.ratio, self.strict, self.common = least, ratio, strict, common
        self.docs = docs.select(F.col(id).alias("id"), F.col(text).alias("text")).where(F.col("text").isNotNull() & (F.col("text") != ""))
        self.other = None if other is None else other.select(F.col(text).alias("text")).where(F.col("text").isNotNull())

    @cached_property
    def parsed(self) -> DataFrame:
        return cut(self.docs.mapInArrow(_parse, "id bigint, text string, dropped array<int>"))

    @cached_property
    def counts(self) -> DataFrame:
        """a, b, n: words (b empty) and neighbouring pairs with their counts."""
        out = "a string, b string, n bigint"
        found = self.parsed.select("text", "dropped").mapInArrow(_count_scanned, out)
        if self.other is not None:
            found = found.unionAll(self.other.mapInArrow(_count_plain, out))
        return cut(found.groupBy("a", "b").agg(F.sum("n").alias("n")))

    def near(self, asked: DataFrame) -> DataFrame:
        """word, n, near (array of n, v): each asked word with its count and the words it may be a misreading of; NULL where there is none.

        Frequent words are asked as well, so that a misreading is never taken for the original of another.
        """
        single = self.counts.where(F.col("b") == "").select(F.col("a").alias("word"), "n")
        all_words = single.join(asked.withColumn("asked", F.lit(True)), "word", "full").select("word", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("asked", F.lit(False)).alias("asked"))
        known = (F.col("n") >= self.ratio) & (F.char_length("word") > 2)
        enough = F.when(F.col("n") >= self.least, F.col("n") * self.strict).otherwise(F.greatest("n", F.lit(1)) * self.ratio).cast("bigint")
        asks = (F.col("asked") | known) & (F.char_length("word") > 2) & F.col("word").rlike(r"\p{L}")
        all_words = cut(all_words.select("word", "n", "asked", F.when(asks, enough).alias("enough"), known.alias("known")).where(F.col("asked") | known), partitioned=True)
        # nothing is frequent enough for a word that would need more than the most frequent one has
        most = single.agg(F.max("n")).first()[0] or 0
        asking = all_words.select("word", "n", F.when(F.col("enough") <= most, F.col("enough")).alias("enough"), "known")
        placed = asking.mapInArrow(_places, "place bigint, asks boolean, kind int, word string, n bigint")
        met = placed.repartition("place").sortWithinPartitions("place", "asks").mapInArrow(_meet, "word string, kind int, v string, n bigint")
        met = cut(met.distinct())
        bad = met.select("word").distinct().join(all_words.where("known").select("word"), "word", "left_semi").select(F.col("word").alias("v"))
        near_by = met.join(bad, "v", "left_anti").groupBy("word").agg(F.min("kind").alias("first"), F.collect_list(F.struct("kind", "n", "v")).alias("all"))
        of_first = F.transform(F.filter("all", lambda x: x.kind == F.col("first")), lambda x: F.struct(x.n.alias("n"), x.v.alias("v")))
        near_by = near_by.select("word", F.sort_array(of_first, False).alias("near"))
        return all_words.where("asked").select("word", "n").join(near_by, "word", "left")

    def _judged(self, repair: bool) -> DataFrame:
        spark = self.docs.sparkSession
        single = self.counts.where(F.col("b") == "")
        total = single.agg(F.sum("n")).first()[0] or 0
        frequent = single.where(F.col("n") >= F.greatest(F.lit(self.common * total), F.lit(self.least)))
        top = {r["a"]: r["n"] for r in frequent.toLocalIterator()}  # at most 1 / common words
        common = spark.sparkContext.broadcast(sound(top, self.strict))
        asked = cut(self.parsed.mapInArrow(lambda it: _asked(it, common.value), "id bigint, word string, before string, after string, read boolean"))
        words = cut(self.near(asked.select("word").distinct()))
        told = asked.join(words, "word").select("id", "word", "before", "after", "read", "n", "near")
        # among several the neighbours decide: the counts of the pairs each would form with them
        several = told.where(F.col("read") & (F.size("near") > 1)).select("word", "before", "after", "near").distinct()
        each = several.select("word", "before", "after", F.explode("near").alias("x")).select("word", "before", "after", "x.n", "x.v")
        pairs = self.counts.where(F.col("b") != "")
        first = pairs.select(F.col("a").alias("before"), F.col("b").alias("v"), F.col("n").alias("m1"))
        second = pairs.select(F.col("a").alias("v"), F.col("b").alias("after"), F.col("n").alias("m2"))
        weighed = each.join(first, ["before", "v"], "left").join(second, ["v", "after"], "left")
        support = F.coalesce("m1", F.lit(0)) + F.coalesce("m2", F.lit(0))
        chosen = weighed.groupBy("word", "before", "after").agg(F.max(F.struct(support.alias("s"), "n", "v")).alias("c")).select("word", "before", "after", F.col("c.v").alias("chosen"))
        # a reading that nothing is near is right, and a part that is no word counts nothing
        told = told.where(F.col("near").isNotNull() | ~F.col("read") & (F.col("n") >= self.least))
        told = told.join(chosen, ["word", "before", "after"], "left")
        row = F.struct("word", "before", "after", "n", F.col("near")[0]["v"].alias("near"), "chosen")
        per_text = told.groupBy(F.col("id").alias("__id")).agg(F.collect_set(row).alias("told"))  # bounded by the words of one text
        texts = self.parsed.join(per_text, F.col("id") == F.col("__id"), "left").select("id", "text", "dropped", "told")
        least = self.least

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                judged = []
                for t, dropped, rows in zip(*(batch.column(c).to_pylist() for c in ("text", "dropped", "told"))):
                    rows = rows or ()
                    near_by = {r["word"]: r["near"] for r in rows if r["near"] is not None}
                    chosen_by = {(r["word"], r["before"], r["after"]): r["chosen"] for r in rows if r["chosen"] is not None}
                    words = Words({r["word"]: r["n"] for r in rows}, near_by, chosen_by, least, common.value)
                    judged.append(judge(t, words, repair, set(dropped)))
                cases = pa.array([[{"line_no": n, "kind": k} for n, k in c] for c, _ in judged], pa.list_(pa.struct([("line_no", pa.int32()), ("kind", pa.string())])))
                yield pa.RecordBatch.from_arrays([batch.column("id"), cases, pa.array([t for _, t in judged], pa.string())], names=["id", "cases", "text"])

        return texts.mapInArrow(run, "id bigint, cases array<struct<line_no:int,kind:string>>, text string")

    def cases(self) -> DataFrame:
        """id, line_no, kind (drop, split or misread)."""
        return self._judged(False).select("id", F.explode("cases").alias("c")).select("id", "c.line_no", "c.kind")

    def repaired(self) -> DataFrame:
        """id, text: continuous paragraphs without furniture and broken words, misread words replaced by their likeliest originals."""
        return self._judged(True).select("id", "text")
