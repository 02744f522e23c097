"""Text decoded with the wrong character encoding: garbled forms of every clean word of the corpus, hash-joined with its tokens."""

from __future__ import annotations

import codecs
import re
from collections import Counter
from collections.abc import Iterator
from functools import cached_property, lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkseek.session import cut

# Encodings that text is met in, by Python's names.
SINGLE_BYTE = ("cp1252", "latin-1", "iso8859-15", "cp1250", "iso8859-2", "cp1251", "koi8-r", "iso8859-5", "cp866", "cp437", "cp850", "cp852", "mac_roman", "cp1254", "cp1253")
EAST_ASIAN = ("shift_jis", "euc_jp", "gbk", "big5", "euc_kr")
LATER = ("cp1252", "latin-1", "mac_roman", "cp437", "cp850")

NOT_ASCII = r"[^\x00-\x7F]"
BREAKS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
PART, RUN = " part", " run"
# East Asian characters with their punctuation and full-width forms; runs of them, and runs that two-byte characters read as single bytes can leave
# (a second byte may be ASCII from @ on), from a first non-ASCII character.
WIDE = r"\u1100-\u11FF\u2E80-\u9FFF\uAC00-\uD7AF\uF900-\uFAFF\uFF00-\uFFEF"
RUNS = rf"[{WIDE}]+|[^\x00-\x7F{WIDE}](?:[\x40-\x7E]|[^\x00-\x7F{WIDE}])*"
# Encodings whose upper half is Latin letters and signs, which no text has many of in a row.
LATIN = ("cp1252", "latin-1", "iso8859-15", "cp1250", "iso8859-2", "cp437", "cp850", "cp852", "mac_roman", "cp1254")
_DAMAGE = re.compile("[�\x80-\x84\x86-\x9f]")
_RUN = re.compile(r"[^\x00-\x7f]+")
_WIDE = re.compile(f"[{WIDE}]+")
_PAIR = re.compile(f"[{WIDE}]{{2}}")
_RUNS = re.compile(RUNS)
_FROM = re.compile(r"[^\x00-\x7F](?:[0-9A-Za-z]|[^\x00-\x7F])*")


@lru_cache(None)
def _table(encoding: str) -> tuple[str, object]:
    """The characters of the 256 bytes of a single-byte encoding and the map back; bytes it leaves open stand for the control character of
    that number."""
    down = "".join(bytes([b]).decode(encoding, "ignore") or chr(b) for b in range(256))
    return down, codecs.charmap_build(down)


@lru_cache(None)
def _bytes_of(encoding: str) -> dict[str, bytes]:
    """The characters of a single-byte encoding with their bytes."""
    return {c: bytes([b]) for b, c in reversed(list(enumerate(_table(encoding)[0])))}


def encoded(text: str, encoding: str) -> bytes | None:
    """text in an encoding; None where it cannot be."""
    try:
        return codecs.charmap_encode(text, "strict", _table(encoding)[1])[0] if encoding in SINGLE_BYTE else text.encode(encoding)
    except UnicodeEncodeError:
        return None


def _decoded(raw: bytes, wrong: str) -> str:
    return raw.decode("utf-8", "replace") if wrong == "utf-8" else codecs.charmap_decode(raw, "strict", _table(wrong)[0])[0]


def misread(text: str, true: str, wrong: str) -> str | None:
    """text encoded as `true` and decoded as `wrong`, a single-byte encoding or "utf-8" with replacement; None where it cannot be."""
    raw = encoded(text, true)
    return None if raw is None else _decoded(raw, wrong)


def reread(text: str, true: str, wrong: str) -> str | None:
    """What misread() made of its text, undone strictly; None if this chain cannot have made it."""
    raw = encoded(text, wrong)
    if raw is None:
        return None
    try:
        return codecs.charmap_decode(raw, "strict", _table(true)[0])[0] if true in SINGLE_BYTE else raw.decode(true)
    except UnicodeDecodeError:
        return None


def chains() -> list[tuple[str, str, str, str]]:
    """All encoding chains: (true, wrong, true of a second time or "", wrong of it or "")."""
    once = [("utf-8", w) for w in SINGLE_BYTE]
    once += [(t, w) for t in SINGLE_BYTE for w in SINGLE_BYTE if t != w]
    once += [(t, w) for t in EAST_ASIAN for w in ("cp1252", "latin-1")]
    lost = [(t, "utf-8") for t in ("cp1252", "cp1250", "cp1251")]
    twice = [("utf-8", a, "utf-8", b) for a in LATER for b in LATER]
    return [(*c, "", "") for c in once + lost] + twice


@lru_cache(None)
def _by_true() -> tuple[dict[str, list[str]], list[tuple[str, list[str]]]]:
    """The chains by their first encoding, and of those that go wrong twice the second halves by the first."""
    once: dict[str, list[str]] = {}
    twice: dict[str, list[str]] = {}
    for a, b, _, d in chains():
        if d:
            twice.setdefault(b, []).append(d)
        else:
            once.setdefault(a, []).append(b)
    return once, list(twice.items())


def forms(word: str) -> dict[str, str]:
    """Garbled forms of a word with the first chain that makes each; the word itself is none."""
    once, twice = _by_true()
    made: list[tuple[str, str]] = []
    for true, wrongs in once.items():
        raw = encoded(word, true)
        if raw is not None:
            made += [(_decoded(raw, wrong), f"{true}>{wrong}") for wrong in wrongs]
    raw = word.encode("utf-8", "replace")
    for first, seconds in twice:
        again = _decoded(raw, first).encode("utf-8")
        made += [(_decoded(again, second), f"utf-8>{first}>utf-8>{second}") for second in seconds]
    found: dict[str, str] = {}
    for g, chain in made:
        if g != word and not g.isascii():
            found.setdefault(g, chain)
    return found


def pieces(found: dict[str, str]) -> list[tuple[str, str]]:
    """(token, chain) of all forms; one with ASCII breaks (East Asian second bytes) gives its longer parts, their chain marked."""
    out = []
    for g, c in found.items():
        if not re.search(BREAKS, g):
            out.append((g, c))
        else:
            out += [(x, c + PART) for x in re.split(BREAKS, g) if len(re.sub(r"[\x00-\x7f]", "", x)) >= 4]
    return out


def by_characters(token: str, clean: frozenset[str]) -> tuple[str, str] | None:
    """(restored, chain) if every run of non-ASCII characters in the token is made up of garbled forms of clean characters.

    clean: the characters the corpus' clean words are written in. UTF-8 gives each such character two to four bytes, so
    their forms cannot overlap and reading the run back tells the only way to cut it into forms.
    """
    for wrong in SINGLE_BYTE:
        out, at, ok = [], 0, False
        for m in _RUN.finditer(token):
            back = reread(m[0], "utf-8", wrong)
            if back is None or not set(back) <= clean:
                if back is not None and (again := reread(back, "utf-8", wrong)) is not None and set(again) <= clean:
                    back = again
                else:
                    ok = False
                    break
            out += [token[at : m.start()], back]
            at, ok = m.end(), True
        if ok:
            return "".join(out) + token[at:], f"utf-8>{wrong}"
    return None


def read_parts(run: str, true: str, wrong: str) -> str:
    """run, read with `wrong`, read again as `true`; characters that cannot be part of it stay."""
    single = wrong in SINGLE_BYTE
    out, raw, chars = [], bytearray(), []

    def flush() -> None:
        at = 0
        while at < len(raw):
            try:
                out.append(raw[at:].decode(true))
                break
            except UnicodeDecodeError as e:
                out.append(raw[at : at + e.start].decode(true))
                # the characters of the bytes that fit nowhere; of a two-byte character the first byte stands for it
                out.extend(c for c in chars[at + e.start : at + e.end])
                at += e.end
        raw.clear(), chars.clear()

    up = _bytes_of(wrong) if single else {}
    for c in run:
        if single:
            own = up.get(c, b"")
        else:
            own = c.encode(wrong, "ignore")
        if own:
            raw += own
            chars += [c] + [""] * (len(own) - 1)
        else:
            flush()
            out.append(c)
    flush()
    return "".join(out)


def grams(text: str) -> set[str]:
    """Pairs of neighbouring East Asian characters, the words of scripts that set none apart."""
    return {m[0][i : i + 2] for m in _WIDE.finditer(text) for i in range(len(m[0]) - 1)}


def readings(run: str) -> list[tuple[str, str]]:
    """(chain, text) of all ways to read a run again that give East Asian pairs: from single bytes, and between East Asian encodings and UTF-8."""
    if _WIDE.match(run):
        ways = [(t, w) for w in EAST_ASIAN for t in ("utf-8", *EAST_ASIAN) if t != w]
    else:
        ways = [(t, w) for t in EAST_ASIAN for w in SINGLE_BYTE]
    found: dict[tuple[str, str], str] = {}
    raws: dict[str, bytes] = {}
    for t, w in ways:
        if w in LATIN or len(run) >= 8 or t == "utf-8":
            if w not in raws:
                raws[w] = codecs.charmap_encode(run, "replace", _table(w)[1])[0] if w in SINGLE_BYTE else run.encode(w, "replace")
            # what read_parts() decodes is in here as well, so most ways end before it
            if not _PAIR.search(raws[w].decode(t, "replace")):
                continue
            text = read_parts(run, t, w)
            if text != run and grams(text):
                found.setdefault((t, text), w)
    return [(f"{t}>{w}{RUN}", text) for (t, text), w in found.items()]


def damaged(token: str) -> bool:
    """Replacement or C1 control characters, which no rightly decoded text holds."""
    return _DAMAGE.search(token) is not None


def _forms_of(batches: Iterator[pa.RecordBatch], clean: frozenset[str]) -> Iterator[pa.RecordBatch]:
    """Words (token, n) -> a row per garbled form of each clean one: neither damaged nor itself made up of garbled characters."""
    for batch in batches:
        words, counts = batch.column("token").to_pylist(), batch.column("n").to_pylist()
        for i in range(0, len(words), 2000):
            rows = [(g, w, n, c) for w, n in zip(words[i : i + 2000], counts[i : i + 2000]) if not damaged(w) and by_characters(w, clean) is None for g, c in pieces(forms(w))]
            columns = list(zip(*rows)) or [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int64(), pa.string()))], names=["token", "word", "word_n", "chain"])


TOKEN, WAY, GRAM = 0, 1, 2  # kinds of rows of _found


def _left_open(text: str, at: int, stop: int) -> int:
    """Where the letters and digits of ASCII begin that stand right before a place."""
    while at > stop and text[at - 1].isascii() and text[at - 1].isalnum():
        at -= 1
    return at


def tokens_of(text: str) -> set[str]:
    """The distinct runs of ASCII letters, digits and non-ASCII characters that hold a non-ASCII character."""
    found, stop = set(), 0
    for m in _FROM.finditer(text):
        found.add(text[_left_open(text, m.start(), stop) : m.end()])
        stop = m.end()
    return found


def runs_of(text: str) -> set[str]:
    """The distinct runs that East Asian bytes can have left, or be: two characters of such a script, or four of single bytes of which two are no ASCII."""
    found = set()
    for m in _RUNS.finditer(text):
        r = m[0]
        if len(r) > 1 and (_WIDE.match(r) or len(r) > 3 and sum(not c.isascii() for c in r) > 1):
            found.add(r)
    return found


def _found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts (id, field, text) -> their tokens and runs (a row each: id, field, kind, token), and for each pair of East Asian characters in how
    many texts of the batch it stands (kind, token, n)."""
    for batch in batches:
        at, kinds, out, pairs = [], [], [], Counter()
        for i, t in enumerate(batch.column("text").to_pylist()):
            here = tokens_of(t)
            runs = runs_of(t)
            at += [i] * (len(here) + len(runs))
            kinds += [TOKEN] * len(here) + [WAY] * len(runs)
            out += here
            out += runs
            pairs.update(grams(t))
        where = pa.array(at + [None] * len(pairs), pa.int32())
        columns = [batch.column(c).take(where) for c in ("id", "field")]
        columns += [pa.array(kinds + [GRAM] * len(pairs), pa.int32()), pa.array(out + list(pairs), pa.string()), pa.array([1] * len(at) + list(pairs.values()), pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, names=["id", "field", "kind", "token", "n"])


def _readings_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [(r, c, t, sorted(grams(t))) for r in batch.column("run").to_pylist() for c, t in readings(r)]
        columns = list(zip(*rows)) or [[], [], [], []]
        kinds = (pa.string(), pa.string(), pa.string(), pa.list_(pa.string()))
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["run", "chain", "text", "grams"])


def _judge(batches: Iterator[pa.RecordBatch], clean: frozenset[str]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for t in batch.column("token").to_pylist():
            back = by_characters(t, clean)
            if back is not None:
                rows.append((t, back[0], back[1], "read back"))
            elif damaged(t):
                rows.append((t, None, "lost", "damaged"))
        columns = list(zip(*rows)) or [[], [], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], names=["token", "word", "chain", "how"])


class Garbled:
    """Finds the text fields that were decoded wrongly, wholly or in part, and restores what can be.

    docs: a row per record; id names the key and fields the text columns, other columns are ignored. NULL, empty and pure
    ASCII fields are never garbled (ASCII bytes read alike under all the encodings).

    Tokens are the runs of letters, digits and non-ASCII characters that hold a non-ASCII character. Each distinct token
    without damage, and not made up of garbled characters, is a clean word: its garbled forms under all chains are generated and
    hash-joined with the tokens. A token is garbled if a clean word has it as a form; for chains from UTF-8, whose forms take two
    characters or more for one and are nothing else, that is all, for others the word must be `ratio` times as frequent. Of
    several words the most frequent one is the original (how = form). Only tokens that no clean word covers are then
    read back by characters, for chains from UTF-8 (how = read back). What is left with replacement or C1 control characters is damage, whose
    original is lost (how = damaged). Only distinct tokens are ever joined; their number follows the vocabulary.

    East Asian texts set no words apart, so a token would be a sentence that hardly stands anywhere else. Their words are pairs of
    neighbouring characters: each distinct run that can come of East Asian bytes is read again under all chains and its pairs are
    joined with those of the corpus. A pair speaks for a reading if it stands in `ratio` times as many fields as are read so; a
    reading is believed if at least half of its pairs speak for it, and `evidence` of them where the run as it stands
    could be words of another script (how = pairs). Of several readings the one with the most occurrences of such pairs is the original.
    """

    def __init__(self, docs: DataFrame, id: str = "item_id", fields: tuple[str, ...] = ("content", "name"), ratio: float = 3.0, char_share: float = 1e-4, evidence: int = 4):
        self.ratio, self.char_share, self.fields, self.evidence = ratio, char_share, fields, evidence
        long = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("text")) for f in fields]))
        self.texts = docs.select(F.col(id).alias("id"), long.alias("x")).select("id", "x.field", "x.text").where(F.col("text").rlike(NOT_ASCII))

    @cached_property
    def pieces(self) -> DataFrame:
        """Tokens, runs and pairs of all fields, made in one pass over the texts."""
        kind = self.texts.schema["id"].dataType.simpleString()
        return cut(self.texts.mapInArrow(_found, f"id {kind}, field string, kind int, token string, n bigint"))

    def tokens(self) -> DataFrame:
        """id, field, token: the distinct non-ASCII tokens of each field."""
        return self.pieces.where(F.col("kind") == TOKEN).select("id", "field", "token")

    def originals(self, tokens: DataFrame) -> DataFrame:
        """token, word, chain, how of every garbled token; word is NULL where it is lost."""
        # spread by the session's number of partitions, not by bytes: the words are few and the work on each is much
        vocabulary = cut(tokens.groupBy("token").agg(F.count("*").alias("n")), partitioned=True)
        total = F.sum("n")
        # characters: how many tokens they occur in, and how many of them are damaged or look like read from UTF-8
        letters = vocabulary.select("n", F.explode(F.array_distinct(F.split(F.regexp_replace("token", r"[\x00-\x7F]", ""), ""))).alias("c")).where("c != ''")
        rows = letters.groupBy("c").agg(total.alias("n")).toLocalIterator()  # bounded by the characters of Unicode
        clean = clean_characters({r["c"]: r["n"] for r in rows}, self.char_share)
        table = vocabulary.mapInArrow(lambda it: _forms_of(it, clean), "token string, word string, word_n bigint, chain string")
        enough = F.when(F.col("chain").startswith("utf-8>"), 1.0).otherwise(self.ratio)
        hit = table.join(vocabulary, "token").where((F.col("word_n") >= enough * F.col("n")) & (F.char_length("token") > 1))
        best = F.max(F.struct("word_n", "word", "chain")).alias("w")
        by_form = cut(hit.groupBy("token").agg(best).select("token", "w.word", "w.chain", F.lit("form").alias("how")))
        rest = vocabulary.select("token").mapInArrow(lambda it: _judge(it, clean), "token string, word string, chain string, how string")
        return by_form.unionByName(rest.join(by_form.select("token"), "token", "left_anti"))

    def runs(self) -> DataFrame:
        """id, field, token, word, chain, how of every run of East Asian text that was read wrongly; its chain is marked."""
        runs = self.pieces.where(F.col("kind") == WAY).select("id", "field", F.col("token").alias("run"))
        ways = cut(runs.select("run").distinct(), partitioned=True)
        read = cut(ways.mapInArrow(_readings_of, "run string, chain string, text string, grams array<string>"))
        clean = self.pieces.where(F.col("kind") == GRAM).groupBy(F.col("token").alias("gram")).agg(F.sum("n").alias("clean_n"))
        known = cut(read.select("run", "chain", F.explode("grams").alias("gram")).join(clean, "gram"))
        own = known.join(runs, "run").select("id", "field", "chain", "gram").distinct().groupBy("chain", "gram").agg(F.count("*").alias("n"))
        speak = known.join(own, ["chain", "gram"]).where(F.col("clean_n") >= self.ratio * F.col("n"))
        votes = speak.groupBy("run", "chain").agg(F.count("*").alias("votes"), F.sum("clean_n").alias("weight"))
        latin = F.regexp_extract("chain", f">(.*){RUN}$", 1).isin(*LATIN)
        held = votes.join(read, ["run", "chain"]).where((2 * F.col("votes") >= F.size("grams")) & (latin | (F.col("votes") >= self.evidence)))
        best = held.groupBy("run").agg(F.max(F.struct("weight", "votes", "text", "chain")).alias("w"))
        return runs.join(best, "run").select("id", "field", F.col("run").alias("token"), F.col("w.text").alias("word"), "w.chain", F.lit("pairs").alias("how"))

    def found(self) -> DataFrame:
        """id, field, tokens (array of token, word, chain, how) of every field with a garbled token or run."""
        tokens = self.tokens()
        garbled = cut(self.originals(tokens))
        every = tokens.join(garbled, "token").select("id", "field", "token", "word", "chain", "how").unionByName(self.runs())
        return every.groupBy("id", "field").agg(F.array_sort(F.collect_list(F.struct("token", "word", "chain", "how"))).alias("tokens"))

    def restored(self) -> DataFrame:
        """id, field, text, restored: the fields found, with each garbled token replaced by its original (what is lost stays)."""
        found = self.found().select(F.col("id").alias("i"), F.col("field").alias("f"), "tokens")
        joined = self.texts.join(found, (F.col("id") == F.col("i")) & (F.col("field") == F.col("f")))
        return joined.select("id", "field", "text", _substitute(F.col("text"), F.col("tokens")).alias("restored"))


def _substitute(text: Column, tokens: Column) -> Column:
    @F.udf("string", useArrow=True)
    def replace(text: str, tokens: list) -> str:
        runs = {t["token"]: t["word"] for t in tokens if t["chain"].endswith(RUN)}
        if runs:
            ways = Counter(t["chain"].removesuffix(RUN) for t in tokens if t["chain"].endswith(RUN))
            chain = max(ways, key=lambda c: (ways[c], c)).split(">")

            def read(m: re.Match) -> str:
                # a single character between digits or the like has no pair to speak for it and follows the others of its field
                if m[0] in runs or len(m[0]) != 2 or _WIDE.match(m[0]):
                    return runs.get(m[0], m[0])
                one = read_parts(m[0], *chain)
                return one if len(one) == 1 and _WIDE.match(one) else m[0]

            text = _RUNS.sub(read, text)
        known = {t["token"]: t["word"] for t in tokens if t["word"] is not None and not t["chain"].endswith((PART, RUN))}
        return re.sub(r"(?:[0-9A-Za-z]|[^\x00-\x7f])+", lambda m: known.get(m[0], m[0]), text)

    return replace(text, tokens)


def clean_characters(counts: dict[str, int], share: float) -> frozenset[str]:
    """The characters clean words are written in: letters of any script, and other characters of at least `share` of all
    occurrences that read-back does not make of more frequent ones."""
    total = sum(counts.values()) or 1
    kept = {c for c, n in counts.items() if not damaged(c) and (c.isalpha() or n >= share * total)}
    common = {"“", "”", "‘", "’", "«", "»", "–", "—", "…", "¿", "¡", "•", "€", "°", "§", "©", "®", "™", "\xa0", "‐", "¬"}  # fixed values: usual signs of text
    return frozenset(kept | common)
