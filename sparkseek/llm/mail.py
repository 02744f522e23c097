"""The text newly written in an e-mail: blocks classified by gradient-boosted trees."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkseek.llm.sampling import labelled
from sparkseek.llm.trees import Boosted, fit_boosted
from sparkseek.session import cut

_SPACE = " \t\r\xa0  ​　﻿"
_QUOTE = re.compile(r"^\s*((?:[>|]\s?)+)")
_ADDRESS = re.compile(r"[\w.+-]+@[\w-]+\.[\w.-]+")
_CONTACT = re.compile(r"[\w.+-]+@[\w-]+\.\w|\+\d\d|\bwww\.|https?://|\b(?:tel|fax|mobile|phone|tél|móvil|telefon)\b", re.I)
_DATE = re.compile(r"\d{1,4}[-./]\d{1,2}[-./]\d{1,4}|\b\d{1,2}\.? [^\W\d]{3,9}\.? \d{4}\b|\b[^\W\d]{3,9} \d{1,2}, \d{4}\b")
_WORD = re.compile(r"[^\W_]+")
# Words of mail programs and of letters, in the languages mails come in.
_WROTE = re.compile(r"\b(?:wrote|writes|schrieb|a écrit|escribió|ha scritto|escreveu|napisał|napisała|пишет|написал|написала)\b", re.I)
_HEAD = re.compile(
    r"^\*?(?:from|sent|to|cc|bcc|subject|date|reply-to|von|gesendet|an|betreff|datum|de|envoyé|envoyée|à|objet|date|enviado|para|asunto|fecha|da|inviato|a|oggetto|data|od|wysłano|do|temat|от|кому|тема|дата|отправлено)\s?:\*?(?:\s|$)",
    re.I,
)
_ORIGINAL = re.compile(
    r"^\s*(?:-{2,}|_{5,}|={5,})\s*(?:original|ursprüngliche|message d|mensaje|forwarded|weitergeleitete|début|inicio|message transféré|messaggio|wiadomość|mensagem|исходное|original-)[^-_=]*(?:-{2,}|_{5,}|={5,})?\s*$"
    r"|^\s*(?:begin forwarded message|anfang der weitergeleiteten (?:e-mail|nachricht)|début du message (?:réexpédié|transféré)|inicio del mensaje reenviado|inizio messaggio inoltrato)\s*:?\s*$",
    re.I,
)
_RULE = re.compile(r"^(?:_{2,}|-{2,}|={2,}|\*{2,}|(?:- ){2,}-?|—+)$")
CLOSINGS = (
    "best", "best regards", "kind regards", "regards", "warm regards", "best wishes", "yours sincerely", "sincerely", "yours faithfully", "yours truly", "cheers",
    "thanks", "many thanks", "thank you", "thanks in advance", "all the best",
    "mfg", "vg", "lg", "viele grüße", "viele grüsse", "beste grüße", "liebe grüße", "schöne grüße", "grüße", "gruß", "mit freundlichen grüßen", "mit besten grüßen", "freundliche grüße", "danke", "vielen dank", "besten dank",
    "cordialement", "bien cordialement", "bien à vous", "merci", "merci d'avance", "salutations", "sincères salutations", "amicalement", "meilleures salutations",
    "un saludo", "saludos", "saludos cordiales", "un cordial saludo", "gracias", "muchas gracias", "atentamente", "gracias de antemano",
    "amitiés", "bonne journée", "à bientôt", "take care", "respectfully", "herzliche grüße", "bis bald", "hasta pronto", "un abrazo", "abrazos",
    "cordiali saluti", "saluti", "grazie", "atenciosamente", "obrigado", "obrigada", "pozdrawiam", "dziękuję", "с уважением", "спасибо",
)
_CLOSINGS = frozenset(c.casefold() for c in CLOSINGS)
_DEVICE = re.compile(r"^(?:sent (?:from|with|via)|get outlook|gesendet (?:von|mit)|von meinem|diese nachricht wurde von|envoyé (?:de|depuis)|enviado (?:desde|con)|inviato da)\b", re.I)
_NAME = re.compile(r"^(?:[A-ZÀ-ÖØ-Þ][^\W\d_]+[.,]?\s*){1,4}$")


def _fixed(text: str) -> str:
    """text with UTF-8 that was read as Windows-1252 undone, where that is possible, so that letter words are known again."""
    try:
        return text.encode("cp1252").decode("utf-8")
    except UnicodeError:
        return text


def _bare(text: str) -> str:
    return _fixed(text).replace("’", "'").strip(" ,.;:!–-").casefold()


@dataclass
class Line:
    no: int
    depth: int
    text: str


def read_lines(text: str) -> list[Line]:
    """Lines that are not empty, numbered from 1, with their quote marks counted and taken off."""
    out = []
    for i, raw in enumerate(text.split("\n"), 1):
        m = _QUOTE.match(raw)
        depth = len(re.sub(r"\s", "", m[1])) if m else 0
        t = (raw[m.end() :] if m else raw).strip(_SPACE)
        if t or depth:
            out.append(Line(i, depth, t))
    return out


KINDS = ("quoted", "intro", "header", "original", "rule", "closing", "device", "text")


def kinds(lines: Sequence[Line]) -> list[str]:
    """What each line looks like by itself (and its neighbour, for an introduction broken over two or three lines)."""
    out = []
    for i, x in enumerate(lines):
        t = x.text
        out.append(
            "quoted" if x.depth else "original" if _ORIGINAL.match(t) else "header" if _HEAD.match(_fixed(t)) and len(t) < 200 else "rule" if _RULE.match(t)
            else "intro" if _introduces(t) else "closing" if _bare(t) in _CLOSINGS else "device" if _DEVICE.match(_fixed(t)) and len(t) < 80 else "text"
        )
    for i, x in enumerate(lines):
        # an introduction whose verb or address went to the next line
        for n in (2, 3):
            part = lines[i : i + n]
            if len(part) == n and all(k == "text" for k in out[i : i + n]) and part[-1].no - x.no == n - 1 and len(part[-1].text) < 60 and not part[0].text.endswith((".", "!", "?")):
                if _introduces(" ".join(p.text for p in part)) and (_DATE.search(x.text) or _ADDRESS.search(part[0].text + part[1].text)):
                    out[i : i + n] = ["intro"] * n
    for i in range(1, len(lines) - 1):
        # an unknown closing: a few words after an empty line and some text, then a name, and nothing but short lines up to the next part
        t, after = lines[i].text, lines[i + 1]
        if out[i] == "text" and lines[i].no - lines[i - 1].no > 1 and out[i - 1] == "text" and len(_WORD.findall(t)) <= 4 and not t.endswith((".", "!", "?", ":", ";")) and not any(map(str.isdigit, t)):
            if out[i + 1] == "text" and _NAME.match(after.text) and t.count(" ") <= 3 and len(t) < 40:
                end = next((j for j in range(i + 1, len(out)) if out[j] != "text"), len(out))
                if all(len(x.text) < 60 or x.text[0] in "“\"„«" for x in lines[i + 1 : end]) and end - i < 9:
                    out[i] = "closing"
    for i, k in enumerate(out):
        # one header field alone is a sentence that happens to begin like one
        if k == "header" and not any(0 <= j < len(out) and out[j] == "header" and abs(lines[j].no - lines[i].no) <= 2 for j in (i - 1, i + 1)):
            out[i] = "text"
    return out


def _introduces(t: str) -> bool:
    t = _fixed(t)
    if not t.endswith(":") or len(t) > 220 or not _WROTE.search(t):
        return False
    return _DATE.search(t) is not None or _ADDRESS.search(t) is not None


@dataclass
class Block:
    lines: list[int]  # indices into the lines
    kind: str
    gap: bool


def blocks(lines: Sequence[Line], ks: Sequence[str]) -> list[Block]:
    """Paragraphs: runs of lines of one kind with no empty line between; each closing, rule and introduction stands alone."""
    out: list[Block] = []
    for i, (x, k) in enumerate(zip(lines, ks)):
        gap = i == 0 or x.no - lines[i - 1].no > 1
        if out and not gap and k == out[-1].kind and k in ("quoted", "header", "text") and not (k == "text" and _alone(x.text, lines[i - 1].text)):
            out[-1].lines.append(i)
        else:
            out.append(Block([i], k, gap))
    return out


def _alone(text: str, before: str) -> bool:
    """Lines a signature or note is made of are judged one by one: names, contacts, short lines without an end."""
    if len(before) >= 40 and text.endswith(".") and not before.endswith((".", "!", "?", ":")):
        return False  # the last words of a wrapped paragraph
    return _CONTACT.search(text) is not None or _NAME.match(text) is not None or len(before) < 40 or before.endswith((".", "!", "?", ":", ","))


FEATURES = 27


def features(lines: Sequence[Line], ks: Sequence[str], bs: Sequence[Block], often: Sequence[int], by_sender: Sequence[int], ancestors: Sequence[float]) -> np.ndarray:
    """One row per block: contact density, quote depth, how often its lines recur with the sender and in all mails, overlap with earlier
    mails of the thread, and what stands before and after it."""
    x = np.zeros((len(bs), FEATURES))
    closed = ruled = original = False
    body = 0
    after_quote = 0.0
    told = False  # something introduced an earlier message and none of it was marked since
    marks = any(b.kind == "quoted" for b in bs)
    for n, b in enumerate(bs):
        k = b.kind
        if k == "original" or k == "header":
            original = True
        if k in ("quoted", "intro"):
            closed = ruled = False
            after_quote = 1.0
        texts = [lines[i].text for i in b.lines]
        joined = " ".join(texts)
        w = len(_WORD.findall(joined))
        caps = sum(t[:1].isupper() for t in joined.split())
        nxt = bs[n + 1].kind if n + 1 < len(bs) else "end"
        x[n] = (
            KINDS.index(k) if k != "text" else 7, max(lines[i].depth for i in b.lines), original, closed, ruled,
            len(_CONTACT.findall(joined)) / (w + 1), caps / (w + 1), min(w, 40), joined.endswith((".", "!", "?", "”", "\"")), _NAME.match(joined) is not None,
            np.log1p(max(often[i] for i in b.lines)), np.log1p(max(by_sender[i] for i in b.lines)), max(ancestors[i] for i in b.lines), (n + 1) / len(bs), body > 0,
            nxt in ("closing", "rule", "end"), nxt in ("original", "header", "intro"), after_quote, joined.endswith(","), b.gap, sum(ch.isdigit() for ch in joined) / (len(joined) + 1), len(b.lines),
            told, marks, bs[n - 1].kind == "quoted" if n else False, bs[n - 1].kind in ("closing", "rule", "device") if n else False, len(joined) / len(b.lines),
        )
        if k in ("intro", "header", "original"):
            told = True
        elif k == "quoted":
            told = False
        if k == "closing":
            closed = True
        if k == "rule" or k == "device":
            ruled = True
        if k == "text" and not (closed or ruled or original):
            body += 1
    return x


def line_labels(lines: Sequence[Line], ks: Sequence[str]) -> list[int]:
    """1 new, 0 not, -1 not sure, of each line, by the forms of mail: quote marks and what introduces a message, known closings, rules.

    Not sure is what follows an introduction without marks, and a lone name or contact that no closing introduces with all that comes after it.
    """
    out, closed, ruled, original, told, lone = [], False, False, False, False, False
    for i, (x, k) in enumerate(zip(lines, ks)):
        if k in ("original", "header"):
            original = True
        if k in ("quoted", "intro"):
            closed = ruled = lone = False
        told = k == "intro" or told and k != "quoted"
        new = k == "text" and not (original or closed or ruled)
        lone = lone or new and (_CONTACT.search(x.text) is not None or _NAME.match(x.text) is not None and i > 0 and not x.text.endswith((",", ".")))
        out.append(-1 if new and (told or lone) else int(new))
        closed = closed or k == "closing"
        ruled = ruled or k in ("rule", "device")
    return out


@dataclass
class Known:
    """A line with its label and what was counted of it."""

    line: Line
    label: int
    often: int
    by_sender: int
    ancestor: float


def views(known: Sequence[Known], ks: Sequence[str]) -> Iterator[list[Known]]:
    """A mail as it stands, and as it would be without one kind of the evidence that its labels rest on.

    Labels are taken from the forms of mail, so a classifier that always sees those forms could only repeat them. In the other views the evidence is taken
    away and the labels stay: quote marks, where something else introduces the earlier message and nothing new follows; the lines
    that introduce it, where its text is marked; closings; rules and device lines. So contact density, frequency with the sender and in all mails,
    overlap with ancestors and the neighbourhood must decide there.
    """
    yield list(known)
    quoted = [i for i, k in enumerate(ks) if k == "quoted"]
    told = [i for i, k in enumerate(ks) if k in ("intro", "header", "original")]
    if quoted and told and told[0] < quoted[0] and not any(x.label == 1 for x in known[quoted[0] :]):
        yield [Known(Line(x.line.no, 0, x.line.text), *_rest(x)) for x in known if x.line.text]
    if quoted and told and all(x.line.depth or i in told or x.label for i, x in enumerate(known)):
        yield [x for i, x in enumerate(known) if i not in told]
    for gone in (("closing",), ("rule", "device"), ("closing", "rule", "device")):
        if any(k in gone for k in ks):
            yield [x for x, k in zip(known, ks) if k not in gone]


def _rest(x: Known) -> tuple[int, int, int, float]:
    return x.label, x.often, x.by_sender, x.ancestor


def labelled_blocks(text: str, stats: list | None) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of the blocks of all views of a mail; -1 where the lines of a block are not sure or do not agree."""
    ls = read_lines(text)
    ks = kinds(ls)
    counted = _counted(len(ls), stats)
    known = [Known(x, y, *c) for x, y, c in zip(ls, line_labels(ls, ks), zip(*counted))]
    xs, ys = [], []
    for view in views(known, ks):
        lines = [v.line for v in view]
        seen = kinds(lines)
        bs = blocks(lines, seen)
        xs.append(features(lines, seen, bs, [v.often for v in view], [v.by_sender for v in view], [v.ancestor for v in view]))
        for b in bs:
            labels = {view[i].label for i in b.lines}
            ys.append(labels.pop() if len(labels) == 1 else -1)
    return np.concatenate(xs), np.array(ys)


def thread_of(subject: str | None) -> str:
    return re.sub(r"^(?:\s*(?:re|aw|fwd?|wg|tr|rv|antw|sv)\s*:\s*)+", "", subject or "", flags=re.I).strip().casefold()


def sender_of(lines: Sequence[Line], ks: Sequence[str]) -> str:
    """The name the sender signs with: the first name-like line after a closing or a rule."""
    for i, k in enumerate(ks):
        if k in ("closing", "rule"):
            for j in range(i + 1, min(i + 3, len(ks))):
                if ks[j] == "text" and _NAME.match(lines[j].text):
                    return lines[j].text.strip(" ,").casefold()
    return ""


def _hash(t: str) -> int:
    return xxhash.xxh3_64_intdigest(t.casefold().encode("utf-8", "surrogatepass")) - 2**63


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for text, subject in zip(batch.column("text").to_pylist(), batch.column("subject").to_pylist()):
            ls = read_lines(text)
            ks = kinds(ls)
            rows.append((_hash(thread_of(subject)), _hash(sender_of(ls, ks)), _hash(text), [_hash(x.text) for x in ls]))
        thread, sender, body, keys = (list(c) for c in zip(*rows)) if rows else ([], [], [], [])
        arrays = [batch.column("id"), batch.column("at"), *(pa.array(c, pa.int64()) for c in (thread, sender, body)), pa.array(keys, pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(arrays, names=["id", "at", "thread", "sender", "body", "keys"])


def _counted(n: int, stats: list | None) -> tuple[list, list, list]:
    """often, by_sender and ancestor of n lines."""
    known = {s["n"]: s for s in stats or ()}
    pick = lambda k, d: [known[i][k] if i in known else d for i in range(n)]
    return pick("often", 1), pick("by_sender", 1), pick("ancestor", 0.0)


def _rows(text: str, stats: list | None) -> tuple[list[Line], list[Block], np.ndarray]:
    ls = read_lines(text)
    ks = kinds(ls)
    bs = blocks(ls, ks)
    return ls, bs, features(ls, ks, bs, *_counted(len(ls), stats))


def _new_text(batches: Iterator[pa.RecordBatch], model: Boosted) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, numbers = [], []
        pages = [(r["id"], *_rows(r["text"], r["stats"])) for r in batch.to_pylist()]
        full = [p for p in pages if len(p[2])]
        if full:
            score = model.predict(np.concatenate([p[3] for p in full]))
            at = 0
            for i, ls, bs, x in full:
                for b, s in zip(bs, score[at : at + len(bs)]):
                    if s > 0:
                        for j in b.lines:
                            if any(map(str.isalnum, ls[j].text)):
                                ids.append(i)
                                numbers.append(ls[j].no)
                at += len(bs)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(numbers, pa.int32())], names=["id", "line_no"])


class NewText:
    """The lines of each mail that its sender newly wrote.

    docs: id, text (falling back to another column where NULL), subject and time columns; other columns are ignored. Lines count
    from 1 and split at \\n only. NULL and empty texts have none. Each mail is cut into blocks; gradient-boosted trees, fitted on about
    `sample` mails (an even sample by hash of the id) with and without the evidence their labels come from (see views), classify them. How many mails hold a line, how many of them by the
    same sender, and whether an earlier mail of the thread held it, is counted over all mails; mails of equal text count
    as one there, so a mail sent again is no ancestor of itself.
    """

    def __init__(self, docs: DataFrame, id: str = "item_id", text: str = "content", fallback: str = "preview", subject: str = "name", time: str = "received_at", sample: int = 800):
        self.sample = sample
        self.docs = docs.select(F.col(id).alias("id"), F.coalesce(F.col(text), F.col(fallback)).alias("text"), F.col(subject).alias("subject"), F.col(time).alias("at"))
        self.docs = self.docs.where(F.col("text").isNotNull() & (F.col("text") != ""))

    def mails(self) -> DataFrame:
        """id, text and stats of its lines: n (index of the line), often, by_sender, ancestor."""
        keyed = cut(self.docs.mapInArrow(_keys, f"id bigint, at {self.docs.schema['at'].dataType.simpleString()}, thread bigint, sender bigint, body bigint, keys array<bigint>"))
        lines = keyed.groupBy("body").agg(F.min_by(F.struct("thread", "sender", "at", "keys"), F.struct("at", "id")).alias("m"))
        lines = lines.select("m.thread", "m.sender", "m.at", F.explode(F.array_distinct("m.keys")).alias("key"))
        often = lines.groupBy("key").agg(F.count("*").alias("often")).where("often > 1")
        by_sender = lines.groupBy("sender", "key").agg(F.count("*").alias("by_sender")).where("by_sender > 1")
        first = lines.groupBy("thread", "key").agg(F.min("at").alias("first"), F.count("*").alias("n_thread")).where("n_thread > 1")
        at = keyed.select("id", "thread", "sender", "at", F.posexplode("keys").alias("n", "key"))
        stats = at.join(often, "key").join(by_sender, ["sender", "key"], "left").join(first, ["thread", "key"], "left")
        ancestor = F.when(F.col("first") < F.col("at"), 1.0).otherwise(0.0)
        stats = stats.groupBy("id").agg(
            F.collect_list(F.struct("n", "often", F.coalesce("by_sender", F.lit(1)).alias("by_sender"), ancestor.alias("ancestor"))).alias("stats")
        )
        return self.docs.select("id", "text").join(stats, "id", "left")

    def model(self, mails: DataFrame, most_blocks: int = 200_000) -> Boosted:
        """Trees from the labelled views of about `sample` mails, as far as they have most_blocks blocks."""
        return fit_boosted(*labelled(mails, lambda r: labelled_blocks(r["text"], r["stats"]), self.sample, most_blocks), trees=40)

    def lines(self) -> DataFrame:
        """id, line_no of every new line with a letter or digit."""
        mails = cut(self.mails())
        model = self.model(mails)
        return mails.mapInArrow(lambda it: _new_text(it, model), "id bigint, line_no int")
