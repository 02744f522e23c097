"""The operators on pages, mails, scans and garbled text."""

import datetime as dt
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sparkseek.llm import boilerplate, encodings, mail, ocr
from sparkseek.llm.trees import fit_boosted

NOUNS = "ledger harbour orchard printer museum valve tenant curtain bracket folder".split()
ITEM = "item_id bigint, parent_path string, name string, content string, preview string, received_at timestamp_ntz, text string, id int, stats string"


def items(spark, rows):
    """(id, path, name, content, preview); extra columns clash with the operators' own."""
    return spark.createDataFrame([(*r, None, "clash", 7, "clash") for r in rows], ITEM)


# minimum cut


def energy(cost, edges, label):
    own = sum(-c if c < 0 and x else c if c > 0 and not x else 0 for c, x in zip(cost, label))
    return own + sum(w for (i, j), w in edges.items() if label[i] != label[j])


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(-6, 6), min_size=1, max_size=8), st.randoms(use_true_random=False))
def test_min_cut_is_minimal(cost, r):
    edges = {(i, j): r.randrange(0, 5) for i in range(len(cost)) for j in range(i + 1, len(cost)) if r.random() < 0.6}
    best = min(energy(cost, edges, [bool(m >> i & 1) for i in range(len(cost))]) for m in range(1 << len(cost)))
    assert energy(cost, edges, boilerplate.min_cut(cost, edges)) == best


def page(r, title):
    menu = ["Services", "Help", "Gallery", "Downloads"]
    body = [f"The {r.choice(NOUNS)} of {r.randrange(999)} was moved between the {r.choice(NOUNS)} and the {r.choice(NOUNS)} before noon." for _ in range(5)]
    foot = ["Most read", f"Quiet {r.choice(NOUNS)}, Abc", f"Damp {r.choice(NOUNS)}, Def", "© 2026 Example. All rights reserved.", "Terms of use | Privacy | Imprint"]
    lines = [*menu, "", title, "", *body, "", *foot]
    return "\n".join(lines), set(range(6, 7)) | set(range(8, 13))


def test_main_content(spark):
    r = random.Random(1)
    pages, truth = [], {}
    for i in range(60):
        text, keep = page(r, f"Title {i} of things")
        pages.append((i, f"web\\site{i % 4}.example", f"Title {i} of things", text, None))
        truth |= {(i, n): True for n in keep}
    pages += [(100, None, None, "", None), (101, "x", None, None, None), (102, "", "t", "\n\n \n", None), (103, "web\\one.example", "n", "Just a line.", None)]
    got = {(x["id"], x["line_no"]) for x in boilerplate.MainContent(items(spark, pages)).lines().collect() if x["id"] < 100}
    both = len(got & set(truth))
    assert both / len(truth) > 0.95 and both / len(got) > 0.95
    assert boilerplate.MainContent(items(spark, [])).lines().count() == 0


def test_units_undo_wrapping():
    text = "Head line\nThe quick brown fox jumps over the lazy dog and then\nruns.\n\nOther short text here and there is something that wraps\nagain."
    assert [(u.first, u.last) for u in boilerplate.units(text)] == [(1, 1), (2, 3), (5, 6)]


# mails


def letter(r, name):
    body = [f"The {r.choice(NOUNS)} was moved to the {r.choice(NOUNS)} and {r.randrange(99)} rows are listed." for _ in range(2)]
    quoted = [f"> The {r.choice(NOUNS)} is open." for _ in range(3)]
    lines = ["Hello Bob,", *body, "", "Best regards", name, "Tel. +00 12 3456", "", "On 2026-01-02, Bob wrote:", *quoted]
    return "\n".join(lines), {1, 2, 3}


def test_new_text(spark):
    r = random.Random(2)
    mails, truth = [], set()
    for i in range(60):
        text, keep = letter(r, r.choice(["Ann Abel", "Cid Dorn"]))
        mails.append((i, "gmail", f"Re: {i % 7}", None if i % 5 == 0 else text, text if i % 5 == 0 else "p"))
        truth |= {(i, n) for n in keep}
    mails += [(100, None, None, None, None), (101, None, None, "", ""), (102, None, None, "> only\r\n> quoted\r\n", None), (103, "g", "s", "word", None)]
    got = {(x["id"], x["line_no"]) for x in mail.NewText(items(spark, mails)).lines().collect()}
    assert {g for g in got if g[0] < 100} == truth
    assert not {g for g in got if g[0] in (100, 101, 102)}
    assert mail.NewText(items(spark, [])).lines().count() == 0


@pytest.mark.parametrize(
    "text, kinds",
    [
        ("On 2026-01-23, at 09:48, Ann <a@x.example>\nwrote:\n> hi", ["intro", "intro", "quoted"]),
        ("On Monday the scan of X wrote nothing to disk.", ["text"]),
        ("From what Ann told us, the plan is unchanged.", ["text"]),
        ("________________________________\nVon: A\nGesendet: 1.1.2026\n\nHallo", ["rule", "header", "header", "text"]),
        ("-----Original Message-----\nFrom: A\nSent: b", ["original", "header", "header"]),
        ("Best regards to the whole team as well.\n\nMit freundlichen Grüßen\nAnn", ["text", "closing", "text"]),
        ("Sent from my phone", ["device"]),
    ],
)
def test_kinds_of_lines(text, kinds):
    assert mail.kinds(mail.read_lines(text)) == kinds


def test_boosted_trees_on_held_out_rows():
    r = np.random.default_rng(1)
    x = r.normal(size=(3000, 6))
    y = ((x[:, 0] * x[:, 1] > 0) ^ (x[:, 2] > 1)).astype(int)
    model = fit_boosted(x[:2000], y[:2000])
    assert ((model.predict(x[2000:]) > 0) == y[2000:]).mean() > 0.9
    assert (fit_boosted(x[:5], np.ones(5)).predict(x) > 0).all() and len(fit_boosted(np.zeros((0, 6)), np.zeros(0)).predict(x)) == 3000


# scans


@settings(max_examples=40, deadline=None)
@given(st.lists(st.text("abcd", min_size=1, max_size=6), min_size=1, max_size=30), st.text("abcd", min_size=1, max_size=6), st.integers(0, 2))
def test_automaton_finds_all_within(vocabulary, word, most):
    trie = ocr.Trie((w, w) for w in set(vocabulary))

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    assert sorted(trie.within(word, most)) == sorted(w for w in set(vocabulary) if distance(word, w) <= most)
    assert all(ocr.near(word, w, most) == (distance(word, w) <= most) for w in vocabulary)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.text("abc", min_size=7, max_size=12), max_size=25, unique=True))
def test_alike_keys(keys):
    found = ocr._alike(keys)
    assert all(sorted(found.get(q, [])) == sorted(k for k in keys if k != q and ocr.near(q, k, 2)) for q in keys)


SCAN = """Quiet ledger, Abc
p. 12
The printer was moved between the harbour and the ledger before the mus-
eum had been listed. The va1ve of the tenant was moved before the cross-
border curtain was

p. 13    Quiet ledger, Abc
listed. The folder was moved before the bracket and the orcbard had been listed.
"""


def scans():
    r = random.Random(3)
    plain = "\n".join(f"The {r.choice(NOUNS)} was moved between the {r.choice(NOUNS)} and the {r.choice(NOUNS)} before the cross-border {r.choice(NOUNS)} had been listed of." for _ in range(300))
    return plain


def test_lookups_equal_trying_all_words(spark):
    r = random.Random(12)
    words = ["".join(r.choice("abrnmil") for _ in range(r.randrange(2, 8))) for _ in range(60)]
    changed = lambda w: (lambda i: w[:i] + r.choice(["", "x", r.choice("abrnmil") * 2]) + w[i + 1 :])(r.randrange(len(w)))
    counts = {w: r.choice([1, 2, 5, 12, 40, 700]) for w in words}
    for w in words:
        counts.setdefault(changed(w), r.choice([1, 2, 3, 11]))
    counts = {w: n for w, n in counts.items() if w}
    other = items(spark, [(i, None, None, " ".join([w] * n), None) for i, (w, n) in enumerate(counts.items())])
    scanned = ocr.ScannedText(items(spark, []), other=other)
    asked = [*counts, "zzzz", "q", *(changed(w) for w in words)]
    met = {}
    for w in set(asked):
        n = counts.get(w, 0)
        enough = n * 60 if n >= 3 else max(n, 1) * 10
        for kind in (0, 1):
            spelt = ocr._shape if kind else str
            if len(w) > (4 if kind else 2):
                met[w, kind] = [v for v, m in counts.items() if v != w and len(v) > 2 and m >= max(enough, 10) and ocr.near(spelt(w), spelt(v), 1) and (not kind or ocr.near(w, v, 3))]
    bad = {w for (w, _), vs in met.items() if vs and counts.get(w, 0) >= 10}
    expected = {}
    for w in set(asked):
        for kind in (0, 1):
            good = [v for v in met.get((w, kind), []) if v not in bad]
            if good and w not in expected:
                expected[w] = sorted(((counts[v], v) for v in good), reverse=True)
    got = scanned.near(spark.createDataFrame([(w,) for w in set(asked)], "word string")).collect()
    assert {x["word"]: x["n"] for x in got} == {w: counts.get(w, 0) for w in set(asked)}
    assert {x["word"]: [tuple(v) for v in x["near"]] for x in got if x["near"]} == expected and len(expected) > 30


def test_repaired_pages_are_the_planted_ones(spark):
    """Truth for the repair: pages are broken and misread, and must come back word for word."""
    r = random.Random(21)
    vocabulary = ["ledger", "harbour", "orchard", "printer", "museum", "valve", "tenant", "curtain", "bracket", "folder", "between", "moved", "listed", "before", "gallery", "engineer"]
    said = lambda: " ".join(r.choice(vocabulary) for _ in range(9)).capitalize() + "."
    other = items(spark, [(1000 + i, None, None, " ".join(said() for _ in range(20)), None) for i in range(40)])
    alike = {"l": "1", "i": "l", "o": "0", "e": "c", "m": "rn"}
    pages, truth, hits, all_words = [], {}, 0, 0
    for i in range(30):
        true = " ".join(said() for _ in range(8))
        lines, line = [], ""
        for w in true.split():
            if len(w) > 5 and r.random() < 0.05:
                c = r.choice([c for c in w[1:] if c in alike] or [""])
                w = w[0] + w[1:].replace(c, alike[c], 1) if c else w
            if len(line) + len(w) > 60:
                cut_at = len(w) // 2
                if len(w) > 6 and w.isalpha():
                    lines.append(line + w[:cut_at] + "-")
                    line = w[cut_at:] + " "
                    continue
                lines.append(line.rstrip())
                line = ""
            line += w + " "
        lines.append(line.rstrip())
        pages.append((i, None, None, "\n".join(lines), None))
        truth[i] = true
    for x in ocr.ScannedText(items(spark, pages), other=other).repaired().collect():
        a, b = x["text"].split(), truth[x["id"]].split()
        all_words += len(b)
        hits += sum(p == q for p, q in zip(a, b)) if len(a) == len(b) else 0
    assert hits >= 0.99 * all_words, (hits, all_words)


def test_scanned_text(spark):
    docs = items(spark, [(1, None, None, SCAN, None), (2, None, None, None, None), (3, None, None, "", None), (4, None, None, "word", None)])
    other = items(spark, [(9, None, None, scans(), None), (10, None, None, None, None)])
    scanned = ocr.ScannedText(docs, other=other)
    got = sorted((x["id"], x["line_no"], x["kind"]) for x in scanned.cases().collect())
    assert got == [(1, 1, "drop"), (1, 2, "drop"), (1, 3, "split"), (1, 4, "misread"), (1, 7, "drop"), (1, 8, "misread")]
    text = {x["id"]: x["text"] for x in scanned.repaired().collect()}
    assert "the museum had been listed. The valve of the tenant" in text[1] and "cross-border curtain was listed." in text[1] and "orchard" in text[1] and "p. 1" not in text[1]
    assert text[4] == "word"
    assert ocr.ScannedText(docs.limit(0)).cases().count() == 0


# encodings


@pytest.mark.parametrize("chain", [("utf-8", "cp1252"), ("utf-8", "latin-1"), ("utf-8", "mac_roman"), ("utf-8", "cp437"), ("cp1252", "cp850"), ("cp1251", "cp1252"), ("utf-8", "cp1252", "utf-8", "cp1252")])
def test_garbled_words_come_back(chain):
    word = "подпись" if chain[0] == "cp1251" else "Größenübersicht"
    g = encodings.misread(word, *chain[:2])
    if len(chain) > 2:
        g = encodings.misread(g, *chain[2:])
    assert g in encodings.forms(word)
    if len(chain) == 2:
        assert encodings.reread(g, *chain) == word


def test_garbled_fields(spark):
    word = "Übersicht größer Señal análisis подпись Bär"
    rows = [(i, None, "name ü", word, None) for i in range(12)]
    bad = encodings.misread("größer Señal", "utf-8", "cp1252")
    rows += [(20, None, "ok", f"x {bad} y", None), (21, encodings.misread("Übersicht", "utf-8", "mac_roman"), encodings.misread("Übersicht", "utf-8", "mac_roman"), None, None)]
    rows += [(22, None, None, "vers�n", None), (23, None, "", "", None), (24, None, "plain", "ascii only", None), (25, None, encodings.misread("Señal", "cp1252", "cp850"), "x", None)]
    rows += [(26, None, "new", encodings.misread("Käse", "utf-8", "cp1252"), None)]
    g = encodings.Garbled(items(spark, rows))
    assert sorted((x["id"], x["field"]) for x in g.found().collect()) == [(20, "content"), (21, "name"), (22, "content"), (25, "name"), (26, "content")]
    fixed = {(x["id"], x["field"]): x["restored"] for x in g.restored().collect()}
    assert fixed[20, "content"] == "x größer Señal y" and fixed[21, "name"] == "Übersicht" and fixed[22, "content"] == "vers�n" and fixed[26, "content"] == "Käse"
    assert encodings.Garbled(items(spark, [])).found().count() == 0


def test_garbled_sentences_without_spaces(spark):
    words = "古い 橋 港 青い 図書館 新しい 会議 倉庫".split()
    rows = [(i, None, None, f"{a}{b}と{c}を{i}件検索しました。", None) for i, (a, b, c) in enumerate((a, b, c) for a in words for b in words for c in words if a != b != c)]
    text = "青い倉庫と古い橋を7,451件検索しました。新しい図書館"
    chains = [("euc_jp", "latin-1"), ("shift_jis", "cp1252"), ("gbk", "cp1252"), ("euc_jp", "mac_roman")]
    rows += [(1000 + i, None, None, f"古い港\n{encodings.misread(text, *c)}\nEND", None) for i, c in enumerate(chains)]
    rows += [(2000, None, "naïve façade", "créée — «été» ÀÉÎÕ", None)]
    g = encodings.Garbled(items(spark, rows))
    assert {x["id"]: x["restored"] for x in g.restored().collect()} == {1000 + i: f"古い港\n{text}\nEND" for i in range(len(chains))}


def test_the_cut_decides():
    # the classifier leans a little to boilerplate for a heading between two paragraphs of one block; its neighbours keep it
    text = "Heading\nA paragraph of more than nine words that ends with a full stop here.\nAnother paragraph of more than nine words that ends with a full stop."
    us = boilerplate.units(text)
    x = boilerplate.features(us, "", [1, 1, 1], [1, 1, 1], [1, 1, 1], 1)
    assert boilerplate.min_cut([-0.5, 4, 4], {}) == [False, True, True]
    cost = np.array([-0.5, 4.0, 4.0])
    assert boilerplate.min_cut(cost, boilerplate.smoothness(us, x)) == [True, True, True]
    assert boilerplate.min_cut(np.array([-6.0, 4.0, 4.0]), boilerplate.smoothness(us, x)) == [False, True, True]


def _letters(n):
    """Mails with usual forms, from which the classifier learns."""
    r, out = random.Random(8), []
    said = lambda i: f"{r.choice(('The', 'Our', 'No', 'One'))} {' '.join(r.choice(NOUNS) for _ in range(r.randrange(4, 12)))} of item {i * 7 + r.randrange(7)}{r.choice('.?')}"
    for i in range(n):
        who = f"Ann{chr(97 + i % 7)} Bor{chr(97 + i % 5)}"
        body = "\n".join(said(i) for _ in range(r.randrange(1, 4)))
        sign = f"Best regards,\n{who}\nTel. +00 {10000 + i % 35}\nThis message is confidential and meant for its addressee only."
        old = f"On 2026-01-0{i % 9 + 1}, Eve Q <eve@x.example> wrote:\n" + "\n".join("> " + said(i) for _ in range(r.randrange(1, 4)))
        out.append((i, [f"Hi all,\n{body}\n\n{sign}", f"Hello Eve,\n{body}\n\n{sign}\n\n{old}", f"{body}\n\n--\n{who}\nwww.ann.example\n\n{old}"][i % 3]))
    return out


def test_mails_without_known_forms(spark):
    """Closings and languages the forms do not know, and history without marks: there the counted features decide."""
    rows = [(i, f"subject {i}", t) for i, t in _letters(300)]
    name, odd = "Anna Borc", {}
    for n, closing in enumerate(("Met vriendelijke groet", "Ystävällisin terveisin", "Med vänlig hälsning")):
        odd[1000 + n] = f"Hi all,\nThe report on item {n} was late and nobody had asked for it.\nPlease look at page {n} of it before we meet again.\n{closing}\n{name}\nTel. +00 10001\nThis message is confidential and meant for its addressee only."
    odd[1010] = "Hello Eve,\nThe order for item 3 was sent to the harbour yesterday.\n\nBest regards,\nAnna Borc\n\nOn 2026-01-03, Eve Q <eve@x.example> wrote:\nWhat about the boats, are they ready now?\nI would like to see them before the winter."
    schema = "item_id bigint, name string, content string, preview string, received_at timestamp_ntz"
    at = dt.datetime(2026, 1, 1)
    df = spark.createDataFrame([(i, s, t, None, at) for i, s, t in rows] + [(i, f"odd {i}", t, None, at) for i, t in odd.items()], schema)
    new = {}
    for r in mail.NewText(df).lines().collect():
        new.setdefault(r["id"], set()).add(r["line_no"])
    for n in range(3):
        assert {2, 3} <= new[1000 + n] and not {6, 7} & new[1000 + n], (n, new[1000 + n])
    assert {1, 2} <= new[1010] and not {8, 9} & new[1010], new[1010]
    rule = [mail.line_labels(ls := mail.read_lines(odd[1010]), mail.kinds(ls))]
    assert rule[0][-2:] == [-1, -1]  # the forms alone do not tell


def test_restored_fields_are_the_planted_ones(spark):
    """Truth for the restoration: fields garbled by chains of all kinds, wholly or in part, come back as they were."""
    r = random.Random(5)
    words = "größer Übung Straße señal montaña película bibliothèque déjà où forêt élève пример слово письмо Größe cañería".split()
    said = lambda: " ".join(r.choice([*words, *NOUNS]) for _ in range(12))
    rows, truth = [(i, None, "name", said(), None) for i in range(400)], {}
    chains = [("utf-8", "cp1252"), ("utf-8", "latin-1"), ("utf-8", "mac_roman"), ("utf-8", "cp437"), ("cp1251", "cp1252"), ("utf-8", "cp1252", "utf-8", "cp1252")]
    for i in range(60):
        clean = said()
        parts = clean.split()
        chain = chains[i % len(chains)]
        half = r.randrange(0, 6)
        for k in range(half, len(parts)):
            g = encodings.misread(parts[k], *chain[:2])
            if g is not None and len(chain) > 2:
                g = encodings.misread(g, *chain[2:])
            parts[k] = parts[k] if g is None else g
        if " ".join(parts) != clean:
            truth[1000 + i] = clean
        rows.append((1000 + i, None, "name", " ".join(parts), None))
    got = {x["id"]: x["restored"] for x in encodings.Garbled(items(spark, rows)).restored().where("field = 'content'").collect()}
    assert set(got) >= {i for i in truth} and not {i for i in got if i < 1000}
    assert sum(got[i] == t for i, t in truth.items()) >= 0.95 * len(truth)
