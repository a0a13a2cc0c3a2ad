"""Lots of a text are found wherever they stand in it, and in time that grows with its length."""

import random
import re
import time

from tendermill.operators import lots

HEADER = re.compile(r"n[°o]?\s*\.?\s*lot|lot\s*n[°o]?|num[eé]ro\s*lot|liste\s+des\s+lots|d[eé]signation\s+des\s+lots|intitul[eé]\s+des?\s+lots?", re.I)
ROW, LETTER_ROW = re.compile(r"\s*(\d{1,2})\s{1,6}(\S.{1,80})"), re.compile(r"\s*([A-Z])\s{1,6}(\S.{1,80})")
IN_LINE = re.compile(r"(?:^|[\s\-–—:])(?:lot|tranche)\s*[nN°]*\s*(\d{1,2}[A-Za-z]?|[A-Za-z])\b[^\n]{0,80}", re.I | re.M)


def _id(raw):
    if re.fullmatch(r"\d{1,2}[A-Za-z]?", raw):
        return "lot" + (raw.lstrip("0") or "0")
    return f"lot{ord(raw) - 64}" if re.fullmatch("[A-Z]", raw) else None


def _excerpt(lines, at):
    out = []
    for line in map(str.strip, lines[at + 1 : at + 12]):
        if not line and not out:
            continue
        if not line or IN_LINE.match(line) or ROW.match(line):
            break
        out.append(line)
        if sum(map(len, out)) >= 220:
            break
    text = " ".join(out)
    return text[:247].rstrip() + "…" if len(text) > 250 else text


def _plain(text):
    """Lots by plain loops over all lines: ``id, nom, confidence, description``."""
    lines, found = text.split("\n"), {}
    named = lambda raw, label: f"Lot {raw} — {label}" if label else f"Lot {raw}"
    header = next((i for i, x in enumerate(lines) if HEADER.search(x)), len(lines))
    misses = 0
    for i in range(header + 1, len(lines)):
        m = ROW.match(lines[i]) or LETTER_ROW.match(lines[i])
        misses = 0 if m else misses + bool(lines[i].strip())
        if misses == 3:
            break
        if m and _id(m[1]):
            label = re.sub(r"\s{2,}", " ", m[2].strip()[:60]).strip(" -–—")
            found.setdefault(_id(m[1]), (named(m[1], label), 90, _excerpt(lines, i)))
    for m in [] if found else IN_LINE.finditer(text):
        if _id(m[1]):
            label = re.sub(r"(?:lot|tranche)\s*[nN°]*\s*\w+[\s:\-–—]*", "", m[0].strip(), flags=re.I).strip(" :—-–")
            label = re.split(r"[.\n]", label)[0].strip()[:60]
            found.setdefault(_id(m[1]), (named(m[1], label), 80, _excerpt(lines, text.count("\n", 0, m.start()))))
    return [(k, *v) for k, v in found.items()]


def _found(spark, texts):
    df = lots.in_text(spark.createDataFrame(list(enumerate(texts)), "i int, text string"), "text")
    return [[(d.id, d.nom, d.confidence, d.description) for d in r.found] for r in df.orderBy("i").collect()]


def test_lots_far_down_are_found(spark):
    far = "clause\n" * 700
    texts = [f"{far}Le Lot 3 : Plomberie.\nsuite\n", f"{far}Liste des lots\n1  Murs\n{'a' * 6000}\n2  Sols\nfin\n", f"Règlement de la consultation\n{far}Lot 4 : Bois"]
    assert _found(spark, texts) == [
        [("lot3", "Lot 3 — Plomberie", 80, "suite")],
        [("lot1", "Lot 1 — Murs", 90, "a" * 247 + "…"), ("lot2", "Lot 2 — Sols", 90, "fin")],
        [("lot4", "Lot 4 — Bois", 80, "")],
    ]


def test_a_project_has_the_lots_of_whole_texts(spark):
    texts = {"rc": "clause\n" * 700 + "Le Lot 3 : Plomberie.", "autre": "clause\n" * 300 + "Le Lot 7 : Bois."}
    rows = [(1, k, f"{kind}.pdf", kind, text) for k, (kind, text) in enumerate(texts.items())]
    documents = spark.createDataFrame(rows, "project long, doc_id long, file_name string, kind string, text string")
    cells = spark.createDataFrame([], "book long, sheet_no int, sheet string, row int, col int, value string")
    assert sorted((r.id, r.nom) for r in lots.detect(documents, cells).collect()) == [("lot3", "Lot 3 — Plomberie"), ("lot7", "Lot 7 — Bois")]


def test_random_long_texts_agree_with_plain_loops(spark):
    draw = random.Random(11)
    pieces = ["", "", "clause du marché", "le lot {n} : travaux. Suite", "Lot\n\n{n}", "tranche {n}", "lot nN", "lot n°", "x — Lot {c} - Sols, lot {n}", "d" * 130, "Lot {n}", "alloti", "lot B"]
    rows = ["{n}  Murs {n}", " {c}   Toiture -", "{n} Sols  durs", "", "note"]

    def text(table):
        out = [draw.choice(pieces) for _ in range(draw.randrange(150, 900))]
        if table:
            at = draw.randrange(len(out))
            out = [x for x in out[:at] if "n°" not in x and "nN" not in x] + ["Désignation des lots"] + [draw.choice(rows) for _ in range(draw.randrange(1, 400))] + out[at:]
        return "\n".join(x.format(n=draw.randrange(100), c=draw.choice("ABCdefXYZ")) for x in out)

    texts = [text(k % 2) for k in range(60)]
    plain = [_plain(x) for x in texts]
    assert {d[2] for x in plain for d in x} == {80, 90}
    assert _found(spark, texts) == plain


def test_very_long_texts_take_linear_time(spark):
    many = "\n".join(f"Le lot {k % 100}{chr(97 + k // 100 % 26)} : travaux" for k in range(100_000))
    table = "Liste des lots\n" + "\n".join(f"{k % 100}  Travaux {k}" for k in range(100_000))
    blank = "Lot" + "\n" * 100_000 + "5 : Bois" + "\nlot" + " " * 100_000 + "."
    documents = spark.createDataFrame([(k, k, "rc.pdf", "rc", x) for k, x in enumerate([many, table, blank])], "project long, doc_id long, file_name string, kind string, text string")
    cells = spark.createDataFrame([], "book long, sheet_no int, sheet string, row int, col int, value string")
    began = time.monotonic()
    got = [r["count"] for r in lots.detect(documents, cells).groupBy("project").count().orderBy("project").collect()]
    assert time.monotonic() - began < 100
    assert got == [2600, 100, 1]


def test_texts_are_split_once(spark):
    documents = spark.createDataFrame([(1, 1, "rc.pdf", "rc", "Lot 1")], "project long, doc_id long, file_name string, kind string, text string")
    cells = spark.createDataFrame([], "book long, sheet_no int, sheet string, row int, col int, value string")
    assert lots.detect(documents, cells)._jdf.queryExecution().optimizedPlan().toString().count("split(coalesce(text") == 1
