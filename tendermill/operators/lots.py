"""Lots of a tender: detections in sheet names, cells, file names and texts, and their merge.

A detection is a struct ``id, nom, confidence, sources, tranches, description``.
All lines of a text are scanned inside the row, in time that grows with its
length, so no line is shuffled; only detections are grouped, by project and lot.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tendermill.functions.classify import canonical_lot
from tendermill.functions.text import normalise

DETECTION = "struct<id:string,nom:string,confidence:int,sources:array<string>,tranches:array<string>,description:string>"

# Names of sheets without lots, patterns of lots, and families of trades with their keywords.
IGNORED_SHEET = r"(?i)^(sommaire|recap|recapitulatif|total|couverture|garde|notice|dpgf|bpu|dqe|bordereau|feuil\d*|sheet\d*|onglet\d*)$"
TABLE_HEADER = r"(?iu)(?:n[°o]?\s*\.?\s*lot|lot\s*n[°o]?|num[eé]ro\s*lot|liste\s+des\s+lots|d[eé]signation\s+des\s+lots|intitul[eé]\s+des?\s+lots?)"
TABLE_ROW = r"^\s*(\d{1,2})\s{1,6}(\S.{1,80})"
TABLE_ROW_LETTER = r"^\s*([A-Z])\s{1,6}(\S.{1,80})"
LOT_IN_LINE = r"(?iumU)(?:^|[\s\-–—:])(?:lot|tranche)\s*+[nN°]*\s*+(\d{1,2}[A-Za-z]?|[A-Za-z])\b[^\n]{0,80}"
LOT_IN_FILE = r"(?iU)lot[\s_\-]*(\d{1,2}[A-Za-z]?|[A-Za-z](?!\w))"
LOT_IN_CELL = r"(?iU)\blot\s*n?°?\s*(\d{1,2}[A-Za-z]?)\b"
LOT_IN_SHEET = r"(?iU)\blot\s*[nN°]*\s*(\d{1,2}[A-Za-z]?)\b"
TRANCHE = r"(?iU)tranche\s*(ferme|optionnel\w*|condition\w*)?|\b(ferme|optionnel\w*)\b"
ANNEX_FILE = r"(?i)annexe|allotissement|liste.{0,6}lots|sommaire|alloti"
PLACEHOLDER = "[document volumineux"
FAMILIES = (
    (1, "VRD / Voirie et Réseaux Divers", ("vrd", "voirie", "terrassement", "reseaux divers", "assainissement", "viabilisation", "reseau sec", "reseau humide")),
    (2, "Gros œuvre", ("gros oeuvre", "gros-oeuvre", "maconnerie", "beton arme", "structure", "fondations", "ferraillage", "banche")),
    (3, "Charpente", ("charpente", "ossature bois", "charpente bois", "lamelle colle", "charpente metallique")),
    (4, "Couverture / Étanchéité", ("couverture", "etancheite", "zinguerie", "toiture", "ardoise", "tuile", "bac acier")),
    (5, "Façades / Ravalement", ("facade", "bardage", "ravalement", "isolation thermique par exterieur", "ite", "enduit facade")),
    (6, "Menuiseries extérieures", ("menuiserie ext", "menuiseries exterieures", "aluminium", "menuiserie aluminium", "menuiserie pvc", "vitrage", "fenetre", "baie vitree", "porte exterieure", "rideau metallique")),
    (7, "Serrurerie / Métallerie", ("serrurerie", "metallerie", "garde-corps", "garde corps", "portail", "cloture metallique", "escalier metallique")),
    (8, "Plâtrerie / Faux-plafonds", ("platrerie", "doublage", "faux-plafond", "faux plafond", "cloison", "isolation interieure", "laine de verre")),
    (9, "Menuiseries intérieures", ("menuiserie int", "menuiseries interieures", "boiserie", "placards", "porte interieure", "bloc porte")),
    (10, "Peinture / Revêtements muraux", ("peinture", "revetement mural", "papier peint", "toile de verre")),
    (11, "Carrelage / Faïence", ("carrelage", "faience", "granit", "marbre", "pierre naturelle")),
    (12, "Sols souples", ("sol souple", "moquette", "parquet", "linoleum", "stratifie", "sols bois")),
    (13, "Plomberie / Sanitaires", ("plomberie", "sanitaire", "robinetterie", "plomberie-sanitaire", "eau chaude sanitaire", "ecs")),
    (14, "CVC (Chauffage-Ventilation-Climatisation)", ("chauffage", "ventilation", "climatisation", "cvc", "pac", "plancher chauffant", "radiateur", "vmc")),
    (15, "Électricité courants forts", ("electricite", "courants forts", "cfo", "tableau electrique", "eclairage", "distribution electrique")),
    (16, "Courants faibles / SSI", ("courants faibles", "courant faible", "ssi", "cfa", "surete", "controle acces", "securite incendie", "reseau informatique")),
    (17, "Ascenseurs / Élévateurs", ("ascenseur", "elevateur", "monte-charge", "monte charge", "nacelle")),
    (18, "Espaces verts / Paysage", ("espaces verts", "paysage", "paysagisme", "vegetaux", "engazonnement", "plantations")),
)
#: Rows and columns of a sheet, header rows searched for tranches, tranches kept.
CELL_ROWS, CELL_COLS, TRANCHE_ROWS, TRANCHES = 500, 4, 10, 8
SPREADSHEETS = (".xlsx", ".xls", ".ods")


def detection(id_: Column, nom: Column, confidence: int, source: str, description: Column | None = None, tranches: Column | None = None) -> Column:
    made = F.struct(
        id_.alias("id"), nom.alias("nom"), F.lit(confidence).alias("confidence"), F.array(F.lit(source)).alias("sources"),
        (F.array().cast("array<string>") if tranches is None else tranches).alias("tranches"), (F.lit("") if description is None else description).alias("description"),
    )
    return made.cast(DETECTION)


def _stripped(text: Column, chars: str) -> Column:
    return F.regexp_replace(text, f"^[{chars}]+|[{chars}]+$", "")


def _titled(raw: Column, label: Column) -> Column:
    return F.when(label != "", F.concat(F.lit("Lot "), raw, F.lit(" — "), label)).otherwise(F.concat(F.lit("Lot "), raw))


def ignored_sheet(name: Column) -> Column:
    return normalise(name).rlike(IGNORED_SHEET)


def in_sheet_name(name: Column) -> Column:
    """Detection in the name of a sheet: a lot's number, else a trade, else the name itself; NULL if none."""
    # A list of one: its lambda has the normalised name as a value, where each keyword's test would make it again.
    once = F.array(F.struct(F.trim(name).alias("name"), normalise(F.trim(name)).alias("plain")))
    return F.get(F.transform(once, lambda s: _sheet_detection(s["name"], s["plain"])), F.lit(0))


def _sheet_detection(name: Column, plain: Column) -> Column:
    raw = F.regexp_extract(name, LOT_IN_SHEET, 1)
    label = F.left(_stripped(F.regexp_replace(name, r"(?i)lot\s*[nN°]*\s*[\d]+[a-z]?[\s:\-–—]*", ""), r" :—\-–"), F.lit(60))
    out = F.when((name == "") | plain.rlike(IGNORED_SHEET), F.lit(None).cast(DETECTION))
    out = out.when(raw != "", detection(canonical_lot(raw), _titled(raw, label), 85, "excel"))
    for number, default, words in FAMILIES:
        hit = F.lit(False)
        for w in words:
            hit = hit | plain.contains(w)
        shown = F.when(F.char_length(name) > 3, F.left(name, F.lit(60))).otherwise(default)
        out = out.when(hit, detection(F.lit(f"lot{number}"), F.concat(F.lit(f"Lot {number} — "), shown), 70, "excel"))
    key = F.left(F.regexp_replace(plain, "[^a-z0-9]", "_"), F.lit(20))
    return out.when((F.char_length(name) >= 4) & ~name.rlike(r"^\d+$"), detection(F.concat(F.lit("lot_sheet_"), key), F.left(name, F.lit(60)), 40, "excel"))


def in_file_name(name: Column, source: str = "filename", confidence: int = 55) -> Column:
    raw = F.regexp_extract(name, LOT_IN_FILE, 1)
    return F.when(canonical_lot(raw).isNotNull(), detection(canonical_lot(raw), F.concat(F.lit("Lot "), raw), confidence, source))


def in_cell(value: Column) -> Column:
    value = F.trim(value)
    raw = F.regexp_extract(value, LOT_IN_CELL, 1)
    label = F.left(_stripped(F.regexp_replace(value, LOT_IN_CELL, ""), r" :—\-–"), F.lit(60))
    return F.when((raw != "") & (F.char_length(value) <= 120), detection(canonical_lot(raw), _titled(raw, label), 65, "excel"))


def excerpt_after(lines: Column, at: Column) -> Column:
    """Lines after ``at``: up to a blank one, the next heading or 220 characters; leading blanks are skipped."""
    state = F.struct(F.array().cast("array<string>").alias("t"), F.lit(0).alias("n"), F.lit(False).alias("done"))

    def step(s: Column, line: Column) -> Column:
        line = F.trim(line)
        heading = line.rlike("^(?:" + LOT_IN_LINE + ")") | line.rlike(TABLE_ROW)
        blank = line == ""
        stop = s["done"] | (blank & (F.size(s["t"]) > 0)) | (~blank & heading)
        keep = ~stop & ~blank
        n = s["n"] + F.when(keep, F.char_length(line)).otherwise(0)
        return F.struct(F.when(keep, F.concat(s["t"], F.array(line))).otherwise(s["t"]).alias("t"), n.alias("n"), (stop | (n >= 220)).alias("done"))

    text = F.aggregate(F.slice(lines, at + 2, 11), state, step, lambda s: F.trim(F.array_join(s["t"], " ")))
    return F.when(F.char_length(text) > 250, F.concat(F.rtrim(F.left(text, F.lit(247))), F.lit("…"))).otherwise(text)


def _once(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is made once: a list of one holds it, which each use in ``f`` would make again."""
    return F.get(F.transform(F.array(F.struct(value.alias("v"))), lambda s: f(s["v"])), F.lit(0))


def _firsts(found: Column) -> Column:
    """The first detection of each id: sorted by id and place, those whose neighbour before has another id."""

    def chosen(found: Column) -> Column:
        ids = F.sort_array(F.transform(found, lambda d, k: F.struct(d["id"].alias("id"), k.alias("k"))))
        firsts = _once(ids, lambda ids: F.filter(ids, lambda x, i: ~x["id"].eqNullSafe(F.get(ids, i - 1)["id"])))
        return F.transform(F.sort_array(F.transform(firsts, lambda x: x["k"])), lambda k: F.get(found, k))

    return _once(found, chosen)


def _told(found: Column) -> Column:
    """A row for a detection with an id; a filter after it would be pushed below and make the detection twice."""
    return F.explode(F.filter(F.array(found), lambda d: d["id"].isNotNull()))


def scanned_lines(text: Column) -> Column:
    return F.split(text, r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x85\u2028\u2029]")


def _table_hits(lines: Column) -> Column:
    """Numbers of the table rows after the first header, up to the third line in a row that is none; blank lines do not count."""
    row = lambda i: F.get(lines, i).rlike(TABLE_ROW) | F.get(lines, i).rlike(TABLE_ROW_LETTER)

    def step(s: Column, i: Column) -> Column:
        open_ = s["misses"] < 3
        misses = F.when(~open_ | (F.trim(F.get(lines, i)) == ""), s["misses"]).when(row(i), 0).otherwise(s["misses"] + 1)
        return F.struct(misses.alias("misses"), F.when(open_, i).otherwise(s["last"]).alias("last"))

    def after(header: Column) -> Column:
        state = F.struct(F.lit(0).alias("misses"), header.alias("last"))
        last = F.aggregate(F.sequence(header, F.size(lines) - 1), state, step, lambda s: s["last"])
        found = F.filter(F.sequence(header, last), row)
        return F.when((header > 0) & (header < F.size(lines)), found).otherwise(F.array().cast("array<int>"))

    return _once(F.array_position(F.transform(lines, lambda x: x.rlike(TABLE_HEADER)), F.lit(True)).cast("int"), after)


def _first_lots(hits: Column) -> Column:
    """``id, line, raw, rest`` of the first of ``hits(line, raw, rest)`` for each lot, before more is made of them."""
    lots = F.transform(hits, lambda h: F.struct(canonical_lot(h["raw"]).alias("id"), h["line"].alias("line"), h["raw"].alias("raw"), h["rest"].alias("rest")))
    return _firsts(F.filter(lots, lambda x: x["id"].isNotNull()))


def _table_detections(lines: Column, hits: Column) -> Column:
    def cut(i: Column) -> Column:
        line = F.get(lines, i)
        group = lambda n: F.when(line.rlike(TABLE_ROW), F.regexp_extract(line, TABLE_ROW, n)).otherwise(F.regexp_extract(line, TABLE_ROW_LETTER, n))
        return F.struct(i.alias("line"), group(1).alias("raw"), group(2).alias("rest"))

    def made(x: Column) -> Column:
        label = _stripped(F.regexp_replace(F.left(F.trim(x["rest"]), F.lit(60)), r"\s{2,}", " "), r" \-–—")
        return detection(x["id"], _titled(x["raw"], label), 90, "rc_text", excerpt_after(lines, x["line"]))

    return F.transform(_first_lots(F.transform(hits, cut)), made)


def _line_detections(lines: Column) -> Column:
    """Detections inside lines; a mark before each match tells its line and where its text begins."""
    mark = "\u0001"
    block = F.translate(F.array_join(lines, "\n"), mark, " ")
    marked = F.regexp_replace(block, LOT_IN_LINE, f"{mark}$0")

    def matches(marked: Column) -> Column:
        marks = lambda x: F.char_length(x) - F.char_length(F.translate(x, mark, ""))
        at = F.flatten(F.transform(F.split(marked, "\n"), lambda x, i: F.array_repeat(i, marks(x))))
        begun = F.split(marked, mark)
        texts = F.transform(F.slice(begun, F.lit(2), F.size(begun)), lambda x: F.regexp_extract(x, LOT_IN_LINE, 0))
        return F.zip_with(at, texts, lambda i, x: F.struct(i.alias("line"), F.regexp_extract(x, LOT_IN_LINE, 1).alias("raw"), x.alias("rest")))

    def made(x: Column) -> Column:
        whole = F.trim(F.regexp_replace(x["rest"], r"^\s+|(?<!\s)\s++$", ""))
        after = _stripped(F.regexp_replace(whole, r"(?iU)(?:lot|tranche)\s*[nN°]*\s*[\w]+[\s:\-–—]*", ""), r" :—\-–")
        label = F.left(F.trim(F.get(F.split(after, r"[.\n]"), F.lit(0))), F.lit(60))
        return detection(x["id"], _titled(x["raw"], label), 80, "rc_text", excerpt_after(lines, x["line"]))

    return F.transform(_first_lots(_once(marked, matches)), made)


def in_text(df: DataFrame, text: str) -> DataFrame:
    """Add ``found``: the rows of a table of lots if there are any, else the lots named inside lines, in the whole text."""
    df = df.withColumn("_lines", scanned_lines(F.coalesce(text, F.lit(""))))
    df = df.withColumn("_table", _table_detections(F.col("_lines"), _table_hits(F.col("_lines"))))
    found = F.when(F.size("_table") > 0, F.col("_table")).otherwise(_line_detections(F.col("_lines")))
    return df.withColumn("found", found).drop("_lines", "_table")


def wanted_pdf(name: Column, kind: Column, text: Column) -> Column:
    """Whether a PDF's text is searched: rules, other documents and annexes, if it is no placeholder."""
    kind = F.coalesce(kind, F.lit("autre"))
    chosen = kind.isin("rc", "ccap", "autre") | name.rlike(ANNEX_FILE)
    return F.lower(name).endswith(".pdf") & chosen & ~F.coalesce(text, F.lit("")).startswith(PLACEHOLDER)


def in_books(cells: DataFrame) -> DataFrame:
    """``book, seq, d``: detections of each workbook from ``cells(book, sheet_no, sheet, row, col, value)``.

    Cells are searched only if at most two sheets are not ignored.  Tranches,
    named in the first rows of the first sheet that has any, go to all lots.
    """
    sheets = cells.select("book", "sheet_no", "sheet").distinct()
    named = sheets.select("book", F.col("sheet_no").cast("long").alias("seq"), _told(in_sheet_name(F.col("sheet"))).alias("d"))
    few = sheets.where(~ignored_sheet(F.col("sheet"))).groupBy("book").agg(F.count("*").alias("n")).where("n <= 2").select("book")
    searched = cells.where(f"row < {CELL_ROWS} and col < {CELL_COLS}").where(~ignored_sheet(F.col("sheet")))
    seq = (F.lit(1 << 40) + F.col("sheet_no") * 10_000 + F.col("row") * 10 + F.col("col")).cast("long")
    inside = searched.join(few, "book", "left_semi").select("book", seq.alias("seq"), _told(in_cell(F.col("value"))).alias("d"))
    both = named.unionByName(inside)
    first = both.groupBy("book", F.col("d.id").alias("id")).agg(F.min_by(F.struct("seq", "d"), "seq").alias("x")).select("book", "x.*")

    value = F.trim("value")
    heads = cells.where(F.col("row") < TRANCHE_ROWS).where(value.rlike(TRANCHE) & F.char_length(value).between(4, 79))
    heads = heads.groupBy("book", "sheet_no").agg(F.array_sort(F.collect_list(F.struct("row", "col", F.left(value, F.lit(60)).alias("t")))).alias("h"))
    heads = heads.groupBy("book").agg(F.min_by("h", "sheet_no").alias("h")).select("book", F.slice(F.array_distinct(F.col("h.t")), 1, TRANCHES).alias("t"))
    out = first.join(heads, "book", "left")
    return out.select("book", "seq", F.col("d").withField("tranches", F.coalesce("t", F.col("d.tranches"))).alias("d"))


def best_label(old: Column, new: Column, keep_old: Column) -> Column:
    """The longer of two names without their ``Lot N —``; of equals the old one if asked."""
    size = lambda x: F.char_length(F.trim(F.regexp_replace(x, r"(?i)^lot\s*\d+[a-z]?\s*[—\-–:]\s*", "")))
    return F.when(size(new) > size(old), new).when(size(old) > size(new), old).when(keep_old, old).otherwise(new)


def merged(found: DataFrame, project: str = "project") -> DataFrame:
    """One row a lot from ``project, seq, d``; ``seq`` orders sheets before texts before file names.

    Each further source adds 15 to the confidence.  Lots made of a sheet's name
    alone go if the project has others.
    """
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("seq", "d"))), lambda x: x["d"])
    groups = found.where("d.id is not null").groupBy(project, F.col("d.id").alias("id")).agg(ordered.alias("all"))

    def step(s: Column, x: Column) -> Column:
        new = F.array_except(x["sources"], s["sources"])
        sources = F.concat(s["sources"], new)
        return F.struct(
            s["id"].alias("id"), best_label(s["nom"], x["nom"], F.array_contains(sources, "rc_text")).alias("nom"),
            F.when(F.size(new) > 0, F.least(F.lit(100), s["confidence"] + 15 * F.size(new))).otherwise(s["confidence"]).alias("confidence"),
            sources.alias("sources"), F.array_union(s["tranches"], x["tranches"]).alias("tranches"),
            F.when(F.char_length(x["description"]) > F.char_length(s["description"]), x["description"]).otherwise(s["description"]).alias("description"),
        ).cast(DETECTION)

    first = F.get("all", F.lit(0))
    folded = groups.select(project, F.aggregate(F.slice("all", F.lit(2), F.greatest(F.size("all") - 1, F.lit(0))), first, step).alias("d"))
    real = ~F.col("d.id").startswith("lot_sheet_")
    any_real = F.max(real).over(Window.partitionBy(project))
    return folded.withColumn("_any", any_real).where(real | ~F.col("_any")).select(project, "d.*")


def lot_order(id_: Column) -> list[Column]:
    """Natural order: number and suffix, then letters, then all others."""
    number, letter = F.regexp_extract(id_, r"^lot(\d+)([A-Za-z]?)", 1), F.regexp_extract(id_, r"^lot([A-Za-z])$", 1)
    rank = F.when(number != "", number.cast("int")).when(letter != "", F.ascii(F.upper(letter)) - 65 + 100).otherwise(999)
    return [rank, F.when(number != "", F.upper(F.regexp_extract(id_, r"^lot(\d+)([A-Za-z]?)", 2))).otherwise("")]


def detect(documents: DataFrame, cells: DataFrame) -> DataFrame:
    """Lots of each project from ``documents(project, doc_id, file_name, kind, text)`` and the cells of its workbooks (``book`` is ``doc_id``).

    Sheets and spreadsheet names come first, then texts of documents, then file names.
    """
    part = lambda n: (F.lit(n << 50) + F.col("doc_id") * 4).cast("decimal(38,0)")
    sheet = F.exists(F.array(*map(F.lit, SPREADSHEETS)), lambda e: F.lower("file_name").endswith(e))
    own = documents.where(sheet).select("project", part(0).alias("p"), F.lit(0).cast("long").alias("k"), _told(in_file_name(F.col("file_name"), "excel", 75)).alias("d"))
    books = in_books(cells).join(documents.select("project", "doc_id"), F.col("book") == F.col("doc_id"))
    books = books.select("project", (part(0) + 1).alias("p"), F.col("seq").alias("k"), "d")
    read = in_text(documents.where(wanted_pdf(F.col("file_name"), F.col("kind"), F.col("text"))), "text")
    # Of a bare column Spark would infer a filter by its size, push it below and there split the text again for each line.
    told = F.filter("found", lambda d: d["id"].isNotNull())
    texts = read.select("project", part(1).alias("p"), F.posexplode(told).alias("k", "d")).withColumn("k", F.col("k").cast("long"))
    names = documents.select("project", part(2).alias("p"), F.lit(0).cast("long").alias("k"), _told(in_file_name(F.col("file_name"))).alias("d"))
    rows = own.unionByName(books).unionByName(texts).unionByName(names)
    return merged(rows.select("project", F.struct("p", "k").alias("seq"), "d"))
