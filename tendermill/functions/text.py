"""Scalar text functions, each a Column to Column expression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Latin letters with marks and their bases; other non-ASCII characters are dropped, œ and æ too.
ACCENTED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝŸ\u00a0\u202f"
PLAIN = "aaaaaaceeeeiiiinooooouuuuyyAAAAAACEEEEIIIINOOOOOUUUUYY  "


def without_accents(text: Column) -> Column:
    return F.regexp_replace(F.translate(text, ACCENTED, PLAIN), r"[^\x00-\x7F]", "")


def normalise(text: Column) -> Column:
    """Lower-case ASCII with single blanks."""
    return F.trim(F.regexp_replace(F.lower(without_accents(text)), r"\s+", " "))


def extension(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"\.[^.]*$", 0))


def safe_name(name: Column) -> Column:
    """File name of letters, digits, dots and dashes; empty names become ``document``."""
    kept = F.regexp_replace(F.regexp_replace(without_accents(name), r"[^A-Za-z0-9.\-]", "_"), "_+", "_")
    return F.coalesce(F.nullif(F.regexp_replace(kept, "^_+|_+$", ""), F.lit("")), F.lit("document"))


def without_controls(text: Column) -> Column:
    clean = F.regexp_replace(F.regexp_replace(text, r"[\x00-\x1f\x7f-\x{9f}]", "_"), "_+", "_")
    return F.regexp_replace(clean, "^_+|_+$", "")


def initials(name: Column) -> Column:
    words = F.filter(F.split(name, " "), lambda w: w != "")
    return F.upper(F.substring(F.array_join(F.transform(words, lambda w: F.substring(w, 1, 1)), ""), 1, 2))


def token_estimate(text: Column) -> Column:
    return F.floor(F.char_length(text) / 4)


def guarded(text: Column, most_tokens: int, marker: str) -> Column:
    """Text cut at four characters a token, with a marker where it was cut."""
    limit = 4 * most_tokens
    return F.when(F.char_length(text) > limit, F.concat(F.left(text, F.lit(limit)), F.lit(marker))).otherwise(text)


def labelled_block(kind: Column, name: Column, text: Column) -> Column:
    return F.concat(F.lit("=== "), F.upper(kind), F.lit(" — "), name, F.lit(" ===\n"), text)


def number_text(text: Column) -> Column:
    """Digits of a French or plain number: blanks, no-break spaces and the euro sign go, the comma is a point."""
    return F.translate(text, ", \u00a0€", ".")


NUMBER = r"^[+-]?(\d+(_\d+)*(\.(\d+(_\d+)*)?)?|\.\d+(_\d+)*)([eE][+-]?\d+)?$"


def to_number(text: Column) -> Column:
    """Double, or NULL for anything that is not one plain number."""
    plain = number_text(F.trim(text))
    return F.when(plain.rlike(NUMBER), F.replace(plain, F.lit("_"), F.lit("")).cast("double"))


SUMMARY_ROW = r"(?i)^(total|sous.?total|tva|ttc|ht|remise|avance|r[eé]capitulat)"


def is_summary_row(label: Column) -> Column:
    return F.trim(label).rlike(SUMMARY_ROW)


def excerpt(lines: Column, at: Column, ahead: int = 11, most: int = 220) -> Column:
    """The lines after ``at`` up to a blank one, leading blanks skipped, joined until ``most`` characters."""
    state = F.struct(F.lit("").alias("t"), F.lit(False).alias("done"))

    def step(s: Column, line: Column) -> Column:
        blank, empty = F.trim(line) == "", s["t"] == ""
        joined = F.when(empty, F.trim(line)).otherwise(F.concat(s["t"], F.lit(" "), F.trim(line)))
        text = F.when(s["done"] | blank, s["t"]).otherwise(joined)
        done = s["done"] | (blank & ~empty) | (F.char_length(text) >= most)
        return F.struct(text.alias("t"), done.alias("done"))

    return F.aggregate(F.slice(lines, at + 1, ahead), state, step, lambda s: s["t"])


def segments(text: Column, target: int = 45, least: int = 15) -> Column:
    """Pieces of about ``target`` characters, cut at the last blank in reach; pieces under ``least`` are dropped.

    A text of n characters has at most n / ``least`` pieces, which bounds the fold.
    """
    strip = lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", "")
    start = F.struct(F.array().cast("array<string>").alias("out"), strip(text).alias("rest"))

    def step(s: Column, _: Column) -> Column:
        rest, n = s["rest"], F.char_length(s["rest"])
        window = F.substring(rest, least + 1, target + 1 - least)
        back = F.instr(F.reverse(window), " ")
        cut = F.when(n <= target, n).when(back > 0, F.lit(target + 1) - back).otherwise(target)
        piece = strip(F.left(rest, cut))
        out = F.when(F.char_length(piece) >= least, F.concat(s["out"], F.array(piece))).otherwise(s["out"])
        return F.struct(out.alias("out"), strip(F.substring(rest, cut + 1, n)).alias("rest"))

    rounds = F.sequence(F.lit(0), F.floor(F.char_length(F.coalesce(text, F.lit(""))) / least).cast("int"))
    return F.aggregate(rounds, start, step, lambda s: s["out"])


def fallback_pairs(text: Column) -> Column:
    """The first five pairs of neighbours among the words of more than four characters."""
    words = F.filter(F.split(text, r"(?U)\s+"), lambda w: F.char_length(w) > 4)
    pairs = F.transform(words, lambda w, i: F.concat(w, F.lit(" "), F.get(words, i + 1)))
    return F.slice(F.filter(pairs, lambda p: p.isNotNull()), 1, 5)


def page_of(pages: Column, wanted: Column, text: Column) -> Column:
    """The declared page if the document has it, else the first whose text holds the first fifty characters; NULL if none."""
    hit = F.array_position(F.transform(pages, lambda p: F.lower(p).contains(F.lower(F.left(text, F.lit(50))))), F.lit(True)).cast("int")
    return F.when(wanted.between(1, F.size(pages)), wanted).when(hit > 0, hit)


def without_nul(text: Column) -> Column:
    return F.replace(text, F.lit("\u0000"), F.lit(""))


def travel_minutes(km: Column, speed: int = 60) -> Column:
    return F.bround(km / speed * 60).cast("int")


def euros(amount: Column) -> Column:
    """Whole euros as French readers write them: narrow blanks between thousands, a blank before the sign."""
    return F.concat(F.replace(F.format_number(amount, 0), F.lit(","), F.lit("\u202f")), F.lit("\u00a0€"))


def default_name(first: Column, last: Column, email: Column) -> Column:
    whole = F.trim(F.concat_ws(" ", first, last))
    return F.when(whole != "", whole).otherwise(F.substring_index(email, "@", 1))


def bullets(text: Column) -> Column:
    """Non-blank lines as ``bullet`` and ``runs`` of ``text`` and ``bold``."""
    mark = "\u0001"
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.regexp_replace(x, r"\s+$", "")), lambda x: x != "")

    def parsed(line: Column) -> Column:
        bullet = line.rlike(r"^[-*]\s+")
        content = F.when(bullet, F.regexp_replace(line, r"^[-*]\s+", "")).otherwise(line)
        parts = F.split(F.regexp_replace(F.replace(content, F.lit(mark), F.lit("")), r"\*\*.*?\*\*", f"{mark}$0{mark}"), mark)
        run = lambda p, i: F.struct(F.when(i % 2 == 1, F.substring(p, F.lit(3), F.char_length(p) - 4)).otherwise(p).alias("text"), (i % 2 == 1).alias("bold"))
        return F.struct(bullet.alias("bullet"), F.filter(F.transform(parts, run), lambda r: (r["text"] != "") | r["bold"]).alias("runs"))

    return F.transform(lines, parsed)


def without_front_matter(text: Column) -> Column:
    end = F.locate("---", text, 4)
    return F.when(text.startswith("---") & (end > 0), F.regexp_replace(F.substring(text, end + 3, F.char_length(text)), r"^\n+", "")).otherwise(text)


def markdown_section(text: Column, header: str) -> Column:
    """From the first heading that holds ``header`` to the next of its level or above; front matter is left out."""
    body = without_front_matter(text)
    state = F.struct(F.array().cast("array<string>").alias("out"), F.lit(0).alias("level"), F.lit(False).alias("done"))

    def step(s: Column, line: Column) -> Column:
        level = F.char_length(F.regexp_extract(line, "^(#*)", 1))
        inside, heading = s["level"] > 0, level > 0
        done = s["done"] | (inside & heading & (level <= s["level"]))
        opens = ~inside & heading & F.lower(line).contains(header.lower())
        keep = ~done & (inside | opens)
        return F.struct(
            F.when(keep, F.concat(s["out"], F.array(line))).otherwise(s["out"]).alias("out"), F.when(opens, level).otherwise(s["level"]).alias("level"), done.alias("done")
        )

    return F.regexp_replace(F.aggregate(F.split(body, "\n"), state, step, lambda s: F.array_join(s["out"], "\n")), r"^\s+|\s+$", "")


def disposition(name: Column) -> Column:
    """Content disposition of a download: an ASCII name and the percent-encoded one."""
    plain = F.regexp_replace(name, r"[^\x00-\x7F]", "?")
    coded = F.replace(F.replace(F.replace(F.url_encode(name), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))
    return F.concat(F.lit('inline; filename="'), F.replace(plain, F.lit('"'), F.lit("")), F.lit("\"; filename*=UTF-8''"), coded)


#: Pieces that cover a text: braces outside strings, what lies between them, and a string without an end.
_BRACE_PIECE = r"""(?s)[{}]|(?:[^{}"]++|"(?:[^"\\]++|\\.)*+")++|".*+"""


def first_object(text: Column) -> Column:
    """The first JSON object in a text, by counting braces outside strings; NULL if none is closed."""
    pieces = F.regexp_extract_all(F.substring(text, F.instr(text, "{"), F.char_length(text)), F.lit(_BRACE_PIECE), F.lit(0))
    state = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("i"), F.lit(0).alias("end"))

    def step(s: Column, piece: Column) -> Column:
        i, depth = s["i"] + F.char_length(piece), s["depth"] + F.when(piece == "{", 1).when(piece == "}", -1).otherwise(0)
        here = F.struct(depth.alias("depth"), i.alias("i"), F.when((piece == "}") & (depth == 0), i).otherwise(0).alias("end"))
        return F.when(s["end"] > 0, s).otherwise(here)

    end = F.aggregate(pieces, state, step, lambda s: F.nullif(s["end"], F.lit(0)))
    return F.when(F.instr(text, "{") > 0, F.substring(text, F.instr(text, "{"), end))


#: Pieces of a JSON text: whole and cut-off strings in either quotes, brackets and marks, and bare words with the blanks within.
_JSON_PIECE = r"""(?s)"(?:[^"\\]++|\\.)*+(?:"|\\?\z)|'(?:[^'\\]++|\\.)*+(?:'(?=\s*[:,}\]])|\\?\z)|[{}\[\],:]|[^\s{}\[\],:"](?:[^{}\[\],:"\n]*[^\s{}\[\],:"])?"""


def _json_string(piece: Column) -> Column:
    """A string of JSON from a quoted or bare piece; line breaks and tabs within are escaped, a cut-off end is closed."""
    quote = F.left(piece, F.lit(1))
    quoted = quote.isin('"', "'")
    body = F.when(quoted, F.substring(piece, F.lit(2), F.char_length(piece))).otherwise(piece)
    body = F.when(quoted & F.endswith(body, quote) & ~body.rlike(r"(?<!\\)(?:\\\\)*\\.\z"), F.left(body, F.char_length(body) - 1)).otherwise(body)
    body = F.regexp_replace(body, r"(?<!\\)((?:\\\\)*)\\(?:u[0-9A-Fa-f]{0,3})?\z", "$1")
    body = F.when(quote == "'", F.regexp_replace(F.replace(body, F.lit("\\'"), F.lit("'")), '(?<!\\\\)"', '\\\\"')).otherwise(body)
    body = F.when(quoted, body).otherwise(F.replace(body, F.lit("\\"), F.lit("\\\\")))
    for raw, spelt in (("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        body = F.replace(body, F.lit(raw), F.lit(spelt))
    return F.when(piece.rlike(r'\A"[^"\\\n\r\t]*+"\z'), piece).otherwise(F.concat(F.lit('"'), body, F.lit('"')))


def _json_scalar(piece: Column) -> Column:
    low = F.lower(piece)
    word = F.when(low.isin("true", "false", "null"), low).when(low == "none", "null")
    return F.when(piece.rlike(r"^-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?$"), piece).otherwise(F.coalesce(word, _json_string(piece)))


def repaired_json(text: Column) -> Column:
    """The object that begins at the first brace, as JSON, whatever of it is there.

    An automaton passes over the pieces with a stack of open brackets and what
    it waits for next: a key, a colon, a value or a separator.  Cut-off strings
    and open brackets are closed, bare keys and words quoted, missing colons,
    commas and values put in (a missing value is an empty text), spare commas
    dropped, brackets that do not match closed in order, and what follows the
    object is left out.  NULL without a brace.
    """
    pieces = F.regexp_extract_all(F.substring(text, F.instr(text, "{"), F.char_length(text)), F.lit(_JSON_PIECE), 0)
    state = lambda out, stack, wants, done: F.struct(out.alias("out"), stack.alias("stack"), wants.alias("wants"), done.alias("done"))
    no = F.lit(False)

    def whole(s: Column) -> Column:
        """What is written so far, fit for a closing bracket."""
        bare = F.regexp_replace(s["out"], ",$", "")
        return F.when(s["wants"] == ":", F.concat(s["out"], F.lit(':""'))).when((s["wants"] == "v") & s["out"].endswith(":"), F.concat(s["out"], F.lit('""'))).otherwise(bare)

    def closed(s: Column, opening: str, closing: str, other: str) -> Column:
        """The nearest bracket of the kind is closed, and those opened since."""
        last = F.char_length(s["stack"]) + 1 - F.instr(F.reverse(s["stack"]), opening)
        out = F.concat(whole(s), F.repeat(F.lit(other), F.char_length(s["stack"]) - last), F.lit(closing))
        return F.when(F.instr(s["stack"], opening) == 0, s).otherwise(state(out, F.left(s["stack"], last - 1), F.lit(","), last == 1))

    def step(s: Column, piece: Column) -> Column:
        wants, inside = s["wants"], F.substring(s["stack"], -1, 1)
        after = F.when(inside == "{", "k").otherwise("v")
        # A key or value where a separator or colon should be has that put before it.
        missing = F.when(wants == ",", ",").when(wants == ":", ":").otherwise("")
        place = F.when(wants == ",", after).when(wants == ":", "v").otherwise(wants)
        before = F.concat(s["out"], missing)
        opened = state(F.concat(before, piece), F.concat(s["stack"], piece), F.when(piece == "{", "k").otherwise("v"), no)
        comma = F.when((wants == "v") & s["out"].endswith(":"), F.concat(s["out"], F.lit('"",'))).when(wants == ":", F.concat(s["out"], F.lit(':"",'))).when(wants == ",", F.concat(s["out"], F.lit(",")))
        word = F.when(place == "k", _json_string(piece)).otherwise(F.when(piece.rlike("^[\"']"), _json_string(piece)).otherwise(_json_scalar(piece)))
        return (
            F.when(s["done"], s)
            .when(piece.isin("{", "["), F.when((place == "k") & (F.char_length(s["stack"]) > 0), s).otherwise(opened))
            .when(piece == "}", closed(s, "{", "}", "]")).when(piece == "]", closed(s, "[", "]", "}"))
            .when(piece == ",", F.when(comma.isNull(), s).otherwise(state(F.coalesce(comma, s["out"]), s["stack"], after, no)))
            .when(piece == ":", F.when(wants == ":", state(F.concat(s["out"], F.lit(":")), s["stack"], F.lit("v"), no)).otherwise(s))
            .otherwise(state(F.concat(before, word), s["stack"], F.when(place == "k", ":").otherwise(","), no))
        )

    end = lambda s: F.when(s["done"], s["out"]).otherwise(F.concat(whole(s), F.translate(F.reverse(s["stack"]), "{[", "}]")))
    start = state(F.lit(""), F.lit(""), F.lit("v"), no)
    return F.when(F.instr(text, "{") > 0, F.aggregate(pieces, start, step, end))


def lenient_json(text: Column, skeleton: str) -> Column:
    """The first object of a text as JSON, repaired if it does not parse; the skeleton without one."""
    # Each candidate is made once: the filter tells whether the one of its array parses.
    valid = lambda x: F.get(F.filter(F.array(x), lambda y: F.try_parse_json(y).isNotNull()), F.lit(0))
    return F.coalesce(valid(first_object(text)), valid(repaired_json(text)), F.lit(skeleton))


def whole_days(at: Column, now: Column) -> Column:
    """Whole days from ``now`` to ``at``, cut toward zero."""
    return F.timestamp_diff("DAY", now, at).cast("int")
