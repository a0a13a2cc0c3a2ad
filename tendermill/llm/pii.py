"""Format-preserving pseudonyms for personal data, in SQL expressions only.

One regular expression marks candidates in the whole text, each candidate is
validated (check digits, calendar, ranges) and a keyed Feistel network permutes
the valid ones within their format: card numbers stay valid card numbers of the
same layout, dates stay dates, addresses stay addresses.  A permutation maps
equal values to equal pseudonyms and different values to different ones, so
records stay linked across documents without any shared table.  E-mail names
and secrets have no number format; they get a keyed digest of fixed form.

No row depends on another, so there is no shuffle.  The key is the first line of
the file that the setting ``spark.tendermill.pii.key.file`` names, or the setting
``spark.tendermill.pii.key``, or a parameter; anybody without it cannot invert the
permutation.  Without any, an application draws a key of its own, which it keeps
in the shared folder: its pseudonyms are linked within the application alone.
The key is read by a subquery where it is used, and so is in no plan or log.

Left out: national phone numbers other than of three, three and four digits, and
secrets without a name (token, password) or the prefix AKIA.

Defined results: NULL texts stay NULL, empty texts stay empty, candidates that
fail validation stay as they are, repeated rows are treated alike and other
columns pass through.
"""

from __future__ import annotations

import secrets
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tendermill.llm.common import let, shared_dir

ROUNDS = 8
KEY_SETTING = "spark.tendermill.pii.key"
KEY_FILE_SETTING = "spark.tendermill.pii.key.file"

#: Marks around candidates; a text's own marks are escaped before and restored after.
MARK, ESC = "\u0001", "\u0002"

# An address begins where a run of its characters does, or where the candidate before ends: no run is read twice.
EMAIL = r"(?:\G|(?<![A-Za-z0-9À-ɏ._%+-]))[A-Za-z0-9À-ɏ._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"
IP = r"(?:\d{1,3}\.){3}\d{1,3}"
IBAN = r"[A-Z]{2}\d{2}[A-Z0-9]{11,30}|[A-Z]{2}\d{2}(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?(?! ?[A-Z0-9])"
# A number's groups share one separator, and none of them begins another value that follows it.
CARD = r"\d{13,19}|\d{4} \d{4} \d{4} \d{1,4}|\d{4}-\d{4}-\d{4}-\d{1,4}|\d{4} \d{6} \d{5}|\d{4}-\d{6}-\d{5}"
NATIONAL = r"\(\d{3}\) ?\d{3}[ .-]\d{4}|[2-9]\d{2}-[2-9]\d{2}-\d{4}|[2-9]\d{2}\.[2-9]\d{2}\.\d{4}"
NO_CARD = r"(?!\d{4} \d{4} \d{4} \d|\d{4}-\d{4}-\d{4}-\d|\d{4}[ -]\d{6}[ -]\d{5})"
PHONE = (
    r"\+\d{1,3}[ .-]?\(\d{1,4}\)[ .-]?\d{3,4}[ .-]?\d{4}|"
    r"\+\d{1,3}(?: " + NO_CARD + r"\d{1,4}(?![\d]|[.-]\d)){2,5}|\+\d{1,3}(?:\.\d{1,4}){2,5}|\+\d{1,3}(?:-\d{1,4}){2,5}|\+\d{7,15}"
)
SSN = r"\d{3}-\d{2}-\d{4}"
ISO_DATE = r"\d{4}-\d{2}-\d{2}"
DMY_DATE = r"\d{2}[./]\d{2}[./]\d{4}"
# Names in any case; = or : with or without blanks, and quotes around the value.
SECRET_HEAD = r"(?:(?i:token)\s{0,3}[=:]\s{0,3}[\"']?(?=[0-9A-Fa-f]{16})|(?i:password)\s{0,3}[=:]\s{0,3}[\"']?|(?i:AKIA)(?=[0-9A-Za-z]{16}(?![0-9A-Za-z])))"
SECRET = (
    r"(?:(?i:token)\s{0,3}[=:]\s{0,3}(?:\"[0-9A-Fa-f]{16,}\"|'[0-9A-Fa-f]{16,}'|[0-9A-Fa-f]{16,})|"
    r"(?i:password)(?:=|\s{0,3}[=:]\s{0,3}(?=[\"'])|\s{0,3}[=:]\s{0,3}(?=\S*[0-9]))(?:\"[^\s\"|]{6,}\"|'[^\s'|]{6,}'|[^\s\"'|][^\s\"|]{5,})|"
    r"AKIA[0-9A-Z]{16}|(?<![A-Za-z0-9])akia[0-9a-z]{16}(?![A-Za-z0-9]))"
)

EDGE_LEFT, EDGE_RIGHT = r"(?<![A-Za-z0-9@])(?<![0-9][.,-])", r"(?![A-Za-z0-9@])(?![.,-][0-9])"
PHONE_LEFT = r"(?<![A-Za-z0-9+])"
CANDIDATE = (
    f"{SECRET}|{EMAIL}|{PHONE_LEFT}(?:{PHONE})(?![0-9])|{EDGE_LEFT}(?:{NATIONAL}){EDGE_RIGHT}|"
    f"{EDGE_LEFT}(?:{IP}|{IBAN}|{SSN}|{ISO_DATE}|{DMY_DATE}|{CARD}){EDGE_RIGHT}"
)


def _prf(key: Column, *parts: Column) -> Column:
    """Keyed pseudo-random 60-bit number of ``parts``."""
    digest = F.sha2(F.concat_ws("/", key, *[p.cast("string") for p in parts]), 256)
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint")


def feistel(key: Column, tag: Column, a: Column, b: Column, size_a: Column, size_b: Column) -> Column:
    """Permute pairs (a, b) of ``[0, size_a) x [0, size_b)``; the inverse subtracts in reverse order.

    Rounds alternately add to one part a keyed function of the other.
    """
    state = lambda x, y: F.struct(x.cast("bigint").alias("a"), y.cast("bigint").alias("b"))

    def step(s: Column, r: Column) -> Column:
        to_a = F.pmod(s["a"] + _prf(key, tag, r, s["b"]), size_a.cast("bigint"))
        to_b = F.pmod(s["b"] + _prf(key, tag, r, s["a"]), size_b.cast("bigint"))
        return F.when(r % 2 == 0, state(to_a, s["b"])).otherwise(state(s["a"], to_b))

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), state(a, b), step)


def _pow10(n: Column) -> Column:
    return F.rpad(F.lit("1"), n + 1, "0").cast("bigint")


def permute_digits(key: Column, tag: str, digits: Column) -> Column:
    """Permutation of the digit strings of one length (2 to 34 digits)."""
    n = F.char_length(digits)
    left = F.floor(n / 2).cast("int")
    right = n - left
    a = F.substring(digits, F.lit(1), left).cast("bigint")
    b = F.substring(digits, left + 1, right).cast("bigint")
    pair = feistel(key, F.concat(F.lit(tag), n.cast("string")), a, b, _pow10(left), _pow10(right))
    return let(pair, lambda z: F.concat(F.lpad(z["a"].cast("string"), left, "0"), F.lpad(z["b"].cast("string"), right, "0")))


def digits_of(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def refill(layout: Column, digits: Column) -> Column:
    """``layout`` with its digits replaced by ``digits``, in order."""
    at = lambda i: F.substring(layout, i, F.lit(1))
    nth = lambda i: F.char_length(digits_of(F.substring(layout, F.lit(1), i)))

    def filled(d: Column) -> Column:
        one = lambda i: F.when(at(i).between("0", "9"), F.substring(d, nth(i), F.lit(1))).otherwise(at(i))
        return F.array_join(F.transform(F.sequence(F.lit(1), F.char_length(layout)), one), "")

    return F.when(layout.rlike("^[0-9]*$"), digits).otherwise(let(digits, filled))


def luhn_sum(digits: Column) -> Column:
    """Luhn sum, the last digit counting once."""
    n = F.char_length(digits)

    def term(i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return F.when((n - i) % 2 == 1, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda s, i: s + term(i))


def card(key: Column, text: Column) -> Column:
    check = lambda body: F.pmod(10 - luhn_sum(F.concat(body, F.lit("0"))) % 10, F.lit(10)).cast("string")

    def swapped(digits: Column) -> Column:
        body = permute_digits(key, "card", F.substring(digits, F.lit(1), F.char_length(digits) - 1))
        return F.when(luhn_sum(digits) % 10 == 0, refill(text, let(body, lambda b: F.concat(b, check(b))))).otherwise(text)

    return let(digits_of(text), swapped)


def ip(key: Column, text: Column) -> Column:
    part = lambda i: F.get(F.split(text, r"\."), F.lit(i)).cast("int")
    valid = (part(0) < 256) & (part(1) < 256) & (part(2) < 256) & (part(3) < 256)
    size = F.lit(1 << 16)
    pair = feistel(key, F.lit("ip"), part(0) * 256 + part(1), part(2) * 256 + part(3), size, size)
    halves = lambda x: [F.floor(x / 256).cast("string"), (x % 256).cast("string")]
    return F.when(valid, let(pair, lambda z: F.concat_ws(".", *halves(z["a"]), *halves(z["b"])))).otherwise(text)


def mod97(text: Column) -> Column:
    """Remainder of the number that spells A to Z as 10 to 35."""

    def step(s: Column, i: Column) -> Column:
        c = F.ascii(F.substring(text, i, F.lit(1)))
        return F.when(c >= 65, (s * 100 + c - 55) % 97).otherwise((s * 10 + c - 48) % 97)

    return F.aggregate(F.sequence(F.lit(1), F.char_length(text)), F.lit(0), step)


def iban(key: Column, text: Column) -> Column:
    """Grouped values get the pseudonym of the unspaced form in their own groups."""
    spaced = lambda n: F.trim(F.regexp_replace(n, "(.{4})", "$1 "))
    told = lambda p, n: F.when(n == p, text).when(text.contains(" "), spaced(n)).otherwise(n)
    return let(F.replace(text, F.lit(" "), F.lit("")), lambda p: let(_iban(key, p), lambda n: told(p, n)))


def _iban(key: Column, text: Column) -> Column:
    country, bban = F.substring(text, 1, 2), F.substring(text, F.lit(5), F.char_length(text) - 4)
    valid = (mod97(F.concat(bban, F.substring(text, 1, 4))) == 1) & (F.char_length(digits_of(bban)) >= 2)
    check = lambda b: F.lpad((98 - mod97(F.concat(b, country, F.lit("00")))).cast("string"), 2, "0")
    new = refill(bban, permute_digits(key, "iban", digits_of(bban)))
    return F.when(valid, let(new, lambda b: F.concat(country, check(b), b))).otherwise(text)


def phone(key: Column, text: Column) -> Column:
    """The country code stays; seven digits or more in all are a valid number.

    National numbers have ten digits; without brackets, area and exchange begin with
    2 to 9.  Both first digits stay, so that pseudonyms are such numbers again.
    """
    code = F.regexp_extract(text, r"^\+\d{1,3}(?=[ .(-])", 0)
    code = F.when(code == "", F.substring(text, 1, 3)).otherwise(code)
    rest = F.substring(text, F.char_length(code) + 1, F.char_length(text))
    valid = (F.char_length(digits_of(text)) >= 7) & (F.char_length(digits_of(rest)) >= 4)
    abroad = F.when(valid, F.concat(code, refill(rest, permute_digits(key, "phone", digits_of(rest))))).otherwise(text)

    def national(d: Column) -> Column:
        first, fourth = F.substring(d, 1, 1), F.substring(d, 4, 1)
        new = permute_digits(key, "national", F.concat(F.substring(d, 2, 2), F.substring(d, 5, 6)))
        return let(new, lambda n: F.concat(first, F.substring(n, 1, 2), fourth, F.substring(n, 3, 6)))

    return F.when(text.startswith("+"), abroad).otherwise(refill(text, let(digits_of(text), national)))


def ssn(key: Column, text: Column) -> Column:
    area, group, serial = (F.substring(text, *x).cast("int") for x in ((1, 3), (5, 2), (8, 4)))
    valid = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
    rest = (group - 1) * 9999 + serial - 1
    pair = feistel(key, F.lit("ssn"), area - F.when(area > 666, 2).otherwise(1), rest, F.lit(898), F.lit(99 * 9999))
    pad = lambda c, n: F.lpad(c.cast("string"), n, "0")

    def spelled(z: Column) -> Column:
        new = z["a"] + F.when(z["a"] >= 665, 2).otherwise(1)
        return F.concat_ws("-", pad(new, 3), pad(F.floor(z["b"] / 9999) + 1, 2), pad(z["b"] % 9999 + 1, 4))

    return F.when(valid, let(pair, spelled)).otherwise(text)


def date(key: Column, text: Column, form: str) -> Column:
    """1900 to 2099 are permuted among themselves, other years within their 400-year cycle.

    73049 days are 17 * 4297, 146097 days are 189 * 773: no value leaves its range.
    """
    day = F.try_to_date(text, form)
    recent = F.year(day).between(1900, 2099)
    cycle = F.floor(F.year(day) / 400) * 400
    first = F.when(recent, F.lit("1900-01-01").cast("date")).otherwise(F.make_date(F.greatest(cycle, F.lit(1)), F.lit(1), F.lit(1)))
    size_a, size_b = F.when(recent, 17).otherwise(189), F.when(recent, 4297).otherwise(773)
    off = F.datediff(day, first)
    pair = feistel(key, F.concat(F.lit("date"), first.cast("string")), off % size_a, F.floor(off / size_a), size_a, size_b)
    new = let(pair, lambda z: F.date_add(first, (z["a"] + size_a * z["b"]).cast("int")))
    return F.when(day.isNotNull() & (F.year(day) >= 400), F.date_format(new, form)).otherwise(text)


def email(key: Column, text: Column) -> Column:
    name = F.substring(F.sha2(F.concat_ws("/", key, F.lit("email"), F.lower(text)), 256), 1, 16)
    return F.concat(F.lit("u"), name, F.regexp_extract(text, "@.*$", 0))


def secret(key: Column, text: Column) -> Column:
    digest = F.sha2(F.concat_ws("/", key, F.lit("secret"), text), 256)
    head = F.regexp_extract(text, f"^{SECRET_HEAD}", 0)
    quoted = F.substring(head, -1, 1).isin('"', "'")
    tail = F.when(quoted, F.substring(head, -1, 1)).otherwise("")
    value = F.substring(text, F.char_length(head) + 1, F.char_length(text) - F.char_length(head) - F.char_length(tail))
    new = F.substring(F.repeat(digest, 1 + F.floor(F.char_length(value) / 64).cast("int")), F.lit(1), F.char_length(value))
    capital = (value == F.upper(value)) & value.rlike("[A-Z]") & ~F.lower(head).startswith("password")
    return F.concat(head, F.when((head == "AKIA") | capital, F.upper(new)).otherwise(new), tail)


def kind_of(text: Column) -> Column:
    whole = lambda p: text.rlike(f"^(?:{p})$")
    return (
        F.when(whole(SECRET), "secret").when(whole(EMAIL), "email").when(whole(f"{PHONE}|{NATIONAL}"), "phone").when(whole(IP), "ip")
        .when(whole(IBAN), "iban").when(whole(SSN), "ssn").when(whole(ISO_DATE), "iso").when(whole(DMY_DATE), "dmy")
        .when(whole(CARD), "card")
    )


def pseudonym(key: Column, kind: Column, text: Column) -> Column:
    dotted = F.substring(text, 3, 1) == "."
    return (
        F.when(kind.isNull(), text)
        .when(kind == "secret", secret(key, text)).when(kind == "email", email(key, text)).when(kind == "phone", phone(key, text))
        .when(kind == "ip", ip(key, text)).when(kind == "iban", iban(key, text)).when(kind == "ssn", ssn(key, text))
        .when(kind == "iso", date(key, text, "yyyy-MM-dd"))
        .when((kind == "dmy") & dotted, date(key, text, "dd.MM.yyyy"))
        .when((kind == "dmy") & F.try_to_date(text, "dd/MM/yyyy").isNotNull(), date(key, text, "dd/MM/yyyy"))
        .when(kind == "dmy", date(key, text, "MM/dd/yyyy"))
        .when(kind == "card", card(key, text)).otherwise(text)
    )


@lru_cache(maxsize=64)
def _key_file(folder: str, application: str, key: str) -> str:
    """File in the shared folder that holds a key, or one drawn for the application; the rows are no part of a plan."""
    spark = SparkSession.active()
    path = f"{folder}/pii-key-{secrets.token_hex(8)}"
    spark.createDataFrame([(key or secrets.token_hex(32),)], "value string").coalesce(1).write.text(path)
    return path


def key_column(spark: SparkSession, key: str | None = None) -> Column:
    """The key as a column that a subquery reads."""
    path = None if key else spark.conf.get(KEY_FILE_SETTING, None)
    if not path:
        path = _key_file(shared_dir(spark), spark.sparkContext.applicationId, key or spark.conf.get(KEY_SETTING, None) or "")
    return spark.read.text(path).agg(F.first("value")).scalar()


def pseudonymise(docs: DataFrame, key: str | None = None, found: str | None = None) -> DataFrame:
    """``docs`` with a pseudonymised ``text``; ``found`` names a column for the number of replaced values."""
    if found and found in docs.columns:
        raise ValueError(f"there is a column {found} already")
    cols = docs.columns
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in cols]).alias("row"))
    text = F.col("row.text")
    safe = F.replace(F.replace(text, F.lit(ESC), F.lit(ESC + "b")), F.lit(MARK), F.lit(ESC + "a"))
    marked = F.regexp_replace(safe, CANDIDATE, f"{MARK}$0{MARK}")
    rows = rows.select("row", F.split(marked, MARK).alias("parts"), key_column(docs.sparkSession, key).alias("key"))
    tell = lambda p, i: F.struct(F.when(i % 2 == 1, kind_of(p)).alias("kind"), p.alias("p"))
    rows = rows.withColumn("told", F.when(F.size("parts") > 1, F.transform("parts", tell)))
    rows = rows.withColumn("new", F.coalesce(F.transform("told", lambda t: pseudonym(F.col("key"), t["kind"], t["p"])), "parts"))
    joined = F.array_join("new", "")
    clean = F.replace(F.replace(joined, F.lit(ESC + "a"), F.lit(MARK)), F.lit(ESC + "b"), F.lit(ESC))
    out = [clean.alias(c) if c == "text" else F.col(f"row.`{c}`") for c in cols]
    if found:
        changed = F.filter(F.arrays_zip(F.col("parts").alias("p"), F.col("new").alias("n")), lambda z: z["p"] != z["n"])
        out.append(F.coalesce(F.size(changed), F.lit(0)).cast("long").alias(found))
    return rows.select(*out)
