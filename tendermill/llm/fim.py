"""Fill-in-the-middle transformation by a counted-quantifier regular expression.

A text is a run of units, one code point each unless told otherwise, matched
from the left.  ``regexp_count`` gives their number n; hashes of the id choose
two cuts a <= b; and one match of a pattern made for the row,
``\\A((?:unit){a}+)((?:unit){b-a}+)(.*)\\z``, captures prefix, middle and suffix
and puts them in their new order with the sentinels between.  Possessive groups
are loops without backtracking, so neither time nor stack grows with more than
the text.  Units are counted by blocks of ``COUNTED`` first and singly in what
is left, so that the count holds no array of all of them.

Rows do not depend on each other and there is no shuffle.

Defined results: NULL and empty texts, texts that hold a sentinel and those that
chance leaves out are ``plain`` (NULL gives an empty output); the same id and
text always give the same output, so repeated rows are equal; a NULL id counts
as an empty one; text that no unit matches belongs to the suffix; other columns
pass through, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tendermill.llm.common import let

#: One code point; a unit must match at least one character.
CODE_POINT = r"(?s:.)"
#: Of prefix, suffix and middle; they begin with ``<``, which no pattern treats specially.
SENTINELS = ("<P>", "<S>", "<M>")
#: Percent of texts that are transformed, and percent of these in the order suffix, prefix, middle.
RATE, SPM = 90, 20
SEED = 1
#: Units in a block that is counted at once.
COUNTED = 64


def count_units(text: Column, unit: str = CODE_POINT, block: int = COUNTED) -> Column:
    """Number of units that follow each other from the start of ``text``."""
    blocks = F.regexp_count(text, F.lit(rf"\G(?:{unit}){{{block}}}+"))
    rest = F.regexp_extract(text, rf"(?s)\A(?:(?:{unit}){{{block}}}+)*+(.*)\z", 1)
    return (blocks.cast("long") * block + F.regexp_count(rest, F.lit(rf"\G(?:{unit})"))).cast("long")


def _draws(doc_id: Column, seed: int) -> list[Column]:
    """Four unsigned 32-bit numbers from the sha256 of ``seed:doc_id``."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]


def _spelt(text: str) -> str:
    """``text`` as a replacement that stands for itself."""
    return text.replace("\\", "\\\\").replace("$", "\\$")


def transform(
    docs: DataFrame, unit: str = CODE_POINT, sentinels: tuple[str, str, str] = SENTINELS, rate: int = RATE, spm: int = SPM, seed: int = SEED
) -> DataFrame:
    """``row`` (the input's columns), ``n`` units, ``form`` (plain, psm or spm) and ``output`` of each row."""
    p, s, m = sentinels
    if len(set(sentinels)) < 3 or any(not x or (x != y and x in y) for x in sentinels for y in sentinels):
        raise ValueError("sentinels must be three texts none of which holds another")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    rows = rows.withColumn("text", F.coalesce(F.col("row.text"), F.lit("")))
    rows = rows.withColumn("n", count_units(F.col("text"), unit))
    h1, h2, h3, h4 = _draws(F.col("row.doc_id"), seed)
    at = [F.pmod(h, F.col("n") + 1) for h in (h1, h2)]
    plain = (F.col("n") == 0) | F.col("text").contains(p) | F.col("text").contains(s) | F.col("text").contains(m) | (F.pmod(h3, F.lit(100)) >= rate)
    form = F.when(plain, "plain").when(F.pmod(h4, F.lit(100)) < spm, "spm").otherwise("psm")
    rows = rows.select("row", "text", "n", form.alias("form"), F.least(*at).alias("a"), F.greatest(*at).alias("b"))
    group = lambda n: F.concat(F.lit(f"((?:{unit}){{"), n.cast("string"), F.lit("}+)"))
    pattern = F.concat(F.lit(r"\A"), group(F.col("a")), group(F.col("b") - F.col("a")), F.lit(r"((?s:.*))\z"))
    psm, spm_order = f"{_spelt(p)}$1{_spelt(s)}$3{_spelt(m)}$2", f"{_spelt(s)}$3{_spelt(p)}$1{_spelt(m)}$2"
    order = F.when(F.col("form") == "spm", spm_order).otherwise(psm)
    output = F.when(F.col("form") == "plain", F.col("text")).otherwise(F.regexp_replace(F.col("text"), pattern, order))
    return rows.select("row", "n", "form", output.alias("output"))


def parts(output: Column, form: Column, sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """Struct of ``prefix``, ``middle`` and ``suffix``, NULL for plain outputs."""
    cut = F.split(output, "|".join(rf"\Q{x}\E" for x in sentinels))
    named = lambda x, order: F.struct(*[F.get(x, F.lit(i)).alias(c) for c, i in zip(("prefix", "middle", "suffix"), order)])
    return F.when(form != "plain", let(cut, lambda x: F.when(form == "psm", named(x, (1, 3, 2))).otherwise(named(x, (2, 3, 1)))))


def restored(output: Column, form: Column, sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The text that ``output`` was made of."""
    return F.when(form == "plain", output).otherwise(let(parts(output, form, sentinels), _rejoined))


def _rejoined(parts: Column) -> Column:
    return F.concat(parts["prefix"], parts["middle"], parts["suffix"])


def digests(docs: DataFrame) -> DataFrame:
    """Counts and digests of outputs and of the texts restored from them."""
    form, output, cut = F.col("form"), F.col("output"), F.col("parts")
    made = transform(docs).withColumn("parts", parts(output, form))
    chars = lambda c: F.char_length(cut[c]).cast("long").alias(f"{c}_chars")
    sha = lambda x: F.sha2(x.cast("binary"), 256)
    again = F.when(form == "plain", output).otherwise(_rejoined(cut))
    return made.select(
        F.col("row.doc_id").alias("doc_id"), "n", "form", chars("prefix"), chars("middle"), sha(output).alias("output_sha256"), sha(again).alias("restored_sha256")
    )
