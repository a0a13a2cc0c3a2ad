"""Quality rules as weak supervision: rules vote or abstain, EM weighs them.

Every rule looks at a few counts of the whole text and votes good (1), bad (-1)
or abstains (0).  Expectation-maximisation over the table of vote patterns (at
most ``3 ** len(RULES)`` rows, whatever the corpus) estimates how often each
rule is right about good and about bad documents; the posterior probability of
a good document replaces the conjunction of all rules.

Everything is DataFrame expressions: word windows are arrays inside a row, so
nothing but the pattern counts is shuffled.

Defined results: NULL and empty texts have no words and fail the base rule;
NULL ids are kept as they are; repeated rows are judged one by one; an empty
table gives an empty result; columns other than ``doc_id`` and ``text`` are
ignored by :func:`judge` and passed through by :func:`keep`.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tendermill.llm.common import WORD, let, materialise, words_of

WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
ITERATIONS = 20
#: EM starts from a corpus that is mostly good.
START = 0.9
BOUND = 0.001
#: What rules are believed to do, and the weight of that belief in corpora.
BELIEF_GOOD, BELIEF_BAD, STRENGTH = 0.995, 0.3, 0.1


@dataclass(frozen=True)
class Rule:
    """Votes bad above ``bad``, good up to ``good``, abstains between; ``per`` is the denominator."""

    name: str
    count: str
    per: str
    good: float
    bad: float


RULES = (
    Rule("symbols", "n_symbols", "n_words", 0.01, 0.10),
    Rule("repeats", "n_repeat_words", "n_words", 0.05, 0.30),
    Rule("lines", "n_dup_lines", "n_lines", 0.0, 0.30),
    Rule("capitals", "n_upper", "word_chars", 0.12, 0.30),
    Rule("shouting", "n_shouts", "n_words", 0.01, 0.10),
    Rule("bars", "n_bars", "n_words", 0.01, 0.10),
    Rule("long_words", "word_chars", "n_words", 9.0, 14.0),
)

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _window_hashes() -> Column:
    """Hash of every window: hashes of one word are joined to two, four and eight."""
    both = lambda x, y: F.xxhash64(x, y)
    from_ = lambda h, at: F.slice(h, at + 1, F.greatest(F.size("words"), F.lit(1)))
    hashes = F.transform("words", lambda w: F.xxhash64(w))
    for size in (1, 2, 4):
        hashes = let(hashes, lambda h: F.zip_with(h, from_(h, size), both))  # noqa: B023
    return F.when(F.size("words") >= WINDOW, F.slice(hashes, F.lit(1), F.greatest(F.size("words") - WINDOW + 1, F.lit(0))))


def with_counts(df: DataFrame) -> DataFrame:
    """Add the counts that the rules read; ``text`` must be a column of ``df``."""
    text = F.coalesce(F.col("text"), F.lit(""))
    df = df.withColumn("words", words_of(F.col("text"))).withColumn("hashes", _window_hashes())
    may_repeat = F.size(F.array_distinct("hashes")) < F.size("hashes")
    # Hashes only rule repeats out; windows that share one compare the words themselves.
    pairs = F.transform("hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    df = df.withColumn("pairs", F.when(may_repeat, F.sort_array(pairs))).drop("hashes")
    twin = lambda x, k: F.coalesce(F.get("pairs", k)["h"] == x["h"], F.lit(False))
    df = df.withColumn("pairs", F.filter("pairs", lambda x, k: twin(x, k - 1) | twin(x, k + 1)))
    gram = lambda i: F.array_join(F.slice("words", i + 1, WINDOW), " ")
    grams = F.transform("pairs", lambda x: F.struct(x["h"].alias("h"), gram(x["i"]).alias("g"), x["i"].alias("i")))
    df = df.withColumn("grams", F.sort_array(grams)).drop("pairs")
    same = lambda x, k: F.get("grams", k)["g"] == x["g"]
    at = F.filter("grams", lambda x, k: F.coalesce(same(x, k - 1), F.lit(False)) | F.coalesce(same(x, k + 1), F.lit(False)))
    df = df.withColumn("at", F.sort_array(F.transform(at, lambda x: x["i"]))).drop("grams")
    covered = F.aggregate(
        "at",
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
        lambda s, i: F.struct((s["n"] + i + WINDOW - F.greatest(i, s["end"])).alias("n"), (i + WINDOW).alias("end")),
        lambda s: s["n"],
    )
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD))
    joined = F.array_join("words", "")
    df = df.withColumns({"lines": lines, "joined": joined, "n_repeat_words": F.coalesce(covered, F.lit(0)).cast("long")})
    # The characters that rules count, in a string of their own, which is short.
    marks = F.regexp_replace("joined", r"[^#*$%&|<>!?A-Z]+", "")
    df = df.withColumn("marks", marks)
    return df.withColumns(
        {
            "n_words": F.size("words").cast("long"),
            "word_chars": F.char_length("joined").cast("long"),
            "n_symbols": F.regexp_count("marks", F.lit(r"[#*$%&|<>]")).cast("long"),
            "n_lines": F.size("lines").cast("long"),
            "n_dup_lines": (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"),
            "n_upper": F.regexp_count("marks", F.lit(r"[A-Z]")).cast("long"),
            "n_shouts": F.regexp_count("marks", F.lit(r"[!?]")).cast("long"),
            "n_bars": F.regexp_count("marks", F.lit(r"[|]")).cast("long"),
        }
    ).drop("words", "at", "lines", "joined", "marks")


def vote(rule: Rule) -> Column:
    """1, -1 or 0; a text without the denominator abstains."""
    share = F.col(rule.count) / F.col(rule.per)
    return F.when(F.col(rule.per) == 0, 0).when(share > rule.bad, -1).when(share <= rule.good, 1).otherwise(0).cast("int")


def with_votes(df: DataFrame) -> DataFrame:
    return df.withColumns({f"v_{r.name}": vote(r) for r in RULES})


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def posterior(votes, state: Column) -> Column:
    """Probability of a good document; ``votes(j)`` is the vote of rule j."""
    odds = F.ln(state["prior"] / (1 - state["prior"]))
    for j in range(len(RULES)):
        g, b = F.get(state["good"], F.lit(j)), F.get(state["bad"], F.lit(j))
        odds = odds + F.when(votes(j) == 1, F.ln(g / (1 - b))).when(votes(j) == -1, F.ln((1 - g) / b)).otherwise(0.0)
    return 1 / (1 + F.exp(-odds))


def learn(voted: DataFrame, iterations: int = ITERATIONS) -> DataFrame:
    """EM over the vote patterns of ``voted``: one row ``state(prior, good, bad)``.

    ``good[j]`` is how often rule j, if it votes, says good of a good document,
    ``bad[j]`` how often it says bad of a bad one.  Both are drawn to a prior
    belief as strong as the corpus: rules seldom fire on good documents, and
    each sees only some kinds of bad ones.  The patterns fit in one array, so a
    step is an expression over it.
    """
    v = F.array(*[F.col(f"v_{r.name}") for r in RULES])
    patterns = voted.groupBy(v.alias("v")).count().select("v", F.col("count").cast("double").alias("n"))
    table = patterns.agg(F.array_sort(F.collect_list(F.struct("v", "n"))).alias("t"))
    table = table.withColumn("all", F.aggregate("t", F.lit(0.0), lambda s, x: s + x["n"]))
    rules = range(len(RULES))
    total = F.greatest(F.col("all"), F.lit(1.0))

    def step(state: Column, _: Column) -> Column:
        weigh = lambda x: F.struct(x["v"], x["n"], (x["n"] * posterior(lambda j: F.get(x["v"], F.lit(j)), state)).alias("p"))

        def update(t: Column) -> Column:
            def rate(j: int, value: int, weight, belief: float) -> Column:
                hit = F.aggregate(t, F.lit(0.0), lambda s, x: s + F.when(F.get(x["v"], F.lit(j)) == value, weight(x)).otherwise(0.0))
                cast = F.aggregate(t, F.lit(0.0), lambda s, x: s + F.when(F.get(x["v"], F.lit(j)) != 0, weight(x)).otherwise(0.0))
                return (hit + belief * STRENGTH * total) / (cast + STRENGTH * total)

            good = [rate(j, 1, lambda x: x["p"], BELIEF_GOOD) for j in rules]
            bad = [rate(j, -1, lambda x: x["n"] - x["p"], BELIEF_BAD) for j in rules]
            prior = F.aggregate(t, F.lit(0.0), lambda s, x: s + x["p"]) / total
            clip = F.least(F.lit(1 - BOUND), F.greatest(F.lit(BOUND), prior))
            return F.struct(clip.alias("prior"), F.array(*good).alias("good"), F.array(*bad).alias("bad"))

        # A one-element array evaluates the weighted patterns once for all rates.
        return F.get(F.transform(F.array(F.transform("t", weigh)), update), F.lit(0))

    level = lambda x: F.array(*[F.lit(x)] * len(RULES))
    start = F.struct(F.lit(START).alias("prior"), level(BELIEF_GOOD).alias("good"), level(BELIEF_BAD).alias("bad"))
    return table.select(F.aggregate(F.sequence(F.lit(1), F.lit(iterations)), start, step).alias("state"))


def with_posterior(voted: DataFrame, learnt: DataFrame) -> DataFrame:
    """Add ``p_good``; ``learnt`` is one row, which goes to every task."""
    state = materialise(learnt.coalesce(1), "accuracies").select(F.struct("state.*").alias("state"))
    both = voted.join(F.broadcast(state), F.lit(True))
    return both.withColumn("p_good", posterior(lambda j: F.col(f"v_{RULES[j].name}"), F.col("state"))).drop("state")


def judge(docs: DataFrame) -> DataFrame:
    """One row a document: counts, base verdict, posterior and ``kept``."""
    counted = with_counts(docs.select("doc_id", "text")).drop("text")
    voted = materialise(with_votes(counted), "counts")
    scored = with_posterior(voted, learn(voted))
    kept = (~base_failed() & (F.col("p_good") >= 0.5)).alias("kept")
    return scored.select("doc_id", *BASE, base_failed().alias("base_failed"), kept, F.round("p_good", 4).alias("p_good"))


def keep(docs: DataFrame) -> DataFrame:
    """The documents that pass, with the columns of ``docs``.

    Counts and texts are written once; the estimation reads the votes alone.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    counted = with_counts(docs.select(row, F.col("text"))).drop("text")
    voted = materialise(with_votes(counted), "counted-rows")
    scored = with_posterior(voted, learn(voted))
    return scored.where(~base_failed() & (F.col("p_good") >= 0.5)).select("row.*")
