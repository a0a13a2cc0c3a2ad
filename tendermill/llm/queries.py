"""The queries of the operators of this subpackage, and SQL where SQL can express one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tendermill.llm import ann, bpe, fim, hyperminhash, mixing, passages, phrases, pii, quality_rules, quality_trees, simhash, token_files, toxicity
from tendermill.llm.common import documents

Query = Callable[[SparkSession, str], DataFrame]


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.without_repeats(documents(spark, sf_dir)).drop("kept")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(documents(spark, sf_dir))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.plan(documents(spark, sf_dir))


def op4_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.neighbours(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.components(documents(spark, sf_dir))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.digests(documents(spark, sf_dir), tokenizer_file("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.read(token_files.write(documents(spark, sf_dir), tokenizer_file("byte_bpe_50k.json")))


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(documents(spark, sf_dir), _labels(spark, sf_dir))


def op9_quality_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_trees.classify(documents(spark, sf_dir), _labels(spark, sf_dir))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymise(documents(spark, sf_dir).select("doc_id", "text"), found="n_replaced")


def op11_hyperminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hyperminhash.components(documents(spark, sf_dir))


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(documents(spark, sf_dir))


def op13_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim.digests(documents(spark, sf_dir))


QUERIES: dict[str, Query] = {
    "op1_passages": op1_passages,
    "op2_quality_rules": op2_quality_rules,
    "op3_mixing": op3_mixing,
    "op4_ann": op4_ann,
    "op5_simhash": op5_simhash,
    "op6_bpe": op6_bpe,
    "op7_token_files": op7_token_files,
    "op8_toxicity": op8_toxicity,
    "op9_quality_trees": op9_quality_trees,
    "op10_pii": op10_pii,
    "op11_hyperminhash": op11_hyperminhash,
    "op12_phrases": op12_phrases,
    "op13_fim": op13_fim,
}


def _rule_sql(r: quality_rules.Rule) -> str:
    share = f"{r.count}::DOUBLE / {r.per}"
    return f"CASE WHEN {r.per} = 0 THEN 0 WHEN {share} > {r.bad!r} THEN -1 WHEN {share} <= {r.good!r} THEN 1 ELSE 0 END AS v_{r.name}"


def quality_sql() -> str:
    """Counts by list functions and unnesting, EM by a recursive query."""
    q = quality_rules
    names = [r.name for r in q.RULES]
    votes = ", ".join(f"v_{n}" for n in names)
    clip = lambda x: f"least({1 - q.BOUND!r}, greatest({q.BOUND!r}, {x}))"

    def odds(state: str) -> str:
        terms = [f"ln({state}.prior / (1 - {state}.prior))"]
        for n in names:
            g, b = f"{state}.g_{n}", f"{state}.b_{n}"
            terms.append(f"CASE v_{n} WHEN 1 THEN ln({g} / (1 - {b})) WHEN -1 THEN ln((1 - {g}) / {b}) ELSE 0 END")
        return f"1 / (1 + exp(-({' + '.join(terms)})))"

    start = ", ".join(f"{q.BELIEF_GOOD!r}::DOUBLE AS g_{n}, {q.BELIEF_BAD!r}::DOUBLE AS b_{n}" for n in names)

    def ratio(value: int, weight: str, belief: float, n: str) -> str:
        top = f"coalesce(sum(CASE WHEN v_{n} = {value} THEN {weight} END), 0)"
        cast = f"coalesce(sum(CASE WHEN v_{n} <> 0 THEN {weight} END), 0)"
        return f"({top} + {belief!r}::DOUBLE * {q.STRENGTH!r} * sum(n)) / ({cast} + {q.STRENGTH!r}::DOUBLE * sum(n))"

    steps = ", ".join(
        f"{ratio(1, 'n * p', q.BELIEF_GOOD, x)} AS g_{x}, {ratio(-1, 'n * (1 - p)', q.BELIEF_BAD, x)} AS b_{x}" for x in names
    )
    w = q.WINDOW
    return f"""
WITH RECURSIVE a AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text,
    list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words
  FROM documents),
grams AS (
  SELECT rid, i, array_to_string(words[i + 1 : i + {w}], ' ') AS g
  FROM (SELECT rid, words, unnest(range(0, len(words) - {w - 1})) AS i FROM a WHERE len(words) >= {w})),
twice AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS n FROM grams) WHERE n > 1),
cover AS (
  SELECT rid, sum(least({w}, coalesce(i - lag, {w})))::BIGINT AS n
  FROM (SELECT rid, i, lag(i) OVER (PARTITION BY rid ORDER BY i) AS lag FROM twice) GROUP BY rid),
b AS (
  SELECT rid, doc_id, len(words)::BIGINT AS n_words, array_to_string(words, '') AS joined,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines
  FROM a),
counts AS (
  SELECT doc_id, n_words, length(joined)::BIGINT AS word_chars,
    len(regexp_extract_all(joined, '[#*$%&|<>]'))::BIGINT AS n_symbols,
    len(lines)::BIGINT AS n_lines, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
    coalesce(cover.n, 0)::BIGINT AS n_repeat_words, len(regexp_extract_all(joined, '[A-Z]'))::BIGINT AS n_upper,
    len(regexp_extract_all(joined, '[!?]'))::BIGINT AS n_shouts, len(regexp_extract_all(joined, '[|]'))::BIGINT AS n_bars
  FROM b LEFT JOIN cover USING (rid)),
voted AS (SELECT *, {", ".join(map(_rule_sql, q.RULES))} FROM counts),
patterns AS (SELECT {votes}, count(*) AS n FROM voted GROUP BY {votes}),
em AS (
  SELECT 0 AS step, {q.START!r}::DOUBLE AS prior, {start}
  UNION ALL
  SELECT step + 1, {clip("sum(n * p) / sum(n)")} AS prior, {steps}
  FROM (SELECT em.step, patterns.*, {odds("em")} AS p FROM em, patterns WHERE em.step < {q.ITERATIONS})
  GROUP BY step)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (n_words < {q.MIN_WORDS} OR 100 * n_repeat_words > {q.MAX_REPEAT_PERCENT} * n_words) AS base_failed,
  NOT (n_words < {q.MIN_WORDS} OR 100 * n_repeat_words > {q.MAX_REPEAT_PERCENT} * n_words) AND {odds("em")} >= 0.5 AS kept,
  round({odds("em")}, 4) AS p_good
FROM voted, em WHERE em.step = {q.ITERATIONS}"""


def mixing_sql() -> str:
    """The bisections as recursive queries over one row, the permutations as window sums."""
    m = mixing
    num = lambda x: f"('0x' || substr({x}, 1, 12))::BIGINT"
    src, ident = "coalesce(src, 'null')", "coalesce(doc_id::VARCHAR, 'null')"
    return f"""
WITH RECURSIVE r AS (
  SELECT doc_id, source AS src, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS n_tokens,
    md5(coalesce(text, '')) AS key FROM documents),
totals AS (SELECT src, sum(n_tokens)::BIGINT AS tokens, count(*) AS rows FROM r GROUP BY src),
budget AS (SELECT sum(tokens)::DOUBLE AS budget, {m.EVENNESS!r} * ln(count(*)) AS target FROM totals WHERE tokens > 0),
share AS (SELECT src, tokens, tokens / budget AS p, budget, target FROM totals, budget WHERE tokens > 0),
one AS (SELECT sum(-p * ln(p)) >= any_value(target) AS ok FROM share),
low AS (
  SELECT 0 AS step, 0.0::DOUBLE AS lo, 1.0::DOUBLE AS hi
  UNION ALL
  SELECT step + 1, CASE WHEN h >= target THEN mid ELSE lo END, CASE WHEN h >= target THEN hi ELSE mid END
  FROM (
    SELECT step, lo, hi, mid, any_value(target) AS target, sum(-(x / z) * ln(x / z)) AS h
    FROM (SELECT step, lo, hi, (lo + hi) / 2 AS mid, target, pow(p, (lo + hi) / 2) AS x,
      sum(pow(p, (lo + hi) / 2)) OVER (PARTITION BY step) AS z FROM low, share WHERE step < {m.STEPS})
    GROUP BY step, lo, hi, mid)),
even AS (SELECT CASE WHEN (SELECT ok FROM one) THEN 1.0 ELSE lo END AS alpha FROM low WHERE step = {m.STEPS}),
high AS (
  SELECT 0 AS step, alpha AS lo, 1.0::DOUBLE AS hi FROM even
  UNION ALL
  SELECT step + 1, CASE WHEN e <= {m.MAX_EPOCHS!r} THEN lo ELSE mid END, CASE WHEN e <= {m.MAX_EPOCHS!r} THEN mid ELSE hi END
  FROM (
    SELECT step, lo, hi, mid, max(x / z * budget / tokens) AS e
    FROM (SELECT step, lo, hi, (lo + hi) / 2 AS mid, budget, tokens, pow(p, (lo + hi) / 2) AS x,
      sum(pow(p, (lo + hi) / 2)) OVER (PARTITION BY step) AS z FROM high, share WHERE step < {m.STEPS})
    GROUP BY step, lo, hi, mid)),
fits AS (
  SELECT max(x / sum_x * budget / tokens) <= {m.MAX_EPOCHS!r} AS ok
  FROM (SELECT pow(p, alpha) AS x, sum(pow(p, alpha)) OVER () AS sum_x, budget, tokens FROM share, even)),
alpha AS (SELECT CASE WHEN (SELECT ok FROM fits) THEN (SELECT alpha FROM even) ELSE hi END AS alpha FROM high WHERE step = {m.STEPS}),
quota AS (
  SELECT src, floor(budget * pow(p, alpha) / sum(pow(p, alpha)) OVER ())::BIGINT AS quota FROM share, alpha),
sources AS (
  SELECT t.src, t.tokens, coalesce(q.quota, 0) AS quota,
    greatest(1, ceil(t.rows / greatest({float(m.BLOCK_ROWS)!r}, sqrt(t.rows))))::BIGINT AS n_blocks
  FROM totals t LEFT JOIN quota q ON t.src IS NOT DISTINCT FROM q.src),
dealt AS (
  SELECT r.*, s.tokens, s.quota, s.n_blocks, md5(concat_ws('/', '{m.SEED}', coalesce(r.src, 'null'), {ident}, key)) AS h
  FROM r JOIN sources s ON r.src IS NOT DISTINCT FROM s.src),
hashed AS (SELECT *, {num("h")} % n_blocks AS block FROM dealt),
epochs AS (
  SELECT src, block, tokens, quota, b_tokens, unnest(range(0, (quota + tokens - 1) // tokens)) AS epoch
  FROM (SELECT src, block, any_value(tokens) AS tokens, any_value(quota) AS quota, sum(n_tokens)::BIGINT AS b_tokens
    FROM hashed GROUP BY src, block) WHERE tokens > 0 AND quota > 0),
ordered AS (
  SELECT *, epoch * tokens + coalesce(sum(b_tokens) OVER (PARTITION BY src, epoch
    ORDER BY md5(concat_ws('/', '{m.SEED}', epoch::VARCHAR, {src}, block::VARCHAR)), block
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS b_start
  FROM epochs),
placed AS (
  SELECT h.doc_id, h.src, o.epoch, h.block, h.n_tokens, o.quota,
    (o.b_start + coalesce(sum(h.n_tokens) OVER (PARTITION BY h.src, h.block, o.epoch
      ORDER BY md5(concat_ws('/', '{m.SEED}', o.epoch::VARCHAR, h.h)), h.n_tokens
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS start
  FROM hashed h JOIN ordered o ON h.src IS NOT DISTINCT FROM o.src AND h.block = o.block
  WHERE o.b_start < o.quota)
SELECT doc_id, src AS source, epoch::INTEGER AS epoch, block, n_tokens, start FROM placed WHERE start < quota"""


CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def near_sql() -> str:
    """Pairs by common shingles, groups by passing smaller ids on."""
    m = hyperminhash
    return f"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{CAPITALS}', '{CAPITALS.lower()}'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + {m.SHINGLE - 1}], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(2, len(w) - {m.SHINGLE - 2}))) AS i FROM words WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*)::BIGINT AS n FROM shingles GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM shingles a JOIN shingles b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT u, v FROM pairs JOIN sizes x ON x.doc_id = u JOIN sizes y ON y.doc_id = v WHERE 100 * c >= {m.PERCENT} * (x.n + y.n - c)),
edges AS (SELECT u, v FROM links UNION ALL SELECT v, u FROM links),
reach AS (SELECT doc_id, doc_id AS c FROM documents UNION SELECT e.v, r.c FROM reach r JOIN edges e ON e.u = r.doc_id WHERE r.c < e.v)
SELECT doc_id, coalesce(any_value(n), 0) AS n_shingles, min(c) AS component_id, doc_id = min(c) AS kept
FROM reach LEFT JOIN sizes USING (doc_id) GROUP BY doc_id"""


def phrases_sql() -> str:
    """All phrases are counted; cuts and longer phrases meet theirs by joins."""
    m = phrases
    return f"""
WITH pieces AS (
  SELECT coalesce(lang, '{m.WITHOUT_LANGUAGE}') AS lang,
    unnest(string_split_regex(translate(coalesce(text, ''), '{CAPITALS}', '{CAPITALS.lower()}'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
runs AS (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM pieces),
grams AS (
  SELECT lang, size, array_to_string(w[i + 1 : i + size], ' ') AS phrase
  FROM (SELECT lang, w, size, unnest(range(0, len(w) - size + 1)) AS i
    FROM (SELECT lang, w, unnest(range(1, {m.LONGEST + 1})) AS size FROM runs) WHERE len(w) >= size)),
counts AS (SELECT lang, phrase, size, count(*)::BIGINT AS f FROM grams GROUP BY ALL),
totals AS (SELECT lang, sum(f)::BIGINT AS n FROM counts WHERE size = 1 GROUP BY lang),
found AS (SELECT lang, phrase, size, f AS a, string_split(phrase, ' ') AS w FROM counts WHERE size > 1 AND f >= {m.SUPPORT}),
cuts AS (
  SELECT lang, phrase, size, a, k, array_to_string(w[1 : k], ' ') AS lp, array_to_string(w[k + 1 : size], ' ') AS rp
  FROM (SELECT *, unnest(range(1, size)) AS k FROM found)),
met AS (
  SELECT c.lang, c.phrase, c.a, c.k, x.f AS l, y.f AS r, (c.a::HUGEINT * {m.SCALE} // (x.f::HUGEINT + y.f))::BIGINT AS score
  FROM cuts c JOIN counts x ON x.lang = c.lang AND x.phrase = c.lp JOIN counts y ON y.lang = c.lang AND y.phrase = c.rp),
worst AS (SELECT * FROM met QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inner_parts AS (
  SELECT lang, a, array_to_string(w[i : i + n - 1], ' ') AS phrase
  FROM (SELECT lang, a, w, n, unnest(range(1, size - n + 2)) AS i FROM (SELECT lang, a, w, size, unnest(range(2, size)) AS n FROM found WHERE size > 2))),
longest AS (SELECT lang, phrase, max(a) AS most FROM inner_parts GROUP BY ALL),
kept AS (
  SELECT w.* FROM worst w LEFT JOIN longest o ON o.lang = w.lang AND o.phrase = w.phrase
  WHERE o.most IS NULL OR 100 * o.most < {m.INSIDE} * w.a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase)::INTEGER AS rank, phrase, a, l, r, n, score
FROM kept JOIN totals USING (lang) QUALIFY rank <= {m.TOP}"""


def fim_sql() -> str:
    p, s, m = fim.SENTINELS
    draw = lambda i: f"('0x' || substr(h, {1 + 8 * i}, 8))::BIGINT"
    return f"""
WITH a AS (
  SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, ''))::BIGINT AS n, sha256('{fim.SEED}:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
b AS (
  SELECT doc_id, t, n, least({draw(0)} % (n + 1), {draw(1)} % (n + 1)) AS a, greatest({draw(0)} % (n + 1), {draw(1)} % (n + 1)) AS b,
    CASE WHEN n = 0 OR contains(t, '{p}') OR contains(t, '{s}') OR contains(t, '{m}') OR {draw(2)} % 100 >= {fim.RATE} THEN 'plain'
      WHEN {draw(3)} % 100 < {fim.SPM} THEN 'spm' ELSE 'psm' END AS form FROM a),
c AS (SELECT *, substring(t, 1, a) AS pre, substring(t, a + 1, b - a) AS mid, substring(t, b + 1) AS suf FROM b)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '{p}' || pre || '{s}' || suf || '{m}' || mid
    ELSE '{s}' || suf || '{p}' || pre || '{m}' || mid END) AS output_sha256, sha256(t) AS restored_sha256
FROM c"""


ORACLE_SQL: dict[str, str] = {"op2_quality_rules": quality_sql(), "op3_mixing": mixing_sql(), "op11_hyperminhash": near_sql(), "op12_phrases": phrases_sql(), "op13_fim": fim_sql()}
