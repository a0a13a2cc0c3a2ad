"""Collocations by SON partitioning: mine shards at lowered support, then count all candidates exactly.

Documents are dealt to ``SHARDS`` shards by a hash of the row.  A shard is a share
of the corpus, not a task: its counts are partial sums of many tasks.

*Words.*  Words are counted by language; those below the support occur in no
candidate.  The same pass gives the words of each shard and language.

*Shards.*  A phrase with ``support`` occurrences in its language has, in at least
one shard, its share of them: the support times the shard's share of the
language's words, rounded up.  Each shard is mined completely at that number,
pairs first, then phrases of three and four words all of whose pairs are frequent
in some shard.  Phrases are 64-bit hashes here; a collision only adds a candidate.

*Union and exact count.*  Locally frequent phrases of all shards are the
candidates.  They are counted over the whole corpus by their words, and those
that reach the support stay.

What tasks need to know of the level before, frequent words or pairs, is a bitmap
of ``BITS`` bits at most, whatever the corpus; a bit that stands for two phrases
only adds candidates, whose exact counts then decide.

The score compares a phrase with its two parts at the weakest cut, in whole
numbers of 38 digits.  Phrases inside a longer candidate that holds most of their
occurrences are dropped.

Defined results: NULL and empty texts have no words; a NULL language is ``und``;
a NULL id counts like any other and repeated rows count as often as they come;
languages without candidates have no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tendermill.llm.common import materialise

SUPPORT = 30
LONGEST = 4
TOP = 2000
#: A candidate goes if a longer one that holds it has this percentage of its occurrences.
INSIDE = 80
SCALE = 2_000_000
SHARDS = 4
BITS = 1 << 26
#: Bytes of text that are counted together before partial counts go out.
CHUNK = 3 << 20
#: Best rows are picked by so many hash groups of a language first.
PICKED = 64
WITHOUT_LANGUAGE = "und"

#: Ends of pieces become a byte that UTF-8 never has, tabs a space.
_BREAK = b"\xff"
_CLEAN = bytes.maketrans(b".,;:!?\n\x0b\x0c\r\t", _BREAK * 10 + b" ")
_ODD, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xFF51AFD7ED558CCD)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * _MIX
    return x ^ (x >> np.uint64(29))


class Words:
    """Lower-cased words of a text: the distinct ones, and of each place the number of its word; breaks between pieces are words here."""

    def __init__(self, raw: bytes):
        letters = np.frombuffer(raw.lower().translate(_CLEAN).replace(_BREAK, b" \xff "), np.uint8)
        inside = letters != 32
        edges = np.flatnonzero(np.diff(inside, prepend=False, append=False))
        ends = np.concatenate(([0], np.cumsum(edges[1::2] - edges[::2]))).astype(np.int32)
        words = pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(ends), pa.py_buffer(letters[inside])]).dictionary_encode()
        _, ends, letters = words.dictionary.buffers()
        at, held = np.frombuffer(ends, np.int32)[: len(words.dictionary) + 1].tolist(), letters.to_pybytes() if letters else b""
        self.distinct = [held[s:e] for s, e in zip(at, at[1:])]
        self.number = words.indices.to_numpy().astype(np.int64)
        #: A break is 0, and no word is.
        self.hashes = np.fromiter((0 if w == _BREAK else word_hash(w) for w in self.distinct), np.uint64, len(self.distinct))


def word_hash(word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(word) or 1


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, int, Words]]:
    """Language, shard, mark of both, and words of some documents of one language and shard at a time."""
    held: dict[tuple[str, int, int], list[bytes]] = {}
    size = 0

    def out() -> Iterator[tuple[str, int, int, Words]]:
        for of, raws in held.items():
            yield *of, Words(b"\n".join(raws))

    for batch in batches:
        for *of, raw in zip(*(batch[c].to_pylist() for c in ("lang", "shard", "part")), batch["raw"]):
            text = raw.as_py()
            held.setdefault(tuple(of), []).append(text)
            size += len(text)
            if size >= CHUNK:
                yield from out()
                held, size = {}, 0
    yield from out()


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of words; those of a shard's words have no word."""
    for lang, shard, _, words in _chunks(batches):
        n = np.bincount(words.number, minlength=len(words.distinct))
        real = np.flatnonzero(words.hashes)
        spelt = pa.array([words.distinct[i] for i in real.tolist()], pa.binary()).cast(pa.string())
        for phrases, counts, of in ((spelt, n[real], None), (pa.nulls(1, pa.string()), n[real].sum(keepdims=True), shard)):
            columns = [pa.repeat(pa.scalar(lang), len(counts)), pa.repeat(pa.scalar(of, pa.int32()), len(counts)), phrases, pa.array(counts.astype(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, names=["lang", "shard", "phrase", "f"])


def _lang_hash(lang: str) -> np.uint64:
    return np.uint64(xxhash.xxh3_64_intdigest(lang.encode(), 1))


class _Grams:
    """Hashes of the phrases that begin at each word, and which of them may be frequent."""

    def __init__(self, lang: str, words: Words, frequent: np.ndarray):
        first = _mixed(words.hashes ^ _lang_hash(lang))
        self.h, self.hash = words.hashes[words.number], [first[words.number]]
        self.may = [((words.hashes != 0) & _known(frequent, first))[words.number]]

    def extend(self) -> None:
        """Phrases of one word more; both phrases of one word less must be possible."""
        last, size = self.hash[-1], len(self.hash)
        n = max(0, len(self.h) - size)
        self.hash.append(_mixed(last[:n] * _ODD + self.h[size:]))
        self.may.append(self.may[-1][:n] & self.may[-1][1 : n + 1])

    def keep(self, bits: np.ndarray) -> None:
        self.may[-1] &= _known(bits, self.hash[-1])


def _known(bits: np.ndarray, x: np.ndarray) -> np.ndarray:
    at = x % np.uint64(len(bits) * 8)
    return (bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


def _mine(words, pairs):
    """Partial counts of the phrases of each shard: pairs, or with ``pairs`` known the longer ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of_words, of_pairs = _bits(words), None if pairs is None else _bits(pairs)
        for lang, _, part, chunk in _chunks(batches):
            g = _Grams(lang, chunk, of_words)
            g.extend()
            found = [g.hash[1][g.may[1]]]
            if of_pairs is not None:
                g.keep(of_pairs)
                found = []
                for _ in range(LONGEST - 2):
                    g.extend()
                    found.append(g.hash[-1][g.may[-1]])
            for x in found:
                keys, n = np.unique(x, return_counts=True)
                columns = [pa.repeat(pa.scalar(part, pa.int64()), len(keys)), pa.array(keys.view(np.int64)), pa.array(n.astype(np.int64))]
                yield pa.RecordBatch.from_arrays(columns, names=["part", "key", "f"])

    return run


def _count_exactly(words, pairs, longer):
    """Partial counts of the candidates by their words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of_words, of_pairs, of_longer = _bits(words), _bits(pairs), _bits(longer)
        for lang, _, _, chunk in _chunks(batches):
            g, words_of, number = _Grams(lang, chunk, of_words), chunk.distinct, chunk.number
            # Equal phrases of the chunk get one number, made of that of the phrase without its last word and that word's.
            at, same = np.arange(len(number)), number
            for size in range(2, LONGEST + 1):
                g.extend()
                g.keep(of_pairs if size == 2 else of_longer)
                here = np.flatnonzero(g.may[-1])
                before = np.searchsorted(at, here)
                _, first, same, n = np.unique((same[before] << 32) | number[here + size - 1], return_index=True, return_inverse=True, return_counts=True)
                at = here
                phrases = [b" ".join([words_of[w] for w in x]) for x in number[here[first][:, None] + np.arange(size)].tolist()]
                columns = [pa.repeat(pa.scalar(lang), len(phrases)), pa.array(phrases, pa.binary()).cast(pa.string()), pa.repeat(pa.scalar(size, pa.int32()), len(phrases)), pa.array(n.astype(np.int64))]
                yield pa.RecordBatch.from_arrays(columns, names=["lang", "phrase", "size", "f"])

    return run


def _bits(shared) -> np.ndarray:
    return np.frombuffer(shared.value, np.uint8)


def _phrase_key(rows: DataFrame) -> DataFrame:
    """``key`` of the words of ``rows(lang, phrase)``, as :class:`_Grams` has it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, words = batch["lang"].to_pylist(), batch["phrase"].to_pylist()
            h = np.fromiter((word_hash(w.encode()) for w in words), np.uint64, len(words))
            of_lang = {x: _lang_hash(x) for x in set(langs)}
            keys = _mixed(h ^ np.fromiter((of_lang[x] for x in langs), np.uint64, len(langs)))
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64))], names=["key"])

    return rows.select("lang", "phrase").mapInArrow(run, "key long")


def bitmap(keys: DataFrame, bits: int):
    """Broadcast of a bitmap with the bits of ``keys(key)`` set; its size has a bound of its own, ``bits``."""
    at = F.pmod(F.col("key"), F.lit(bits))  # bits is a power of two: the remainder of the unsigned number
    whole = keys.select(F.shiftright(at, 6).alias("w"), F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(at, F.lit(64)).cast("int")).alias("b"))
    table = whole.groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    out = np.zeros(bits // 64, np.int64)
    out[table["w"].to_numpy()] = table["b"].to_numpy()
    return keys.sparkSession.sparkContext.broadcast(out.astype("<i8").tobytes())


def texts(docs: DataFrame, shards: int) -> DataFrame:
    raw = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    shard = F.pmod(F.xxhash64("doc_id", raw), F.lit(shards)).cast("int")
    lang = F.coalesce(F.col("lang").cast("string"), F.lit(WITHOUT_LANGUAGE))
    rows = docs.select(lang.alias("lang"), shard.alias("shard"), raw.alias("raw"))
    return rows.withColumn("part", F.xxhash64("lang", "shard"))


def candidates(docs: DataFrame, support: int = SUPPORT, shards: int = SHARDS, bits: int = BITS) -> tuple[DataFrame, DataFrame]:
    """``lang, phrase, size, f`` of all phrases of one word or more with ``support`` occurrences, and ``lang, n`` words."""
    rows = texts(docs, shards)
    counted = rows.mapInArrow(_count_words, "lang string, shard int, phrase string, f long").groupBy("lang", "shard", "phrase").agg(F.sum("f").alias("f"))
    counted = materialise(counted.where(F.col("phrase").isNull() | (F.col("f") >= support)), "phrase-words")
    words, of_shards = counted.where("phrase is not null"), counted.where("phrase is null and f > 0")
    totals = of_shards.groupBy("lang").agg(F.sum("f").alias("n"))
    # A row a language and shard: the least number of occurrences that is this shard's share.
    share = F.ceil((F.col("f").cast("decimal(38,0)") * support) / F.col("n")).cast("long")
    least = of_shards.select("lang", "shard", "f").join(totals, "lang").select(F.xxhash64("lang", "shard").alias("part"), F.greatest(share, F.lit(1)).alias("least"))

    def locally_frequent(mined: DataFrame, name: str) -> DataFrame:
        sums = mined.groupBy("part", "key").agg(F.sum("f").alias("f"))
        frequent = sums.join(least, "part").where("f >= least").select("key").distinct()
        return materialise(frequent, name)

    schema = "part long, key long, f long"
    of_words = bitmap(_phrase_key(words), bits)
    of_pairs = bitmap(locally_frequent(rows.mapInArrow(_mine(of_words, None), schema), "phrase-pairs"), bits)
    of_longer = bitmap(locally_frequent(rows.mapInArrow(_mine(of_words, of_pairs), schema), "phrase-longer"), bits)
    exact = rows.mapInArrow(_count_exactly(of_words, of_pairs, of_longer), "lang string, phrase string, size int, f long")
    exact = exact.groupBy("lang", "phrase", "size").agg(F.sum("f").alias("f")).where(F.col("f") >= support)
    every = exact.unionByName(words.select("lang", "phrase", F.lit(1).alias("size"), "f"))
    return materialise(every, "phrases"), totals


def _part(start: Column, length: Column) -> Column:
    return F.array_join(F.slice(F.split("phrase", " "), start, length), " ")


def scored(counts: DataFrame) -> DataFrame:
    """``lang, phrase, size, a, l, r, score`` of each phrase of two words or more, at its weakest cut."""
    phrases = counts.where("size > 1").withColumnRenamed("f", "a")
    cuts = phrases.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1)))
    cuts = cuts.select("lang", "phrase", "size", "a", "k", _part(F.lit(1), F.col("k")).alias("left"), _part(F.col("k") + 1, F.col("size") - F.col("k")).alias("right"))
    known = lambda side, f: counts.select("lang", F.col("phrase").alias(side), F.col("f").alias(f))
    met = cuts.join(known("left", "l"), ["lang", "left"]).join(known("right", "r"), ["lang", "right"])
    score = F.expr(f"(cast(a as decimal(28,0)) * {SCALE}) div (cast(l as decimal(28,0)) + r)").alias("score")
    worst = met.select("lang", "phrase", "size", "a", F.struct(score, "k", "l", "r").alias("cut")).groupBy("lang", "phrase", "size", "a").agg(F.min("cut").alias("cut"))
    return worst.select("lang", "phrase", "size", "a", "cut.l", "cut.r", "cut.score")


def outside(found: DataFrame, inside: int = INSIDE) -> DataFrame:
    """Without phrases that lie in a longer one with ``inside`` percent of their occurrences."""
    starts = lambda n: F.transform(F.sequence(F.lit(1), F.col("size") - n + 1), lambda i: _part(i, n))
    shorter = F.flatten(F.transform(F.sequence(F.lit(2), F.col("size") - 1), starts))
    longest = found.where("size > 2").select("lang", F.explode(F.array_distinct(shorter)).alias("phrase"), "a")
    longest = longest.groupBy("lang", "phrase").agg(F.max("a").alias("most"))
    big = lambda c: F.col(c).cast("decimal(28,0)")
    return found.join(longest, ["lang", "phrase"], "left").where(F.col("most").isNull() | (big("most") * 100 < big("a") * inside)).drop("most")


def collocations(docs: DataFrame, support: int = SUPPORT, top: int = TOP, shards: int = SHARDS, bits: int = BITS) -> DataFrame:
    """The first ``top`` phrases of each language: ``lang, rank, phrase, a, l, r, n, score``."""
    counts, totals = candidates(docs, support, shards, bits)
    kept = outside(scored(counts)).withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(PICKED)))
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    ranked = lambda df, *keys: df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= top)
    best = ranked(ranked(kept, "lang", "salt").drop("rank"), "lang")
    return best.join(totals, "lang").select("lang", "rank", "phrase", *(F.col(c).cast("long").alias(c) for c in ("a", "l", "r", "n", "score")))
