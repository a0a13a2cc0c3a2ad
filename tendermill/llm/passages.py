"""Substring dedup with repeated-phrase automata.

A passage of ``window`` words is removed wherever its words also start in a
document with a smaller id.

*Confirm.*  Every window has one anchor, the phrase of ``PHRASE`` words with
the least hash in it; only anchors (about one position in eighteen) are
shuffled.  Anchors of two or more documents are the recurring phrases, and the
least id that holds one is its home.  Texts are read once more, and each run of
windows with one home is written out as a stretch.  Documents without a
recurring phrase cannot hold a passage and end here.  Equal stretches are one
from now on, under the least of their ids: it decides for all the others.
Windows of distinct stretches are counted by hash and home, with partial sums
before the shuffle; those of two or more documents are the confirmed passages,
each with the least id as its owner.

*Compile.*  Owners hand in the words of their passages.  Passages are dealt to
shards by home, and each shard becomes an Aho-Corasick automaton
(pyahocorasick) whose patterns are the anchor phrases, with a table of the
windows of its passages beside it.

*Stream.*  Stretches go to the shards of their homes and are streamed through
the automata.  The windows around a hit are looked up in the table, each once, and
compared with the passage word by word; one whose owner has a smaller id is an
occurrence.  So the work is in proportion to the text, however often a phrase
recurs within it.
A shard with many passages is cut into several automata and one with many
stretches into several tasks, which meet each other, so neither a passage that
a third of all documents share nor a phrase with many passages around it
burdens a single task.

Defined results: NULL texts have no words; rows with a NULL id own nothing and
lose every window that a document with an id has; repeated rows are handled one by
one, and rows of one id do not affect each other; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tendermill.llm.common import join_counted, materialise, text_bytes

WINDOW = 50
PHRASE = 16
#: Bytes of passages in an automaton, and of stretches in a task, aimed at.
SHARD_BYTES = 1 << 20
TASK_BYTES = 4 << 20
#: Windows in a stretch or a passage; longer runs are cut, and the pieces overlap by all words of a window but one.
MOST_WINDOWS = 20_000
#: Bytes of text read at a time.
CHUNK = 1 << 20
NOBODY = (1 << 63) - 1
_ODD = np.uint64(0x9E3779B97F4A7C15)


class WordHashes(dict):
    """64-bit hashes of words, kept within a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        found = self[word] = xxhash.xxh3_64_intdigest(word)
        return found


def _rolling(h: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of ``size`` words: sums of the words' hashes by powers of an odd number, modulo 2**64."""
    n = len(h) - size + 1
    powers = np.cumprod(np.full(len(h), _ODD, np.uint64))
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(h * powers, dtype=np.uint64)))
    inverse = pow(int(_ODD), -1, 1 << 64)
    x = (sums[size:] - sums[:n]) * np.cumprod(np.full(n, inverse, np.uint64))
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return x ^ (x >> np.uint64(29))


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """The least value in each run of ``width``."""
    span = 1
    while span < width:
        step = min(span, width - span)
        x = np.minimum(x[:-step], x[step:])
        span += step
    return x


class Reading:
    """Words of some texts, and of all their windows the text, the place in it and the anchor."""

    def __init__(self, raws: Iterable[bytes], hashes: WordHashes, window: int):
        self.words, self.window = [raw.split() for raw in raws], window
        sizes = np.fromiter(map(len, self.words), np.int64, len(self.words))
        ends = np.cumsum(sizes)
        starts = ends - sizes
        total = int(ends[-1]) if len(ends) else 0
        self.h = np.fromiter(map(hashes.__getitem__, chain.from_iterable(self.words)), np.uint64, total)
        per_text = np.maximum(sizes - window + 1, 0)
        self.text = np.repeat(np.arange(len(sizes)), per_text)
        at = np.arange(len(self.text)) - np.repeat(np.cumsum(per_text) - per_text, per_text)
        self.at, self.flat = at, at + starts[self.text]
        self.anchor = np.empty(0, np.uint64)
        if len(self.at):
            size = min(PHRASE, window)
            self.anchor = _least(_rolling(self.h, size), window - size + 1)[self.flat]

    def runs(self, value: np.ndarray, most: int = 0) -> np.ndarray:
        """Bounds of the runs of windows with one ``value`` in one text, cut after ``most`` windows."""
        new = np.flatnonzero((value[1:] != value[:-1]) | (self.text[1:] != self.text[:-1])) + 1
        bounds = np.concatenate(([0], new, [len(value)]))
        if most and (np.diff(bounds) > most).any():
            bounds = np.unique(np.concatenate([*(np.arange(s, e, most) for s, e in zip(bounds[:-1], bounds[1:])), [len(value)]]))
        return bounds

    def covered(self, s: int, e: int) -> bytes:
        """The words that windows ``s`` to ``e - 1`` cover."""
        return b" ".join(self.words[self.text[s]][self.at[s] : self.at[e - 1] + self.window])


def _chunks(batch: pa.RecordBatch) -> Iterator[tuple[int, list[bytes]]]:
    """Some rows' texts at a time, with the number of the first."""
    held, size, first = [], 0, 0
    for i, raw in enumerate(batch["raw"]):
        held.append(raw.as_py())
        size += len(held[-1])
        if size >= CHUNK:
            yield first, held
            held, size, first = [], 0, i + 1
    if held:
        yield first, held


def _anchors(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            for first, raws in _chunks(batch):
                r = Reading(raws, hashes, window)
                if len(r.at):
                    new = r.runs(r.anchor)[:-1]
                    rows = pa.array(first + r.text[new])
                    yield pa.RecordBatch.from_arrays(
                        [batch["doc_id"].take(rows), batch["key"].take(rows), pa.array(r.anchor[new].view(np.int64))], names=["doc_id", "key", "anchor"]
                    )

    return run


STRETCHES = "doc_id long, key long, home long, sid long, start int, n int, text binary"


def _stretches(window: int):
    """Runs of windows with one home, as the words that they cover; ``sid`` tells different words apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            for first, raws in _chunks(batch):
                part = batch.slice(first, len(raws))
                known, one = np.unique(part["anchors"].flatten().to_numpy(), return_index=True)
                homes = part["homes"].flatten().to_numpy()[one]
                r = Reading(raws, hashes, window)
                wanted = r.anchor.view(np.int64)
                at = np.minimum(np.searchsorted(known, wanted), len(known) - 1)
                home = np.where(known[at] == wanted, homes[at], NOBODY)
                bounds = r.runs(home, MOST_WINDOWS)
                mine = np.flatnonzero(home[bounds[:-1]] != NOBODY)
                starts, ends = bounds[mine], bounds[mine + 1]
                texts = [r.covered(s, e) for s, e in zip(starts.tolist(), ends.tolist())]
                sids = np.fromiter(map(xxhash.xxh3_64_intdigest, texts), np.uint64, len(texts)).view(np.int64)
                rows = pa.array(r.text[starts])
                columns = [
                    part["doc_id"].take(rows), part["key"].take(rows), pa.array(home[starts]), pa.array(sids),
                    pa.array(r.at[starts].astype(np.int32)), pa.array((ends - starts + window - 1).astype(np.int32)), pa.array(texts, pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "key", "home", "sid", "start", "n", "text"])

    return run


def _windows(window: int):
    """Hash and place of each window of a stretch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            for first, raws in _chunks(batch):
                r = Reading(raws, hashes, window)
                rows = pa.array(first + r.text)
                columns = [*(batch[c].take(rows) for c in ("home", "owner", "sid")), pa.array(_rolling(r.h, window)[r.flat].view(np.int64)), pa.array(r.at.astype(np.int32))]
                yield pa.RecordBatch.from_arrays(columns, names=["home", "owner", "sid", "window", "at"])

    return run


def _passages(window: int):
    """Runs of an owner's confirmed windows, as the words that they cover."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, texts = [], []
            for i, (raw, owned) in enumerate(zip(batch["raw"], batch["owned"])):
                words, at = raw.as_py().split(), np.sort(owned.values.to_numpy())
                cuts = np.concatenate(([0], np.flatnonzero(np.diff(at) != 1) + 1, [len(at)]))
                for s, e in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                    texts.append(b" ".join(words[at[s] : at[e - 1] + window]))
                    rows.append(i)
            rows = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([batch["home"].take(rows), batch["owner"].take(rows), pa.array(texts, pa.binary())], names=["home", "owner", "text"])

    return run


class Automaton:
    """Anchor phrases and windows of a shard's passages.

    A word is three letters of three alphabets, so that a node has few children
    and phrases begin at words only; passages have one letter a word.
    """

    BASE = 128

    def __init__(self, passages: list[tuple[int, bytes]], window: int):
        self.window, self.size = window, min(PHRASE, window)
        self.letters: dict[bytes, str] = {}
        self.spelt: dict[bytes, str] = {}
        self.texts: list[str] = []
        passages = sorted(passages, key=lambda p: (p[0], -len(p[1])))
        self.machine = ahocorasick.Automaton(ahocorasick.STORE_ANY)
        self.hashes, windows = WordHashes(), []
        for _, raw in passages:
            r = Reading([raw], self.hashes, window)
            words = r.words[0]
            self.texts.append("".join([self.letters.get(w) or self._letter(w) for w in words]))
            _, first = np.unique(phrases := _rolling(r.h, self.size), return_index=True)
            for at in first[np.isin(phrases[first], r.anchor)].tolist():
                self.machine.add_word("".join([self.spelt[w] for w in words[at : at + self.size]]), True)
            windows.append(_rolling(r.h, window))
        self.machine.make_automaton()
        # Each window once, with the least owner that has it: passages are in the order of owners, and the first of equals counts.
        every = np.concatenate(windows) if windows else np.empty(0, np.uint64)
        sizes = np.fromiter(map(len, windows), np.int64, len(windows))
        self.known, first = np.unique(every, return_index=True)
        self.passage = np.repeat(np.arange(len(sizes)), sizes)[first]
        self.place = first - (np.cumsum(sizes) - sizes)[self.passage]
        self.owner = np.array([owner for owner, _ in passages], np.int64)[self.passage] if passages else np.empty(0, np.int64)

    def _letter(self, word: bytes) -> str:
        n = len(self.letters) + 1
        high, low = divmod(n, self.BASE)
        high, middle = divmod(high, self.BASE)
        self.spelt[word] = chr(1 + low) + chr(0x100 + middle) + chr(0x200 + high)
        self.letters[word] = chr(n if n < 0xD800 else n + 0x800)
        return self.letters[word]

    def occurrences(self, raw: bytes, doc_id: int) -> list[tuple[int, int]]:
        """Intervals of the words of ``raw`` that windows with smaller owners cover."""
        r = Reading([raw], self.hashes, self.window)
        words, n = r.words[0], len(r.at)
        if not n or not len(self.known):
            return []
        hits = [end for end, _ in self.machine.iter("".join([self.spelt.get(w, "\0\0\0") for w in words]))]
        if not hits:
            return []
        # Windows that hold a hit.
        at = (np.array(hits) + 1) // 3 - self.size
        near = np.zeros(n + 1, np.int64)
        np.add.at(near, np.clip(at + self.size - self.window, 0, n), 1)
        np.add.at(near, np.clip(at + 1, 0, n), -1)
        mine = _rolling(r.h, self.window)
        row = np.minimum(np.searchsorted(self.known, mine), len(self.known) - 1)
        found = np.flatnonzero((self.known[row] == mine) & (self.owner[row] < doc_id) & (np.cumsum(near[:n]) > 0))
        if not len(found):
            return []
        row = row[found]
        passage, place = self.passage[row], self.place[row]
        new = np.flatnonzero((np.diff(found) != 1) | (np.diff(passage) != 0) | (np.diff(place) != 1)) + 1
        text = "".join([self.letters.get(w, "\0") for w in words])
        covered = np.zeros(len(words) + 1, np.int64)
        for s, e in zip([0, *new.tolist()], [*new.tolist(), len(found)]):
            self._compare(text, covered, int(found[s]), int(passage[s]), int(place[s]), e - s)
        bounds = np.flatnonzero(np.diff(np.cumsum(covered) > 0, prepend=False, append=False))
        return list(zip(bounds[::2].tolist(), bounds[1::2].tolist()))

    def _compare(self, text: str, covered: np.ndarray, start: int, passage: int, place: int, windows: int) -> None:
        """Mark the words of ``windows`` windows that follow each other in text and passage; if their words differ somewhere, those windows that are equal."""
        size = windows + self.window - 1
        if text[start : start + size] == self.texts[passage][place : place + size]:
            covered[start] += 1
            covered[start + size] -= 1
        elif windows > 1:
            half = windows // 2
            self._compare(text, covered, start, passage, place, half)
            self._compare(text, covered, start + half, passage, place + half, windows - half)


FOUND = pa.schema([("home", pa.int64()), ("sid", pa.int64()), ("s", pa.int32()), ("e", pa.int32())])


def _locate(window: int):
    def run(passages: pa.Table, stretches: pa.Table) -> pa.Table:
        if not passages.num_rows or not stretches.num_rows:
            return FOUND.empty_table()
        machine = Automaton(list(zip(passages["owner"].to_pylist(), passages["text"].to_pylist())), window)
        rows, cuts = [], []
        for i, (owner, raw) in enumerate(zip(stretches["owner"], stretches["text"])):
            found = machine.occurrences(raw.as_py(), owner.as_py())
            cuts += found
            rows += [i] * len(found)
        rows, (s, e) = pa.array(rows, pa.int64()), zip(*cuts) if cuts else ((), ())
        return pa.Table.from_arrays([stretches["home"].take(rows), stretches["sid"].take(rows), pa.array(s, pa.int32()), pa.array(e, pa.int32())], schema=FOUND)

    return run


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts, removed, shas, texts = [], [], [], []
        for raw, cuts in zip(batch["raw"], batch["cuts"]):
            words, cuts = raw.as_py().split(), cuts.as_py()
            kept = words
            if cuts:
                gone = np.zeros(len(words) + 1, np.int64)
                for cut in cuts:
                    gone[cut["s"]] += 1
                    gone[cut["e"]] -= 1
                kept = [w for w, g in zip(words, np.cumsum(gone).tolist()) if not g]
            text = b" ".join(kept)
            counts.append(len(words))
            removed.append(len(words) - len(kept))
            shas.append(hashlib.sha256(text).hexdigest())
            texts.append(text)
        cols = [batch["doc_id"], pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(shas, pa.string()), pa.array(texts, pa.binary())]
        yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept"])


def stretches(rows: DataFrame, window: int = WINDOW) -> DataFrame:
    """All stretches of ``rows(doc_id, key, raw)``."""
    anchors = materialise(rows.select("doc_id", "key", "raw").mapInArrow(_anchors(window), "doc_id long, key long, anchor long"), "anchors")
    homes = anchors.groupBy("anchor").agg(F.min("doc_id").alias("home"), F.max("doc_id").alias("last"))
    recurring = homes.where("home < last").select("anchor", "home")
    mine = anchors.join(recurring, "anchor").groupBy("doc_id", "key").agg(F.collect_set(F.struct("anchor", "home")).alias("x"))
    mine = mine.select("doc_id", "key", F.col("x.anchor").alias("anchors"), F.col("x.home").alias("homes"))
    marked = rows.join(mine, ["doc_id", "key"]).select("doc_id", "key", "raw", "anchors", "homes")
    return materialise(marked.mapInArrow(_stretches(window), STRETCHES), "stretches")


def passages(distinct: DataFrame, window: int = WINDOW) -> DataFrame:
    """``home, owner, text`` of the confirmed passages of ``distinct(home, sid, owner, text)``."""
    columns = "home long, owner long, sid long, window long, at int"
    windows = distinct.select("home", "owner", "sid", F.col("text").alias("raw")).mapInArrow(_windows(window), columns)
    found = windows.groupBy("home", "window").agg(F.min(F.struct("owner", "sid", "at")).alias("first"), F.max("owner").alias("last"))
    owned = found.where("first.owner < last").groupBy("home", F.col("first.sid").alias("sid")).agg(F.collect_list("first.at").alias("owned"))
    owners = distinct.join(owned, ["home", "sid"]).select("home", "owner", F.col("text").alias("raw"), "owned")
    return materialise(owners.mapInArrow(_passages(window), "home long, owner long, text binary"), "passages")


def _dealt(df: DataFrame, n_shards: int, target: int, part: str, *deal: str) -> tuple[DataFrame, DataFrame]:
    """``df`` with its shard, and the number of parts (of about ``target`` bytes) of each shard."""
    sharded = df.withColumn("shard", F.pmod(F.xxhash64("home"), F.lit(n_shards)).cast("int")).withColumn("deal", F.xxhash64(*deal))
    size = F.ceil(F.sum(F.octet_length("text")) / target).cast("int")
    return sharded, sharded.groupBy("shard").agg(F.greatest(F.lit(1), size).alias(part))


def occurrences(rows: DataFrame, window: int = WINDOW) -> DataFrame:
    """``doc_id, key, s, e``: word intervals to remove from ``rows(doc_id, key, raw)``."""
    sent = stretches(rows, window)
    distinct = sent.groupBy("home", "sid").agg(F.min("doc_id").alias("owner"), F.any_value("text").alias("text"), F.count("*").alias("members"))
    distinct = materialise(distinct, "distinct-stretches")
    owned = passages(distinct, window)

    size = owned.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n_shards = max(1, -(-size // SHARD_BYTES))
    left, left_parts = _dealt(owned, n_shards, SHARD_BYTES, "p", "owner", "text")
    right, right_parts = _dealt(distinct, n_shards, TASK_BYTES, "q", "sid")
    # Cell (i, j) of a shard is its automaton i with its task j.
    grid = materialise(left_parts.join(right_parts, "shard").coalesce(1), "passage-grid")
    own = lambda n: F.pmod("deal", F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = left.join(grid, "shard").select("shard", own("p").alias("i"), each("q").alias("j"), "owner", "text")
    right = right.join(grid, "shard").select(F.col("shard").alias("to"), each("p").alias("k"), own("q").alias("l"), "home", "sid", "owner", "text")
    met = left.groupBy("shard", "i", "j").cogroup(right.groupBy("to", "k", "l"))
    found = met.applyInArrow(_locate(window), "home long, sid long, s int, e int")
    cuts = found.groupBy("home", "sid").agg(F.collect_set(F.struct("s", "e")).alias("cuts"))

    # A stretch that a smaller id has as well goes whole; the owner's own copy loses what was found.
    each_row = join_counted(sent.select("doc_id", "key", "home", "sid", "start", "n"), distinct.select("home", "sid", "owner", "members"), "home", "sid")
    copies = each_row.where("doc_id > owner").select("doc_id", "key", F.col("start").alias("s"), (F.col("start") + F.col("n")).alias("e"))
    first = each_row.where("doc_id = owner").join(cuts, ["home", "sid"]).select("doc_id", "key", "start", F.explode("cuts").alias("cut"))
    first = first.select("doc_id", "key", (F.col("start") + F.col("cut.s")).alias("s"), (F.col("start") + F.col("cut.e")).alias("e"))
    return copies.unionByName(first)


def without_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256, kept``; ``kept`` is the text that is left."""
    rows = text_bytes(docs, "doc_id").withColumn("key", F.xxhash64("raw")).withColumn("doc_id", F.coalesce("doc_id", F.lit(NOBODY)))
    cuts = occurrences(rows, window).groupBy("doc_id", "key").agg(F.collect_set(F.struct("s", "e")).alias("cuts"))
    both = rows.join(cuts, ["doc_id", "key"], "left")
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept binary"
    out = both.select("doc_id", "raw", "cuts").mapInArrow(_digests, schema)
    return out.withColumns({"doc_id": F.nullif("doc_id", F.lit(NOBODY)), "kept": F.decode("kept", "UTF-8")})
