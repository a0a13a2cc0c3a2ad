"""Near duplicates by HyperMinHash: small registers propose, whole sets decide.

A document is the set of its five-word shingles (64-bit hashes).  Two documents
are linked if 100 times their common shingles are at least ``percent`` times all
of theirs; groups are what links join.

*Registers.*  Rounds of a hash throw each shingle into one of ``BUCKETS`` buckets;
a bucket keeps the least value of the first round that reached it, which is the
same in two sets with a chance of their Jaccard similarity.  It is stored in 16
bits: the number of leading zeros and ``MANTISSA`` bits after the leading one.

*Bands.*  ``ROWS`` neighbouring registers are one band key; documents that share
one meet.  A pair at 0.85 meets in none of 32 bands with a chance of 6e-11.  Keys
with the same members are met once, and a key with more than ``block`` members is
cut into blocks that meet pairwise, a cell each.

*Estimates.*  Within a cell the similarity of all pairs is estimated from equal
registers, less those that are equal by chance alone: registers collide where two
different values have the same leading zeros and mantissa, which the sets' own
leading zeros tell.  Pairs more than six deviations below the threshold (a chance
of 1e-8) or of sizes that exclude a link go no further.  A cell proposes all its
pairs while they are few for its members, else the pairs of its greatest spanning
forest, so that a group of thousands of copies proposes about as many pairs.

*Verification.*  Proposed pairs are compared by their whole sets; one document's
set is in memory with one of its partners' at a time.  Cells that proposed a
forest only, and whose members are not all in one group after that, compare what
is left within the cell by whole sets, without writing pairs out.

Equal sets travel once, under the least of their ids.

Defined results: rows without words (NULL, empty, blank) have no shingles and
are linked with nothing; a text under five words is one shingle; rows with a
NULL id take no part, their component is NULL and they are kept; rows of one id
are one document, so their groups are one; repeated rows appear as often as they
came; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tendermill.llm.common import join_counted, materialise, one_row_each, text_bytes
from tendermill.llm.components import connected_components
from tendermill.llm.passages import WordHashes
from tendermill.llm.simhash import _stars, majority

SHINGLE = 5
PERCENT = 85
BUCKETS, MANTISSA = 128, 10
ROWS = 4
#: Bits of a value within its round.
VALUE = 48
#: Deviations of the estimate below the threshold that a pair may have.
DEVIATIONS = 6
BLOCK = 2048
#: Pairs a member that a cell may propose before it proposes a forest.
PAIRS = 4
#: Partners that meet one document's set in a row.
SALTS = 64
_ODD, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xFF51AFD7ED558CCD)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * _MIX
    x = (x ^ (x >> np.uint64(29))) * _ODD
    return x ^ (x >> np.uint64(32))


def shingle_set(raw: bytes, hashes: WordHashes, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the shingles of a lower-cased text."""
    words = raw.lower().split()
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    k = min(size, len(words))
    if not k:
        return h
    n = len(words) - k + 1
    x = np.full(n, k, np.uint64)
    for i in range(k):
        x = _mixed(x * _ODD + h[i : i + n])
    return np.unique(x)


def registers(shingles: np.ndarray) -> np.ndarray:
    """Leading zeros and mantissa of each bucket's least value, 16 bits each."""
    least = np.full(BUCKETS, np.iinfo(np.uint64).max, np.uint64)
    done, darts = 0, BUCKETS * (math.log(BUCKETS) + 3)
    while (least == np.iinfo(np.uint64).max).any():
        rounds = np.arange(done, done + math.ceil(darts / len(shingles)), dtype=np.uint64)
        x = _mixed(shingles[None, :] ^ _mixed(rounds + _ODD)[:, None])
        key = (rounds[:, None] << np.uint64(VALUE)) | (x >> np.uint64(64 - VALUE))
        np.minimum.at(least, (x % np.uint64(BUCKETS)).astype(np.int64).ravel(), key.ravel())
        done += len(rounds)
    value = least & np.uint64((1 << VALUE) - 1)
    zeros = (VALUE - np.frexp(value.astype(np.float64))[1]).astype(np.uint64)
    mantissa = ((value << zeros) >> np.uint64(VALUE - 1 - MANTISSA)) & np.uint64((1 << MANTISSA) - 1)
    return ((zeros << np.uint64(MANTISSA)) | mantissa).astype(np.uint16)


def band_keys(regs: np.ndarray) -> np.ndarray:
    """Signed 64-bit key of each band of each row of registers."""
    bands = np.ascontiguousarray(regs, "<u2").view("<u8")
    return _mixed(bands + np.arange(bands.shape[1], dtype=np.uint64) * _ODD).view(np.int64)


def estimates(regs: np.ndarray, rows: slice) -> np.ndarray:
    """Collision-corrected Jaccard similarity of some rows with all rows of registers."""
    equal = np.zeros((len(regs[rows]), len(regs)), np.int32)
    for b in range(BUCKETS):
        equal += regs[rows, b][:, None] == regs[None, :, b]
    zeros = regs >> MANTISSA
    share = np.zeros((len(regs), VALUE + 1), np.float32)
    for z in range(VALUE + 1):
        share[:, z] = (zeros == z).sum(axis=1) / BUCKETS
    by_chance = share[rows] @ share.T / (1 << MANTISSA)
    return (equal / np.float32(BUCKETS) - by_chance) / (1 - by_chance)


def least_estimate(percent: int) -> float:
    j = percent / 100
    return j - DEVIATIONS * math.sqrt(j * (1 - j) / BUCKETS)


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u2").reshape(-1, BUCKETS)


def _marks(least: int, with_prints: bool):
    """Size, mark, fingerprint and registers of each text; sets under ``least`` shingles have no registers, as they cannot be linked to another set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            sizes, marks, prints, regs = [], [], [], []
            for raw in batch["raw"]:
                found = shingle_set(raw.as_py(), hashes)
                sizes.append(len(found))
                marks.append(xxhash.xxh3_128_digest(found.tobytes()))
                prints.append(majority(found) if with_prints else 0)
                regs.append(registers(found).tobytes() if len(found) >= least else None)
            fp = pa.array(np.array(prints, np.uint64).view(np.int64))
            columns = [batch["doc_id"], batch["h"], pa.array(sizes, pa.int64()), pa.array(marks, pa.binary()), fp, pa.array(regs, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "h", "n", "mark", "fp", "regs"])

    return run


def _send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            keys = band_keys(_matrix(batch["regs"]))
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(np.repeat(batch["rep"].to_numpy(), keys.shape[1]))], names=["key", "rep"])


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows of one key and cell at a time."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        key, cell = batch["key"].to_numpy(), batch["cell"].to_numpy()
        cuts = [0, *(np.flatnonzero((key[1:] != key[:-1]) | (cell[1:] != cell[:-1])) + 1).tolist(), len(key)]
        if held and (held[-1]["key"][-1].as_py(), held[-1]["cell"][-1].as_py()) != (key[0], cell[0]):
            yield pa.Table.from_batches(held)
            held = []
        for s, e in zip(cuts[:-1], cuts[1:]):
            held.append(batch.slice(s, e - s))
            if e < len(key):
                yield pa.Table.from_batches(held)
                held = []
    if held:
        yield pa.Table.from_batches(held)


def _possible(t: pa.Table, percent: int) -> np.ndarray:
    """Estimate of each pair of a cell that may be linked, -1 for all others; blocks are compared across only, if there are two."""
    n, side, regs = t["n"].to_numpy(), t["side"].to_numpy(), _matrix(t["regs"])
    found = np.full((len(n), len(n)), -1, np.float32)
    two = side.any() and not side.all()
    bound = least_estimate(percent)
    for at in range(0, len(n), 256):
        rows = slice(at, min(at + 256, len(n)))
        est = estimates(regs, rows)
        ok = (est >= bound) & (100 * np.minimum(n[rows, None], n[None]) >= percent * np.maximum(n[rows, None], n[None]))
        if two:
            ok &= side[rows, None] != side[None]
        found[rows] = np.where(ok, est, -1)
    np.fill_diagonal(found, -1)
    return found


def _forest(est: np.ndarray) -> list[tuple[int, int]]:
    """Greatest spanning forest: in each round every tree takes its best pair with another one."""
    est, root, out = est.copy(), np.arange(len(est)), []

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return int(x)

    while True:
        best = est.argmax(axis=1)
        value = est[np.arange(len(est)), best]
        order = np.argsort(-value, kind="stable")
        order = order[value[order] >= 0]
        if not len(order):
            return out
        trees = np.fromiter(map(find, range(len(root))), np.int64, len(root))
        _, first = np.unique(trees[order], return_index=True)
        for i in order[first].tolist():
            a, b = find(i), find(int(best[i]))
            if a != b:
                root[max(a, b)] = min(a, b)
                out.append((i, int(best[i])))
        trees = np.fromiter(map(find, range(len(root))), np.int64, len(root))
        est[trees[:, None] == trees[None]] = -1


PROPOSED = pa.schema([("u", pa.int64()), ("v", pa.int64()), ("key", pa.int64()), ("cell", pa.int32()), ("more", pa.bool_())])


def _propose(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _cells(batches):
            est = _possible(t, percent)
            i, j = np.nonzero(np.triu(est >= 0))
            more = len(i) > PAIRS * len(est)
            if more:
                i, j = (np.array(x) for x in zip(*_forest(est)))
            if len(i):
                # The end with more pairs is the one whose set stays in memory.
                degree = np.bincount(np.concatenate([i, j]), minlength=len(est))
                swap = degree[i] < degree[j]
                i, j = np.where(swap, j, i), np.where(swap, i, j)
                rep = t["rep"].to_numpy()
                same = lambda c, kind: pa.array([t[c][0].as_py()] * len(i), kind)
                yield pa.RecordBatch.from_arrays([pa.array(rep[i]), pa.array(rep[j]), same("key", pa.int64()), same("cell", pa.int32()), pa.array([more] * len(i))], schema=PROPOSED)

    return run


def common(a: np.ndarray, b: np.ndarray) -> int:
    """Number of values in both of two sorted sets."""
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    return int((large[np.minimum(np.searchsorted(large, small), len(large) - 1)] == small).sum()) if len(small) else 0


def _verify(percent: int):
    """Rows in order of ``u, salt, role``: the set of u (role 0), then its partners."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, own = WordHashes(), np.empty(0, np.uint64)
        for batch in batches:
            out = []
            for u, v, role, raw in zip(batch["u"].to_pylist(), batch["v"].to_pylist(), batch["role"].to_pylist(), batch["raw"]):
                found = shingle_set(raw.as_py(), hashes)
                if not role:
                    own = found
                elif 100 * (both := common(own, found)) >= percent * (len(own) + len(found) - both):
                    out.append((u, v))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out)], names=["u", "v"])

    return run


def intersections(sets: list[np.ndarray]) -> np.ndarray:
    """Common values of all pairs of sets, as products of the rows of a 0/1 table of the values that two or more of them hold."""
    _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    shared = count[column] > 1
    row, column = row[shared], np.cumsum(count > 1)[column[shared]] - 1
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    out = np.zeros((len(sets), len(sets)), np.float32)
    width = max(256, (4 << 20) // len(sets))
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        s, e = np.searchsorted(column, (at, at + width))
        table = np.zeros((len(sets), width), np.float32)
        table[row[s:e], column[s:e] - at] = 1
        out += table @ table.T
    return out.astype(np.int64)


def _rest(percent: int):
    """Links of a cell between groups, by whole sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for t in _cells(batches):
            group = t["component"].to_numpy()
            open_pairs = (_possible(t, percent) >= 0) & (group[:, None] != group[None])
            inside = np.flatnonzero(open_pairs.any(axis=1))
            if not len(inside):
                continue
            sets = [shingle_set(t["raw"][i].as_py(), hashes) for i in inside.tolist()]
            both, n = intersections(sets), np.array([len(s) for s in sets])
            i, j = np.nonzero(np.triu(open_pairs[np.ix_(inside, inside)]) & (100 * both >= percent * (n[:, None] + n[None] - both)))
            rep = t["rep"].to_numpy()[inside]
            u, v = _stars(rep[i], rep[j])
            if len(u):
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

    return run


def _hashed(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``h`` (tells the texts of one id apart) and ``raw`` of rows with an id."""
    return text_bytes(docs, "doc_id").where("doc_id is not null").select("doc_id", F.xxhash64("raw").alias("h"), "raw")


def marked(docs: DataFrame, percent: int = PERCENT, with_prints: bool = False) -> DataFrame:
    """``doc_id, h, n, mark, fp, regs`` of each row with an id; equal sets have equal marks.

    ``fp`` is the majority fingerprint of the set, if asked for.
    """
    least = next(n for n in range(1, 101) if 100 * n >= percent * (n + 1))
    return materialise(_hashed(docs).mapInArrow(_marks(least, with_prints), "doc_id long, h long, n long, mark binary, fp long, regs binary"), "hyper-marks")


def _groups(reps: DataFrame, block: int) -> DataFrame:
    """``key, rep, cell, side``: the members of each band key with two or more, once for each cell."""
    sent = reps.mapInArrow(_send, "key long, rep long")
    members = F.sum(F.xxhash64("rep").cast("decimal(38,0)")), F.sum(F.xxhash64("rep", F.lit(1)).cast("decimal(38,0)"))
    groups = sent.groupBy("key").agg(F.count("*").alias("size"), *(m.alias(f"m{i}") for i, m in enumerate(members))).where("size > 1")
    groups = groups.groupBy("size", "m0", "m1").agg(F.min("key").alias("key"))
    groups = groups.select("key", F.when(F.col("size") > block, F.ceil(F.col("size") * 2 / block).cast("int")).alias("parts"))
    cut, own = sent.join(groups, "key"), F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int")
    cell = lambda j: F.struct((F.least(own, j) * F.col("parts") + F.greatest(own, j)).alias("cell"), F.when(own > j, 1).otherwise(0).alias("side"))
    whole = F.array(F.struct(F.lit(0).alias("cell"), F.lit(0).alias("side")))
    cells = F.when(F.col("parts").isNull(), whole).otherwise(F.transform(F.sequence(F.lit(0), F.col("parts") - 1), cell))
    return cut.select("key", "rep", F.inline(cells))


def _by_cell(df: DataFrame) -> DataFrame:
    return df.repartition("key", "cell").sortWithinPartitions("key", "cell")


#: From ``rep, h, n, fp, regs`` of all sets to further pairs ``u, v`` for verification.
Proposer = Callable[[DataFrame], DataFrame]


def links(docs: DataFrame, marks: DataFrame, percent: int = PERCENT, block: int = BLOCK, propose: Proposer | None = None) -> DataFrame:
    """Edges ``(u, v)`` between the least ids of sets; they join what all links join.  ``marks`` are those of :func:`marked`."""
    firsts = [F.first(c).alias(c) for c in ("n", "fp", "regs")]
    reps = marks.where("regs is not null").groupBy("mark").agg(F.min(F.struct("doc_id", "h")).alias("r"), *firsts)
    reps = materialise(reps.select(F.col("r.doc_id").alias("rep"), F.col("r.h").alias("h"), "n", "fp", "regs"), "hyper-reps")
    groups = materialise(_groups(reps, block), "hyper-groups")
    known = reps.select("rep", "n", "regs")
    proposed = _by_cell(groups.join(known, "rep")).mapInArrow(_propose(percent), "u long, v long, key long, cell int, more boolean")
    proposed = materialise(proposed, "hyper-proposed")
    pairs = proposed.select("u", "v").distinct()
    if propose:
        pairs = materialise(pairs.unionByName(propose(reps).select("u", "v")).distinct(), "hyper-pairs")

    wanted = reps.join(pairs.select(F.explode(F.array("u", "v")).alias("rep")).distinct(), "rep", "left_semi").select("rep", "h")
    texts = _hashed(docs).withColumnRenamed("doc_id", "rep").join(wanted, ["rep", "h"]).groupBy("rep").agg(F.first("raw").alias("raw"))
    texts = materialise(texts, "hyper-texts")
    salted = pairs.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int"))
    partners = salted.join(texts.withColumnRenamed("rep", "v"), "v").select("u", "salt", F.lit(1).alias("role"), "v", "raw")
    owners = salted.select("u", "salt").distinct().join(texts.withColumnRenamed("rep", "u"), "u")
    rows = owners.select("u", "salt", F.lit(0).alias("role"), F.lit(None).cast("long").alias("v"), "raw").unionByName(partners)
    rows = rows.repartition("u", "salt").sortWithinPartitions("u", "salt", "role")
    found = materialise(rows.mapInArrow(_verify(percent), "u long, v long"), "hyper-links")

    unfinished = proposed.where("more").select("key", "cell").distinct()
    if unfinished.isEmpty():
        return found
    grouped = connected_components(found).withColumnRenamed("node", "rep")
    left = groups.join(unfinished, ["key", "cell"], "left_semi").join(grouped, "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    left = materialise(left, "hyper-left")
    several = left.groupBy("key", "cell").agg(F.min("component").alias("a"), F.max("component").alias("b")).where("a < b").select("key", "cell")
    met = left.join(several, ["key", "cell"], "left_semi").join(known, "rep").join(texts, "rep")
    between = materialise(_by_cell(met).mapInArrow(_rest(percent), "u long, v long"), "hyper-rest")
    # The groups so far are stars, which join what their links joined.
    return grouped.select(F.col("rep").alias("u"), F.col("component").alias("v")).unionByName(between)


def components(docs: DataFrame, percent: int = PERCENT, block: int = BLOCK, propose: Proposer | None = None, empty_alike: bool = False) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of each row of ``docs``.

    With ``empty_alike``, documents without shingles are copies of each other.
    """
    marks = marked(docs, percent, propose is not None)
    alone = F.lit(False) if empty_alike else F.col("n") == 0
    sets = marks.where(~alone).groupBy("mark").agg(F.min("doc_id").alias("rep"), F.count("*").alias("members"))
    sets = materialise(sets, "hyper-sets")
    with_sets = join_counted(marks.where(~alone).select("doc_id", "n", "mark"), sets, "mark").select("doc_id", "n", "rep")
    rows = materialise(with_sets.unionByName(marks.where(alone).select("doc_id", "n", F.col("doc_id").alias("rep"))), "hyper-rows")
    # Rows of one id with several sets are one document.
    repeated = rows.groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("b")).where("a < b").select("doc_id")
    same = rows.join(repeated, "doc_id").select(F.col("doc_id").alias("u"), F.col("rep").alias("v"))
    found = connected_components(links(docs, marks, percent, block, propose).unionByName(same)).withColumnRenamed("node", "rep")
    table = rows.groupBy("rep").agg(F.count("*").alias("members")).join(found, "rep", "left")
    table = materialise(table.select("rep", "members", F.coalesce("component", "rep").alias("component_id")), "hyper-components")
    named = join_counted(rows, table, "rep").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    unnamed = text_bytes(docs, "doc_id").where("doc_id is null").select("doc_id", "raw").mapInArrow(_sizes, "doc_id long, n_shingles long")
    every = named.unionByName(unnamed.select("doc_id", "n_shingles", F.lit(None).cast("long").alias("component_id")))
    return every.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = WordHashes()
    for batch in batches:
        sizes = [len(shingle_set(raw.as_py(), hashes)) for raw in batch["raw"]]
        yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(sizes, pa.int64())], names=["doc_id", "n_shingles"])


def drop(docs: DataFrame, percent: int = PERCENT, block: int = BLOCK) -> DataFrame:
    """One document of each group, the one with the smallest id, with all its columns; rows with a NULL id stay."""
    chosen = components(docs.select("doc_id", "text"), percent, block).where("doc_id = component_id").select("doc_id").distinct()
    return one_row_each(docs, chosen)
