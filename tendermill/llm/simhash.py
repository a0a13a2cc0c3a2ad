"""SimHash near-duplicates by anchor points of a covering code.

A fingerprint has 64 bits.  Two fingerprints that differ in at most four bits
differ in at most two bits of one of two disjoint 31-bit halves (two bits stay
over).  On each half the anchors are the words of the perfect [31, 26] Hamming
code, whose covering radius is 1: the midpoint of two halves at distance two is
one bit from each and at most one from an anchor, so both halves lie within
radius plus half their threshold (1 + 1 bits) of that anchor.  A fingerprint is
therefore sent to the 16 anchors (one, if it is itself an anchor) within two
bits of each half, and fingerprints are compared per anchor.  No link is lost.

Copies share one fingerprint and travel once.  An anchor with more than
``block`` fingerprints is cut into blocks that meet pairwise, so no task holds
an unbounded group; within a task found links are reduced to stars.

Defined results: a text without words (NULL, empty, blank) has fingerprint
zero and links like any other; rows with a NULL id take no part in components
(their component is NULL) and repeated rows appear as often as they came.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tendermill.llm.common import join_counted, materialise, one_row_each, text_bytes
from tendermill.llm.components import connected_components

SHINGLE = 4
SEED = 42
THRESHOLD = 4
HALF = 31
BLOCK = 2048


def shingle_hashes(raw: bytes, size: int = SHINGLE) -> np.ndarray:
    """XXH64 of each shingle of the lower-cased words, repeats included."""
    words = raw.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(size, len(words))
    digest = xxhash.xxh64_intdigest
    cuts = zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist())
    return np.fromiter((digest(joined[a:b], SEED) for a, b in cuts), np.uint64, len(words) - k + 1)


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half of ``hashes``, as an unsigned integer."""
    n = len(hashes)
    if not n:
        return 0
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):
        part = np.ascontiguousarray(hashes[at : at + (1 << 16)], dtype="<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprint(raw: bytes) -> int:
    return majority(shingle_hashes(raw))


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = np.fromiter((fingerprint(x) for x in batch["raw"].to_pylist()), np.uint64, batch.num_rows)
        keys = [batch[c] for c in batch.schema.names[:-1]]
        yield pa.RecordBatch.from_arrays([*keys, pa.array(found.view(np.int64))], names=[*batch.schema.names[:-1], "fp"])


def with_fingerprints(docs: DataFrame, *keys: str) -> DataFrame:
    """``keys`` and ``fp``, the fingerprint as a signed long, of each row."""
    plain = text_bytes(docs, *keys)
    fields = ", ".join(f"`{c}` {plain.schema[c].dataType.simpleString()}" for c in keys)
    return plain.mapInArrow(_fingerprints, f"{fields}, fp long")


def anchor_flips() -> list[list[int]]:
    """For each syndrome, the bit flips that lead to a code word within two bits.

    Position i (from 1) has the parity column i, so flipping positions whose
    numbers xor to the syndrome gives a code word.
    """
    out = [[0]]
    for s in range(1, HALF + 1):
        pairs = [(a, a ^ s) for a in range(1, HALF + 1) if a < a ^ s <= HALF]
        out.append([1 << s - 1, *((1 << a - 1) | (1 << b - 1) for a, b in pairs)])
    return out


def syndrome(half: Column) -> Column:
    """Xor of the numbers of the set positions, a parity bit at a time."""
    out = F.lit(0)
    for j in range(5):
        mask = sum(1 << i - 1 for i in range(1, HALF + 1) if i >> j & 1)
        parity = F.bit_count(half.bitwiseAND(F.lit(mask))).bitwiseAND(F.lit(1))
        out = out + F.shiftleft(parity, j)
    return out


def anchors(fp: Column) -> Column:
    """Array of the anchors to which a fingerprint goes; bit 31 tells the half."""
    flips = F.array(*[F.array(*[F.lit(x).cast("long") for x in row]) for row in anchor_flips()])

    def side(number: int) -> Column:
        half = F.shiftright(fp, HALF * number).bitwiseAND(F.lit((1 << HALF) - 1))
        return F.transform(F.get(flips, syndrome(half)), lambda m: half.bitwiseXOR(m) + F.lit(number << HALF))

    return F.concat(side(0), side(1))


def _stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Replace links by links to the smallest member of each group they form."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := root.setdefault(x, x)) != x:
            root[x] = root.setdefault(up, up)
            x = up
        return x

    for x, y in zip(a.tolist(), b.tolist()):
        x, y = find(x), find(y)
        if x != y:
            root[max(x, y)] = min(x, y)
    nodes = [x for x in root if find(x) != x]
    return np.array(nodes, np.int64), np.array([find(x) for x in nodes], np.int64)


def _close_within(fp: np.ndarray, rep: np.ndarray, side: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Links within one group; blocks (side 0 and 1) are compared across only, if there are two."""
    two = side.any() and not side.all()
    left, right = (np.flatnonzero(side == 0), np.flatnonzero(side == 1)) if two else (np.arange(len(fp)),) * 2
    found = []
    for at in range(0, len(left), 256):
        i = left[at : at + 256]
        x, y = np.nonzero(np.bitwise_count(fp[i][:, None] ^ fp[right][None, :]) <= limit)
        found.append((rep[i[x]], rep[right[y]]))
    a, b = (np.concatenate(z) for z in zip(*found))
    return _stars(a[a != b], b[a != b])


def _compare(limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def links(rows: pa.Table) -> Iterator[pa.RecordBatch]:
            if rows.num_rows < 2:
                return
            key, cell, side, fp, rep = (rows[c].to_numpy() for c in ("anchor", "cell", "side", "fp", "rep"))
            fp = fp.view(np.uint64)
            new = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (cell[1:] != cell[:-1]))))
            sizes = np.diff(np.append(new, len(key)))
            a, b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
            group = np.repeat(np.arange(len(new)), sizes)
            small = np.repeat(sizes <= 16, sizes)
            for k in range(1, int(sizes[sizes <= 16].max(initial=1))):
                at = np.flatnonzero((group[k:] == group[:-k]) & small[k:])
                at = at[np.bitwise_count(fp[at] ^ fp[at + k]) <= limit]
                a.append(rep[at])
                b.append(rep[at + k])
            for s, n in zip(new[sizes > 16].tolist(), sizes[sizes > 16].tolist()):
                x, y = _close_within(fp[s : s + n], rep[s : s + n], side[s : s + n], limit)
                a.append(x)
                b.append(y)
            u, v = _stars(np.concatenate(a), np.concatenate(b))
            if len(u):
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

        for batch in batches:
            if not batch.num_rows:
                continue
            keys, cells = batch["anchor"].to_numpy(), batch["cell"].to_numpy()
            last = np.flatnonzero((keys != keys[-1]) | (cells != cells[-1]))
            cut = int(last[-1]) + 1 if len(last) else 0
            if cut or (held and (held[-1]["anchor"][-1], held[-1]["cell"][-1]) != (batch["anchor"][0], batch["cell"][0])):
                yield from links(pa.Table.from_batches([*held, batch.slice(0, cut)]))
                held = []
            held.append(batch.slice(cut))
        if held:
            yield from links(pa.Table.from_batches(held))

    return run


def links(reps: DataFrame, limit: int = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """Star edges ``(u, v)`` between the ``rep`` of fingerprints within ``limit`` bits.

    ``reps(fp, rep)`` holds each fingerprint once.  Anchors over ``block`` are
    cut by a hash of the fingerprint; block pair (i, j) is one cell.
    """
    sent = reps.select(F.explode(anchors(F.col("fp"))).alias("anchor"), "fp", "rep")
    hot = sent.groupBy("anchor").count().where(F.col("count") > block)
    hot = hot.select("anchor", F.ceil(F.col("count") * 2 / block).cast("int").alias("n"))
    cut = sent.join(hot, "anchor", "left")
    own = F.pmod(F.xxhash64("fp"), F.col("n")).cast("int")
    cells = F.when(F.col("n").isNull(), F.array(F.struct(F.lit(0).alias("cell"), F.lit(0).alias("side")))).otherwise(
        F.transform(
            F.sequence(F.lit(0), F.col("n") - 1),
            lambda j: F.struct(
                (F.least(own, j) * F.col("n") + F.greatest(own, j)).alias("cell"), F.when(own > j, 1).otherwise(0).alias("side")
            ),
        )
    )
    dealt = cut.select("anchor", "fp", "rep", F.inline(cells))
    dealt = dealt.repartition("anchor", "cell").sortWithinPartitions("anchor", "cell")
    return dealt.mapInArrow(_compare(limit), "u long, v long")


def components(docs: DataFrame, limit: int = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """``doc_id, fp, component_id`` of each row of ``docs``."""
    if limit > THRESHOLD:
        raise ValueError("the two halves cover four differing bits")
    marked = materialise(with_fingerprints(docs, "doc_id"), "fingerprints")
    known = marked.where("doc_id is not null")
    reps = materialise(known.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count("*").alias("members")), "fingerprint-reps")
    found = connected_components(links(reps.select("fp", "rep"), limit, block))
    named = reps.join(found.withColumnRenamed("node", "rep"), "rep", "left")
    named = materialise(named.select("fp", F.coalesce("component", "rep").alias("component_id"), "members"), "fingerprint-components")
    without = marked.where("doc_id is null").select("doc_id", "fp", F.lit(None).cast("long").alias("component_id"))
    return join_counted(known, named, "fp").select("doc_id", "fp", "component_id").unionByName(without)


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """One document of each component, the one with the smallest id; NULL ids stay.

    Repeated rows of one id are copies too: the smallest row stays.
    """
    chosen = components(docs.select("doc_id", "text")).where("doc_id = component_id").select("doc_id").distinct()
    return one_row_each(docs, chosen)
