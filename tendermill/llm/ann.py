"""Approximate nearest neighbours: a navigable small-world graph per shard.

Equal vectors are indexed once, with the smallest of their ids (more than any
result can hold are never needed).  Distinct vectors are dealt to shards of
bounded size by hash; each shard is one hierarchical graph, stored as flat
arrays: vectors, the members of each level, and per level an (n, degree) table
of neighbours.  Shards and blocks of queries are files in the shared folder; a
task loads one shard and passes some blocks of queries through it, so no vector
is copied by a shuffle.  The shards' results are merged by exact score.

Largest inner products are nearest distances once each vector gets one more
coordinate that brings it to the shard's greatest norm, so the graph is built
and searched in that space, in double precision; scores are products of the
original vectors.  Points are inserted, and queries answered, many at a time:
all of a batch take a step of the beam search together in numpy.

How wide a beam must be depends on the vectors: products of vectors with unequal
norms have queries far from all points.  Once built, a shard answers ``TRIALS``
of its own vectors with beams of growing width until they find ``AIM`` of what a
comparison with all its vectors finds, and keeps that width; there is no end to
the widening but the shard's size, at which the search is exact.

Defined results: vectors that are NULL, of length zero norm, or with NULL or
non-finite components, and rows with a NULL id, take no part; neither do vectors
of another length than the most frequent one; a repeated id counts once for each
vector that it has; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tendermill.llm.common import as_uri, get_arrays, materialise, new_path, put_arrays

K = 20
QUERY_EVERY = 20
SHARD = 16384
#: Queries in a block, and blocks that a task passes through its shard.
BLOCK = 512
BLOCKS = 8
DEGREE = 24
EF_BUILD = 48
EF_SEARCH = 200
#: Queries that try a new graph, and the share of their neighbours that it must find.
TRIALS, AIM = 200, 0.97
LEVEL_RATIO = 16
BATCH = 512
OPENED = 4


class Graph:
    """Flat arrays of one shard: ``levels[l]`` are the members, ``links[l]`` their neighbours (by position in the level, -1: none)."""

    def __init__(self, vectors: np.ndarray, levels: list[np.ndarray], links: list[np.ndarray]):
        self.vectors, self.levels, self.links = vectors, levels, links

    @classmethod
    def build(cls, vectors: np.ndarray, seed: int = 1) -> Graph:
        """Levels are nested random subsets, each a ``LEVEL_RATIO``-th of the one below, built from the top."""
        n = len(vectors)
        order = np.random.default_rng(seed).permutation(n)
        sizes = [n]
        while sizes[-1] > 2 * DEGREE:
            sizes.append(-(-sizes[-1] // LEVEL_RATIO))
        graph = cls(vectors, [order[:s] for s in sizes], [np.full((s, DEGREE), -1, np.int32) for s in sizes])
        for level in range(len(sizes) - 1, -1, -1):
            graph._fill(level)
        return graph

    def _fill(self, level: int) -> None:
        """Insert the members of a level, in growing batches; the level above gives entry points."""
        x, links = self.vectors[self.levels[level]], self.links[level]
        done = min(len(x), 2 * DEGREE)
        d = _distances(x[:done], x[:done])
        np.fill_diagonal(d, np.inf)
        near = np.argsort(d, axis=1)[:, : min(DEGREE, done - 1)]
        links[:done, : near.shape[1]] = near
        while done < len(x):
            end = min(len(x), done + min(BATCH, max(32, done // 2)))
            new = np.arange(done, end)
            entry = self._entries(x[new], level)
            entry = np.where(entry < done, entry, 0)
            found, dist = _beam(x, links, x[new], entry, EF_BUILD, done)
            # Newcomers of one batch may be each other's neighbours too.
            mutual = _distances(x[new], x[new])
            np.fill_diagonal(mutual, np.inf)
            peers = np.argsort(mutual, axis=1)[:, :DEGREE]
            found = np.concatenate([found, new[peers]], axis=1)
            dist = np.concatenate([dist, np.take_along_axis(mutual, peers, axis=1)], axis=1)
            chosen = _diverse(x, found, dist)
            links[new] = chosen
            self._link_back(x, links, new, chosen)
            done = end

    @staticmethod
    def _link_back(x: np.ndarray, links: np.ndarray, new: np.ndarray, chosen: np.ndarray) -> None:
        """Add reverse links; where a list overflows, choose again among old and new."""
        target, source = chosen.ravel(), np.repeat(new, chosen.shape[1])
        target, source = target[target >= 0], source[target >= 0]
        order = np.argsort(target, kind="stable")
        target, source = target[order], source[order]
        nodes, first, count = np.unique(target, return_index=True, return_counts=True)
        rank = np.arange(len(target)) - np.repeat(first, count)
        room = 2 * DEGREE
        while len(nodes):
            batch = np.full((len(nodes), room), -1, np.int32)
            part = rank < room
            batch[np.repeat(np.arange(len(nodes)), count)[part], rank[part]] = source[part]
            both = np.concatenate([links[nodes], batch], axis=1)
            both[both == nodes[:, None]] = -1
            off = x[both] - x[nodes][:, None]
            d = np.where(both >= 0, np.einsum("bid,bid->bi", off, off), np.inf)
            links[nodes] = _diverse(x, both, d)
            more = count > room
            keep = np.repeat(more, count) & (rank >= room)
            target, source, rank = target[keep], source[keep], rank[keep] - room
            nodes, count = nodes[more], count[more] - room

    def _entries(self, queries: np.ndarray, level: int) -> np.ndarray:
        """Positions in ``level`` that the search of the levels above leads to."""
        entry = np.zeros(len(queries), np.int64)
        for above in range(len(self.levels) - 1, level, -1):
            x = self.vectors[self.levels[above]]
            entry = _beam(x, self.links[above], queries, entry, 8, len(x))[0][:, 0]
        return entry

    def search(self, queries: np.ndarray, k: int, ef: int = EF_SEARCH) -> np.ndarray:
        """Up to ``k`` rows of ``vectors`` near each query, -1 where there are fewer."""
        x = self.vectors[self.levels[0]]
        found = _beam(x, self.links[0], queries, self._entries(queries, 0), max(ef, k), len(x))[0][:, :k]
        return np.where(found >= 0, self.levels[0][found], -1)


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    middle = a.mean(axis=0)  # near copies far from zero would cancel
    a, b = a - middle, b - middle
    return np.maximum((a**2).sum(axis=1)[:, None] + (b**2).sum(axis=1)[None] - 2 * a @ b.T, 0)


def _diverse(x: np.ndarray, found: np.ndarray, dist: np.ndarray) -> np.ndarray:
    """Neighbours that are nearer to the point than to one another, then the nearest of the rest."""
    order = np.argsort(dist, axis=1, kind="stable")[:, : 2 * DEGREE]
    found, dist = np.take_along_axis(found, order, axis=1), np.take_along_axis(dist, order, axis=1)
    found = np.where(np.isfinite(dist), found, -1)
    same = np.zeros(found.shape, bool)
    same[:, 1:] = found[:, 1:] == found[:, :-1]
    valid = (found >= 0) & ~same
    points = x[found] - x[found[:, :1]]
    norm = (points**2).sum(axis=2)
    between = norm[:, :, None] + norm[:, None, :] - 2 * points @ points.transpose(0, 2, 1)
    kept = np.zeros(found.shape, bool)
    for i in range(found.shape[1]):
        hidden = (kept[:, :i] & (between[:, i, :i] < dist[:, i, None])).any(axis=1) if i else np.zeros(len(found), bool)
        kept[:, i] = valid[:, i] & ~hidden
    first = np.argsort(np.where(kept, 0, np.where(valid, 1, 2)), axis=1, kind="stable")[:, :DEGREE]
    out = np.where(np.take_along_axis(valid, first, axis=1), np.take_along_axis(found, first, axis=1), -1)
    return np.pad(out, ((0, 0), (0, DEGREE - out.shape[1])), constant_values=-1).astype(np.int32)


def _beam(x: np.ndarray, links: np.ndarray, queries: np.ndarray, entry: np.ndarray, ef: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Beam search of all queries in step: the ``ef`` nearest points reached, nearest first.

    A step opens the ``OPENED`` nearest points of each beam that are still closed.
    """
    b, width = len(queries), OPENED * links.shape[1]
    rows = np.arange(b)
    seen = np.full((b, n), -1, np.int32)
    seen[rows, entry] = 0
    ids = np.full((b, ef), -1, np.int64)
    dist = np.full((b, ef), np.inf)
    closed = np.zeros((b, ef), bool)
    ids[:, 0], closed[:, 0] = entry, True
    middle = x[:n].mean(axis=0)
    x, queries = x[:n] - middle, queries - middle
    norms, own = (x**2).sum(axis=1), (queries**2).sum(axis=1)
    dist[:, 0] = ((x[entry] - queries) ** 2).sum(axis=1)
    active = rows
    while len(active):
        order = closed[active].cumsum(axis=1)
        live = order[:, -1] > 0
        active, order = active[live], order[live]
        if not len(active):
            break
        r, c = np.nonzero(closed[active] & (order <= OPENED))
        place = order[r, c] - 1
        q = active[r]
        closed[q, c] = False
        near = links[ids[q, c]]
        fresh = (near >= 0) & (near < n)
        fresh &= seen[q[:, None], np.maximum(near, 0) * fresh] < 0
        i, k = np.nonzero(fresh)
        cand, q = near[i, k], q[i]
        # A point that two opened points lead to counts once: the last mark stands.
        mark = np.arange(len(cand), dtype=np.int32)
        seen[q, cand] = mark
        once = seen[q, cand] == mark
        i, k, cand, q = i[once], k[once], cand[once], q[once]
        d, new = np.full((len(active), width), np.inf), np.full((len(active), width), -1, np.int64)
        at = place[i] * links.shape[1] + k
        d[r[i], at] = norms[cand] + own[q] - 2 * np.einsum("ij,ij->i", x[cand], queries[q])
        new[r[i], at] = cand
        all_d = np.concatenate([dist[active], d], axis=1)
        best = np.argsort(all_d, axis=1)[:, :ef]
        dist[active] = np.take_along_axis(all_d, best, axis=1)
        ids[active] = np.take_along_axis(np.concatenate([ids[active], new], axis=1), best, axis=1)
        closed[active] = np.take_along_axis(np.concatenate([closed[active], new >= 0], axis=1), best, axis=1)
    return ids, dist


def lifted(vectors: np.ndarray) -> np.ndarray:
    """One coordinate more, so that all vectors have the greatest norm."""
    norms = (vectors**2).sum(axis=1)
    return np.concatenate([vectors, np.sqrt(np.maximum(norms.max() - norms, 0))[:, None]], axis=1)


def calibrated(graph: Graph, vectors: np.ndarray, k: int = K, seed: int = 2) -> int:
    """Beam width at which ``TRIALS`` of the graph's vectors find ``AIM`` of their ``k`` largest products."""
    n = len(vectors)
    if n <= max(EF_SEARCH, k + 1):
        return EF_SEARCH
    q = vectors[np.random.default_rng(seed).choice(n, min(TRIALS, n), replace=False)]
    exact = np.argpartition(-(q @ vectors.T), k, axis=1)[:, : k + 1]
    ef = EF_SEARCH
    while ef < n:
        found = graph.search(np.pad(q, ((0, 0), (0, 1))), k + 1, ef)
        if np.mean([np.isin(e, f).mean() for e, f in zip(exact, found)]) >= AIM:
            break
        ef *= 2
    return min(ef, n)


INDEX_SQL = "shard int, n int, file string"


def _build(root: str):
    def run(rows: pa.Table) -> pa.Table:
        """Write the index of a shard's distinct vectors."""
        vectors = np.array(rows["embedding"].to_pylist(), np.float64)
        graph = Graph.build(lifted(vectors))
        ids = rows["ids"].to_pylist()
        shard = rows["shard"][0].as_py()
        arrays = {
            "vectors": vectors,
            "ids": np.concatenate([np.array(x, np.int64) for x in ids]),
            "counts": np.array([len(x) for x in ids], np.int32),
            "levels": np.concatenate(graph.levels).astype(np.int32),
            "links": np.concatenate(graph.links),
            "sizes": np.array([len(x) for x in graph.levels], np.int32),
            "ef": np.array(calibrated(graph, vectors)),
        }
        put_arrays(f"{root}/shard-{shard:06d}", arrays)
        return pa.Table.from_pylist([{"shard": shard, "n": len(vectors), "file": f"{root}/shard-{shard:06d}"}], schema=pa.schema([("shard", pa.int32()), ("n", pa.int32()), ("file", pa.string())]))

    return run


def _block(root: str):
    def run(rows: pa.Table) -> pa.Table:
        block = rows["block"][0].as_py()
        put_arrays(f"{root}/block-{block:06d}", {"ids": rows["query_id"].to_numpy(), "vectors": np.array(rows["embedding"].to_pylist(), np.float64)})
        return pa.Table.from_pylist([{"block": block, "queries": f"{root}/block-{block:06d}"}], schema=pa.schema([("block", pa.int32()), ("queries", pa.string())]))

    return run


class Shard:
    def __init__(self, file: str):
        a = get_arrays(file)
        cuts = np.cumsum(a["sizes"])[:-1]
        self.vectors, self.ids, self.counts = a["vectors"], a["ids"], a["counts"]
        self.starts, self.ef = np.cumsum(self.counts) - self.counts, int(a["ef"])
        self.graph = Graph(lifted(self.vectors), np.split(a["levels"], cuts), np.split(a["links"], cuts))

    def nearest(self, wanted: np.ndarray, q: np.ndarray, k: int, ef: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Up to ``k`` of query, id and score for each query, by exact score among all that the beam found."""
        found = self.graph.search(np.pad(q, ((0, 0), (0, 1))), max(ef, self.ef, k + 1), max(ef, self.ef))
        r, c = np.nonzero(found >= 0)
        points = found[r, c]
        score = np.einsum("ij,ij->i", q[r], self.vectors[points])
        # Copies share the score; of a query's results at most k + 1 can matter.
        times = self.counts[points]
        at = np.repeat(self.starts[points], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        query, vec, score = np.repeat(wanted[r], times), self.ids[at], np.repeat(score, times)
        keep = query != vec
        query, vec, score = query[keep], vec[keep], score[keep]
        order = np.lexsort((vec, -score, query))
        query, vec, score = query[order], vec[order], score[order]
        first = np.concatenate(([True], query[1:] != query[:-1])) if len(query) else np.zeros(0, bool)
        rank = np.arange(len(query)) - np.maximum.accumulate(np.where(first, np.arange(len(query)), 0))
        top = rank < k
        return query[top], vec[top], score[top]


FOUND = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])


def _search(k: int, ef: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, shard = None, None
        for batch in batches:
            for row in batch.to_pylist():
                if row["file"] != file:
                    file, shard = row["file"], Shard(row["file"])
                q = get_arrays(row["queries"])
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in shard.nearest(q["ids"], q["vectors"], k, ef)], schema=FOUND)

    return run


def usable(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & finite & F.exists(vector, lambda x: x != 0)


def index(vectors: DataFrame, k: int = K, shard: int = SHARD) -> DataFrame:
    """``shard, n, file`` of each shard, from ``vec_id, embedding``."""
    smallest = Window.partitionBy("embedding").orderBy("vec_id")
    firsts = vectors.distinct().withColumn("r", F.row_number().over(smallest)).where(F.col("r") <= k + 1)
    points = firsts.groupBy("embedding").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    points = materialise(points, "ann-points")
    n = max(1, -(-points.count() // shard))
    dealt = points.withColumn("shard", F.pmod(F.xxhash64("embedding"), F.lit(n)).cast("int"))
    root = as_uri(new_path(vectors.sparkSession, "ann-shards"))
    # As many ranges as shards, which are of one size: graphs are built side by side, one a task.
    return materialise(dealt.repartitionByRange(n, "shard").groupBy("shard").applyInArrow(_build(root), INDEX_SQL), "ann-index")


def search(queries: DataFrame, indexed: DataFrame, k: int = K, block: int = BLOCK, ef: int = EF_SEARCH) -> DataFrame:
    """``query_id, rank, vec_id, score`` for ``queries(query_id, embedding)``, all of them against all shards.

    Shards and blocks of queries meet as pairs of file names.
    """
    n_blocks = max(1, -(-queries.count() // block))
    cut = queries.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(n_blocks)).cast("int"))
    root = as_uri(new_path(queries.sparkSession, "ann-queries"))
    blocks = materialise(cut.groupBy("block").applyInArrow(_block(root), "block int, queries string"), "ann-blocks")
    all_blocks = F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1)))
    pairs = indexed.select("shard", "file", all_blocks.alias("block")).join(blocks, "block")
    batch = F.floor(F.col("block") / BLOCKS)
    tasks = max(1, indexed.count()) * -(-n_blocks // BLOCKS)
    pairs = pairs.repartitionByRange(tasks, "shard", batch).sortWithinPartitions("shard", "block").select("file", "queries")
    found = pairs.mapInArrow(_search(k, ef), "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return best.select("query_id", "rank", "vec_id", "score")


def neighbours(embeddings: DataFrame, every: int = QUERY_EVERY, k: int = K, shard: int = SHARD) -> DataFrame:
    """The ``k`` nearest other rows of each row whose id is divisible by ``every``."""
    good = embeddings.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    good = good.where(F.col("vec_id").isNotNull() & usable(F.col("embedding")))
    sizes = good.groupBy(F.size("embedding").alias("d")).count().orderBy(F.col("count").desc(), "d").limit(1).collect()
    good = good.where(F.size("embedding") == (sizes[0]["d"] if sizes else 0))
    queries = good.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), "embedding").distinct()
    return search(queries, index(good, k, shard), k)
