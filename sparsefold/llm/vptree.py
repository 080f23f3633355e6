"""Nearest neighbours by vantage-point trees, one per shard of rows.

Rows are dealt to shards of bounded size by a hash of their id, so equal or similar vectors fill no shard. A shard's task
builds its tree: each node holds a vantage point and the median of its distances, which splits the rows. A block of
queries descends together; a side is skipped if the triangle inequality, with the gap to the median stretched by
``factor``, rules out anything nearer than the k-th best so far. Factor 1 skips only what cannot matter and is exact,
ties included. Shards and blocks of queries meet by an equi-join on the shard; each pair reports k rows at most.

Distances are Euclidean on the original numbers in double precision, infinite only where no double holds them. Vectors that are null, zero, or hold null or
non-finite components take no part; queries meet rows of their own dimension only. Rows without an id take no part. A
row never finds its own id; rows that repeat an id are found separately, and the least vector of them asks for all. An empty table gives an empty one, further columns are
not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from sparsefold.llm.shared import stored

K = 10
FACTOR = 1.3
SHARD_ROWS, BLOCK_QUERIES, LEAF_ROWS, QUERIES_AT_ONCE = 4096, 32768, 256, 512
NO_ID = np.iinfo(np.int64).max
#: Relative error that a matrix product of double numbers may have here, with room.
ROUNDING = 1e-9
#: Squared lengths up to here can be multiplied and subtracted; distances from here on have exact squares.
LARGE, TINY = 1e300, 1e-140
FOUND = "query_id long, vec_id long, score double"


def usable(vector: Column) -> Column:
    v = vector.cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite, F.lit(False)) & F.coalesce(F.exists(v, lambda x: x != 0), F.lit(False))


class Tree:
    """Rows in tree order: a node covers rows ``start`` to ``end``, the inner half of its vantage point's distances first."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.vectors = ids[order], vectors[order]
        self.split: dict[tuple[int, int], tuple[np.ndarray, int, float, float]] = {}
        todo = [(0, len(ids))]
        while todo:
            start, end = todo.pop()
            if end - start <= LEAF_ROWS:
                continue
            point = self.vectors[start].copy()
            d = distances(point, self.vectors[start:end])
            by = np.argsort(d, kind="stable")
            for a in (self.ids, self.vectors):
                a[start:end] = a[start:end][by]
            half = (end - start) // 2
            self.split[start, end] = point, start + half, d[by[half - 1]], d[by[half]]
            todo += [(start, start + half), (start + half, end)]
        with np.errstate(over="ignore"):
            self.squares = np.einsum("ij,ij->i", self.vectors, self.vectors)


def distances(a: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Distances whose squares leave the range of doubles are taken again of numbers scaled by a power of two, which is exact."""
    with np.errstate(over="ignore", invalid="ignore", under="ignore"):
        diff = rows - a
        d = np.sqrt(np.einsum("...j,...j->...", diff, diff))
        for bad, scale in ((~np.isfinite(d), 2.0 ** -600), (d < TINY, 2.0 ** 600)):
            if bad.any():
                diff = rows[bad] * scale - (a[bad] if a.ndim == rows.ndim else a) * scale
                d[bad] = np.sqrt(np.einsum("...j,...j->...", diff, diff)) / scale
    return d


class Best:
    """The k nearest rows of each query so far, ties to smaller ids."""

    def __init__(self, query_ids: np.ndarray, queries: np.ndarray, k: int):
        self.own, self.queries, self.k = query_ids, queries, k
        with np.errstate(over="ignore"):
            self.squares = np.einsum("ij,ij->i", queries, queries)
        self.d = np.full((len(query_ids), k), np.inf)
        self.ids = np.full((len(query_ids), k), NO_ID)

    def offer(self, q: np.ndarray, tree: Tree, start: int, end: int) -> None:
        """A matrix product, with a margin for its rounding, screens what cannot be among the k nearest; the rest is measured exactly."""
        rows = slice(start, end)
        other = self.own[q][:, None] != tree.ids[rows]
        with np.errstate(over="ignore", invalid="ignore"):
            size = self.squares[q][:, None] + tree.squares[rows]
            close = other
            if size.max() < LARGE:
                near = size - 2 * (self.queries[q] @ tree.vectors[rows].T)
                near[~other] = np.inf
                limit = self.d[q, -1] ** 2
                if end - start > self.k:
                    limit = np.minimum(limit, np.partition(near, self.k - 1, axis=1)[:, self.k - 1])
                close = other & (near <= limit[:, None] + ROUNDING * size + TINY)
        row, col = np.nonzero(close)
        if not row.size:
            return
        vec = start + col
        d = np.concatenate([distances(self.queries[q[i]], tree.vectors[v]) for i, v in zip(np.array_split(row, 1 + len(row) // 65536), np.array_split(vec, 1 + len(row) // 65536), strict=True)])
        by = np.lexsort((tree.ids[vec], d, row))
        row, d, ids = row[by], d[by], tree.ids[vec][by]
        changed, first = np.unique(row, return_index=True)
        rank = np.arange(len(row)) - np.repeat(first, np.diff([*first, len(row)]))
        keep = rank < self.k
        at = np.searchsorted(changed, row[keep])
        new_d, new_ids = np.full((len(changed), self.k), np.inf), np.full((len(changed), self.k), NO_ID)
        new_d[at, rank[keep]], new_ids[at, rank[keep]] = d[keep], ids[keep]
        q = q[changed]
        d, ids = np.concatenate([self.d[q], new_d], axis=1), np.concatenate([self.ids[q], new_ids], axis=1)
        by = np.lexsort((ids, d), axis=1)[:, :self.k]
        self.d[q], self.ids[q] = np.take_along_axis(d, by, 1), np.take_along_axis(ids, by, 1)


def search(tree: Tree, query_ids: np.ndarray, queries: np.ndarray, k: int, factor: float) -> Best:
    best = Best(query_ids, queries, k)
    todo = [(0, len(tree.ids), np.arange(len(queries)), np.zeros(len(queries)))]
    while todo:
        start, end, q, bound = todo.pop()
        # Bounds were taken when the side was put off; the k-th best may have come nearer since.
        q = q[bound * factor <= best.d[q, -1]]
        if not q.size or start == end:
            continue
        if (start, end) not in tree.split:
            for at in range(0, len(q), QUERIES_AT_ONCE):
                best.offer(q[at:at + QUERIES_AT_ONCE], tree, start, end)
            continue
        point, middle, low, high = tree.split[start, end]
        d = distances(point, queries[q])
        with np.errstate(invalid="ignore"):
            # Two distances beyond the numbers' range tell nothing apart.
            to_inner, to_outer = (np.nan_to_num(np.maximum(gap, 0), nan=0.0, posinf=np.inf) for gap in (d - low, high - d))
        nearer = to_inner <= to_outer
        inner, outer = (start, middle), (middle, end)
        # The last put on is taken first: each query visits its nearer side before the other.
        todo += [(*outer, q[nearer], to_outer[nearer]), (*inner, q[~nearer], to_inner[~nearer]),
                 (*inner, q[nearer], to_inner[nearer]), (*outer, q[~nearer], to_outer[~nearer])]
    return best


def matrix(vectors) -> np.ndarray:
    return np.stack([np.asarray(v, dtype=np.float64) for v in vectors])


def shard_search(k: int, factor: float):
    def run(key, rows: pd.DataFrame, blocks: pd.DataFrame) -> pd.DataFrame:
        out = {"query_id": [], "vec_id": [], "score": []}
        if len(rows) and len(blocks):
            tree = Tree(rows["vec_id"].to_numpy(dtype=np.int64), matrix(rows["v"]))
            best = search(tree, blocks["vec_id"].to_numpy(dtype=np.int64), matrix(blocks["v"]), k, factor)
            q, col = np.nonzero(best.ids != NO_ID)
            out = {"query_id": best.own[q], "vec_id": best.ids[q, col], "score": best.d[q, col]}
        return pd.DataFrame(out)

    return run


def nearest(vectors: DataFrame, asked: Column, k: int = K, factor: float = FACTOR, vec_id: str = "vec_id", vector: str = "embedding",
            shard_rows: int = SHARD_ROWS, block_queries: int = BLOCK_QUERIES) -> DataFrame:
    """(query_id, rank, vec_id, score) of each row that ``asked`` selects, its k nearest of all other rows."""
    good = vectors.where(usable(F.col(vector)) & F.col(vec_id).isNotNull())
    rows = stored(good.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v"), F.size(vector).alias("dim"), asked.alias("asked")))
    dims = {r["dim"]: (r["n"], r["q"]) for r in rows.groupBy("dim").agg(F.count("*").alias("n"), F.count_if("asked").alias("q")).collect()}
    shards = max([1, *(-(-n // shard_rows) for n, _ in dims.values())])
    blocks = max([1, *(-(-q // block_queries) for _, q in dims.values())])
    spread = lambda n, what: F.pmod(F.xxhash64(F.lit(what), "vec_id"), F.lit(n))
    dealt = rows.select("vec_id", "v", "dim", spread(shards, "shard").alias("shard"))
    first = rows.where("asked").groupBy("vec_id").agg(F.min(F.struct("dim", "v")).alias("q")).select("vec_id", "q.v", "q.dim")
    queries = first.select("vec_id", "v", "dim", spread(blocks, "block").alias("block"))
    # Every block of queries is taken to every shard of its dimension, and every shard's rows to each block.
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)).cast("array<bigint>"))
    left = dealt.withColumn("block", every(blocks)).groupBy("dim", "shard", "block")
    right = queries.withColumn("shard", every(shards)).groupBy("dim", "shard", "block")
    found = left.cogroup(right).applyInPandas(shard_search(k, factor), FOUND)
    w = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
