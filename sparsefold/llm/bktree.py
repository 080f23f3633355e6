"""SimHash near-duplicates: BK-trees over shards of fingerprints, and connected components of the links.

Two fingerprints within ``radius`` of their bits agree on ``blocks - radius`` of ``blocks`` blocks at least. Every
fingerprint goes, once per choice of that many blocks, to the shard of those blocks' value; a shard's task builds a
BK-tree for each value, searches every fingerprint in the tree of its own value along the edges within the radius only,
and emits one edge to the least member of each group it finds, never a group's pairs. A value that more than
``HOT_ROWS`` distinct fingerprints share is cut by the same rule into blocks of the remaining bits. Trees stay in the
task that holds the shard's rows: all trees together grow with the corpus, so none is sent to every executor.

A null text is empty and a text without words has fingerprint zero, linked like any other. Repeated rows share a
component, null ids take no part in the choice of the smallest id, and an empty table gives an empty one. Further
columns are read by ``keep_one`` alone, which returns them unchanged.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from sparsefold.llm.shared import broadcast_if_small, let, row_key, stored, whole
from sparsefold.llm.simhash import fingerprint, votes, words

WORDS, RADIUS = 3, 2
SHARD_ROWS, HOT_ROWS, SEARCHED_AT_ONCE = 8192, 4096, 256
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
DEEPEST = 4


def lower_ascii(text: Column) -> Column:
    """A-Z only; all-ASCII texts, told by their byte count, take the faster function."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def shingle_hashes(text: Column, size: int = WORDS) -> Column:
    """XXH64 (seed 42) of every run of ``size`` words joined by single spaces; fewer words: of them all; none: empty."""
    def hashes(w: Column) -> Column:
        each = F.transform(F.sequence(F.lit(0), F.size(w) - size), lambda i: F.xxhash64(F.concat_ws(" ", *[w[i + k] for k in range(size)])))
        short = F.array(F.xxhash64(F.array_join(w, " ")))
        return F.when(F.size(w) >= size, each).when(F.size(w) > 0, short).otherwise(F.expr("cast(array() as array<bigint>)"))

    return let(words(lower_ascii(text)), hashes)


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = WORDS) -> DataFrame:
    """(key, doc_id, fp, copies) per distinct (doc_id, text), stored; ``copies`` counts its rows."""
    body = whole(text)
    # The key is worked out below the explosion, once per row.
    keyed_rows = docs.select(row_key(F.col(doc_id), body).alias("key"), F.col(doc_id).alias("doc_id"), shingle_hashes(body, size).alias("hashes"))
    terms = keyed_rows.select("key", "doc_id", F.posexplode_outer("hashes").alias("pos", "h"))
    weight = F.when(F.col("h").isNull(), 0).otherwise(1).cast("long")
    rows = F.sum(F.when(F.coalesce("pos", F.lit(0)) == 0, 1).otherwise(0)).alias("copies")
    return stored(terms.groupBy("key", "doc_id").agg(*votes(F.coalesce("h", F.lit(0).cast("long")), weight), rows).select("key", "doc_id", fingerprint().alias("fp"), "copies"))


def plant(values: np.ndarray, roots: np.ndarray, radius: int) -> np.ndarray:
    """BK-trees of fingerprints: ``child[node, radius + distance]`` or -1. ``roots`` has the root of each one's tree; within
    a tree fingerprints are distinct."""
    child = np.full((len(values), 65 + 2 * radius), -1, dtype=np.int32)
    items = np.flatnonzero(roots != np.arange(len(values)))
    at = roots[items]
    while items.size:
        slot = at * child.shape[1] + radius + np.bitwise_count(values[items] ^ values[at])
        _, first, which = np.unique(slot, return_index=True, return_inverse=True)
        child.flat[slot[first]] = items[first]
        at = items[first][which]
        deeper = at != items
        items, at = items[deeper], at[deeper]
    return child


def search(values: np.ndarray, roots: np.ndarray, child: np.ndarray, queries: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (query, node) of one tree within the radius, level by level."""
    q, node = queries, roots[queries]
    reach = np.arange(2 * radius + 1)
    while q.size:
        d = np.bitwise_count(values[q] ^ values[node]).astype(np.int64)
        yield q[d <= radius], node[d <= radius]
        below = child[node[:, None], d[:, None] + reach]
        row, col = np.nonzero(below >= 0)
        q, node = q[row], below[row, col].astype(np.int64)


def roots_of(label: np.ndarray, x: np.ndarray) -> np.ndarray:
    while True:
        up = label[x]
        if np.array_equal(up, x):
            return x
        x = up


def groups(values: np.ndarray, roots: np.ndarray, radius: int) -> np.ndarray:
    """For each fingerprint the first of its tree that it is linked with."""
    child = plant(values, roots, radius)
    label = np.arange(len(values))
    for start in range(0, len(values), SEARCHED_AT_ONCE):
        for a, b in search(values, roots, child, np.arange(start, min(start + SEARCHED_AT_ONCE, len(values))), radius):
            while a.size:
                a, b = roots_of(label, a), roots_of(label, b)
                a, b = np.minimum(a, b)[a != b], np.maximum(a, b)[a != b]
                np.minimum.at(label, b, a)
    return roots_of(label, np.arange(len(values)))


def shard_edges(radius: int):
    def edges(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.drop_duplicates().sort_values(["path", "key", "fp"])
        signed, path, key = (rows[c].to_numpy(dtype=np.int64) for c in ("fp", "path", "key"))
        new = np.concatenate([[True], (path[1:] != path[:-1]) | (key[1:] != key[:-1])])
        roots = np.flatnonzero(new)[np.cumsum(new) - 1]
        first = groups(signed.view(np.uint64), roots, radius)
        moved = first != np.arange(len(signed))
        return pd.DataFrame({"a": signed[moved], "b": signed[first[moved]]}).drop_duplicates()

    return edges


def refined(masks: list[int], blocks: int, agree: int) -> list[int]:
    """The masks of the next cut: each mask's free bits in ``blocks`` blocks, every choice of ``agree`` of them added to it."""
    out = []
    for m in masks:
        free = [b for b in range(64) if not m >> b & 1]
        edges = [round(i * len(free) / blocks) for i in range(blocks + 1)]
        part = [sum(1 << b for b in free[edges[i]:edges[i + 1]]) for i in range(blocks)]
        out += [m | sum(part[i] for i in own) for own in combinations(range(blocks), agree)]
    return out


def signed64(m: int) -> int:
    return m - (1 << 64) * (m >> 63)


def links(fps: DataFrame, radius: int = RADIUS, blocks: int | None = None, hot_rows: int = HOT_ROWS, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(a, b), stored: edges that connect exactly the fingerprints connected by steps of ``radius`` bits or fewer.
    ``fps``: stored, distinct ``fp``. More ``blocks`` than the least, ``radius + 1``, make more but smaller trees."""
    blocks = blocks or radius + 1
    if blocks <= radius:
        raise ValueError("more blocks than bits that may differ are needed")
    agree, masks = blocks - radius, refined([0], blocks, blocks - radius)
    parts = len(masks)
    rows = fps.select("fp", F.explode(keyed(masks, range(parts))).alias("k")).select("fp", "k.path", "k.key")
    found, deepest = [], DEEPEST if parts <= 3 else 2
    for depth in range(deepest):
        counts = stored(rows.groupBy("path", "key").count().where("count > 1"))
        last = depth == deepest - 1
        usual = counts if last else counts.where(F.col("count") <= hot_rows)
        total, hot = usual.agg(F.coalesce(F.sum("count"), F.lit(0))).first()[0], None if last else counts.where(F.col("count") > hot_rows)
        n_shards = 1 + total // shard_rows
        dealt = rows.join(usual.select("path", "key"), ["path", "key"]).select("fp", "path", "key", F.pmod(F.xxhash64("path", "key"), F.lit(n_shards)).alias("shard"))
        found.append(dealt.groupBy("shard").applyInPandas(shard_edges(radius), "a long, b long"))
        if last or hot.isEmpty():
            break
        finer = refined(masks, blocks, agree)
        again = stored(rows.join(broadcast_if_small(hot.select("path", "key"), 16), ["path", "key"]))
        cut = reduce(lambda other, p: F.when(F.col("path") == p, keyed(finer, range(p * parts, (p + 1) * parts))).otherwise(other), range(1, len(masks)), keyed(finer, range(parts)))
        rows, masks = again.select("fp", F.explode(cut).alias("k")).select("fp", "k.path", "k.key"), finer
    return stored(reduce(DataFrame.unionByName, found).distinct())


def keyed(masks: list[int], paths: range) -> Column:
    return F.array(*[F.struct(F.lit(p).alias("path"), F.col("fp").bitwiseAND(F.lit(signed64(masks[p]))).alias("key")) for p in paths])


def components(edges: DataFrame) -> DataFrame:
    """(fp, root), stored, of all that have an edge; ``root`` is the least of its component. Alternates two steps until
    nothing changes: everyone greater is tied to the least neighbour, then everyone smaller is. Minima are combined
    before the shuffle and rows return to them by a join that may be split, so a centre of many edges is no hot task."""
    edges = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    mark = None
    while True:
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = stored(large)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        near = large.join(least, "u")
        small = near.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        edges = stored(small.where("u <> v").distinct())
        now = edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).first()
        if now == mark:
            return edges.select(F.col("u").alias("fp"), F.col("v").alias("root"))
        mark = now


def component_ids(rows: DataFrame, radius: int = RADIUS, blocks: int | None = None) -> DataFrame:
    """(fp, root, component_id), stored, of every distinct fingerprint in ``rows`` (doc_id, fp)."""
    fps = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = components(links(fps, radius, blocks))
    tied = fps.join(roots, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    own = tied.groupBy("root").agg(F.min("least").alias("component_id"))
    return stored(tied.join(own, "root").select("fp", "root", "component_id"))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = WORDS, radius: int = RADIUS,
                    blocks: int | None = None) -> DataFrame:
    """(doc_id, fp, component_id) for every row."""
    rows = fingerprints(docs, doc_id, text, size)
    met = rows.join(component_ids(rows, radius, blocks), "fp")
    return met.select("doc_id", "fp", "component_id", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("n")).drop("n")


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = WORDS, radius: int = RADIUS,
             blocks: int | None = None) -> DataFrame:
    """``docs`` with one row of each component: its smallest id, of several rows with that id one."""
    rows = fingerprints(docs, doc_id, text, size)
    return first_of_each(docs, rows.join(component_ids(rows, radius, blocks), "fp"), doc_id, text)


def first_of_each(docs: DataFrame, of: DataFrame, doc_id: str, text: str) -> DataFrame:
    """``docs`` with one row of each ``root`` of ``of``, which has (key, doc_id, copies, root) per distinct (doc_id, text)."""
    chosen = of.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "key")).alias("k")).select("k.key", F.lit(1).alias("c"))
    gone = stored(of.join(chosen, "key", "left").where(F.col("c").isNull() | (F.col("copies") > 1)).select("key", F.col("c").isNotNull().alias("repeated")))
    # Texts are shuffled once, by key, at every size; repeated rows are told apart in that order.
    met = docs.select(F.struct("*").alias("row"), row_key(F.col(doc_id), whole(text)).alias("key")).join(gone.hint("merge"), "key", "left")
    nth = F.row_number().over(Window.partitionBy("key").orderBy("key"))
    return met.where("repeated is null or repeated").withColumn("nth", nth).where("repeated is null or nth = 1").select("row.*")
