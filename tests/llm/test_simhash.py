"""Fingerprints, the Hamming search and near-duplicate components against brute force."""

import hashlib
import random
import re

import numpy as np
import xxhash

from sparsefold.llm import bktree, simhash
from sparsefold.llm.queries import op9_fingerprints, op10_near_duplicates


def word_fp(t):
    terms = [(xxhash.xxh64_intdigest(w.encode(), seed=42), min(len(w), 12) ** 2) for w in re.findall(r"[^\x20\x09-\x0D]+", t)]
    total = sum(w for _, w in terms)
    return sum(1 << b for b in range(64) if 2 * sum(w for h, w in terms if h >> b & 1) > total)


def shingle_fp(t, k=3):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), t))
    hs = [xxhash.xxh64_intdigest(" ".join(w[i:i + k]).encode(), seed=42) for i in range(max(1, len(w) - k + 1))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def components(fps, radius):
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in fps:
        for b in fps:
            if (a ^ b).bit_count() <= radius:
                root[find(a)] = find(b)
    return {f: find(f) for f in fps}


def corpus():
    rng = random.Random(5)
    vocabulary = ["".join(rng.choices("abcdeÉß", k=rng.randint(1, 9))) for _ in range(300)]
    rows = []
    for i in range(40):
        t = " ".join(rng.choices(vocabulary, k=rng.randint(1, 120)))
        rows.append((i * 7, t))
        if i % 3 == 0:
            rows += [(1000 + i, t.upper() if t.isascii() else t), (2000 + i, t + " tail"), (3000 + i, t.replace(" ", "\n\t ", 2))]
    long = " ".join(rng.choices(vocabulary, k=30000))
    return [*rows, (5000, long), (5050, long + " x"), (5100, None), (5150, ""), (5200, " \t\n"), (5250, "É é"), (5250, "É é"), (5300, "a"), (None, "null id"), (14, "same id")]


def written(spark, tmp_path, rows):
    spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, fp string, key int").write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


def test_fingerprints_edits_and_neighbours(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(simhash, "CELL_ROWS", 8)
    rows = corpus()
    got = op9_fingerprints(spark, written(spark, tmp_path, rows)).collect()
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), (r[1] or "").encode()))
    texts = [t or "" for _, t in order]
    want = []
    for at, (i, _) in enumerate(order):
        t, following = texts[at], texts[(at + 1) % len(texts)]
        k = len(t) // 3
        e = t[:len(t) - k] + following[:k]
        f = word_fp(t)
        like = lambda g: 1 - (f ^ g).bit_count() / 64  # noqa: E731,B023
        n = sum((f ^ word_fp(o)).bit_count() <= 3 for o in texts if len(o) < 20000 or len(t) > 20000) if i is not None and i % 50 == 0 and len(t) < 20000 else None
        want.append((i, len(t), hashlib.sha256(e.encode()).hexdigest(), f"{f:016x}", f"{word_fp(e):016x}", like(word_fp(e)), like(word_fp(following)), n and n - 1))
    key = lambda r: tuple(map(str, r[:7]))
    got, want = sorted(map(tuple, got), key=key), sorted(want, key=key)
    assert [g[:7] for g in got] == [w[:7] for w in want]
    assert all(g[7] == w[7] for g, w in zip(got, want, strict=True) if g[1] < 20000)


def test_ids_over_the_whole_range_and_a_thousand_rows_of_one(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(simhash, "CELL_ROWS", 8)
    rows = [(i, f"text number {i} of these") for i in (-(1 << 63), -(1 << 63) + 1, -5, 0, 50, (1 << 62), (1 << 63) - 1)] + [(7, f"same id {i}") for i in range(1000)]
    got = op9_fingerprints(spark, written(spark, tmp_path, rows)).collect()
    order = sorted(rows, key=lambda r: (-r[0], r[1].encode()))
    want = []
    for at, (i, t) in enumerate(order):
        k, following = len(t) // 3, order[(at + 1) % len(order)][1]
        want.append((i, hashlib.sha256((t[:len(t) - k] + following[:k]).encode()).hexdigest(), f"{word_fp(t):016x}"))
    assert sorted((r["doc_id"], r["edited_sha256"], r["fingerprint"]) for r in got) == sorted(want)
    fps = {word_fp(t) for _, t in rows}
    for r in got:
        if r["doc_id"] % 50 == 0:
            own = int(r["fingerprint"], 16)
            near = sorted((b, f - (1 << 64) * (f >> 63)) for f in fps if (b := (f ^ own).bit_count()) <= 3)
            assert r["within"] == ",".join(f"{f & (1 << 64) - 1:016x}:{b}" for b, f in near)
        else:
            assert r["within"] is None


def test_block_tables_find_every_pair_once(spark):
    rng = np.random.default_rng(1)
    base = rng.integers(-(1 << 63), (1 << 63) - 1, 60)
    near = [int(b) ^ sum(1 << int(x) for x in rng.choice(63, r % 6, replace=False)) for r, b in enumerate(np.tile(base, 4))]
    fps = sorted({int(b) for b in base} | set(near) | {0, -1, -(1 << 63)})
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    for radius, blocks in ((3, 5), (2, 3), (0, 1)):
        got = sorted(tuple(r) for r in simhash.within(df, df, radius, blocks).collect())
        apart = lambda a, b: ((a ^ b) & (2**64 - 1)).bit_count()
        assert got == sorted((a, b, apart(a, b)) for a in fps for b in fps if apart(a, b) <= radius)


def test_near_duplicate_components(spark, tmp_path):
    rows = corpus()
    got = sorted(map(tuple, op10_near_duplicates(spark, written(spark, tmp_path, rows)).collect()), key=str)
    fps = [shingle_fp(t or "") for _, t in rows]
    root = components(set(fps), 2)
    least = {}
    for (i, _), f in zip(rows, fps, strict=True):
        if i is not None:
            least[root[f]] = min(i, least.get(root[f], i))
    assert got == sorted(((i, f"{f:016x}", least.get(root[f])) for (i, _), f in zip(rows, fps, strict=True)), key=str)


def test_tree_search_and_hot_block_values(spark):
    rng = np.random.default_rng(2)
    chain = [0]
    for _ in range(500):
        chain.append(chain[-1] ^ (1 << int(rng.integers(0, 64))) ^ (1 << int(rng.integers(0, 64))))
    dense = [(7 << 50) | int(x) for x in rng.choice(1 << 14, 900, replace=False)]
    far = [int(x) for x in rng.integers(0, 1 << 63, 800)]
    fps = sorted({*chain, *dense, *far})
    values = np.array(fps, dtype=np.uint64)
    for radius in (0, 2, 5):
        apart = np.bitwise_count(values[:, None] ^ values[None])
        for tree in (np.zeros(len(values), dtype=np.int64), np.arange(len(values)) % 7):
            child = bktree.plant(values, tree, radius)
            pairs = {(int(a), int(b)) for x, y in bktree.search(values, tree, child, np.arange(len(values)), radius) for a, b in zip(x, y, strict=True)}
            assert pairs == {(int(a), int(b)) for a, b in np.argwhere((apart <= radius) & (tree[:, None] == tree[None]))}
    signed = [f - (1 << 64) * (f >> 63) for f in fps]
    df = spark.createDataFrame([(f,) for f in signed], "fp long")
    for radius, blocks, hot in ((2, None, 4096), (2, None, 20), (2, 4, 4096), (5, 7, 50)):
        want = {}
        for f, r in components(fps, radius).items():
            want.setdefault(r, set()).add(f)
        roots = {r["fp"]: r["root"] for r in bktree.components(bktree.links(df, radius, blocks, hot_rows=hot, shard_rows=64)).collect()}
        have = {}
        for f, s in zip(fps, signed, strict=True):
            have.setdefault(roots.get(s, s), set()).add(f)
        assert {frozenset(x) for x in have.values()} == {frozenset(x) for x in want.values()}
        assert all(min(s for f, s in zip(fps, signed, strict=True) if f in x) == r for r, x in have.items())


def test_keep_one(spark):
    rows = [(5, "one two three four", "a"), (3, "One two  three four", "b"), (3, "One two  three four", "b"), (9, "other words here now", "c"), (None, "", "d"), (4, None, "e"),
            (None, "null ids only, twice", "f"), (None, "null ids only, twice", "f")]
    df = spark.createDataFrame(rows, "doc_id long, text string, key string")
    kept = sorted(map(tuple, bktree.keep_one(df).collect()), key=str)
    assert kept == sorted([rows[1], rows[3], rows[5], rows[6]], key=str)
    assert bktree.keep_one(df.limit(0)).count() == 0


def test_empty_table(spark, tmp_path):
    base = written(spark, tmp_path, [])
    assert op9_fingerprints(spark, base).count() == 0 and op10_near_duplicates(spark, base).count() == 0
