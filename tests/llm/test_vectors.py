"""Vantage-point trees against brute force."""

import numpy as np

from sparsefold.llm import vptree
from sparsefold.llm.queries import op6_nearest


def brute(rows, k=10):
    out = []
    for q, v in rows:
        if q is None or q % 100 or (len(v), v) > min((len(w), w) for i, w in rows if i == q):
            continue
        near = sorted((float(vptree.distances(np.array(v, float), np.array(w, float)[None])[0]), i) for i, w in rows if i is not None and i != q and len(w) == len(v))
        out += [(q, r, i, d) for r, (d, i) in enumerate(near[:k], 1)]
    return sorted(out)


def test_exact_search_with_ties_copies_and_unusable_vectors(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(3)
    good = [(i, rng.normal(size=8).round(1).tolist()) for i in range(700)]
    good += [(i, [1.0, 2.0] + [0.0] * 6) for i in range(700, 1300)] + [(2000, [3.0, 4.0]), (2001, [3.0, 5.0]), (2100, [1.0]), (100, [0.5] * 8)]
    nan, inf = float("nan"), float("inf")
    bad = [(5000, None), (5001, []), (5100, [0.0] * 8), (5200, [nan] + [1.0] * 7), (5300, [inf] + [1.0] * 7), (5400, [None] + [1.0] * 7), (None, [1.0] * 8)]
    df = spark.createDataFrame([(i, v, 1) for i, v in good + bad], "vec_id long, embedding array<double>, score int")
    monkeypatch.setattr(vptree, "LEAF_ROWS", 16)
    asked = "coalesce(vec_id % 100 = 0, false)"
    from pyspark.sql import functions as F

    got = vptree.nearest(df, F.expr(asked), factor=1.0, shard_rows=200, block_queries=4)
    assert sorted(map(tuple, got.collect())) == brute(good)
    df.write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {tuple(r)[:3] for r in op6_nearest(spark, str(tmp_path)).collect()}
    want = {r[:3] for r in brute(good)}
    assert len(got & want) >= 0.95 * len(want)


def test_numbers_whose_squares_leave_the_range(spark, monkeypatch):
    rng = np.random.default_rng(8)
    rows = [(i, (rng.normal(size=3) * 10.0 ** rng.choice([-200, -3, 0, 100, 200])).tolist()) for i in range(600)]
    rows += [(900, [1e308, 0.0, 0.0]), (1000, [-1e308, 1e308, 0.0]), (1001, [-1.7e308] * 3)]
    monkeypatch.setattr(vptree, "LEAF_ROWS", 16)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(map(tuple, vptree.nearest(df, df["vec_id"] % 100 == 0, factor=1.0, shard_rows=100).collect()))
    assert got == brute(rows) and len(got) == 80


def test_recall_of_the_query(spark):
    base = "/root/testdata/sf0.01"
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{base}/embeddings.parquet").collect()]
    got = {(r["query_id"], r["vec_id"]) for r in op6_nearest(spark, base).collect()}
    want = {(q, i) for q, _, i, _ in brute(rows)}
    assert len(got & want) >= 0.95 * len(want)


def test_pruning_saves_work_and_relaxing_saves_more():
    rng = np.random.default_rng(4)
    rows = rng.normal(size=(6000, 2))
    tree = vptree.Tree(np.arange(6000), rows)
    seen = []
    offer = vptree.Best.offer
    for factor in (1.0, 3.0):
        n = 0

        def counted(self, q, t, s, e):
            nonlocal n
            n += len(q) * (e - s)
            offer(self, q, t, s, e)

        vptree.Best.offer = counted
        try:
            vptree.search(tree, np.arange(50), rows[:50], 5, factor)
        finally:
            vptree.Best.offer = offer
        seen.append(n)
    assert seen[1] < seen[0] < 50 * 6000 / 3


def test_empty(spark, tmp_path):
    spark.createDataFrame([], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    assert op6_nearest(spark, str(tmp_path)).count() == 0
