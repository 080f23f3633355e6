"""Hand-made edge cases, and brute force on small frames."""

import hashlib
import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparsefold.functions.numeric import mask_outlier
from sparsefold.operators import autocorr, bitstats, clean, evaluate, graph, joins, moments, reshape, similarity, split
from sparsefold.operators import labels as lab
from sparsefold.operators.descriptors import MOLECULE_RULES, rule_flags, scalar_descriptors
from sparsefold.operators.fingerprint import key_fingerprint, with_ngram_bits
from sparsefold.sources import stores
from sparsefold.sources.tsv import read_tsv, write_tsv


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*(order or df.columns)).collect()]


def bit_frame(spark, sets):
    return spark.createDataFrame([(i, s) for i, s in enumerate(sets)], "id bigint, bits array<int>")


def test_chi2_class_sum_form(spark):
    df = spark.createDataFrame([([7], 0), ([7], 0), ([], 1), ([7], 1)], "bits array<int>, y int")
    (bit, support, rate, chi2), = rows(bitstats.chi2_bits(df))
    assert (bit, support) == (7, 3)
    assert rate == pytest.approx(1 / 3) and chi2 == pytest.approx(1 / 3)


def test_significance_bounds_are_strict(spark):
    stats = spark.createDataFrame([(1, .4, 9.), (2, .8, 9.), (3, .39, 9.), (4, .81, 9.), (5, .81, 3.84)], "bit int, rate double, chi2 double")
    neg, pos = bitstats.significant_bits(stats)
    assert rows(neg) == [(3,)] and rows(pos) == [(4,)]


def test_tanimoto_of_overlapping_and_empty_columns(spark):
    # Columns 0 = {1,2,3}, 1 = {2,3,4}, 2 empty, over records 1..4.
    df = bit_frame(spark, [[0], [0, 1], [0, 1], [1]])
    assert rows(similarity.tanimoto_pairs(df, "id", 3, 0.0)) == [(0, 1, 2, 0.5)]
    assert rows(similarity.tanimoto_pairs(df, "id", 3, 0.5)) == []


@pytest.mark.parametrize("tile", [64, 7])
def test_cooccurrence_equals_brute_force_in_one_or_many_tiles(spark, tile):
    rng = np.random.default_rng(5)
    m = rng.random((50, 20)) < 0.3
    df = bit_frame(spark, [[int(b) for b in np.flatnonzero(r)] for r in m])
    want = {(a, b): int((m[:, a] & m[:, b]).sum()) for a in range(20) for b in range(a + 1, 20)}
    got = {(r["a"], r["b"]): r["both"] for r in similarity.cooccurrence(df, "id", 20, tile=tile).collect()}
    assert got == {k: v for k, v in want.items() if v}


def test_pruning_is_not_greedy(spark):
    pairs = spark.createDataFrame([("a", "b", .99), ("b", "c", -.99), ("a", "c", .1), ("a", "d", None)], "f1 string, f2 string, r double")
    assert rows(similarity.prune_pearson(pairs)) == [("b",), ("c",)]


def test_pearson_with_constant_missing_and_large_values(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(1e6, 1, 60)
    data = [(float(a), float(2 * a + e), 5.0, None if i % 7 == 0 else float(e)) for i, (a, e) in enumerate(zip(x, rng.normal(size=60)))]
    df = spark.createDataFrame(data, "a double, b double, c double, d double")
    got = {(r["f1"], r["f2"]): r["r"] for r in similarity.pearson_pairs(df, ["a", "b", "c", "d"]).collect()}
    cols = df.toPandas().corr()
    assert got["a", "c"] is None and got["b", "c"] is None
    for p in [("a", "b"), ("a", "d"), ("b", "d")]:
        assert got[p] == pytest.approx(cols.loc[p], abs=1e-9)


def test_outlier_bound_is_strict(spark):
    df = spark.createDataFrame([(v,) for v in (1e5, 100000.1, -100000.1, math.inf, -math.inf, math.nan)], "v double")
    assert [r[0] for r in df.select(mask_outlier(F.col("v"))).collect()] == [1e5, None, None, None, None, None]


def test_imputer_uses_training_rows_only(spark):
    train = spark.createDataFrame([(1.0, None), (3.0, None), (None, None)], "v double, w double")
    test = spark.createDataFrame([(None, 4.0), (100.0, None)], "v double, w double")
    params = clean.fit_imputer(train, ["v", "w"])
    assert rows(clean.apply_imputer(train, params, ["v", "w"]), "v") == [(1.0, None), (2.0, None), (3.0, None)]
    assert rows(clean.apply_imputer(test, params, ["v", "w"]), "v") == [(2.0, 4.0), (100.0, None)]


@pytest.mark.parametrize("kind", ["standard", "minmax", "maxabs", "none"])
def test_constant_column_scales_to_zero(spark, kind):
    df = spark.createDataFrame([(5.0, 1.0), (5.0, -3.0), (5.0, 2.0)], "c double, v double")
    out = clean.apply_scaler(df, clean.fit_scaler(df, ["c", "v"], kind), ["c", "v"]).toPandas()
    v = np.array([1.0, -3.0, 2.0])
    want = {"standard": (v - v.mean()) / v.std(), "minmax": (v + 3) / 5, "maxabs": v / 3, "none": v}[kind]
    assert sorted(out["v"]) == pytest.approx(sorted(want))
    assert set(out["c"]) == {{"standard": 0.0, "minmax": 0.0, "maxabs": 1.0, "none": 5.0}[kind]}
    with pytest.raises(ValueError):
        clean.fit_scaler(df, ["c"], "other")


def test_row_sum_is_signed(spark):
    df = spark.createDataFrame([(-1.0, 3.0), (2.0, -2.0)], "a double, b double")
    assert [tuple(r) for r in clean.row_sum_scale(df, ["a", "b"]).collect()] == [(-0.5, 1.5), (None, None)]


def test_label_codes_are_alphabetical_and_fitted_on_train(spark):
    df = spark.createDataFrame([("Permeable",)] * 3 + [("Non_permeable",)], "t string")
    codes = lab.fit_label_codes(df, "t")
    assert rows(codes) == [("Non_permeable", 0), ("Permeable", 1)]
    new = spark.createDataFrame([("Permeable",), ("other",)], "t string")
    assert rows(lab.apply_label_codes(new, codes, "t")) == [("Permeable", 1), ("other", None)]


def test_balanced_weights(spark):
    df = spark.createDataFrame([(1,)] * 3 + [(0,)], "y int")
    assert rows(lab.balanced_weights(df, "y")) == [(0, 2.0), (1, pytest.approx(2 / 3))]


def test_rank_drops_zero_and_breaks_ties_by_name(spark):
    df = spark.createDataFrame([("b", -2.0), ("a", 2.0), ("z", 0.0), ("c", 5.0)], "f string, coef double")
    assert rows(reshape.rank_by_abs(df, "f", "coef"), "rank") == [("c", 5.0, 1), ("a", 2.0, 2), ("b", -2.0, 3)]


def preds(spark, y, p):
    return spark.createDataFrame([(0, a, float(b)) for a, b in zip(y, p)], "g int, actual int, prob double")


def test_auc_with_ties_and_single_class(spark):
    assert evaluate.auc(preds(spark, [0, 1, 0, 1], [.5, .5, .1, .9]), ["g"]).head()["auc"] == pytest.approx(0.875)
    assert evaluate.auc(preds(spark, [1, 1], [.5, .9]), ["g"]).head()["auc"] is None


def test_auc_equals_pair_counting(spark):
    rng = np.random.default_rng(4)
    y, p = rng.integers(0, 2, 700), np.round(rng.random(700), 2) * 0.01
    pos, neg = p[y == 1], p[y == 0]
    want = ((pos[:, None] > neg).sum() + 0.5 * (pos[:, None] == neg).sum()) / (len(pos) * len(neg))
    df = spark.createDataFrame([(0, int(a), float(b)) for a, b in zip(y, p)], "g int, actual int, prob double")
    assert evaluate.auc(df, ["g"]).head()["auc"] == pytest.approx(want)


def test_half_is_class_zero_and_empty_ratios_are_zero(spark):
    row = evaluate.confusion_scores(preds(spark, [1, 1], [.5, .9]), ["g"]).head()
    assert (row["accuracy"], row["sensitivity"], row["specificity"]) == (0.5, 0.5, 0.0)


def test_rule_flags_at_bounds_and_with_missing_operands(spark):
    cols = ["molecular_weight", "logp", "h_bond_donor", "h_bond_acceptors", "rotatable_bonds", "number_of_atoms",
            "molar_refractivity", "topological_surface_area_mapping", "formal_charge", "heavy_atoms", "num_of_rings"]
    base = dict(zip(cols, [300.0, 3.0, 3.0, 3.0, 3.0, 20.0, 40.0, 140.0, 0.0, 15.0, 1.0]))
    cases = [base, base | {"logp": None}, base | {"logp": math.nan}, base | {"molecular_weight": 400.0}, base | {"num_of_rings": 0.0}]
    df = spark.createDataFrame([(i, *[c[k] for k in cols]) for i, c in enumerate(cases)], "id int, " + ", ".join(f"{c} double" for c in cols))
    got = [tuple(r)[1:] for r in rule_flags(df, "id", MOLECULE_RULES).orderBy("id").collect()]
    assert got == [(1, 1, 1, 1, 1, 1), (0, 0, 1, 0, 0, 0), (0, 0, 1, 0, 0, 0), (1, 1, 1, 0, 1, 0), (1, 1, 1, 1, 1, 0)]


def test_texts_without_words(spark):
    df = spark.createDataFrame([(1, ""), (2, "!!"), (3, "one")], "id bigint, text string")
    d = {r["id"]: r for r in scalar_descriptors(df, "id", "text").collect()}
    assert d[1]["digit_ratio"] is None and d[2]["mean_token_len"] is None and d[2]["n_tokens"] == 0 and d[3]["n_tokens"] == 1
    assert [len(r["bits"]) for r in with_ngram_bits(df, "text", 64).orderBy("id").collect()] == [0, 0, 1]
    assert key_fingerprint(df.select("id", "text", F.lit("en").alias("lang")), "id").where("id = 1").count() == 1


def test_isolated_node_still_gets_labels(spark):
    df = spark.createDataFrame([(1, "solo"), (2, "a b a a")], "id bigint, text string")
    g = graph.token_graph(df, "id", "text")
    assert rows(graph.graph_edges(g, "id")) == [(2, "a", "b")]
    names = graph.neighbourhood_fingerprint(g, "id", 1 << 30)
    assert rows(names.groupBy("id").agg(F.sum("n"))) == [(1, 3), (2, 6)]
    assert "Exchange" not in names._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("limit", [1_000_000, 20])
def test_lag_autocorrelation_with_and_without_hot_groups(spark, limit):
    rng = np.random.default_rng(0)
    # One user has most rows; many rows share a time.
    data = [(int(u), int(t), i, float(v)) for i, (u, t, v) in enumerate(zip(
        rng.choice([1, 1, 1, 2, 3], 400), rng.integers(0, 90, 400), rng.normal(size=400)))]
    df = spark.createDataFrame(data, "u bigint, s bigint, id bigint, v double").withColumn("ts", F.timestamp_seconds("s"))
    got = {(r["u"], r["lag"]): r["ac"] for r in autocorr.lag_autocorrelation(df, "u", ["ts", "id"], "v", 8, limit).collect()}
    want = {}
    for u in (1, 2, 3):
        x = np.array([v for _, _, v in sorted((s, i, v) for w, s, i, v in data if w == u)])
        want |= {(u, k): float((x[:-k] * x[k:]).sum()) for k in range(1, 9) if len(x) > k}
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k]) for k in want)


def test_principal_moments_equal_numpy(spark):
    x = np.random.default_rng(8).normal(size=(30, 3)) @ np.diag([3, 2, 1])
    df = spark.createDataFrame([("g", *map(float, r)) for r in x], "g string, a double, b double, c double")
    lam = [r["moment"] for r in moments.group_principal_moments(moments.group_covariance(df.withColumn("x", F.array("a", "b", "c")), "g", "x", 3), "g", 3).orderBy("component").collect()]
    assert lam == pytest.approx(sorted(np.linalg.eigvalsh(np.cov(x.T, bias=True)))[::-1])


def test_leverage_is_the_hat_diagonal(spark):
    x = np.array([1.0, 2.0, 4.0, 9.0])
    df = spark.createDataFrame([(i, "g", float(v)) for i, v in enumerate(x)] + [(9, "one", 3.0)], "id int, g string, x double")
    got = {r["id"]: r["h"] for r in moments.group_leverage(df, "id", "g", "x").collect()}
    d = np.column_stack([np.ones(4), x])
    assert [got[i] for i in range(4)] == pytest.approx(np.diag(d @ np.linalg.inv(d.T @ d) @ d.T))
    assert got[9] == 1.0


def test_leverage_with_several_regressors_null_groups_and_missing_values(spark):
    x = np.random.default_rng(3).normal(size=(12, 3)) + 100
    x[:, 2] = x[:, 0] + x[:, 1]  # adds no direction
    data = [(i, None if i < 6 else "g", *map(float, r)) for i, r in enumerate(x)] + [(50, "g", None, 1.0, 1.0)]
    df = spark.createDataFrame(data, "id int, g string, a double, b double, c double")
    got = {r["id"]: r["h"] for r in moments.group_leverage(df, "id", "g", ["a", "b", "c"]).collect()}
    assert got.pop(50) is None and len(got) == 12
    for own in (range(6), range(6, 12)):
        d = np.column_stack([np.ones(6), x[list(own), :2]])
        assert [got[i] for i in own] == pytest.approx(np.diag(d @ np.linalg.inv(d.T @ d) @ d.T))


def test_fractions_are_exact_disjoint_and_checked(spark):
    df = spark.range(997).withColumnRenamed("id", "doc")
    parts = split.split_fractions(df, "doc", [0.7, 0.2, 0.1], ["a", "b", "c"], 3)
    assert rows(parts.groupBy("part").count()) == [("a", 698), ("b", 199), ("c", 100)]
    assert parts.select("doc").distinct().count() == 997
    assert rows(parts) == rows(split.split_fractions(df.repartition(5), "doc", [0.7, 0.2, 0.1], ["a", "b", "c"], 3))
    with pytest.raises(ValueError):
        split.split_fractions(df, "doc", [0.5, 0.4], ["a", "b"], 1)
    empty_first = split.split_fractions(df.limit(3), "doc", [0.1, 0.9], ["a", "b"], 1)
    assert rows(empty_first.groupBy("part").count()) == [("b", 3)]


def test_seeded_group_splits_keep_groups_whole_and_test_fixed(spark):
    df = spark.range(400).select("id", (F.col("id") % 17).cast("string").alias("g"))
    out = split.seeded_group_splits(df, "id", "g", [1, 2, 3]).join(df, "id").persist()
    assert out.groupBy("seed", "id").count().where("count <> 1").count() == 0
    assert out.groupBy("seed", "g").agg(F.count_distinct("part").alias("n")).where("n <> 1").count() == 0
    tests = [set(r["id"] for r in out.where((F.col("seed") == s) & (F.col("part") == "test")).collect()) for s in (1, 2, 3)]
    assert tests[0] and tests[0] == tests[1] == tests[2]


def test_predictions_align_by_id(spark):
    df = spark.createDataFrame([(1, "m1", .1), (2, "m1", .2), (2, "m2", .9)], "id int, model string, prob double")
    assert rows(joins.align_predictions(df, ["id"], ["m1", "m2"])) == [(1, .1, None), (2, .2, .9)]


def test_semi_join_keeps_duplicates(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "id int, v string")
    ids = spark.createDataFrame([(1,), (1,)], "id int")
    assert rows(joins.restrict_to(df, ids, "id")) == [(1, "a"), (1, "b")]
    assert rows(joins.without(df, ids, "id")) == [(2, "c")]


def test_tsv_keeps_nulls_tabs_and_empty_strings(spark, tmp_path):
    df = spark.createDataFrame([(1, "a\tb", 1.5), (2, None, None), (3, "", 0.0), (4, 'say "x"', 2.0)], "id int, s string, v double")
    write_tsv(df, str(tmp_path / "t"), index=True)
    assert rows(read_tsv(spark, str(tmp_path / "t"), df.schema, index=True), "id") == rows(df, "id")


def test_tsv_keeps_line_breaks_blanks_and_backslashes(spark, tmp_path):
    odd = ["a\nb", " x ", "\t", "\r\n", "\\", "\\n", "\\\n", "\\N", "\\e", "\\q", '"', '""', "#c", ",", "é 日", " "]
    df = spark.createDataFrame(list(enumerate(odd)), "id int, s string")
    write_tsv(df, str(tmp_path / "t"))
    assert rows(read_tsv(spark, str(tmp_path / "t"), df.schema), "id") == rows(df, "id")


def test_chi2_of_one_class_is_missing(spark):
    df = spark.createDataFrame([([1, 2], 1), ([1], 1)], "bits array<int>, y int")
    assert rows(bitstats.chi2_bits(df).select("bit", "support", "chi2")) == [(1, 2, None), (2, 1, None)]


def test_auc_leaves_missing_scores_out_and_counts_them(spark):
    df = spark.createDataFrame([("m", 1, 0.9), ("m", 0, 0.1), ("m", 1, None)], "model string, actual int, prob double")
    assert evaluate.auc(df, ["model"]).head()["auc"] == 1.0
    assert evaluate.unscored(df, ["model"]).head()["n"] == 1


def test_workers_need_no_package_on_their_path(tmp_path):
    code = ("import sys; sys.path.insert(0, %r)\n"
            "from sparsefold.session import build_session\nfrom sparsefold.operators.neighbours import nearest_neighbours\n"
            "spark = build_session(2)\ndf = spark.createDataFrame([(1, [0.0]), (2, [1.0])], 'id long, x array<double>')\n"
            "print('rows', nearest_neighbours(df, df, 'id', 'x', 1).count())")
    import os
    import subprocess
    import sys

    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    said = subprocess.run([sys.executable, "-c", code % root], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=180)
    assert "rows 2" in said.stdout, said.stderr[-2000:]


def test_records_without_text_have_empty_features(spark):
    from sparsefold.operators import design, graph

    docs = spark.createDataFrame([(1, None, "en"), (2, "", None), (3, "one two one.", "en")], "doc_id long, text string, lang string")
    found = {r["doc_id"]: r for r in design.record_features(docs, "doc_id", "text").collect()}
    names = {i: design.column_names(r["bits"]) for i, r in found.items()}
    assert not [n for i in (1, 2) for n in names[i] if not n.startswith("key")] and found[1]["n_chars"] is None
    assert {n.split("_")[0] for n in names[3]} == {"ng", "nb", "key"} and found[3]["bits"] == sorted(set(found[3]["bits"]))
    lags = graph.lag_autocorrelation(graph.token_graph(docs, "doc_id", "text"), "doc_id", 2).collect()
    assert {(r["doc_id"], r["lag"]): r["ac"] for r in lags} == {(1, 1): 0, (1, 2): 0, (2, 1): 0, (2, 2): 0, (3, 1): 9, (3, 2): 0}


def test_graph_lags_equal_breadth_first_search(monkeypatch):
    from collections import deque

    from sparsefold.operators import graph

    rng = np.random.default_rng(3)
    monkeypatch.setattr(graph, "START_NODES", 7)
    for n, m in ((1, 0), (2, 1), (30, 40), (60, 61)):
        nodes = [f"w{'x' * int(rng.integers(0, 6))}{i}" for i in range(n)]
        pairs = sorted({" ".join(sorted(rng.choice(nodes, 2))) for _ in range(m)})
        near = {w: set() for w in nodes}
        for a, _, b in (p.partition(" ") for p in pairs):
            if a != b:
                near[a].add(b)
                near[b].add(a)
        want = [0.0] * 4
        for s in nodes:
            steps, todo = {s: 0}, deque([s])
            while todo:
                v = todo.popleft()
                for w in near[v] - set(steps):
                    steps[w] = steps[v] + 1
                    todo.append(w)
            for w, d in steps.items():
                if 0 < d <= 4 and s < w:
                    want[d - 1] += len(s) * len(w)
        assert graph.distance_products(nodes, pairs, np.array([len(w) for w in nodes], dtype=float), 4) == want


def test_stores_round_trip(spark, tmp_path):
    train = spark.createDataFrame([(1.0,), (3.0,)], "v double")
    stores.save_params(clean.fit_scaler(train, ["v"]), str(tmp_path / "p"))
    out = clean.apply_scaler(train, stores.load_params(spark, str(tmp_path / "p")), ["v"])
    assert rows(out) == [(-1.0,), (1.0,)]
    log = str(tmp_path / "log")
    for run in ("one", "two", "two"):
        stores.log_metrics(train, log, run)
    assert sorted(map(tuple, stores.load_metrics(spark, log).collect())) == [(1.0, "one"), (1.0, "two"), (3.0, "one"), (3.0, "two")]
    preds = spark.createDataFrame([("m", "test", 1, 7, 0.5), ("m", "valid", 1, 8, 0.25), ("n", "test", 2, 7, 0.75)], "model string, part string, seed int, doc_id long, prob double")
    for some in (preds, preds.where("model = 'm'"), preds.where("seed = 2")):
        stores.save_predictions(some, str(tmp_path / "preds"))
    again = stores.load_predictions(spark, str(tmp_path / "preds")).select(*preds.columns)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, preds.collect()))
    with pytest.raises(ValueError):
        stores.save_list(train.withColumn("w", F.lit(1)), str(tmp_path / "l"))
    stores.save_list(train, str(tmp_path / "l"))
    assert stores.load_list(spark, str(tmp_path / "l")).count() == 2


def test_long_fingerprints_leave_a_task_in_bounded_batches(spark, monkeypatch):
    """A batch of many records is hashed record by record; its result is never one piece."""
    monkeypatch.setattr(graph, "LONG_ROWS", 50)
    texts = [" ".join(f"w{i}x{k % 7}" for k in range(i % 12)) if i % 9 else None for i in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)), "id bigint, text string").coalesce(1)
    g = graph.token_graph(df, "id", "text")
    found = graph.neighbourhood_fingerprint(g, "id", 64)
    want = Counter()
    for r in g.collect():
        for label in graph._labels(r["nodes"] or [], r["_pairs"] or [], 2):
            want[r["id"], int(hashlib.md5(label.encode()).hexdigest()[:8], 16) % 64] += 1
    assert rows(found) == sorted((*key, n) for key, n in want.items())
    assert "MapInArrow" in found._jdf.queryExecution().executedPlan().toString()


def test_texts_of_listed_records_are_not_shuffled(spark, tmp_path):
    """Labels may be null or repeated, each repeat counts; the texts meet them where they were read."""
    from sparsefold.plans.catalog import QUERIES

    docs = [(1, "a b a"), (2, "c d"), (3, None), (4, "e f"), (None, "g h")]
    spark.createDataFrame(docs, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1), (2, None), (2, 0), (None, 1)], "doc_id bigint, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        out = QUERIES["fp_neighbourhood"](spark, str(tmp_path))
        assert "SortMergeJoin" not in out._jdf.queryExecution().executedPlan().toString()
        n = {r["doc_id"]: r["n"] for r in out.groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
        assert n == {1: 6, 2: 12} and QUERIES["graph_embedding"](spark, str(tmp_path)).where("weight IS NOT NULL").count() == 18
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("threshold", [0.95, 0.8])
def test_near_copies_equal_brute_force_and_no_set_is_shuffled_whole(spark, threshold):
    """Sizes from none to hundreds, steps of one bit around the threshold, copies, repeated rows, null ids and null sets."""
    rng = np.random.default_rng(4)
    sets = [[], [], None, [0], [7], [7], [(1 << 31) - 1, 3]]
    for n in (5, 19, 20, 21, 40, 60, 400):
        base = rng.choice(1 << 20, n, replace=False).tolist()
        sets += [base, base[::-1], base[1:], [*base, 5 << 20], [*base[2:], 6 << 20], base[: round(n * 0.95)], base[: round(n * 0.95) - 1], [*base[: n - n // 30], *range(9 << 20, (9 << 20) + n // 30)]]
    data = [(i, s) for i, s in enumerate(sets)]
    data += [data[9], (None, [7]), (None, sets[30])]
    df = spark.createDataFrame(data, "id bigint, bits array<int>").repartition(3)
    got = similarity.tanimoto_rows(df, "id", threshold)
    first = {}
    for i, s in data:
        if i is not None and s is not None:
            key = frozenset(s)
            first[key] = min(i, first.get(key, i))
    want = [(i, first[frozenset(s)], 1.0) for i, s in data if i is not None and s is not None and i != first[frozenset(s)]]
    for a, i in first.items():
        for b, j in first.items():
            if j < i and a and b and len(a & b) / len(a | b) >= threshold:
                want.append((i, j, len(a & b) / len(a | b)))
    assert rows(got) == sorted(want) and len(want) > 30
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert not [line for line in plan.splitlines() if "hashpartitioning(bits" in line or "HashAggregate" in line and "bits" in line]


def test_a_size_class_and_the_next_hold_all_sizes_that_can_be_alike():
    for threshold in (0.5, 0.8, 0.95, 0.99):
        ends = similarity.size_classes(5000, threshold)
        sizes = np.arange(1, 4000)
        largest = np.minimum((sizes / threshold + 1e-9).astype(int), 5000)
        assert (np.searchsorted(ends, largest) - np.searchsorted(ends, sizes) <= 1).all() and ends[-1] >= 5000


def test_splits_of_many_seeds_are_a_small_plan(spark):
    df = spark.createDataFrame([(i, f"g{i % 23}") for i in range(300)], "id bigint, source string")
    parts = split.seeded_group_splits(df, "id", "source", [1, 2, 3, 4, 5])
    plan = parts._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") <= 6 and "Window" not in plan
    assert parts.groupBy("seed").count().where("count = 300").count() == 5
