"""Every operator as a named query over the input tables: name -> f(spark, base_dir) -> DataFrame."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from sparsefold.functions.hashing import hash_int, seeded_hash
from sparsefold.operators import autocorr, bitstats, clean, descriptors, evaluate, fingerprint, graph, joins, kernel
from sparsefold.operators import labels as lab, models, moments, neighbours, resample, reshape, select, similarity, split
from sparsefold.plans import flows
from sparsefold.session import settle, shared_dir, small_side
from sparsefold.sources import stores
from sparsefold.sources.tables import labelled_records, labelled_texts, labels, table, with_label
from sparsefold.sources.tsv import read_tsv, write_tsv

DESC = descriptors.DESCRIPTORS
FOLD_BITS, SIG_BITS, SMALL_BITS, WIDE_BITS = 1024, 4096, 16, 1 << 20
SEEDS = [1, 2, 3, 4, 5]

QUERIES = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def r6(*cols: str) -> list[Column]:
    return [F.round(c, 6).alias(c) for c in cols]


def documents(spark, base) -> DataFrame:
    return table(spark, base, "documents", "doc_id")


def record_bits(spark, base, n_bits, max_n=3) -> DataFrame:
    """(doc_id, y, bits) of the labelled records."""
    bits = fingerprint.with_ngram_bits(labelled_texts(spark, base).select("doc_id", "text"), "text", n_bits, max_n)
    return with_label(bits, spark, base).select("doc_id", "y", "bits")


def record_words(spark, base, n_bits) -> DataFrame:
    return record_bits(spark, base, n_bits, max_n=1)


def described(spark, base) -> DataFrame:
    return descriptors.scalar_descriptors(documents(spark, base), "doc_id", "text")


def described_parts(spark, base) -> DataFrame:
    return split.with_test_part(described(spark, base), "doc_id")


def scored_records(spark, base, seed: int | Column) -> DataFrame:
    """(doc_id, y, n_chars, u): a reproducible score in [0, 1) with ties."""
    rec = labelled_records(spark, base).select("doc_id", "y", "n_chars")
    return rec.withColumn("u", hash_int(seeded_hash(F.col("doc_id"), seed)) % 1000 / F.lit(1000.0))


def three_models(spark, base) -> DataFrame:
    """(seed, model, doc_id, y, prob): three score columns that need no fitting, for five seeds."""
    rec = labelled_records(spark, base).select("doc_id", "y", "n_chars", F.explode(F.array(*map(F.lit, SEEDS))).alias("seed"))
    u = hash_int(seeded_hash(F.col("doc_id"), F.col("seed"))) % 1000 / F.lit(1000.0)
    length = F.least(F.lit(1.0), F.col("n_chars") / F.lit(4000.0))
    scores = F.create_map(F.lit("m1"), u, F.lit("m2"), length, F.lit("m3"), (u + length) / 2)
    return rec.select("seed", "doc_id", "y", F.explode(scores).alias("model", "prob"))


# Sources and sinks


@query
def src_labelled_records(spark, base):
    return labelled_records(spark, base).select("doc_id", "y", "n_chars")


@query
def src_tsv_roundtrip(spark, base):
    docs = table(spark, base, "documents")
    path = shared_dir(spark)
    write_tsv(docs, path, index=True)
    return read_tsv(spark, path, docs.schema, index=True)


# Labels and reshaping


@query
def label_recode(spark, base):
    named = table(spark, base, "labels").select("doc_id", lab.to_class_name(F.col("quality")).alias("target"))
    return named.select("doc_id", "target", lab.from_class_name(F.col("target")).alias("target_num"))


@query
def label_index_alpha(spark, base):
    docs = table(spark, base, "documents").select("lang")
    coded = lab.apply_label_codes(docs, lab.fit_label_codes(docs, "lang"), "lang")
    return coded.groupBy("lang", "code").agg(F.count("*").alias("n"))


@query
def label_inverse(spark, base):
    docs = table(spark, base, "documents").select("doc_id", "lang")
    codes = lab.fit_label_codes(docs, "lang")
    coded = lab.apply_label_codes(docs, codes, "lang").select("doc_id", "code")
    return lab.invert_label_codes(coded, codes).select("doc_id", "lang")


@query
def class_balance(spark, base):
    return lab.class_counts(table(spark, base, "labels").select(F.col("quality").alias("y")), "y")


@query
def balanced_weights(spark, base):
    y = table(spark, base, "labels").select(F.col("quality").alias("y"))
    return lab.balanced_weights(y, "y").select("y", *r6("w"))


def long_features(spark, base) -> DataFrame:
    """(doc_id, family, feature, value) over n-gram bits, keys and descriptors."""
    docs = documents(spark, base)
    bits = fingerprint.ngram_fingerprint(docs, "doc_id", "text", FOLD_BITS)
    keys = fingerprint.key_fingerprint(docs, "doc_id")
    nums = reshape.melt(described(spark, base), "doc_id", DESC)
    one = F.lit(1.0).alias("value")
    return joins.assemble_long(
        bits.select("doc_id", F.lit("ng").alias("family"), F.concat(F.lit("ng_"), "bit").alias("feature"), one),
        keys.select("doc_id", F.lit("key").alias("family"), F.concat(F.lit("key_"), "key").alias("feature"), one),
        nums.select("doc_id", F.lit("num").alias("family"), "feature", "value").where(F.col("value").isNotNull()))


@query
def feature_family_stats(spark, base):
    per_feature = long_features(spark, base).groupBy("family", "feature").agg(F.count("*").alias("n"))
    return per_feature.groupBy("family").agg(F.count("*").alias("n_features"), F.sum("n").alias("n_cells"))


@query
def assemble_families(spark, base):
    count = lambda fam: F.sum((F.col("family") == fam).cast("bigint"))
    return long_features(spark, base).groupBy("doc_id").agg(
        count("ng").alias("n_bits"), count("key").alias("n_keys"), count("num").alias("n_nums"))


@query
def melt_features(spark, base):
    return reshape.melt(described(spark, base), "doc_id", DESC).select("doc_id", "feature", *r6("value"))


@query
def feature_as_array(spark, base):
    chunks = reshape.feature_chunks(reshape.melt(described(spark, base), "doc_id", DESC), "doc_id")
    text = F.array_join(F.transform("values", lambda v: F.coalesce(F.round(v * 1000).cast("bigint").cast("string"), F.lit("?"))), ",")
    return chunks.select("feature", "chunk", "n", text.alias("column"))


@query
def similarity_pivot(spark, base):
    pairs = similarity.tanimoto_pairs(record_bits(spark, base, SMALL_BITS), "doc_id", SMALL_BITS, 0.0)
    wide = reshape.pivot_square(pairs, "a", "b", "sim", list(range(SMALL_BITS)), "c_")
    return wide.select(F.col("a").alias("bit_1"), *r6(*[f"c_{i}" for i in range(SMALL_BITS)]))


@query
def missing_profile(spark, base):
    cols = ["o_totalprice", "o_orderdate"]
    orders = table(spark, base, "orders").select(*cols)
    return reshape.missing_profile(clean.mask_outliers(orders, ["o_totalprice"]), cols)


@query
def rank_by_abs(spark, base):
    rec = record_words(spark, base, FOLD_BITS)
    share = rec.agg(F.avg("y")).scalar()
    coef = bitstats.positive_rate(rec).select("bit", F.round(F.col("rate") - share, 6).alias("coef"))
    return reshape.rank_by_abs(coef, "bit", "coef")


# Joins


@query
def join_features_outer(spark, base):
    docs = table(spark, base, "documents").select("doc_id", F.lit(1).alias("d"))
    labels = table(spark, base, "labels").select("doc_id", F.lit(1).alias("l"))
    both = joins.outer_join(docs, labels, "doc_id")
    return both.select("doc_id", F.coalesce("d", F.lit(0)).alias("has_doc"), F.coalesce("l", F.lit(0)).alias("has_label"))


@query
def feature_pairs(spark, base):
    """Pairs of single-word bits that meet in a fifth of the labelled records."""
    rec = record_words(spark, base, SIG_BITS)
    pairs = similarity.cooccurrence(rec, "doc_id", SIG_BITS)
    return pairs.where(F.col("both") * 5 >= rec.agg(F.count("*")).scalar())


@query
def split_semi_join(spark, base):
    docs = table(spark, base, "documents").select("doc_id", "source", "n_chars")
    test = split.with_test_part(docs.select("doc_id"), "doc_id").where(F.col("part") == "test")
    return joins.restrict_to(docs, test, "doc_id")


@query
def drop_listed_features(spark, base):
    desc = described(spark, base)
    listed = similarity.prune_pearson(similarity.pearson_pairs(desc, DESC))
    return reshape.drop_listed(reshape.melt(desc, "doc_id", DESC), listed).select("doc_id", "feature", *r6("value"))


@query
def stack_align_predictions(spark, base):
    models = ["m1", "m2", "m3"]
    wide = joins.align_predictions(three_models(spark, base), ["seed", "doc_id", "y"], models)
    return wide.select("seed", "doc_id", "y", *r6(*models))


# Featurisation


@query
def fp_ngram(spark, base):
    return fingerprint.ngram_fingerprint(documents(spark, base), "doc_id", "text", FOLD_BITS)


@query
def fp_keys(spark, base):
    return fingerprint.key_fingerprint(documents(spark, base), "doc_id")


@query
def doc_graph_edges(spark, base):
    return graph.graph_edges(graph.token_graph(documents(spark, base), "doc_id", "text"), "doc_id")


def record_fingerprint(spark, base) -> DataFrame:
    """Of the labelled records. A label list that is short enough goes to the texts, so that these are not shuffled."""
    listed = documents(spark, base).join(small_side(labels(spark, base).select("doc_id")), "doc_id")
    return graph.neighbourhood_fingerprint(graph.token_graph(listed, "doc_id", "text"), "doc_id", FOLD_BITS)


@query
def fp_neighbourhood(spark, base):
    return record_fingerprint(spark, base).select("doc_id", "bit")


@query
def graph_embedding(spark, base):
    return graph.graph_embedding(record_fingerprint(spark, base), "doc_id").select("doc_id", "bit", *r6("weight"))


@query
def autocorr_lag(spark, base):
    events = table(spark, base, "events")
    return autocorr.lag_autocorrelation(events, "user_id", ["ts", "event_id"], "value").select("user_id", "lag", F.round("ac", 4).alias("ac"))


@query
def autocorr_graph(spark, base):
    docs = documents(spark, base).select("doc_id", "text")
    return graph.lag_autocorrelation(graph.token_graph(docs, "doc_id", "text"), "doc_id", 2).select("doc_id", "lag", "ac")


@query
def autocorr_distance(spark, base):
    e = F.transform("embedding", lambda v: v.cast("double"))
    points = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: F.slice(e, i * 4 + 1, 4))
    out = autocorr.distance_autocorrelation(table(spark, base, "embeddings"), "vec_id", points, 16)
    return out.select("vec_id", "bin", *r6("ac"))


DIMS = 64


def label_covariance(spark, base):
    return moments.group_covariance(table(spark, base, "embeddings"), "label", "embedding", DIMS)


@query
def group_covariance(spark, base):
    return label_covariance(spark, base).select("label", "i", "j", F.round("cov", 8).alias("cov"))


@query
def group_pca_moments(spark, base):
    lam = moments.group_principal_moments(label_covariance(spark, base), "label", DIMS)
    return lam.groupBy("label").agg(F.round(F.sum("moment"), 8).alias("trace"),
                                    F.round(F.sum(F.col("moment") * F.col("moment")), 8).alias("sum_sq"))


@query
def group_leverage(spark, base):
    events = table(spark, base, "events").select("event_id", "event_type", "value")
    return moments.group_leverage(events, "event_id", "event_type", "value").select("event_id", F.round("h", 8).alias("h"))


@query
def scalar_descriptors(spark, base):
    return described(spark, base).select("doc_id", *r6(*DESC))


@query
def rule_flags(spark, base):
    return descriptors.rule_flags(described(spark, base), "doc_id", descriptors.TEXT_RULES)


# Bit statistics


@query
def chi2_bits(spark, base):
    return bitstats.chi2_bits(record_words(spark, base, FOLD_BITS)).select("bit", "support", *r6("chi2"))


@query
def bit_positive_rate(spark, base):
    return bitstats.positive_rate(record_words(spark, base, FOLD_BITS)).select("bit", *r6("rate"))


def significant(spark, base):
    return bitstats.significant_bits(settle(bitstats.chi2_bits(record_words(spark, base, SIG_BITS))))


@query
def sig_bits_neg(spark, base):
    return significant(spark, base)[0]


@query
def sig_bits_pos(spark, base):
    return significant(spark, base)[1]


@query
def sig_bit_counts(spark, base):
    neg, pos = significant(spark, base)
    return record_words(spark, base, SIG_BITS).select(
        "doc_id", reshape.count_listed(F.col("bits"), neg).alias("neg_cnt"),
        reshape.count_listed(F.col("bits"), pos).alias("pos_cnt"))


# Cleaning


@query
def outlier_mask(spark, base):
    orders = table(spark, base, "orders").select("o_orderkey", F.col("o_totalprice").alias("price"))
    return clean.mask_outliers(orders, ["price"])


@query
def impute_mean_fit_apply(spark, base):
    orders = table(spark, base, "orders").select("o_orderkey", F.col("o_totalprice").alias("price"))
    masked = split.with_test_part(clean.mask_outliers(orders, ["price"]), "o_orderkey")
    means = clean.fit_imputer(masked.where(F.col("part") == "train"), ["price"])
    return clean.apply_imputer(masked, means, ["price"]).select("o_orderkey", *r6("price"))


def scaled_long(spark, base, kind):
    desc = described_parts(spark, base)
    if kind == "rowsum":
        out = clean.row_sum_scale(desc, DESC)
    else:
        out = clean.apply_scaler(desc, clean.fit_scaler(desc.where(F.col("part") == "train"), DESC, kind), DESC)
    return reshape.melt(out, "doc_id", DESC).select("doc_id", "feature", F.round("value", 8).alias("scaled"))


for _kind in ("standard", "minmax", "maxabs", "rowsum"):
    QUERIES[f"scale_{_kind}"] = lambda spark, base, kind=_kind: scaled_long(spark, base, kind)


# Similarity and pruning


@query
def tanimoto_pairs(spark, base):
    pairs = similarity.tanimoto_pairs(record_bits(spark, base, FOLD_BITS), "doc_id", FOLD_BITS, 0.5)
    return pairs.select("a", "b", "both", *r6("sim"))


@query
def tanimoto_rows(spark, base):
    bits = fingerprint.with_ngram_bits(documents(spark, base).select("doc_id", "text"), "text", WIDE_BITS)
    return similarity.tanimoto_rows(bits, "doc_id", 0.95).select("doc_id", "nbr", *r6("sim"))


@query
def prune_tanimoto(spark, base):
    pairs = similarity.tanimoto_pairs(record_bits(spark, base, SIG_BITS), "doc_id", SIG_BITS, 0.5)
    return similarity.prune_later(pairs, "b", "bit")


@query
def pearson_pairs(spark, base):
    return similarity.pearson_pairs(described(spark, base), DESC).select("f1", "f2", *r6("r"))


@query
def prune_pearson(spark, base):
    return similarity.prune_pearson(similarity.pearson_pairs(described(spark, base), DESC))


# Splits


@query
def split_fractions(spark, base):
    docs = table(spark, base, "documents").select("doc_id")
    parts = split.split_fractions(docs, "doc_id", [0.7, 0.2, 0.1], ["train", "valid", "test"], seed=1)
    return parts.groupBy("part").agg(F.count("*").alias("n"), F.sum("doc_id").alias("id_sum"))


@query
def split_stratified(spark, base):
    y = table(spark, base, "labels").select("doc_id", F.col("quality").alias("y"))
    rows = split.stratified_shuffle_split(y, "doc_id", "y", repeats=20, test=0.125).where("is_test")
    return rows.groupBy("rep", "y").agg(F.count("*").alias("n"), F.sum("doc_id").alias("id_sum"))


@query
def split_by_group(spark, base):
    return split.split_by_group(table(spark, base, "documents").select("source"), "source")


# Evaluation


def predictions(spark, base):
    """(model, seed, part, doc_id, actual, prob) of the fixed scores."""
    preds = three_models(spark, base).withColumnRenamed("y", "actual")
    parts = split.with_test_part(table(spark, base, "documents").select("doc_id"), "doc_id")
    return preds.join(parts, "doc_id")


@query
def threshold_class(spark, base):
    return scored_records(spark, base, 1).select("doc_id", evaluate.to_class(F.col("u")).alias("cls"))


@query
def metric_auc(spark, base):
    return evaluate.auc(three_models(spark, base), ["model", "seed"], "y").select("model", "seed", *r6("auc"))


@query
def metric_confusion(spark, base):
    names = ["accuracy", "f1", "sensitivity", "specificity"]
    return evaluate.confusion_scores(three_models(spark, base), ["model", "seed"], "y").select("model", "seed", *r6(*names))


@query
def metric_logloss_mae(spark, base):
    return evaluate.loss_scores(three_models(spark, base), ["model", "seed"], "y").select("model", "seed", *r6("logloss", "mae"))


@query
def results_table(spark, base):
    names = ["auc", "accuracy", "f1", "sensitivity", "specificity"]
    return evaluate.metrics(predictions(spark, base), ["model", "part", "seed"]).select("model", "part", "seed", *r6(*names))


@query
def results_from_log(spark, base):
    """``results_table`` by way of the stored predictions and the run log. The run is written twice, which leaves one copy."""
    path, preds = shared_dir(spark), settle(predictions(spark, base))
    for _ in range(2):
        logged = flows.save_run(spark, path, "twice", preds)
    return logged.select("run", "model", "part", "seed", *r6("auc", "accuracy", "f1", "sensitivity", "specificity"))


@query
def metric_over_seeds(spark, base):
    return evaluate.over_seeds(evaluate.auc(predictions(spark, base), ["model", "part", "seed"]), ["model", "part"])


@query
def pick_best_params(spark, base):
    """Which of the three score columns has the best mean negative log loss over the seeds."""
    loss = evaluate.loss_scores(three_models(spark, base), ["model", "seed"], "y")
    scores = loss.select(F.col("model").alias("params"), F.substring("model", 2, 1).cast("int").alias("at"), (-F.col("logloss")).alias("score"))
    return evaluate.pick_best(scores, ["params"], "at").select("params", *r6("score"))


# Kernels


def embeddings(spark, base) -> DataFrame:
    return table(spark, base, "embeddings")


@query
def kernel_gram(spark, base):
    return kernel.gram_sums(embeddings(spark, base), "vec_id", "embedding", 64).select("vec_id", *r6("k_self", "k_sum"))


@query
def kernel_gram_centered(spark, base):
    return kernel.gram_sums(embeddings(spark, base), "vec_id", "embedding", 64).select("vec_id", F.round("k_centered", 9).alias("k_centered"))


def raw_descriptors(spark, base) -> DataFrame:
    """(doc_id, y, descriptors...) of the labelled records; texts stay with their scan."""
    desc = descriptors.scalar_descriptors(labelled_texts(spark, base), "doc_id", "text")
    return settle(with_label(desc, spark, base))


def raw_vectors(spark, base) -> DataFrame:
    """(doc_id, y, x): raw descriptors, to be filled and scaled by those rows that train."""
    return raw_descriptors(spark, base).select("doc_id", "y", F.array(*DESC).alias("x"))


def described_vectors(spark, base) -> DataFrame:
    """(doc_id, y, x, features): scaled descriptors of the labelled records."""
    desc = raw_descriptors(spark, base)
    desc = clean.apply_imputer(desc, clean.fit_imputer(desc, DESC), DESC)
    scaled = clean.apply_scaler(desc, clean.fit_scaler(desc, DESC), DESC)
    x = F.array(*DESC)
    return scaled.select("doc_id", "y", x.alias("x"), array_to_vector(x).alias("features")).persist()


def record_scores(spark, base) -> DataFrame:
    rows = described_vectors(spark, base)
    return kernel.apply_kernel_pca(kernel.fit_kernel_pca(rows, len(DESC)), rows)


@query
def kpca_scores(spark, base):
    """Per component the sum of squared scores; all together the trace of the centred Gram matrix."""
    lam = kernel.spectrum(record_scores(spark, base))
    return lam.agg(F.round(F.sum("sum_sq"), 4).alias("trace"), F.round(F.sum(F.col("sum_sq") * F.col("sum_sq")), 2).alias("sum_sq_sq"))


LANDMARKS = 512


@query
def kpca_landmark_scores(spark, base):
    """Kernel PCA by landmark rows of every record: the squared length in the mapped
    space (``own``) and of the scores, fitted over all records (``score_sq``)."""
    rows = settle(fingerprint.with_ngram_bits(documents(spark, base).select("doc_id", "text"), "text", FOLD_BITS, 1).select("doc_id", "bits"))
    first = kernel.landmark_order(rows, "doc_id", LANDMARKS)
    marks = kernel.choose_landmarks(first.select("doc_id", kernel.dense_bits("bits", FOLD_BITS).alias("x")), "doc_id", "x", LANDMARKS)
    mapped = kernel.landmark_bit_features(rows, marks)
    scores = kernel.fit_landmark_pca(mapped, kernel.whitener(marks).shape[1]).transform(mapped)
    length = lambda v: F.aggregate(vector_to_array(v), F.lit(0.0), lambda a, x: a + x * x)
    return scores.select("doc_id", length("_map").alias("own"), length("kpca").alias("score_sq")).select("doc_id", *r6("own", "score_sq"))


@query
def kpca_landmark_bounds(spark, base):
    """What must hold of ``kpca_landmark_scores`` whatever the data: no record is longer in the mapped space than under the kernel itself
    (``within``), and the landmarks keep their kernel values (``exact``, NULL for other records)."""
    docs = documents(spark, base).select("doc_id", "text")
    bits = fingerprint.with_ngram_bits(docs, "text", FOLD_BITS, 1)
    own = (kernel.GAMMA * F.size("bits") + 1) * (kernel.GAMMA * F.size("bits") + 1)
    marks = kernel.landmark_order(docs.select("doc_id"), "doc_id", LANDMARKS).select("doc_id", F.lit(True).alias("is_landmark"))
    rows = bits.select("doc_id", own.alias("k_self")).join(marks, "doc_id", "left").join(kpca_landmark_scores(spark, base), "doc_id")
    return rows.select("doc_id", *r6("k_self"), (F.col("own") <= F.col("k_self") + 2e-6).alias("within"),
                       F.when(F.col("is_landmark"), F.abs(F.col("own") - F.col("k_self")) <= 2e-6).alias("exact"))


# Resampling


def all_scaled(spark, base) -> DataFrame:
    """(doc_id, y, x): the scaled descriptors of the labelled records, missing ones 0."""
    rows = settle(raw_descriptors(spark, base).select("doc_id", "y", *[F.coalesce(F.round(c, 6), F.lit(0.0)).alias(c) for c in DESC]))
    scaled = clean.apply_scaler(rows, clean.fit_scaler(rows, DESC, "maxabs"), DESC)
    return settle(scaled.select("doc_id", "y", F.array(*DESC).alias("x")))


@query
def knn_minority(spark, base):
    small = all_scaled(spark, base).where("y = 0")
    return neighbours.nearest_neighbours(small, small, "doc_id", "x", 5).select("doc_id", "nbr", F.col("rn").cast("int").alias("rn"))


def balance(spark, base, ratio) -> DataFrame:
    out = resample.smote(all_scaled(spark, base), "doc_id", "y", "x", ratio)
    original = F.when(F.col("base").isNull(), 1)
    return out.groupBy("y").agg(F.count(original).alias("n_before"), F.count("*").alias("n_after"))


@query
def smote_balance_counts(spark, base):
    return balance(spark, base, 1.0)


@query
def smote_ratio_counts(spark, base):
    return balance(spark, base, 1.5)


@query
def smote_rows(spark, base):
    """Counts, and how many synthetic rows leave the box spanned by base - half a step and the neighbour."""
    rows = all_scaled(spark, base)
    out = resample.smote(rows, "doc_id", "y", "x").select("y", "x", "base", "nbr", "step")
    at = rows.select("doc_id", F.col("x").alias("p"))
    made = (out.where(F.col("base").isNotNull()).join(at.withColumnsRenamed({"doc_id": "base", "p": "a"}), "base")
            .join(at.withColumnsRenamed({"doc_id": "nbr", "p": "b"}), "nbr"))
    far = F.exists(F.arrays_zip("x", "a", "b"), lambda v: (
        (v["x"] < F.least(v["a"] - (v["b"] - v["a"]) / 2, v["b"]) - 1e-9)
        | (v["x"] > F.greatest(v["a"] - (v["b"] - v["a"]) / 2, v["b"]) + 1e-9)))
    rest = out.where(F.col("base").isNull()).select("y", F.lit(0).alias("far"))
    both = rest.unionByName(made.select("y", far.cast("int").alias("far")))
    return both.groupBy("y").agg(F.count("*").alias("n"), F.sum("far").alias("n_outside_box"))


# Selection, search and models, with the full search and five seeds.

EFFORT = flows.Effort()


def scored(preds: DataFrame) -> DataFrame:
    """Metrics of predictions, which are stored first: every metric reads them, and the models would score all rows anew each time."""
    names = ["auc", "accuracy", "f1", "sensitivity", "specificity"]
    return flows.scores(settle(preds)).select("model", "part", "seed", *r6(*names))


@query
def lasso_select(spark, base):
    return select.lasso_select(raw_vectors(spark, base), "doc_id", DESC, scale=True)


@query
def forward_select(spark, base):
    return select.forward_select(raw_vectors(spark, base), "doc_id", DESC, scale=True)


@query
def grid_search_scores(spark, base):
    grid = [{"c": c, "balanced": b} for c in EFFORT.logistic_c for b in (False, True)]
    return select.logistic_scores(raw_vectors(spark, base), "doc_id", grid, scale=True)


@query
def train_logistic(spark, base):
    """Predictions, column lists and metrics are written; the result is read back from the log."""
    p = flows.prepare(spark, base, EFFORT.seeds)
    logged = flows.save_run(spark, shared_dir(spark), "logistic", settle(flows.logistic_predictions(p, EFFORT)), p.lists)
    return logged.select("model", "part", "seed", *r6("auc", "accuracy", "f1", "sensitivity", "specificity"))


@query
def train_random_forest(spark, base):
    return scored(flows.forest_predictions(flows.prepare(spark, base, EFFORT.seeds), EFFORT))


@query
def train_linear_svm(spark, base):
    return scored(flows.svm_predictions(flows.prepare(spark, base, EFFORT.seeds), EFFORT))


@query
def train_mlp(spark, base):
    return scored(flows.mlp_predictions(flows.prepare(spark, base, EFFORT.seeds), EFFORT))


@query
def train_stacked(spark, base):
    p = flows.prepare(spark, base, EFFORT.seeds)
    preds = flows.base_predictions(p, EFFORT)
    return scored(preds.unionByName(flows.stacked_predictions(preds, EFFORT.seeds)))


@query
def platt_calibrate(spark, base):
    """Every row's probability comes from a margin, a curve, means and scales that other folds' rows gave."""
    held = models.out_of_fold_scaled(raw_descriptors(spark, base), "doc_id", DESC, lambda part: models.fit_linear_svm(part, "doc_id", folds=3))
    return held.select("doc_id", "y", *r6("prob"))


@query
def oof_predictions(spark, base):
    held = models.out_of_fold_scaled(raw_descriptors(spark, base), "doc_id", DESC, lambda part: models.fit_logistic(part))
    return held.select("doc_id", "fold", F.col("y").alias("actual"), *r6("prob"))


def probable(prob: Column) -> Column:
    return F.coalesce((prob >= 0) & (prob <= 1), F.lit(False))


@query
def oof_folds(spark, base):
    """Every labelled record once, in the fold of its hash, with a probability."""
    return oof_predictions(spark, base).select("doc_id", "fold", "actual", probable(F.col("prob")).alias("scored"))


@query
def platt_rows(spark, base):
    return platt_calibrate(spark, base).select("doc_id", "y", probable(F.col("prob")).alias("scored"))


@query
def search_settings(spark, base):
    """Every setting of the search is scored on every repeat that holds rows out; no score of a probability's logarithm is positive."""
    found = grid_search_scores(spark, base)
    return found.groupBy("at", *r6("c"), "balanced").agg(F.count("*").alias("n_reps"), F.max("score").alias("_most")).select(
        "at", "c", "balanced", "n_reps", (F.col("_most") <= 0).alias("possible"))


@query
def train_sizes(spark, base):
    """Rows and positives that the logistic flow scores per part and seed, and whether all of them got a probability."""
    preds = flows.logistic_predictions(flows.prepare(spark, base, EFFORT.seeds), EFFORT)
    return preds.groupBy("model", "part", "seed").agg(F.count("*").alias("n"), F.sum("actual").cast("long").alias("n_pos"),
                                                      F.min(probable(F.col("prob"))).alias("scored"))


@query
def pipeline_save_load_score(spark, base):
    """A fitted kernel PCA written, read back and applied; the scores' spectrum shows it is the same model."""
    rows = described_vectors(spark, base)
    path = shared_dir(spark)
    stores.save_model(kernel.fit_kernel_pca(rows, len(DESC)), path)
    return kernel.spectrum(kernel.apply_kernel_pca(stores.load_model(path), rows))
