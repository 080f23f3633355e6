"""Times the headline queries and prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from sparsefold.plans.catalog import QUERIES
from sparsefold.session import build_session

HEADLINE = ["chi2_bits", "fp_ngram", "tanimoto_pairs", "prune_tanimoto", "pearson_pairs", "kernel_gram", "kpca_scores", "split_stratified",
            "autocorr_lag", "scale_standard", "impute_mean_fit_apply", "tanimoto_rows", "kpca_landmark_scores", "knn_minority", "smote_rows", "metric_auc", "results_table",
            "train_stacked"]


def main() -> None:
    base = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    names = os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",")
    spark = build_session(os.environ.get("BENCH_CPUS", "8"), app="bench")
    spark.range(1000).selectExpr("sum(id)").collect()
    seconds = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, base).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        spark.catalog.clearCache()
    print(json.dumps({"metric": "headline_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
                      "sf": os.path.basename(base.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
