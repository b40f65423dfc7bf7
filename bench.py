"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from lexatlas.plans import catalog  # noqa: E402
from lexatlas.session import build_session  # noqa: E402

HEADLINE = [
    "topic_profile", "p4_impute_median", "p9_category_continuous", "a1_outcome_stats", "a3_outcome_mode", "a4_column_profile",
    "a10_cluster_stats", "a11_topic_extremes", "a12_topic_presence", "a14_pc_effects", "a16_pc_correlation",
    "a23_topic_pc_association", "w1_pc_percentile", "w8_stratified_sample", "w11_folds", "x1_clean_text", "x5_ctfidf",
    "x6_topic_keywords", "g0_fold_gram", "d1_naive_ols", "d6_dml_theta", "d3_ridge_many_features", "d15_vector_contributions",
    "f2_lasso_components", "f4_binned_mi", "r1_standardise", "r2_component_scores", "j11_knn_cosine", "e1_embed_documents",
]


def main() -> None:
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 4))
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    catalog.load()
    spark = build_session("bench", cpus, max(8, int(cpus)))
    # Start the JVM, the code generator and the Python workers once, outside of the timings.
    catalog.QUERIES["w11_folds"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    catalog.QUERIES["d3_ridge_many_features"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for name in HEADLINE:
        start = time.time()
        catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
    print(json.dumps({
        "metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
