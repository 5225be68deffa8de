"""Benchmark the headline queries.

Runs each query in ``HEADLINE`` at ``$BENCH_SF_DIR`` (default
/root/testdata/sf0.1) on ``local[$BENCH_CPUS]`` (default 8), forcing full
execution with a ``noop`` write (nothing is collected to the driver), and
prints ONE JSON line:

    {"metric": "total_sec", "value": N, "unit": "sec", "queries": {...}, "sf": ...}

``$BENCH_RUNS`` (default 1) runs per query; the median is reported. One
warm-up query runs first (JVM start, code generation).
"""

from __future__ import annotations

import json
import os
import re
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "m1_sample_features",      # flagship: S1 + S2 + row features
    "s1_sample",
    "t10_lemma_tokens",
    "t2_punctuation_noisy",
    "v15_fingerprint",
    "v4_tfidf",
    "v9_chi2",
    "m9_multinomial_nb",
    "m17_knn",
    "s4_top_reaction_comments",
    "g7_t17_labelled_lines",
    "l8_seeded_folds",
    "m2_label_spreading",
    "m4_m5_lens_predict",
    "t14_language_id",
    "c2_dbscan",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    from tagweave.plans.registry import load_all
    from tagweave.session import build_session

    spark = build_session(master=f"local[{cpus}]", shuffle_partitions=max(8, cpus),
                          extra={"spark.driver.memory": os.environ.get("BENCH_DRIVER_MEMORY", "24g")})
    queries = load_all()
    keys = [k for k in HEADLINE if k in queries]

    def run(key: str) -> float:
        t0 = time.perf_counter()
        queries[key].build(spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - t0

    run("t4_capitalization")      # warm-up
    out = {}
    for key in keys:
        out[key] = round(statistics.median(run(key) for _ in range(runs)), 3)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({"metric": "total_sec", "value": round(sum(out.values()), 3), "unit": "sec",
                      "queries": out, "sf": float(m.group(1)) if m else sf_dir}))
    spark.stop()


if __name__ == "__main__":
    main()
