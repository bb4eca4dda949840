"""Time the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; print one JSON line.

A query is ended after $BENCH_QUERY seconds (240 unless set) or when all have used $BENCH_BUDGET (1,200 unless set); it is named with the seconds it got, and
queries that could not start are named as skipped. So the line comes whatever a query does. Studies come last.
"""

from __future__ import annotations

import json
import os
import sys
import threading
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "cohort_dual_therapy", "arm_new_user", "select_candidate_drugs", "bootstrap_controls", "trial_assemble",
    "death_validation", "features_baseline", "agg_mad", "clean_trim_outliers", "impute_median_train", "table_one",
    "topk_nearest", "join_pairwise_distance", "balance_smd", "ps_logistic", "match_nearest_1to1", "match_caliper_1toN",
    "match_caliper_mad", "cox_hr_binary", "cox_adjusted_weighted", "km_curve", "aft_effect", "boot_mean_ci",
    "boot_mean_pvalue", "pooled_hr", "ate_bootstrap_ci", "match_ratio_escalation", "drug_effect_summary", "sae_effect_matrix",
    "stratified_effect_matrix",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    wanted = sys.argv[1:] or HEADLINE
    from trialkit.registry import QUERIES
    from trialkit.session import local_session

    partitions = 8 if not cpus.isdigit() else int(cpus)
    spark = local_session("bench", cpus, partitions)
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{folder}/lineitem.parquet").count()  # start the executor threads
    times: dict[str, float] = {}
    ended: dict[str, float] = {}
    skipped, began = [], time.perf_counter()
    budget, most = float(os.environ.get("BENCH_BUDGET", "1200")), float(os.environ.get("BENCH_QUERY", "240"))
    for name in wanted:
        left = budget - (time.perf_counter() - began)
        if left <= 0:
            skipped.append(name)
            continue
        start, over = time.perf_counter(), threading.Event()

        def end(over: threading.Event = over) -> None:
            while not over.wait(1):  # a query is many jobs
                spark.sparkContext.cancelAllJobs()

        watch = threading.Timer(min(most, left), end)
        watch.start()
        try:
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            times[name] = round(time.perf_counter() - start, 3)
        except Exception as error:  # a cancelled or failed query must not hide the others' figures
            ended[name] = round(time.perf_counter() - start, 3)
            print(f"{name}: {str(error)[:200]}", file=sys.stderr, flush=True)
        finally:
            watch.cancel()
            over.set()
        spark.catalog.clearCache()
        print(f"{name:28}{times.get(name, float('nan')):8.2f}", file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "total seconds of the headline queries", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "ended": ended, "skipped": skipped,
        "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"), "cpus": cpus, "shuffle_partitions": partitions, "spark": spark.version,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
