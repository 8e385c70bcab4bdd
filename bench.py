"""Prints one JSON line with the seconds of the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Each is run cold, once, and then warm: the median of three runs (long queries: one). queries and value are warm, cold
holds the first runs. The headline queries are all that were measured before, and the heaviest others.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path
from statistics import median

from pyspark.sql import SparkSession

HEADLINES = (
    "month_trend", "overview_counts", "scope_fail_closed", "search_filter_page", "keyset_page", "governance_counts", "department_rates", "score_histogram", "grade_distribution", "term_freq_multi", "distinct_departments",
    "dict_overlay", "dict_diff", "dict_merge_aliases", "dict_collisions", "dict_content_version", "pii_mask", "deduction_stats", "duplicate_flag", "review_overdue", "log_visibility", "log_keyword", "rate_limit_window",
    "orphan_tasks", "tasks_in_scope", "dict_snapshot_prune", "dict_quality", "dict_cross_type", "dict_effective_counts", "dataset_shape", "term_scan", "candidate_topk", "json_props",
    "ingest_rejects", "clean_actions", "candidate_topk_whole", "fuzzy_normalize", "qc_score_grade", "pii_mask_text", "unmatched_top", "normalize_min_cover", "clean_documents",
)
#: A query that takes longer than this is measured once, after its warm-up.
LONG = 3.0
ROOT = str(Path(__file__).resolve().parent)
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, [ROOT, os.environ.get("PYTHONPATH")]))


def main() -> None:
    from lodestrata.plans import catalogue

    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    took, cold, every = {}, {}, catalogue.queries()
    for name in HEADLINES:
        seconds: list[float] = []
        while len(seconds) < (4 if not seconds or seconds[-1] < LONG else 2):
            began = time.time()
            every[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            seconds.append(time.time() - began)
        took[name], cold[name] = round(median(seconds[1:]), 3), round(seconds[0], 3)
        print(name, cold[name], took[name], file=sys.stderr)
    print(json.dumps({"metric": "headline queries", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "cold": cold, "cold_value": round(sum(cold.values()), 3), "sf": Path(sf_dir).name.removeprefix("sf")}))


if __name__ == "__main__":
    main()
