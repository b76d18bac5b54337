"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import re
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

HEADLINE = (
    "gap_histogram graph_gap frontier_units unit_counts readable_count plan_next_step video_scores next_words_top8 supply_by_video "
    "sentence_filter_reasons quality_score example_deck_top24 majority_lemma_vote unit_resolve_alias trigram_search_jaccard snooze_asleep "
    "sm2_fold reachability_rounds roadmap_walk video_walk"
).split()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    from stepwell.registry import QUERIES
    from stepwell.session import session

    spark = session("bench", f"local[{cpus}]", **{
        "spark.driver.memory": os.environ.get("BENCH_MEMORY", "12g"), "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
        "spark.sql.shuffle.partitions": str(2 * int(cpus)), "spark.sql.files.maxPartitionBytes": "4m", "spark.sql.files.openCostInBytes": "256k",
    })
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()
    took = {}
    for name in sys.argv[1:] or HEADLINE:
        began = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - began, 3)
    sf = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({"metric": "headline queries, total wall time", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": float(sf[1]) if sf else sf_dir}))
    spark.stop()


if __name__ == "__main__":
    main()
