"""Headline queries, timed once each after a warm-up; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from evimatch.plans.catalogue import QUERIES
from evimatch.session import build, ship

HEADLINE = ["match_rank", "match_auto_accept", "route_union_dedupe", "card_numbers", "pick_name", "variant_terms", "fold_text", "dup_groups", "dup_merge_quantity", "ebay_ids", "csv_lines", "title_render", "template_validate", "line_gaps", "job_breaker", "job_eta", "gray_otsu"]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = ship(build("bench", **{"spark.master": f"local[{cpus}]", "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "12g", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"}))
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["cards_counts"](spark, sf).collect()
    took = {}
    for name in HEADLINE:
        t = time.time()
        QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - t, 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf.rstrip("/"))}))


if __name__ == "__main__":
    main()
