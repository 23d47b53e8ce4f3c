"""Times headline queries on one local session; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from soldlens import catalog
from soldlens.session import get_spark

HEADLINE = ("price_stats", "price_stats_with_shipping", "price_series_week", "scope_unkeyed_exact", "latest_position", "searches_report", "precedence_merge", "upsert_stats", "blocking_candidates_whole", "parse_money_roundtrip", "parse_sold_date", "box_iou", "cache_key", "html_links")


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = get_spark("bench")
    catalog.QUERIES["price_stats"](spark, sf_dir).collect()  # warm-up
    took = {}
    for name in HEADLINE:
        began = time.perf_counter()
        catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({"metric": "headline queries, total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": float(os.path.basename(sf_dir.rstrip("/")).removeprefix("sf") or 0)}))


if __name__ == "__main__":
    main()
