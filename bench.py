"""Headline queries on local[$BENCH_CPUS] over $BENCH_SF_DIR; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from plumbline.plans import catalog  # noqa: E402
from plumbline.session import session, ship  # noqa: E402

HEADLINE = ("page_report", "url_identity", "page_link_targets", "page_rule_findings", "duplicate_titles", "copy_signal_counts", "metric_scores", "site_scores", "inbound_counts", "graph_classes", "link_totals", "dead_link_fanout", "site_vitals", "mail_records", "robots_groups", "schema_issue_counts", "topk_per_key", "calibration")


def main() -> None:
    folder, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), int(os.environ.get("BENCH_CPUS", "8"))
    spark = session(f"local[{cpus}]", cpus)
    ship(spark)
    catalog.QUERIES["page_report"](spark, folder).write.format("noop").mode("overwrite").save()  # starts JVM code and workers
    took = {}
    for name in HEADLINE:
        began = time.time()
        catalog.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": folder}))
    spark.stop()


if __name__ == "__main__":
    main()
