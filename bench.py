"""Headline queries over the driver's tables; prints one JSON line.

Each query is run once unmeasured on sf0.001 (class loading, code generation), then once measured.
"""

from __future__ import annotations

import json
import os
import sys
import time

from attesta.plans.all_queries import QUERIES
from attesta.session import local_session

HEADLINE = (
    "verdict_per_run", "first_reading_per_declaration", "candidate_rules_per_product", "clause_decision", "check_si_unit",
    "extract_net_quantity", "contact_elements", "quality_per_declaration", "confusion_matrix", "threshold_sweep",
    "linear_probabilities", "readings_per_declaration", "audit_duplicate_texts", "ledger_reconcile", "merge_run_text", "assemble_word_lines",
)


def run(spark, name: str, folder: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    small = os.path.join(os.path.dirname(folder), "sf0.001")
    spark = local_session("bench")
    spark.sparkContext.setLogLevel("ERROR")
    times, failed = {}, {}
    for name in HEADLINE:
        try:
            if os.path.isdir(small):
                run(spark, name, small)
            times[name] = round(run(spark, name, folder), 3)
        except Exception as e:  # the other figures still count
            failed[name] = str(e).splitlines()[0][:200]
        print(name, times.get(name, "failed"), file=sys.stderr, flush=True)
    print(json.dumps({"metric": "headline queries, total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
                      "failed": failed, "sf": os.path.basename(folder)}))
    spark.stop()


if __name__ == "__main__":
    main()
