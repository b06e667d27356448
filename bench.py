"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from tributary.plans import catalogue
from tributary.session import local_session

HEADLINE = (
    "mart_master", "mart_wide_cast", "mart_union_padded", "scd2_apply", "metric_duplicates", "flag_concat", "nearest_preceding_read",
    "stmt_split", "stmt_signature", "write_coverage", "dedupe_first", "dedupe_best_quality", "contract_score", "hallucination_filter",
    "validate_rules", "parity_gates", "line_chunks", "unit_op_overlap", "lineage_edges", "py_extract", "lineage_pipeline",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"))
    timed: dict[str, float] = {}
    for name in HEADLINE:
        query = catalogue.QUERIES[name]
        runs = []
        for _ in range(2):  # the first compiles; the better counts
            began = time.perf_counter()
            query(spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - began)
        timed[name] = round(min(runs), 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(timed.values()), 3), "unit": "sec", "queries": timed, "sf": sf_dir.rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
