"""Time the headline queries; prints one JSON line.

``BENCH_SF_DIR`` names the data folder, ``BENCH_CPUS`` the local cores. Every
query runs once on the smallest data set first, so the timed run measures the
query and not class loading.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from plait.plans import registry  # noqa: E402
from plait.session import clear_scratch, local_session  # noqa: E402

HEADLINE = [
    "d4_diff_fields",
    "d5_diff_branches",
    "d12_diff_log",
    "m1_diff3",
    "m4_merge3_manual",
    "m5_merge3_apply_theirs",
    "m6_merge2_dry_run",
    "n1_compare",
    "n2_compare_stats",
    "a11_table_digest",
    "s5_merge_into_replace",
    "t7_merge_commit",
    "t9_blame",
    "t10_cherry_pick",
    "t4_log",
    "t5_common_ancestor",
    "j6_as_of",
    "w2_stack_positions",
    "w4_rank",
    "c9_bulk_write",
    "c11_undo_last",
    "p4_anonymize",
    "h2_chain_verify",
    "g5_write_gate",
    "a6_infer_schema",
    "x2_vector_topk",
    "x3_text_search",
    "r1_change_feed",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    warm_dir = os.path.join(os.path.dirname(sf_dir.rstrip("/")), "sf0.001")
    spark = local_session(cpus, "plait-bench")
    spark.sparkContext.setLogLevel("ERROR")
    queries = registry()[0]

    def run(name: str, folder: str) -> float:
        start = time.perf_counter()
        queries[name](spark, folder).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    chosen = sys.argv[1:] or HEADLINE
    for name in chosen:
        if os.path.isdir(warm_dir):
            run(name, warm_dir)
    times = {name: round(run(name, sf_dir), 3) for name in chosen}
    clear_scratch(spark)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline query time",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1],
            }
        )
    )


if __name__ == "__main__":
    main()
