"""Times the headline queries and prints one JSON line.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py
"""

from __future__ import annotations

import json
import os
import time

from consentry.queries import QUERIES, Frames
from consentry.session import build_session

HEADLINE = [
    # masks per row
    "m3_hmac", "m4_mask_email", "m5_mask_iban", "m6_mask_phone",
    # governed reads and SQL
    "s1_governed_scan", "p5_filter_tree", "p12_composite_keys", "j1_enrichment", "j2_hierarchy",
    "s5_file_index", "j3_correlated_exists", "j5_child_lists", "j6_governed_join", "q1_governed_cte",
    # consents and policies in bulk
    "a1_column_levels", "g1_access_matrix", "j12_policy_decision", "a8_policy_replay", "p17_rules_with_literal_parts",
    # audit
    "k6_append_chain", "w1_verify_chain", "a6_disclosure_report", "a9_table_telemetry",
    # lineage and catalog
    "u6_downstream_closure", "u7_revocation_impact", "u2_schema_diff", "s7_table_metadata",
    # cost, privacy, text, streams
    "a11_billed_cost", "w5_privacy_ledger", "t1_scrub_personal_data", "t4_injection_flags",
    "l5_pick_within_budget", "s11_change_envelope", "st5_stream_mask", "k4_merkle_roots", "w1_merkle_proofs",
    "j4_interval_sweep", "a14_private_client_sums", "s13_change_stream",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", cores=cpus, shuffle_partitions=int(cpus))
    # The first query runs once unmeasured, so that the start of the JVM and of code generation is nobody's time.
    QUERIES[HEADLINE[0]](Frames(spark, sf_dir)).write.format("noop").mode("overwrite").save()
    times: dict[str, float] = {}
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](Frames(spark, sf_dir)).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "headline_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
