"""Time the headline queries: one JSON line on stdout.

BENCH_SF_DIR names the data (default /root/testdata/sf0.1), BENCH_CPUS the cores,
BENCH_RUNS the most warm runs per query, of which the median counts. A query stops
repeating after ten seconds of warm runs.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from netspark.plans.queries import QUERIES
from netspark.plans.tables import Tables
from netspark.session import local_session

HEADLINE = [
    "packets_to_risk",
    "f1_flows", "f2_idle_timeout", "x0_flow_features", "p2_direction",
    "w1_ddos_counts", "w3_port_scan_ports", "w4_port_scan_targets", "w7_brute_force_attempts", "w10_verdict_transitions",
    "w12_running_summary", "w1_ddos_at_check",
    "n5_forest_scores", "l1_prompts", "l2_budget", "l3_parsed_responses", "l5_labels",
    "e1_evidence", "i1_correlation", "i2_incidents", "i6_timeline_text", "s10_cef_evidence",
    "q5_by_risk", "q7_case_files", "r3_alert_rate_limit", "r7_geo_enrichment",
    "a3_stratified_split", "t2_finding_retention", "t3_sample_cap", "m3_risk_histogram",
]


def timed(run) -> float:
    started = time.perf_counter()
    run()
    return time.perf_counter() - started


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus, runs = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 4)), int(os.environ.get("BENCH_RUNS", "3"))
    spark = local_session(cpus, int(cpus) if cpus.isdigit() else 8, "bench")
    spark.sparkContext.setLogLevel("ERROR")
    tables = Tables(spark, sf_dir)

    def build() -> None:
        for name in ("packets", "new_flows", "features", "evidence", "bridge", "incidents", "attack_events", "labelled"):
            getattr(tables, name)()

    build_seconds = timed(build)
    flows = tables.features().count()
    seconds = {}
    for name in HEADLINE:
        def run(query=QUERIES[name]) -> None:
            query(spark, sf_dir).write.format("noop").mode("overwrite").save()

        run()
        warm = [timed(run)]
        while len(warm) < runs and sum(warm) < 10:
            warm.append(timed(run))
        seconds[name] = round(statistics.median(warm), 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "headline queries, total of warm medians",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")),
                "table_build_sec": round(build_seconds, 3),
                "flows_per_sec_packets_to_risk": round(flows / seconds["packets_to_risk"], 1),
                "flows_per_sec_assembly_and_features": round(flows / seconds["x0_flow_features"], 1),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
