"""Time the headline queries and print one JSON line.

BENCH_SF_DIR names the table folder, BENCH_CPUS the number of local cores.
"""

from __future__ import annotations

import json
import os
import time

from roadledger.queries import REGISTRY
from roadledger.session import build_session

HEADLINE = """project_rollup deflated_spend_by_year window_match window_match_loose positional_merge uniqueness_census
    chain_intervals link_gaps overlap_drop gap_rows nearest_record containment_sums event_panel event_mean allocate_spend
    grain_panel_nation_year lagged_pseudo_units range_window_ratio weighted_percentiles exact_quantiles completeness_audit
    coverage_by_type extract_routes title_endpoints stratified_sample cluster_hash_split metric_summary interval_metrics
    polyline_position cut_line components merged_parts fe_two_way_weighted nearest_name""".split()


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "16g", "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()
    times = {}
    for name in HEADLINE:
        start = time.time()
        REGISTRY[name].run(spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
    print(json.dumps({"metric": "total wall time of the headline queries", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": folder.rstrip("/").rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
