"""Time the headline queries; prints one JSON line.

``BENCH_SF_DIR`` names the tables, ``BENCH_CPUS`` the cores.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from logwarden.queries import REGISTRY  # noqa: E402
from logwarden.session import session  # noqa: E402

HEADLINE = ["analysis", "features", "stat_features", "stat_percentiles", "stat_entropy", "net_features", "stat_features_lineitem",
            "net_features_lineitem", "delta_global", "events_per_hour", "sessions", "new_action", "zscore", "ensemble", "alerts",
            "cooldown", "drift_report", "validate_schema", "parse_ts", "encode", "syslog_rfc5424", "jsonl_scan", "iforest_scores",
            "stream_sessions"]
# Timed as well, but left out of the total, which stays comparable from run to run.
MORE = ["features_fitted", "trailing_zscore", "stat_percentiles_fields", "stratified_split_ids", "first_time_batches"]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "16g"})
    spark.sparkContext.setLogLevel("ERROR")
    # Start the engine, its compiler and Python workers outside the timings.
    for name in ("sessions", "alerts"):
        REGISTRY[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times: dict[str, float] = {}
    for name in HEADLINE + MORE:
        start = time.perf_counter()
        REGISTRY[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(f"{name}: {times[name]}", file=sys.stderr, flush=True)
    events = spark.read.parquet(f"{sf_dir}/events.parquet").count()
    print(json.dumps({"metric": "headline_total", "value": round(sum(times[n] for n in HEADLINE), 3), "unit": "sec", "queries": times,
                      "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"), "events": events, "cpus": int(cpus),
                      "events_per_second_analysis": round(events / times["analysis"], 1),
                      "events_per_second_features": round(events / times["features"], 1)}))
    spark.stop()


if __name__ == "__main__":
    main()
