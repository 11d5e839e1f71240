"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from tapelens.plans import registry
from tapelens.session import local_session

HEADLINE = [
    "d1_trading_calendar", "b3_price_history", "p1_volume_anomaly", "p2_broker_concentration",
    "p3_price_fundamental", "p4_free_float", "p5_foreign_flow", "p6_structural",
    "p7_run_all_probes", "p11_screen_score", "p16_observation_matrix", "d18_arm_summary",
    "w7_first_threshold_crossing", "e4_request_quota", "a8_flatten_envelope",
    "a4_keyed_upsert", "t3_unsupported_numbers", "t5_vocab_scan", "t7_secret_redaction",
    "t10_transcript_checks", "p11_screen_score_daily", "t3_unsupported_numbers_corpus",
]


def main() -> None:
    directory = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench")
    spark.sparkContext.setLogLevel("OFF")
    jobs = registry.queries()
    jobs["b4_last_session"](spark, directory).collect()  # start the engine before timing
    seconds = {}
    for name in HEADLINE:
        start = time.perf_counter()
        jobs[name](spark, directory).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "total wall time of the headline queries",
        "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
        "sf": directory.rstrip("/").rsplit("sf", 1)[-1],
    }), flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
