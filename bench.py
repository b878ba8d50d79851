"""Time the headline queries and print one JSON line."""

from __future__ import annotations

import json
import os
import time

from rippleframe.plans import REGISTRY
from rippleframe.session import build_session

HEADLINE = [
    "window_features", "measure_baseline", "motion_score", "rolling_mean_var", "hampel_filter", "phase_unwrap", "ema_residual",
    "debounce_islands", "coherence_gate", "asof_sync", "resample_linear", "quantile_calibration", "breathing_rate", "movement_class",
    "calibration_deviation", "room_match", "cross_room_candidates", "trilaterate_2d", "gdop_pairs", "position_fusion", "fusion_attention",
    "privacy_rollup", "rule_engine", "triage_batch", "pck_oks", "packet_decode",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = build_session("bench", os.environ.get("BENCH_CPUS", "8"))
    spark.sparkContext.setLogLevel("ERROR")
    # One small query first, so that start-up is not charged to the first headline query.
    REGISTRY["window_features"].build(spark, sf_dir).write.format("noop").mode("overwrite").save()
    timings = {}
    for name in HEADLINE:
        start = time.perf_counter()
        REGISTRY[name].build(spark, sf_dir).write.format("noop").mode("overwrite").save()
        timings[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(timings.values()), 3), "unit": "sec", "queries": timings,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
