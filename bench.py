"""Time the headline queries: one JSON line on stdout."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pathweave.plans import load_all  # noqa: E402
from pathweave.session import get_session  # noqa: E402

HEADLINE = (
    "suite_motion_stats", "a05_norm_stats", "a06_audit_quality", "a07_err_stats", "w01_forward_flow", "w05_segments", "w14_keyframe_targets",
    "j07_knn_self", "a21_filter_tracks", "j11_bilinear_depth", "j12_patch_depth_median", "a26_fit_sim3", "a29_ransac_sim3",
    "a32_stage_align_translation", "a39_flow_mse_epe", "a42_success_report", "x05_stream_stats_tumbling",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = get_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": str(2 * int(cpus)), "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "16g"})
    spark.sparkContext.setLogLevel("ERROR")
    queries = load_all()
    names = sys.argv[1:] or HEADLINE
    spark.read.parquet(f"{sf_dir}/events.parquet").count()  # start the executor threads
    times = {}
    for name in names:
        start = time.perf_counter()
        queries[name].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
                      "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
