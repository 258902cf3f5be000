"""Time the headline queries and print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose data and cores.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINES = (
    "plan_benchmark_report", "agg01_summary", "joi01_score_join", "win01_rank_candidates", "win02_relative_features",
    "joi04_close_rivals", "joi05_relate_to_top", "joi13_grow_to_whole", "srt03_shortlist", "srt07_argmax_pick",
    "agg05_overlap_metrics", "agg06_evaluate_pickers", "agg07_calibration", "agg13_upper_median", "agg16_perimeter_score",
    "agg19_band_stats", "win04_smooth_series", "win06_runs_from_edge", "win07_min_runs", "win12_session_fold",
    "joi10_resolve_collisions", "nam01_sanitize_name_server", "adm01_admit_uploads", "geo15_quad_overlap", "mlr02_predict_overlap",
)


def main() -> None:
    import bindings
    from sheetwise.session import local_session

    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench")
    bindings.load_all()
    bindings.QUERIES["joi01_score_join"](spark, folder).write.format("noop").mode("overwrite").save()  # warm up
    times = {}
    for name in HEADLINES:
        began = time.perf_counter()
        bindings.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - began, 3)
    total = round(sum(times.values()), 3)
    scale = os.path.basename(folder.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "headline queries, total", "value": total, "unit": "sec", "queries": times, "sf": float(scale)}))
    spark.stop()


if __name__ == "__main__":
    main()
