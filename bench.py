"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

By default every query runs exactly as ``queries()`` runs it: the business
tables are derived from the driver files inside each query.  With
BENCH_LAYOUT=1 the tables are first written once as a stored layout
(sources/layout.py), as a deployment keeps them; that load is timed and
reported on its own (``layout_load_sec``) and the queries run over it.
Each query is run once to warm up, then ``$BENCH_RUNS`` (3) times; the median
wall time is reported.  Results are materialised with the ``noop`` sink (full
execution, nothing collected to the driver).  Shuffle bytes written and the
largest task's peak execution memory of the last run come from Spark's event
log (written to a fresh scratch folder; the UI stays off).  Prints one JSON line.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py [--all] [key-prefix ...]
"""

from __future__ import annotations

import glob
import json
import os
import statistics
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "a1_kpi", "a6_daily_stats", "a6s_daily_stats_safe", "a7_user_totals", "a7s_user_totals_safe", "a8x_system_stats_full",
    "a9_weekly_spend", "a12_favourite_package", "a15h_bandwidth_by_user_hour", "a17_package_breakdown",
    "p1_active_view", "j5_unused_payment", "j8_latest_payment", "j12t_overlapping_sessions", "j14_duplicate_phone",
    "w1_current_session", "w2_price_list", "l2_history_page", "c3d_mask_documents", "c8_callback_extract",
    "q1_orphan_keys", "u5_settle_payments", "u9_attach_credentials", "t4b_rate_limit_batch",
    "u11_reconcile_payments", "a4d_distinct_users_window", "u1v_published_sessions", "u5v_published_payments",
]
STREAMING = ["s3_callback_source", "t1_callback_dedup", "t2_settle_stream", "t3_expiry_stream", "t4_rate_limit",
             "t5_poll_deadline", "t6_stats_tick", "t3t_expiry_timers"]
STREAM_KEYS = {"s3_callback_source", "s3r_callback_side_output", "s5_report_sink", "t1_callback_dedup", "t1s_callback_dedup_state", "t2_settle_stream", "t2v_settle_published", "t2s_sessions_published",
               "t3_expiry_stream", "t3t_expiry_timers", "t4_rate_limit", "t5_poll_deadline", "t5t_deadline_timers", "t6_stats_tick"}


def _event_metrics(log_dir: str) -> dict[str, dict]:
    """Per job group: shuffle bytes written and the largest task peak execution memory."""
    stage_group: dict[int, str] = {}
    out: dict[str, dict] = {}
    files = [p for p in glob.glob(os.path.join(log_dir, "**", "*"), recursive=True) if os.path.isfile(p)]
    for path in sorted(files):
        with open(path) as f:
            for line in f:
                try:
                    ev = json.loads(line)
                except ValueError:
                    continue
                kind = ev.get("Event")
                if kind == "SparkListenerJobStart":
                    group = (ev.get("Properties") or {}).get("spark.jobGroup.id")
                    if group:
                        for sid in ev.get("Stage IDs", []):
                            stage_group[sid] = group
                elif kind == "SparkListenerTaskEnd":
                    group = stage_group.get(ev.get("Stage ID"))
                    m = ev.get("Task Metrics") or {}
                    if not group or not m:
                        continue
                    rec = out.setdefault(group, {"shuffle_bytes": 0, "max_task_peak_mem": 0, "tasks": 0})
                    rec["shuffle_bytes"] += (m.get("Shuffle Write Metrics") or {}).get("Shuffle Bytes Written", 0)
                    rec["max_task_peak_mem"] = max(rec["max_task_peak_mem"], m.get("Peak Execution Memory", 0))
                    rec["tasks"] += 1
    return out


def main(argv: list[str]) -> None:
    from tollgate.plans import catalog, registry
    from tollgate.session import apply_query_conf, build_session, checkpoint_path
    from tollgate.sources.fixtures import Tables
    from tollgate.sources.layout import LaidOutTables, write_layout

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    args = [a for a in argv[1:] if not a.startswith("--")]
    qs = catalog.queries()
    if "--all" in argv:
        keys = list(qs)
    elif args:
        keys = [k for k in qs if any(k.startswith(a) for a in args)]
    else:
        keys = HEADLINE + STREAMING
    log_dir = tempfile.mkdtemp(prefix="tollgate-bench-events-")
    spark = build_session(f"local[{cpus}]", app="tollgate-bench", shuffle_partitions=int(cpus) * 2,
                          extra={"spark.driver.memory": "16g", "spark.eventLog.enabled": "true",
                                 "spark.eventLog.dir": log_dir, "spark.eventLog.compress": "false"})
    sc = spark.sparkContext
    apply_query_conf(spark)
    load = None
    if not os.environ.get("BENCH_LAYOUT"):
        def tables():
            return Tables(spark, sf_dir)
    else:
        path = checkpoint_path(spark, f"bench-layout-{os.getpid()}-{int(time.time())}")
        sc.setJobGroup("layout", "layout")
        t0 = time.perf_counter()
        write_layout(Tables(spark, sf_dir), path, files=int(cpus) * 2)
        load = round(time.perf_counter() - t0, 3)

        stored = LaidOutTables(spark, sf_dir, path)  # opened once, like catalogue tables

        def tables():
            return stored
    times: dict[str, float] = {}
    rows: dict[str, int] = {}
    for key in keys:
        plan = registry.REGISTRY[key].fn.__wrapped__

        def fn(_spark, _sf, plan=plan):
            return plan(tables())
        samples = []
        again = 0 if key in STREAM_KEYS else runs  # a stream runs once: it stages its input and restarts for each slice
        for i in range(again + 1):
            sc.setJobGroup(f"{key}#{i}", key)
            t0 = time.perf_counter()
            fn(spark, sf_dir).write.format("noop").mode("overwrite").save()
            dt = time.perf_counter() - t0
            if i > 0 or again == 0:
                samples.append(dt)
        times[key] = round(statistics.median(samples), 3)
        sc.setJobGroup(f"{key}#rows", key)
        if key not in STREAM_KEYS:  # counting a stream would run it again
            rows[key] = fn(spark, sf_dir).count()
        print(f"# {key}: {times[key]}s", file=sys.stderr, flush=True)
    spark.stop()
    metrics = _event_metrics(log_dir)
    detail = {k: {"rows": rows.get(k), **metrics.get(f"{k}#{0 if k in STREAM_KEYS else runs}", {})} for k in keys}
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "sum_of_median_query_seconds", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": sf, "cpus": int(cpus), "runs": runs,
                      "tables": "derived" if load is None else "stored layout", "layout_load_sec": load,
                      "detail": detail}))


if __name__ == "__main__":
    main(sys.argv)
