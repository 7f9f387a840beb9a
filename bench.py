"""Benchmark the headline queries.

Runs each query at ``$BENCH_SF_DIR`` (default /root/testdata/sf0.1) on
``local[$BENCH_CPUS]``: one warm-up, then the median of ``$BENCH_REPEATS``
(default 3) timed runs.  Each run executes the whole plan into the ``noop``
sink (no collect to the driver).  With ``$BENCH_SMALL_DIR`` (default: sf0.01 beside the
data, where it is there) every query also runs once warm on the smaller tables, for the
ratio of times.  Shuffle bytes, exchanges (stages that write a shuffle) and spilled bytes of one run
come from Spark's event log, written to a fresh folder.  Prints ONE JSON line.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time
from collections import defaultdict

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)

HEADLINE = {
    "q1_fct_loan_features": "fct_loan_features",
    "q2_dq_suite": "dq_suite",
    "q3_pre_loan_surge": "pre_loan_surge",
    "q4_dormant_reactivated": "dormant_reactivated",
    "q5_vector_topk": "ret_vector_topk",
    "q6_findings": "findings",
    "q7_keyword_search": "ret_keyword_search",
}


def default_driver_memory() -> str:
    """About 60 % of the memory limit (cgroup limit when set), 2..8 GB."""
    limit = os.sysconf("SC_PAGE_SIZE") * os.sysconf("SC_PHYS_PAGES")
    for path in ("/sys/fs/cgroup/memory.max", "/sys/fs/cgroup/memory/memory.limit_in_bytes"):
        try:
            v = open(path).read().strip()
            if v.isdigit():
                limit = min(limit, int(v))
        except OSError:
            pass
    return f"{max(2, min(8, int(limit * 0.6 / 2 ** 30)))}g"


def logged_shuffles(folder: str) -> dict[str, dict[str, int]]:
    """Per job group of the event log: shuffle bytes written, stages that wrote any, bytes spilled to disk."""
    group_of, wrote, stages, spilled = {}, defaultdict(int), defaultdict(set), defaultdict(int)
    for base, _, names in os.walk(folder):
        for name in names:
            if not name.startswith(("events_", "local-", "app-")):
                continue
            with open(os.path.join(base, name), encoding="utf-8") as lines:
                for line in lines:
                    event = json.loads(line)
                    if event["Event"] == "SparkListenerJobStart":
                        group = (event.get("Properties") or {}).get("spark.jobGroup.id")
                        group_of.update({s: group for s in event["Stage IDs"]})
                    elif event["Event"] == "SparkListenerTaskEnd" and group_of.get(event["Stage ID"]):
                        metrics = event.get("Task Metrics") or {}
                        group, n = group_of[event["Stage ID"]], metrics.get("Shuffle Write Metrics", {}).get("Shuffle Bytes Written", 0)
                        wrote[group] += n
                        spilled[group] += metrics.get("Disk Bytes Spilled", 0)
                        if n:
                            stages[group].add(event["Stage ID"])
    return {g: {"shuffle_bytes": wrote[g], "exchanges": len(stages[g]), "spilled_bytes": spilled[g]} for g in wrote}


def main() -> None:
    from fundscope.plans.registry import entries
    from fundscope.session import build_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    repeats = int(os.environ.get("BENCH_REPEATS", "3"))
    only = [q for q in os.environ.get("BENCH_QUERIES", "").split(",") if q]
    small_dir = os.environ.get("BENCH_SMALL_DIR", os.path.join(os.path.dirname(sf_dir.rstrip("/")), "sf0.01"))
    log_dir = tempfile.mkdtemp(prefix="bench-events-")
    spark = build_session(f"local[{cpus}]", shuffle_partitions=max(8, 2 * cpus), app_name="fundscope-bench",
                          extra={"spark.driver.memory": os.environ.get("BENCH_DRIVER_MEMORY", default_driver_memory()),
                                 "spark.eventLog.enabled": "true", "spark.eventLog.dir": "file://" + log_dir,
                                 "spark.eventLog.compress": "false"})
    ents = entries()
    chosen = {label: ents[name].fn for label, name in HEADLINE.items()
              if not only or label in only or name in only}

    def run(fn, folder=sf_dir):
        t0 = time.perf_counter()
        fn(spark, folder).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - t0

    run(ents["fct_loan_features"].fn)  # JVM/JIT warm-up so the first timed query is not penalised
    out, ratio = {}, {}
    for label, fn in chosen.items():
        spark.sparkContext.setJobGroup(label, label)
        run(fn)  # per-query warm-up, the run whose shuffles are reported
        spark.sparkContext.setJobGroup("timed", "timed")
        out[label] = round(statistics.median(run(fn) for _ in range(repeats)), 3)
        if os.path.isdir(small_dir) and os.path.realpath(small_dir) != os.path.realpath(sf_dir):
            ratio[label] = round(out[label] / min(run(fn, small_dir) for _ in range(2)), 2)
    spark.stop()
    shuffles = logged_shuffles(log_dir)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "query_seconds_total", "value": round(sum(out.values()), 3), "unit": "sec",
                      "queries": out, "sf": sf, "cpus": cpus, "repeats": repeats, "ratio_to_small": ratio,
                      "plans": {label: shuffles.get(label, {}) for label in chosen}}))


if __name__ == "__main__":
    main()
