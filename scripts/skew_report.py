"""Task balance of the rolling-feature window stage under a hot entity.

Derives a skewed transaction table from the given ``events`` table (one
entity takes the rows of every third user, so it holds about a third of all
rows), runs ``rolling_features`` with and without hot-entity slicing, and
reads Spark's event log (written to a scratch folder) to report, for the
window stage, the largest and median task by shuffle records read and by
run time. Usage: python scripts/skew_report.py [sf_dir] [hot_rows]
"""

from __future__ import annotations

import glob
import json
import os
import statistics
import sys
import tempfile

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def stage_tasks(log_dir: str) -> dict[int, list[dict]]:
    tasks: dict[int, list[dict]] = {}
    for path in glob.glob(os.path.join(log_dir, "**", "*"), recursive=True):
        if os.path.isdir(path) or os.path.basename(path).startswith("appstatus"):
            continue
        with open(path) as f:
            for line in f:
                ev = json.loads(line)
                if ev.get("Event") != "SparkListenerTaskEnd":
                    continue
                info, m = ev["Task Info"], ev.get("Task Metrics") or {}
                rd = (m.get("Shuffle Read Metrics") or {}).get("Total Records Read", 0)
                tasks.setdefault(ev["Stage ID"], []).append(
                    {"records": rd, "ms": info["Finish Time"] - info["Launch Time"]})
    return tasks


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    hot_rows = int(sys.argv[2]) if len(sys.argv) > 2 else 2000
    log_dir = tempfile.mkdtemp(prefix="velocis-eventlog-")
    from pyspark.sql import functions as F
    from velocis.operators.rolling import rolling_features
    from velocis.schemas import HOURLY
    from velocis.session import get_session
    from velocis.sources.tables import read_table, transactions_from_events
    spark = get_session("local[8]", 32, extra={"spark.eventLog.enabled": "true", "spark.eventLog.dir": log_dir,
                                               "spark.eventLog.compress": "false",
                                               "spark.sql.adaptive.coalescePartitions.enabled": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    ev = read_table(spark, sf_dir, "events")
    skewed = ev.withColumn("user_id", F.when(F.col("user_id") % 3 == 0, F.lit(-1)).otherwise(F.col("user_id")))
    txn = transactions_from_events(skewed)
    total = txn.count()
    hot = txn.where(F.col("entity_id") == "-1").count()
    out = {"rows": total, "hot_entity_rows": hot}
    for label, hr in (("unsplit", None), ("split", hot_rows)):
        spark.sparkContext.setJobGroup(label, label)
        rolling_features(txn, HOURLY, hot_rows=hr).write.format("noop").mode("overwrite").save()
    spark.stop()
    tasks = stage_tasks(log_dir)
    # the window stages: stages whose tasks read the most shuffle records
    ranked = sorted(tasks.items(), key=lambda kv: -sum(t["records"] for t in kv[1]))
    windows = sorted(sid for sid, _ in ranked[:2])
    for label, sid in zip(("unsplit", "split"), windows):
        recs = [t["records"] for t in tasks[sid]]
        ms = [t["ms"] for t in tasks[sid]]
        out[label] = {"stage": sid, "tasks": len(recs), "max_task_records": max(recs),
                      "median_task_records": statistics.median(recs), "max_task_ms": max(ms),
                      "median_task_ms": statistics.median(ms)}
    out["event_log"] = log_dir
    print(json.dumps(out, indent=1))


if __name__ == "__main__":
    main()
