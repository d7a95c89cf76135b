"""End-to-end run of the three flows on one table set, with the public API.

  E1 ingest:  events -> transactions -> feature log -> latest-snapshot table
  E3 train:   feature log + labels -> split -> boosted trees -> AUC / AP /
              report / top features -> model bundle (versioned folder)
  E2 score:   requests -> tiered features -> newest model -> decisions ->
              monitoring reports

Usage: python scripts/pipeline.py [sf_dir] [gbt_rounds]
Outputs go under the shared checkpoint folder (``spark.checkpoint.dir``).
"""

from __future__ import annotations

import json
import os
import sys
import time
import uuid

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import functions as F  # noqa: E402

from velocis import api, get_session  # noqa: E402
from velocis.session import scratch_path  # noqa: E402


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    rounds = int(sys.argv[2]) if len(sys.argv) > 2 else 100
    spark = get_session("local[8]", 8)
    spark.sparkContext.setLogLevel("ERROR")
    root = scratch_path(spark, f"pipeline-{uuid.uuid4().hex[:8]}")
    ws = api.HOURLY
    report = {"sf_dir": sf_dir, "root": root}
    t0 = time.time()

    # ingest
    txn = api.transactions(spark, sf_dir)
    flog = api.rolling_features(txn, ws, carry=("is_fraud",))
    flog.drop("computed_at").write.mode("overwrite").parquet(root + "/feature_log")
    flog = spark.read.parquet(root + "/feature_log")
    snapshots = api.SnapshotTable(spark, root + "/snapshots", ws, n_buckets=16, ttl_s=3 * 3600)
    snapshots.upsert(flog)
    report["feature_rows"] = flog.count()
    report["snapshot_entities"] = snapshots.read().count()

    # Train on the served features
    data = api.training_set(flog, None, ws)
    train, test = api.stratified_split(data)
    model = api.train_gbt(train.checkpoint(eager=True), ws, max_iter=rounds)
    scored_test = api.predict(model, test)
    report["roc_auc"] = api.roc_auc(scored_test).first()[0]
    report["average_precision"] = api.average_precision(scored_test).first()[0]
    report["classification_report"] = [r.asDict() for r in api.classification_report(scored_test).collect()]
    importances = api.feature_importances(model, spark, ws)
    report["top_features"] = [r["feature"] for r in api.top_features(importances, 5).collect()]
    api.save_bundle(model, root + "/models/v1", {"model_type": "gbt", "version": "1",
                                                  "roc_auc": report["roc_auc"], "threshold": 0.5})

    # Score requests with the newest model, then monitor
    bundle, meta = api.load_bundle(api.latest_bundle(root + "/models"))
    imp = [r["importance"] for r in importances.orderBy("position").collect()]
    requests = api.requests_from_transactions(txn, delay_seconds=2)
    scored = api.batch_score(requests, txn, None, bundle, ws, max_age_s=300, importances=imp)
    scored = scored.withColumn("model_version", F.lit(meta["version"]))
    scored.drop("features").write.mode("overwrite").parquet(root + "/scored")
    scored = spark.read.parquet(root + "/scored")
    report["decisions"] = {r["decision"]: r["requests"] for r in api.decision_counts(scored).collect()}
    report["served_from"] = api.serving_coverage(scored).first().asDict()
    hist = api.cumulative_histogram(scored, "fraud_probability", (0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0))
    report["score_p99"] = api.histogram_quantile(hist, 0.99).first()[0]
    report["batches"] = api.batch_summary(scored).count()
    report["seconds"] = round(time.time() - t0, 1)
    print(json.dumps(report, default=str, indent=1))


if __name__ == "__main__":
    main()
