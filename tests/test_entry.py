"""Driver contract: entry(), queries(), oracle_sql(); SQL functions."""

import __spark_entry__ as E
from velocis.functions.sql import register_sql_functions

SF001 = "/root/testdata/sf0.001"


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert "amount_zscore" in df.columns


def test_every_oracle_key_has_a_query():
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q) and len(q) >= 60


def test_sql_functions(spark):
    register_sql_functions(spark)
    r = spark.sql("SELECT haversine_km(40.7128, -74.0060, 51.5074, -0.1278) AS d, haversine_km(0, 0, 1, 1) AS z, "
                  "fraud_decision(0.2) AS a, fraud_decision(0.5) AS b, fraud_confidence(0.1) AS c, "
                  "fraud_flag(0.5) AS f").first()
    assert 5500 < r["d"] < 5600 and r["z"] == 0 and (r["a"], r["b"]) == ("REVIEW", "DECLINE")
    assert abs(r["c"] - 0.9) < 1e-12 and r["f"] is False
    plan = spark.sql("SELECT haversine_km(1.0, 2.0, 3.0, 4.0)")._jdf.queryExecution().executedPlan().toString()
    assert "PythonUDF" not in plan and "BatchEvalPython" not in plan


def test_small_queries_run_at_sf0001(spark):
    q = E.queries()
    for name in ("rolling_features", "serve_live", "serve_tiered", "latency_report", "roc_auc", "decision_band"):
        assert q[name](spark, SF001).count() > 0, name
