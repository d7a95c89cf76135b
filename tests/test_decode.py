"""Strict decode (S2), event time (S4), defaults (S5), keyed JSON (S3)."""

import json

from pyspark.sql import functions as F

from velocis.sources.decode import decode_transactions, ingest_defaults, stamp_event_time
from velocis.sources.sinks import keyed_json

GOOD = {"transaction_id": "t1", "entity_id": "e1", "amount": 12.5, "merchant_id": "merch_online_0001",
        "merchant_category": "online", "latitude": 1.0, "longitude": 2.0, "timestamp_ms": 1700000000000}


def test_decode_quarantines_every_kind_of_bad_message(spark):
    missing = {k: v for k, v in GOOD.items() if k != "amount"}
    extra = dict(GOOD, channel="web")
    wrong = dict(GOOD, amount="n/a")
    null = dict(GOOD, amount=None)
    msgs = [json.dumps(GOOD), json.dumps(null), json.dumps(missing), json.dumps(extra), json.dumps(wrong), '{"transaction_id": "t',
            json.dumps(dict(GOOD, is_fraud=True, fraud_type="fraudster"))]
    raw = spark.createDataFrame([(m,) for m in msgs], "value string")
    good, bad = decode_transactions(raw)
    g = good.collect()
    assert len(g) == 2 and g[0]["amount"] == 12.5 and not g[0]["is_fraud"] and g[0]["fraud_type"] == "none"
    reasons = sorted(r["reason"] for r in bad.collect())
    assert reasons == ["bad_type", "extra_keys", "malformed_json", "missing_keys", "null_value"]


def test_stamp_event_time_null_and_zero_use_arrival(spark):
    df = spark.createDataFrame([(1700000000123,), (0,), (None,)], "timestamp_ms long")
    arr = F.timestamp_micros(F.lit(5_000_000))
    out = [r["event_ts"] for r in stamp_event_time(df, "timestamp_ms", arr).select(
        F.unix_micros("event_ts").alias("event_ts")).collect()]
    assert out == [1700000000123000, 5_000_000, 5_000_000]


def test_ingest_defaults(spark):
    df = spark.createDataFrame([(None, None, None, None)],
                               "latitude double, longitude double, merchant_id string, merchant_category string")
    r = ingest_defaults(df).first()
    assert (r["latitude"], r["longitude"], r["merchant_id"], r["merchant_category"]) == (0.0, 0.0, "unknown", "other")


def test_keyed_json(spark):
    df = spark.createDataFrame([("e1", 1.5)], "entity_id string, amount double")
    r = keyed_json(df).first()
    assert r["key"] == "e1" and json.loads(r["value"]) == {"entity_id": "e1", "amount": 1.5}


def test_requests_from_any_transaction_table(spark):
    from velocis.sources.tables import requests_from_transactions
    df = spark.createDataFrame([("t1", "e1", 5.0, 1.0, 2.0, "online", 1_700_000_000_000_000)],
                               "transaction_id string, entity_id string, amount double, latitude double, "
                               "longitude double, merchant_category string, us long")
    r = requests_from_transactions(df, delay_seconds=2).first()
    assert r["request_id"] == "req-t1" and r["batch_id"].startswith("b")
    assert r["request_ts"] is not None


def test_keyed_json_on_a_stream(spark):
    import uuid
    from velocis.session import scratch_path
    from velocis.streaming.streams import keyed_json_stream, parquet_source, run_to_table
    df = spark.createDataFrame([("e1", "t1", 1.5), ("e2", "t2", 2.5)], "entity_id string, transaction_id string, amount double")
    src = scratch_path(spark, f"tests/kj-{uuid.uuid4().hex[:8]}")
    df.write.parquet(src)
    out = spark.read.parquet(run_to_table(keyed_json_stream(parquet_source(spark, src, df.schema)), "kj"))
    got = {r["key"]: json.loads(r["value"]) for r in out.collect()}
    assert got == {"e1": {"entity_id": "e1", "transaction_id": "t1", "amount": 1.5},
                   "e2": {"entity_id": "e2", "transaction_id": "t2", "amount": 2.5}}
