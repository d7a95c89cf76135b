"""Queries for scalar functions, decoding and sinks."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from velocis.functions.scalar import (
    category_code, confidence, decision, haversine_km, is_fraud, snapshot_key,
)
from velocis.operators.rolling import rolling_features
from velocis.operators.scoring import optional_outputs, request_defaults
from velocis.plans.catalog import ROUND, feature_exprs, feature_sql, register, rounded
from velocis.plans.oracle import TXN, haversine_sql, rolling_select
from velocis.schemas import HOURLY
from velocis.sources.decode import decode_transactions, ingest_defaults, stamp_event_time, validate
from velocis.sources.sinks import keyed_json, snapshot_json
from velocis.sources.tables import read_table, requests_from_transactions, transactions

def demo_importances():
    """Importances for the explanation queries: a fixed linear rule over the
    20 positions (position i gets (i + 1) / 210, summing to 1)."""
    return [(i + 1) / 210.0 for i in range(20)]


# A fixed point for the distance query (New York City).
REF_LAT, REF_LON = 40.7128, -74.0060


@register("haversine", f"""WITH {TXN}
SELECT transaction_id,
  round({haversine_sql(str(REF_LAT), str(REF_LON), 'latitude', 'longitude')}, {ROUND}) AS km_from_ref,
  round({haversine_sql('latitude', 'longitude', str(REF_LAT), str(REF_LON))}, {ROUND}) AS km_to_ref,
  round({haversine_sql('0.0', '0.0', 'latitude', 'longitude')}, {ROUND}) AS km_from_origin
FROM txn""")
def q_haversine(spark, sf_dir):
    """distance of every transaction to a fixed point, both directions,
    and from the (0,0) "no location" origin (always 0)."""
    t = transactions(spark, sf_dir)
    return rounded(t.select(
        "transaction_id",
        haversine_km(F.lit(REF_LAT), F.lit(REF_LON), F.col("latitude"), F.col("longitude")).alias("km_from_ref"),
        haversine_km(F.col("latitude"), F.col("longitude"), F.lit(REF_LAT), F.lit(REF_LON)).alias("km_to_ref"),
        haversine_km(F.lit(0.0), F.lit(0.0), F.col("latitude"), F.col("longitude")).alias("km_from_origin")))


_P = "(value % 100) / 100.0"


@register("decision_band", f"""SELECT event_id, {_P} AS p,
  CASE WHEN {_P} < 0.2 THEN 'APPROVE' WHEN {_P} < 0.5 THEN 'REVIEW' ELSE 'DECLINE' END AS decision,
  round(CASE WHEN {_P} < 0.2 THEN 1.0 - {_P} WHEN {_P} < 0.5 THEN 0.5 ELSE {_P} END, {ROUND}) AS confidence,
  {_P} > 0.5 AS is_fraud
FROM events""")
def q_decision_band(spark, sf_dir):
    """F2/F3 over probabilities derived from event values (hits 0.2 and 0.5
    exactly: REVIEW and DECLINE-with-is_fraud-false)."""
    e = read_table(spark, sf_dir, "events").select("event_id", ((F.col("value") % 100) / 100.0).alias("p"))
    out = e.select("event_id", "p", decision("p").alias("decision"),
                   F.round(confidence("p"), ROUND).alias("confidence"), is_fraud("p").alias("is_fraud"))
    return out


@register("category_code", f"""WITH {TXN}
SELECT merchant_category, CAST(CASE merchant_category WHEN 'grocery' THEN 0 WHEN 'gas_station' THEN 1
  WHEN 'restaurant' THEN 2 WHEN 'online' THEN 3 WHEN 'atm' THEN 4 WHEN 'travel' THEN 5
  WHEN 'retail' THEN 6 ELSE 7 END AS BIGINT) AS category_code, CAST(count(*) AS BIGINT) AS transactions
FROM txn GROUP BY ALL""")
def q_category_code(spark, sf_dir):
    """Fixed category codes (unknown -> other), with counts."""
    t = transactions(spark, sf_dir)
    return t.groupBy("merchant_category").agg(F.count(F.lit(1)).alias("transactions")) \
        .select("merchant_category", category_code("merchant_category").cast("long").alias("category_code"),
                "transactions")


@register("key_format", f"""WITH {TXN}
SELECT transaction_id, 'fs:v1:' || entity_id AS snapshot_key, merchant_id FROM txn""")
def q_key_format(spark, sf_dir):
    """snapshot keys and merchant identifiers."""
    t = transactions(spark, sf_dir)
    return t.select("transaction_id", snapshot_key("entity_id").alias("snapshot_key"), "merchant_id")


# Every 5th event has no time, every 7th a zero.
GIVEN_MS = "CASE WHEN event_id % 5 = 0 THEN NULL WHEN event_id % 7 = 0 THEN 0 ELSE timestamp_ms END"


@register("stamp_event_time", f"""WITH {TXN}, g AS (SELECT *, {GIVEN_MS} AS given_ms FROM txn)
SELECT transaction_id, given_ms IS NULL AS no_time, CAST(coalesce(given_ms, -1) AS BIGINT) AS timestamp_ms,
  CAST(CASE WHEN coalesce(given_ms, 0) = 0 THEN us ELSE given_ms * 1000 END AS BIGINT) AS event_us
FROM g""")
def q_stamp_event_time(spark, sf_dir):
    """Epoch ms -> timestamp, null or 0 -> arrival, and back."""
    t = transactions(spark, sf_dir).withColumn("timestamp_ms", F.expr(GIVEN_MS))
    s = stamp_event_time(t, "timestamp_ms", F.col("event_ts"), "stamped")
    return s.select("transaction_id", F.col("timestamp_ms").isNull().alias("no_time"),
                    F.coalesce("timestamp_ms", F.lit(-1)).cast("long").alias("timestamp_ms"),
                    F.unix_micros("stamped").alias("event_us"))


def _holes(col: str, one_in: int) -> str:
    return f"CASE WHEN event_id % {one_in} = 0 THEN NULL ELSE {col} END"


@register("ingest_defaults", f"""WITH {TXN}
SELECT transaction_id, coalesce({_holes('latitude', 5)}, 0.0) AS latitude,
  coalesce({_holes('longitude', 3)}, 0.0) AS longitude, coalesce({_holes('merchant_id', 7)}, 'unknown') AS merchant_id,
  coalesce({_holes('merchant_category', 11)}, 'other') AS merchant_category
FROM txn""")
def q_ingest_defaults(spark, sf_dir):
    """Ingest defaults; every column is missing in some rows."""
    t = transactions(spark, sf_dir)
    for col, one_in in (("latitude", 5), ("longitude", 3), ("merchant_id", 7), ("merchant_category", 11)):
        t = t.withColumn(col, F.expr(_holes(col, one_in)))
    return ingest_defaults(t).select("transaction_id", "latitude", "longitude", "merchant_id", "merchant_category")


def raw_messages(spark, sf_dir):
    """JSON messages built from events; the data decides which are damaged:
    error events lose ``amount``, signup events carry an extra key, views over
    400 are cut short, purchases over 450 carry a non-numeric amount."""
    t = transactions(spark, sf_dir, keep=("event_type", "value"))
    cols = ["transaction_id", "entity_id", "amount", "merchant_id", "merchant_category", "latitude",
            "longitude", "timestamp_ms", "is_fraud"]
    full = F.to_json(F.struct(*[F.col(c) for c in cols]))
    no_amount = F.to_json(F.struct(*[F.col(c) for c in cols if c != "amount"]))
    extra = F.to_json(F.struct(*[F.col(c) for c in cols], F.lit("web").alias("channel")))
    bad_amount = F.to_json(F.struct(*[F.col(c) if c != "amount" else F.lit("n/a").alias("amount") for c in cols]))
    msg = (F.when(F.col("event_type") == "error", no_amount)
           .when(F.col("event_type") == "signup", extra)
           .when((F.col("event_type") == "view") & (F.col("value") > 400), F.substring(full, 1, 40))
           .when((F.col("event_type") == "purchase") & (F.col("value") > 450), bad_amount)
           .otherwise(full))
    return t.select("event_id", "us", msg.alias("value"))


@register("decode_transactions", f"""SELECT event_id,
  CASE WHEN event_type = 'error' THEN 'missing_keys' WHEN event_type = 'signup' THEN 'extra_keys'
       WHEN event_type = 'view' AND value > 400 THEN 'malformed_json'
       WHEN event_type = 'purchase' AND value > 450 THEN 'bad_type' END AS reason,
  CASE WHEN event_type IN ('error', 'signup') OR (event_type = 'view' AND value > 400)
         OR (event_type = 'purchase' AND value > 450) THEN NULL ELSE round(value, {ROUND}) END AS amount
FROM events""")
def q_decode_transactions(spark, sf_dir):
    """Strict decode; bad messages go to quarantine with a reason."""
    raw = raw_messages(spark, sf_dir)
    v = validate(raw)
    return rounded(v.select("event_id", "reason",
                            F.when(F.col("reason").isNull(), F.col("txn.amount")).alias("amount")))


@register("decoded_good", f"""WITH {TXN}
SELECT transaction_id, entity_id, round(amount, {ROUND}) AS amount, merchant_id, merchant_category,
  round(latitude, {ROUND}) AS latitude, round(longitude, {ROUND}) AS longitude, timestamp_ms, is_fraud,
  'none' AS fraud_type
FROM txn JOIN events USING (event_id)
WHERE NOT (event_type IN ('error', 'signup') OR (event_type = 'view' AND value > 400)
           OR (event_type = 'purchase' AND value > 450))""")
def q_decoded_good(spark, sf_dir):
    """S2 good output: the accepted transactions, typed (JSON round trip)."""
    good, _ = decode_transactions(raw_messages(spark, sf_dir))
    return rounded(good)


MESSAGE = ("transaction_id string, entity_id string, amount double, merchant_id string, merchant_category string, "
           "latitude double, longitude double, timestamp_ms long, is_fraud boolean, fraud_type string")


@register("encode_keyed_json", f"""WITH {TXN}
SELECT entity_id AS key, 10 AS n_fields, transaction_id, entity_id, round(amount, {ROUND}) AS amount, merchant_id,
  merchant_category, round(latitude, {ROUND}) AS latitude, round(longitude, {ROUND}) AS longitude, timestamp_ms,
  is_fraud, 'none' AS fraud_type
FROM txn""")
def q_encode_keyed_json(spark, sf_dir):
    """S3: key = entity id, value = JSON of the transaction, parsed again."""
    t = transactions(spark, sf_dir).drop("event_ts", "us", "event_id")
    k = keyed_json(t).select("key", F.size(F.json_object_keys("value")).alias("n_fields"),
                             F.from_json("value", MESSAGE, {"mode": "FAILFAST"}).alias("v"))
    return rounded(k.select("key", "n_fields", "v.*"))


def _snapshot_json_sql() -> str:
    return f"""WITH {_flog_geo_sql()}
SELECT entity_id, entity_id AS in_payload, us // 1000 AS computed_at_ms, {', '.join(feature_sql(HOURLY))},
  merchant_category FROM flog"""


def q_snapshot_json(spark, sf_dir):
    """Snapshot rows as JSON documents with computed_at_ms, parsed again."""
    from velocis.sources.sinks import payload_schema
    j = snapshot_json(rolling_features(transactions(spark, sf_dir), HOURLY), HOURLY)
    p = j.select("entity_id", F.from_json("payload", payload_schema(HOURLY), {"mode": "FAILFAST"}).alias("p"))
    return rounded(p.select("entity_id", F.col("p.entity_id").alias("in_payload"), "p.computed_at_ms",
                            *[f"p.{c}" for c in HOURLY.feature_columns()], "p.merchant_category"))


def _flog_geo_sql() -> str:
    geo = haversine_sql("prev_latitude", "prev_longitude", "latitude", "longitude")
    return f"""{TXN}, flog0 AS ({rolling_select(HOURLY.lengths)}),
flog AS (SELECT *, {geo} AS geo_distance_delta FROM flog0)"""


register("snapshot_json", _snapshot_json_sql())(q_snapshot_json)


def _vec_sql() -> list[str]:
    return [f"CAST(CAST({e} AS FLOAT) AS DOUBLE)" for e in feature_exprs(HOURLY).values()]


@register("model_vector", f"""WITH {_flog_geo_sql()}
SELECT transaction_id, {', '.join(f'round({e}, {ROUND}) AS v{i:02d}' for i, e in enumerate(_vec_sql()))}
FROM flog""")
def q_model_vector(spark, sf_dir):
    """The 20-element float32 vector, one column per element."""
    from velocis.operators.scoring import model_vector
    f = rolling_features(transactions(spark, sf_dir), HOURLY)
    v = f.select("transaction_id", model_vector(HOURLY).alias("v"))
    return v.select("transaction_id", *[F.round(F.col("v")[i].cast("double"), ROUND).alias(f"v{i:02d}")
                                        for i in range(20)])


@register("request_defaults", f"""WITH {TXN}
SELECT CASE WHEN event_id % 6 = 0 THEN 'made' ELSE 'req-' || transaction_id END AS request_id,
  CASE WHEN event_id % 4 = 0 THEN 'made' ELSE transaction_id END AS transaction_id,
  coalesce({_holes('latitude', 5)}, 0.0) AS latitude, coalesce({_holes('longitude', 3)}, 0.0) AS longitude,
  coalesce({_holes('merchant_category', 7)}, 'other') AS merchant_category,
  coalesce(CASE WHEN event_id % 8 <> 0 THEN event_id % 3 = 0 END, false) AS include_features,
  coalesce(CASE WHEN event_id % 9 <> 0 THEN event_id % 4 = 0 END, false) AS explain,
  CAST(1 AS BIGINT) AS requests_with_the_id
FROM txn""")
def q_request_defaults(spark, sf_dir):
    """Request defaults; ids, places, categories and flags are missing in
    some requests. Made ids are shown as such; each belongs to one request."""
    t = transactions(spark, sf_dir)
    r = requests_from_transactions(t).withColumn("event_id", F.col("transaction_id").cast("long"))
    for col, one_in in (("request_id", 6), ("transaction_id", 4), ("latitude", 5), ("longitude", 3),
                        ("merchant_category", 7), ("include_features", 8), ("explain", 9)):
        r = r.withColumn(col, F.expr(_holes(col, one_in)))
    r = request_defaults(r)
    n = F.count(F.lit(1)).over(Window.partitionBy("request_id"))
    made = {c: F.when(F.col(c).rlike("^(req|txn)-[0-9a-f]{16}$"), F.lit("made")).otherwise(F.col(c))
            for c in ("request_id", "transaction_id")}
    return r.withColumn("requests_with_the_id", n).select(
        made["request_id"].alias("request_id"), made["transaction_id"].alias("transaction_id"), "latitude",
        "longitude", "merchant_category", "include_features", "explain", "requests_with_the_id")


@register("optional_outputs", f"""WITH {TXN}
SELECT transaction_id, event_id % 3 = 0 AS has_features,
  CAST(CASE WHEN event_id % 4 = 0 THEN 20 ELSE 0 END AS BIGINT) AS n_explanations
FROM txn""")
def q_optional_outputs(spark, sf_dir):
    """Features struct and explanations only when requested."""
    t = transactions(spark, sf_dir)
    f = rolling_features(t, HOURLY)
    req = requests_from_transactions(t).select("transaction_id", "include_features", "explain")
    o = optional_outputs(f.join(req, "transaction_id"), HOURLY, importances=demo_importances())
    return o.select("transaction_id", F.col("features").isNotNull().alias("has_features"),
                    F.size("explanations").cast("long").alias("n_explanations"))


def _explain_sql() -> str:
    names = ", ".join(f"'{n}'" for n in HOURLY.feature_columns())
    vals = ", ".join(f"CAST(CAST({imp!r} * abs({v}) AS FLOAT) AS DOUBLE)"
                     for imp, v in zip(demo_importances(), _vec_sql()))
    return f"""WITH {_flog_geo_sql()}
SELECT transaction_id, feature, round(contribution, 4) AS contribution
FROM (SELECT transaction_id, unnest([{names}]) AS feature, unnest([{vals}]) AS contribution FROM flog)"""


@register("explain_map", _explain_sql())
def q_explain_map(spark, sf_dir):
    """importance * |value| per feature, exploded."""
    t = transactions(spark, sf_dir)
    f = rolling_features(t, HOURLY).withColumn("explain", F.lit(True))
    o = optional_outputs(f, HOURLY, importances=demo_importances())
    e = o.select("transaction_id", F.explode("explanations").alias("feature", "contribution"))
    return e.select("transaction_id", "feature", F.round(F.col("contribution").cast("double"), 4).alias("contribution"))




@register("sql_functions", f"""WITH {TXN}
SELECT transaction_id,
  round({haversine_sql(str(REF_LAT), str(REF_LON), 'latitude', 'longitude')}, {ROUND}) AS km_from_ref,
  CASE WHEN (amount % 100) / 100.0 < 0.2 THEN 'APPROVE' WHEN (amount % 100) / 100.0 < 0.5 THEN 'REVIEW'
       ELSE 'DECLINE' END AS decision,
  round(CASE WHEN (amount % 100) / 100.0 < 0.2 THEN 1.0 - (amount % 100) / 100.0
             WHEN (amount % 100) / 100.0 < 0.5 THEN 0.5 ELSE (amount % 100) / 100.0 END, {ROUND}) AS confidence,
  (amount % 100) / 100.0 > 0.5 AS is_fraud
FROM txn""")
def q_sql_functions(spark, sf_dir):
    """The same scalar functions called from Spark SQL."""
    from velocis.functions.sql import register_sql_functions
    register_sql_functions(spark)
    transactions(spark, sf_dir).createOrReplaceTempView("velocis_txn")
    return spark.sql(f"""
      SELECT transaction_id, round(haversine_km({REF_LAT}, {REF_LON}, latitude, longitude), {ROUND}) AS km_from_ref,
        fraud_decision((amount % 100) / 100.0) AS decision,
        round(fraud_confidence((amount % 100) / 100.0), {ROUND}) AS confidence,
        fraud_flag((amount % 100) / 100.0) AS is_fraud
      FROM velocis_txn""")
