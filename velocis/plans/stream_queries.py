"""Queries for the streaming operators.

Each stream query turns a driver table into an ordered file stream
(``replay``: consecutive time slices, the query stopped and restarted from
its checkpoint after every slice), runs the real streaming plan, and returns
what the sink wrote as a batch DataFrame.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from velocis.operators.rolling import latest_per_entity, rolling_features
from velocis.plans.catalog import ROUND, feature_sql, register, rounded
from velocis.plans.function_queries import raw_messages
from velocis.plans.oracle import CATEGORY_CASE, TXN, haversine_sql, rolling_select
from velocis.plans.rolling_queries import _features_sql
from velocis.plans.serving_queries import TIER_MAX_AGE, _tiered_sql
from velocis.plans.scoring_queries import SCORED_LINEAR_SQL, _decide_sql, _prob_sql, demo_scorer
from velocis.plans.catalog import feature_exprs
from velocis.schemas import HOURLY
from velocis.session import scratch_path
from velocis.sources.sinks import SnapshotTable, read_snapshots, snapshot_records
from velocis.sources.tables import transactions
from velocis.streaming.stateful import rolling_features_stateful
from velocis.streaming.streams import (
    decode_stream, dedup, parquet_source, replay, sliding_aggregates, snapshot_sink, text_source,
)

CHUNKS = 4
DAY_US = 86400 * 1_000_000
TXN_COLS = ["entity_id", "transaction_id", "us", "event_ts", "amount", "merchant_id", "merchant_category",
            "latitude", "longitude"]


def _txn(spark, sf_dir):
    return transactions(spark, sf_dir).select(*TXN_COLS)


@register("stream_rolling_features", _features_sql(HOURLY))
def q_stream_rolling_features(spark, sf_dir):
    """Rolling features from the stateful processor on a file stream."""
    txn = _txn(spark, sf_dir)
    out = replay(txn, "us", CHUNKS,
                 lambda src: rolling_features_stateful(parquet_source(spark, src, txn.schema), HOURLY),
                 "stream-rolling")
    f = spark.read.parquet(out)
    return rounded(f.select("transaction_id", "entity_id", *HOURLY.feature_columns(), "merchant_category"))


@register("stream_sliding_agg", f"""WITH {TXN},
w AS (SELECT t.*, s AS window_start_us FROM txn t,
        unnest([(us // 1800000000) * 1800000000, (us // 1800000000) * 1800000000 - 1800000000]) AS u(s)),
mx AS (SELECT max(us) AS m FROM txn)
SELECT entity_id, window_start_us, window_start_us + 3600000000 AS window_end_us,
  CAST(count(*) AS BIGINT) AS txn_count, round(sum(amount), {ROUND}) AS amount_sum,
  round(avg(amount), {ROUND}) AS amount_mean, round(coalesce(stddev_pop(amount), 0.0), {ROUND}) AS amount_std,
  round(max(amount), {ROUND}) AS amount_max, round(min(amount), {ROUND}) AS amount_min,
  CAST(count(DISTINCT merchant_id) AS BIGINT) AS unique_merchants
FROM w, mx WHERE window_start_us + 3600000000 <= mx.m
GROUP BY entity_id, window_start_us""")
def q_stream_sliding_agg(spark, sf_dir):
    """1 h windows sliding by 30 min per entity, closed windows only."""
    txn = _txn(spark, sf_dir)
    out = replay(txn, "us", CHUNKS,
                 lambda src: sliding_aggregates(parquet_source(spark, src, txn.schema), "1 hour", "30 minutes"),
                 "stream-sliding")
    return rounded(spark.read.parquet(out))


@register("stream_dedup", f"""WITH {TXN} SELECT transaction_id, round(amount, {ROUND}) AS amount FROM txn""")
def q_stream_dedup(spark, sf_dir):
    """T4: transactions over 400 are delivered twice; the stream keeps one."""
    txn = _txn(spark, sf_dir)
    dup = txn.unionByName(txn.where(F.col("amount") > 400))
    out = replay(dup, "us", CHUNKS, lambda src: dedup(parquet_source(spark, src, txn.schema)), "stream-dedup")
    return rounded(spark.read.parquet(out).select("transaction_id", "amount"))


REJECT_CASE = """CASE WHEN event_type = 'error' THEN 'missing_keys' WHEN event_type = 'signup' THEN 'extra_keys'
  WHEN event_type = 'view' AND value > 400 THEN 'malformed_json'
  WHEN event_type = 'purchase' AND value > 450 THEN 'bad_type' END"""


def _stream_score_sql() -> str:
    geo = haversine_sql("prev_latitude", "prev_longitude", "latitude", "longitude")
    good_txn = f"""txn AS (
  SELECT CAST(event_id AS VARCHAR) AS transaction_id, CAST(user_id AS VARCHAR) AS entity_id, value AS amount,
    printf('merch_%s_%04d', cat, CAST(json_extract_string(props, '$.k') AS INTEGER)) AS merchant_id,
    cat AS merchant_category,
    25 + CAST(event_id * 7919 % 2400 AS DOUBLE) / 100 AS latitude,
    -124 + CAST(event_id * 104729 % 5600 AS DOUBLE) / 100 AS longitude,
    (epoch_us(ts) // 1000) * 1000 AS us, value > 150 AS is_fraud
  FROM (SELECT *, {CATEGORY_CASE} AS cat FROM events) e WHERE {REJECT_CASE} IS NULL)"""
    p = _prob_sql(feature_exprs(HOURLY))
    return f"""WITH {good_txn}, flog0 AS ({rolling_select(HOURLY.lengths)}),
flog AS (SELECT *, {geo} AS geo_distance_delta FROM flog0)
SELECT transaction_id, CAST(NULL AS VARCHAR) AS reason, round({p}, {ROUND}) AS fraud_probability, {_decide_sql(p)}
FROM flog
UNION ALL SELECT NULL, {REJECT_CASE}, NULL, NULL, NULL, NULL FROM events WHERE {REJECT_CASE} IS NOT NULL"""


@register("stream_score", _stream_score_sql())
def q_stream_score(spark, sf_dir):
    """T5 + S1 + S2: JSON messages -> strict decode -> rolling features ->
    scorer, in one foreachBatch with a scored and an error output. Returns
    both: every message ends in one of them."""
    import uuid
    from velocis.streaming.incremental import ScoringStream
    stream = ScoringStream(scratch_path(spark, f"streams/score-{uuid.uuid4().hex[:12]}"), demo_scorer(), HOURLY)
    replay(raw_messages(spark, sf_dir), "us", CHUNKS, lambda src: text_source(spark, src), "stream-score",
           foreach=stream, fmt="text")
    cols = ["transaction_id", "reason", "fraud_probability", "decision", "confidence", "is_fraud"]
    scored = spark.read.parquet(stream.scored_path).withColumn("reason", F.lit(None).cast("string")).select(*cols)
    errors = spark.read.parquet(stream.error_path).select("transaction_id", "reason")
    return rounded(scored.unionByName(errors, allowMissingColumns=True))


@register("src_file_stream", f"""SELECT CASE WHEN event_type = 'error' THEN 'missing_keys'
  WHEN event_type = 'signup' THEN 'extra_keys' WHEN event_type = 'view' AND value > 400 THEN 'malformed_json'
  WHEN event_type = 'purchase' AND value > 450 THEN 'bad_type' END AS reason, CAST(count(*) AS BIGINT) AS messages
FROM events GROUP BY 1""")
def q_src_file_stream(spark, sf_dir):
    """A JSON-lines file stream decoded; messages per reject reason
    (null = accepted)."""
    raw = raw_messages(spark, sf_dir)
    out = replay(raw, "us", CHUNKS, lambda src: decode_stream(text_source(spark, src)).select("reason", "raw"),
                 "stream-decode", fmt="text")
    return spark.read.parquet(out).groupBy("reason").agg(F.count(F.lit(1)).alias("messages"))


def _latest_all_sql(extra_where: str = "") -> str:
    geo = haversine_sql("prev_latitude", "prev_longitude", "latitude", "longitude")
    return f"""WITH {TXN}, flog0 AS ({rolling_select(HOURLY.lengths)}),
flog AS (SELECT *, {geo} AS geo_distance_delta FROM flog0),
latest AS (SELECT * FROM flog QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY us DESC, transaction_id DESC) = 1)
SELECT 'fs:v1:' || entity_id AS key, entity_id, transaction_id, us AS computed_at_us, {{exp}} AS expires_at_us,
  {', '.join(feature_sql(HOURLY))}
FROM latest {extra_where}"""


@register("stream_snapshot_upsert", _latest_all_sql().replace("{exp}", "us + 300000000"))
def q_stream_snapshot_upsert(spark, sf_dir):
    """S6 (stream form): feature rows upserted per micro-batch into the
    bucketed snapshot table; the table at the end."""
    txn = _txn(spark, sf_dir)
    import uuid
    table = SnapshotTable(spark, scratch_path(spark, f"snapshots/{uuid.uuid4().hex[:12]}"), HOURLY, n_buckets=8)
    replay(txn, "us", CHUNKS,
           lambda src: rolling_features_stateful(parquet_source(spark, src, txn.schema), HOURLY),
           "stream-snapshots", foreach=snapshot_sink(table))
    t = table.read()
    return rounded(t.select("key", "entity_id", "transaction_id", "computed_at_us", "expires_at_us",
                            *HOURLY.feature_columns()))


@register("snapshot_read_ttl", _latest_all_sql(
    "WHERE us + 86400000000 > (SELECT max(us) FROM txn)").replace("{exp}", "us + 86400000000"))
def q_snapshot_read_ttl(spark, sf_dir):
    """Snapshot records (TTL 1 day) read as of the newest event: expired
    records are misses; payloads decoded from JSON."""
    txn = transactions(spark, sf_dir)
    latest = latest_per_entity(rolling_features(txn, HOURLY).drop("computed_at"))
    rec = snapshot_records(latest, HOURLY, ttl_s=86400)
    as_of = txn.agg(F.max("us")).first()[0]
    got = read_snapshots(rec, as_of, HOURLY)
    return rounded(got.select("key", "entity_id", "transaction_id", "computed_at_us", "expires_at_us",
                              *HOURLY.feature_columns()))


@register("detected_vs_actual", f"""WITH {SCORED_LINEAR_SQL}
SELECT CASE WHEN p < 0.2 THEN 'APPROVE' WHEN p < 0.5 THEN 'REVIEW' ELSE 'DECLINE' END AS decision,
  p > 0.5 AS predicted_fraud, label AS actual_fraud, CAST(count(*) AS BIGINT) AS transactions
FROM sc GROUP BY ALL""")
def q_detected_vs_actual(spark, sf_dir):
    """Scored transactions joined to the ground-truth table by id."""
    from velocis.operators.monitoring import detected_vs_actual
    from velocis.operators.scoring import score
    txn = transactions(spark, sf_dir)
    truth = txn.select("transaction_id", F.col("is_fraud").alias("actual_fraud"))
    return detected_vs_actual(score(rolling_features(txn, HOURLY), demo_scorer(), HOURLY), truth)


TRUTH_DELAY_US = 300 * 1_000_000


@register("stream_detected_vs_actual", f"""WITH {SCORED_LINEAR_SQL}
SELECT transaction_id,
  CASE WHEN p < 0.2 THEN 'APPROVE' WHEN p < 0.5 THEN 'REVIEW' ELSE 'DECLINE' END AS decision,
  p > 0.5 AS predicted_fraud,
  CASE WHEN CAST(transaction_id AS BIGINT) % 3 <> 0 THEN label END AS actual_fraud
FROM sc""")
def q_stream_detected_vs_actual(spark, sf_dir):
    """J6 on two streams, outer: scored rows and a truth stream five minutes
    behind that lacks every third transaction. Matched and unmatched rows
    together are the scored rows."""
    from velocis.operators.scoring import score
    from velocis.streaming.streams import detected_vs_actual_stream, replay_together
    txn = transactions(spark, sf_dir)
    scored = score(rolling_features(txn, HOURLY), demo_scorer(), HOURLY) \
        .select("transaction_id", "decision", "is_fraud", F.timestamp_micros("us").alias("scored_ts"), "us")
    scored = spark.read.schema(scored.schema).parquet(_written(scored, "scored"))
    known = txn.where(F.col("transaction_id").cast("long") % 3 != 0)
    truth = known.select("transaction_id", F.col("is_fraud").alias("actual_fraud"),
                         (F.col("us") + TRUTH_DELAY_US).alias("us")).withColumn("truth_ts", F.timestamp_micros("us"))
    end = txn.agg((F.max("us") + 86_400_000_000).alias("us"))
    close = {"scored": end.select(F.lit("").alias("transaction_id"), F.lit("").alias("decision"),
                                  F.lit(False).alias("is_fraud"), F.timestamp_micros("us").alias("scored_ts"), "us"),
             "truth": end.select(F.lit("-").alias("transaction_id"), F.lit(False).alias("actual_fraud"), "us",
                                 F.timestamp_micros("us").alias("truth_ts"))}
    out = replay_together(
        {"scored": (scored, "us"), "truth": (truth, "us")}, CHUNKS,
        lambda src: detected_vs_actual_stream(parquet_source(spark, src["scored"], scored.schema),
                                              parquet_source(spark, src["truth"], truth.schema), how="leftOuter"),
        "stream-truth", close)
    return spark.read.parquet(out).where("transaction_id != ''").withColumnRenamed("is_fraud", "predicted_fraud")


@register("stream_serve_tiered", _tiered_sql(TIER_MAX_AGE, 4 * 3600))
def q_stream_serve_tiered(spark, sf_dir):
    """J4 on two streams: requests four hours behind their events are held
    until the watermark has passed them, then answered as in batch."""
    import uuid
    from velocis.sources.tables import requests_from_transactions
    from velocis.streaming.serving import REQUEST_COLS, ServingStream, tagged
    from velocis.streaming.streams import replay_together
    txn = _txn(spark, sf_dir)
    req = requests_from_transactions(txn, 4 * 3600).select(*REQUEST_COLS).withColumn("us", F.unix_micros("request_ts"))
    # an event a day after all others moves the watermark past the last request
    end = txn.agg((F.max("us") + DAY_US).alias("us"))
    close = {"event": txn.limit(0).unionByName(end.withColumn("entity_id", F.lit("-")), allowMissingColumns=True),
             "request": req.limit(0)}
    serving = ServingStream(scratch_path(spark, f"streams/serving-{uuid.uuid4().hex[:12]}"), HOURLY,
                            max_age_s=TIER_MAX_AGE)
    replay_together({"event": (txn, "us"), "request": (req, "us")}, CHUNKS,
                    lambda src: tagged(parquet_source(spark, src["event"], txn.schema),
                                       parquet_source(spark, src["request"], req.schema)),
                    "stream-serving", close, foreach=serving)
    out = spark.read.parquet(serving.output_path)
    return rounded(out.select("request_id", "transaction_id", "entity_id", *HOURLY.feature_columns(),
                              "merchant_category", "served_from", "snapshot_age_s"))


def _written(df, name):
    import uuid
    path = scratch_path(df.sparkSession, f"streams/{name}-{uuid.uuid4().hex[:12]}")
    df.write.parquet(path)
    return path


@register("stream_rolling_incremental", _features_sql(HOURLY))
def q_stream_rolling_incremental(spark, sf_dir):
    """T1, skew-safe form: each micro-batch runs the batch operator (with
    hot-entity slices) over the tail of earlier events plus the new rows."""
    import uuid
    from velocis.streaming.incremental import IncrementalRolling
    txn = _txn(spark, sf_dir)
    inc = IncrementalRolling(scratch_path(spark, f"streams/incremental-{uuid.uuid4().hex[:12]}"), HOURLY)
    replay(txn, "us", CHUNKS, lambda src: parquet_source(spark, src, txn.schema), "stream-incremental",
           foreach=inc)
    f = spark.read.parquet(inc.output_path)
    return rounded(f.select("transaction_id", "entity_id", *HOURLY.feature_columns(), "merchant_category"))


#: Every 50th event arrives three days late, every 7th ten hours late.
ARRIVAL = f"us + CASE WHEN event_id % 50 = 0 THEN {3 * DAY_US} WHEN event_id % 7 = 0 THEN {10 * DAY_US // 24} ELSE 0 END"


def _late_sql(columns: str) -> str:
    """Rows that arrive in a chunk are late if their frame begins before the
    oldest bucket kept: two days before the newest event of earlier chunks."""
    bucket = DAY_US // 4
    return f"""WITH {TXN},
a AS (SELECT *, {ARRIVAL} AS arrival FROM txn),
c AS (SELECT a.*, (arrival - lo) // step AS chunk FROM a,
  (SELECT min(arrival) AS lo, (max(arrival) - min(arrival)) // {CHUNKS} + 1 AS step FROM a)),
m AS (SELECT chunk, max(us) AS top FROM c GROUP BY 1),
s AS (SELECT c.*, coalesce(us - {DAY_US} <
    ((SELECT max(top) FROM m WHERE m.chunk < c.chunk) - {2 * DAY_US}) // {bucket} * {bucket}, false) AS late FROM c)
{columns}"""


def _arrivals(spark, sf_dir):
    txn = _txn(spark, sf_dir)
    event_id = F.col("transaction_id").cast("long")
    return txn.withColumn("arrival", F.col("us") + F.when(event_id % 50 == 0, F.lit(3 * DAY_US))
                          .when(event_id % 7 == 0, F.lit(10 * DAY_US // 24)).otherwise(F.lit(0)))


@register("stream_late_rows", _late_sql(f"""
SELECT transaction_id, true AS late, CAST(0 AS BIGINT) AS txn_count_86400s, 0.0::DOUBLE AS amount_sum_86400s
FROM s WHERE late
UNION ALL
SELECT x.transaction_id, false, CAST(count(y.amount) AS BIGINT), round(sum(y.amount), {ROUND})
FROM s x JOIN s y ON x.entity_id = y.entity_id AND y.us BETWEEN x.us - {DAY_US} AND x.us
  AND y.chunk <= x.chunk AND NOT y.late
WHERE NOT x.late GROUP BY x.transaction_id"""))
def q_stream_late_rows(spark, sf_dir):
    """Events out of order. Every row has features over what had arrived by
    then, but for those whose history is no longer kept, which are set apart."""
    import uuid
    from velocis.streaming.incremental import IncrementalRolling
    txn = _arrivals(spark, sf_dir)
    inc = IncrementalRolling(scratch_path(spark, f"streams/late-{uuid.uuid4().hex[:12]}"), HOURLY)
    replay(txn, "arrival", CHUNKS, lambda src: parquet_source(spark, src, txn.schema), "stream-late", foreach=inc)
    done = spark.read.parquet(inc.output_path).select(
        "transaction_id", F.lit(False).alias("late"), "txn_count_86400s", "amount_sum_86400s")
    apart = spark.read.parquet(inc.late_path).where("reason = 'late'").select(
        "transaction_id", F.lit(True).alias("late"), F.lit(0).alias("txn_count_86400s"),
        F.lit(0.0).alias("amount_sum_86400s"))
    return rounded(done.unionByName(apart))


@register("stream_late_revisions", _features_sql(HOURLY))
def q_stream_late_revisions(spark, sf_dir):
    """The same arrivals with a history of four days, so that none is late,
    and a changelog: its current rows are the batch features of all events."""
    import uuid
    from velocis.streaming.incremental import IncrementalRolling, current_rows
    txn = _arrivals(spark, sf_dir)
    inc = IncrementalRolling(scratch_path(spark, f"streams/revised-{uuid.uuid4().hex[:12]}"), HOURLY,
                             lateness_s=4 * 86400, revisions=True)
    replay(txn, "arrival", CHUNKS, lambda src: parquet_source(spark, src, txn.schema), "stream-revised", foreach=inc)
    f = current_rows(spark.read.parquet(inc.changelog_path))
    return rounded(f.select("transaction_id", "entity_id", *HOURLY.feature_columns(), "merchant_category"))
