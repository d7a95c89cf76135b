"""Queries for scoring and monitoring."""

from __future__ import annotations

from pyspark.sql import functions as F

from velocis.operators.monitoring import (
    batch_summary, cumulative_histogram, decision_counts, engine_totals, fraud_rate, histogram_quantile,
    latency_report, rate_per_window, throughput_report,
)
from velocis.operators.rolling import rolling_features
from velocis.operators.scoring import LinearScorer, batch_score, score
from velocis.plans.catalog import ROUND, feature_exprs, register, rounded
from velocis.plans.oracle import TXN, haversine_sql, rolling_select
from velocis.plans.serving_queries import TIER_MAX_AGE, _tiered_sql
from velocis.schemas import FEATURE_LATENCY_BUCKETS, HOURLY, INFERENCE_LATENCY_BUCKETS, SCORE_BUCKETS
from velocis.sources.tables import read_table, requests_from_transactions, transactions

# Coefficients of the fixed demonstration scorer (our own values, not a
# trained model): large amounts, high z-scores and bursts raise the score.
DEMO_INTERCEPT = -7.0
DEMO_COEFFICIENTS = {
    "current_amount": 0.03,
    "amount_zscore": 0.4,
    "velocity_change_ratio": 0.05,
    "txn_count_86400s": 0.1,
    "unique_merchants_86400s": 0.05,
    "geo_distance_delta": 0.0002,
}


def demo_scorer() -> LinearScorer:
    return LinearScorer(DEMO_COEFFICIENTS, DEMO_INTERCEPT, version="demo-linear-1")


def _margin_sql(exprs: dict[str, str]) -> str:
    terms = [f"{DEMO_INTERCEPT!r}"]
    for c, w in DEMO_COEFFICIENTS.items():
        terms.append(f"{w!r} * CAST(CAST({exprs[c]} AS FLOAT) AS DOUBLE)")
    return " + ".join(terms)


def _prob_sql(exprs: dict[str, str]) -> str:
    return f"(1.0 / (1.0 + exp(-({_margin_sql(exprs)}))))"


def _decide_sql(p: str) -> str:
    return (f"CASE WHEN {p} < 0.2 THEN 'APPROVE' WHEN {p} < 0.5 THEN 'REVIEW' ELSE 'DECLINE' END AS decision, "
            f"round(CASE WHEN {p} < 0.2 THEN 1.0 - {p} WHEN {p} < 0.5 THEN 0.5 ELSE {p} END, {ROUND}) AS confidence, "
            f"{p} > 0.5 AS is_fraud")


def _flog_sql() -> str:
    geo = haversine_sql("prev_latitude", "prev_longitude", "latitude", "longitude")
    return f"""{TXN}, flog0 AS ({rolling_select(HOURLY.lengths)}),
flog AS (SELECT *, {geo} AS geo_distance_delta FROM flog0)"""


SCORED_LINEAR_SQL = f"""{_flog_sql()},
sc AS (SELECT transaction_id, entity_id, us, is_fraud AS label, {_prob_sql(feature_exprs(HOURLY))} AS p FROM flog)"""


@register("score_linear", f"""WITH {SCORED_LINEAR_SQL}
SELECT transaction_id, round(p, {ROUND}) AS fraud_probability, {_decide_sql('p')},
  'demo-linear-1' AS model_version
FROM sc""")
def q_score_linear(spark, sf_dir):
    """M10 (fixed coefficients): score every transaction's own features."""
    f = rolling_features(transactions(spark, sf_dir), HOURLY)
    s = score(f, demo_scorer(), HOURLY)
    return rounded(s.select("transaction_id", "fraud_probability", "decision", "confidence", "is_fraud",
                            "model_version"))


def _batch_scored(spark, sf_dir):
    txn = transactions(spark, sf_dir)
    req = requests_from_transactions(txn, 4 * 3600)
    return batch_score(req, txn, None, demo_scorer(), HOURLY, max_age_s=TIER_MAX_AGE)


def _batch_sql() -> str:
    tiered = _tiered_sql(TIER_MAX_AGE, 4 * 3600)
    # keep the tiered CTEs (up to ``u``: unrounded features) and score on top
    head = tiered.rsplit("\nSELECT request_id, transaction_id, entity_id, ", 1)[0]
    exprs = {c: ("amount" if c == "current_amount" else c) for c in HOURLY.feature_columns()}
    return f"""{head},
bs AS (SELECT u.*, CASE WHEN hit THEN 'snapshot' ELSE 'live' END AS served_from, {_prob_sql(exprs)} AS p,
  'b' || CAST(CAST(floor(CAST(transaction_id AS BIGINT) / 100) AS BIGINT) AS VARCHAR) AS batch_id FROM u)"""


@register("batch_score", f"""{_batch_sql()}
SELECT request_id, transaction_id, served_from, round(p, {ROUND}) AS fraud_probability, {_decide_sql('p')}
FROM bs""")
def q_batch_score(spark, sf_dir):
    """Requests -> tiered features -> scorer -> decision band."""
    s = _batch_scored(spark, sf_dir)
    return rounded(s.select("request_id", "transaction_id", "served_from", "fraud_probability", "decision",
                            "confidence", "is_fraud"))


@register("decision_counts", f"""{_batch_sql()}
SELECT CASE WHEN p < 0.2 THEN 'APPROVE' WHEN p < 0.5 THEN 'REVIEW' ELSE 'DECLINE' END AS decision,
  CAST(count(*) AS BIGINT) AS requests
FROM bs GROUP BY 1""")
def q_decision_counts(spark, sf_dir):
    """Scored requests per decision."""
    return decision_counts(_batch_scored(spark, sf_dir))


@register("batch_summary", f"""{_batch_sql()}
SELECT batch_id, CAST(count(*) AS BIGINT) AS total, CAST(count(p) AS BIGINT) AS succeeded,
  CAST(count(*) - count(p) AS BIGINT) AS failed, CAST(NULL AS BIGINT) AS total_latency_us
FROM bs GROUP BY 1""")
def q_batch_summary(spark, sf_dir):
    """Per batch message: total, succeeded, failed, latency."""
    return batch_summary(_batch_scored(spark, sf_dir))


def _hist_sql(src: str, col: str, bounds) -> str:
    parts = []
    for b in bounds:
        parts.append(f"SELECT '{float(b)!r}' AS le, CAST({float(b)!r} AS DOUBLE) AS le_value, "
                     f"CAST(sum(CASE WHEN {col} <= {float(b)!r} THEN 1 ELSE 0 END) AS BIGINT) AS bucket_count, "
                     f"round(sum({col}), {ROUND}) AS sum, CAST(count({col}) AS BIGINT) AS count FROM {src}")
    parts.append(f"SELECT '+Inf', CAST('inf' AS DOUBLE), CAST(count({col}) AS BIGINT), round(sum({col}), {ROUND}), "
                 f"CAST(count({col}) AS BIGINT) FROM {src}")
    return " UNION ALL ".join(parts)


@register("score_histogram", f"""WITH {SCORED_LINEAR_SQL}
{_hist_sql('sc', 'p', SCORE_BUCKETS)}""")
def q_score_histogram(spark, sf_dir):
    """A10: cumulative score histogram with +Inf, sum and count."""
    f = rolling_features(transactions(spark, sf_dir), HOURLY)
    s = demo_scorer().transform(f)
    return rounded(cumulative_histogram(s, "fraud_probability", SCORE_BUCKETS))


def _quantile_sql(q: float) -> str:
    return f"""WITH {SCORED_LINEAR_SQL}, h AS ({_hist_sql('sc', 'p', SCORE_BUCKETS)}),
h2 AS (SELECT *, coalesce(lag(le_value) OVER (ORDER BY le_value), 0.0) AS prev_le,
         coalesce(lag(bucket_count) OVER (ORDER BY le_value), 0) AS prev_cnt,
         max(bucket_count) OVER () * {q!r} AS rnk FROM h),
b AS (SELECT * FROM h2 WHERE bucket_count >= rnk ORDER BY le_value LIMIT 1)
SELECT round(CASE WHEN le_value = CAST('inf' AS DOUBLE) THEN prev_le
  ELSE prev_le + (le_value - prev_le) * CASE WHEN bucket_count - prev_cnt > 0
    THEN (rnk - prev_cnt) / (bucket_count - prev_cnt) ELSE 1.0 END END, {ROUND}) AS quantile
FROM b"""


@register("histogram_quantile", _quantile_sql(0.99))
def q_histogram_quantile(spark, sf_dir):
    """0.99 quantile of the score from its histogram buckets."""
    f = rolling_features(transactions(spark, sf_dir), HOURLY)
    h = cumulative_histogram(demo_scorer().transform(f), "fraud_probability", SCORE_BUCKETS)
    return rounded(histogram_quantile(h, 0.99))


@register("rate_per_minute", f"""WITH {SCORED_LINEAR_SQL}
SELECT epoch_us(time_bucket(INTERVAL 1 MINUTE, make_timestamp(us))) AS window_start_us,
  CASE WHEN p < 0.2 THEN 'APPROVE' WHEN p < 0.5 THEN 'REVIEW' ELSE 'DECLINE' END AS decision,
  CAST(count(*) AS BIGINT) AS n, round(count(*) / 60.0, {ROUND}) AS rate_per_s
FROM sc GROUP BY ALL""")
def q_rate_per_minute(spark, sf_dir):
    """Decisions per minute and per-second rate."""
    f = rolling_features(transactions(spark, sf_dir), HOURLY)
    s = score(f, demo_scorer(), HOURLY)
    return rounded(rate_per_window(s, "computed_at", "1 minute", ("decision",)))


@register("fraud_rate", f"""WITH {SCORED_LINEAR_SQL}
SELECT epoch_us(time_bucket(INTERVAL 1 HOUR, make_timestamp(us))) AS window_start_us, CAST(count(*) AS BIGINT) AS n,
  CAST(sum(CASE WHEN p >= 0.5 THEN 1 ELSE 0 END) AS BIGINT) AS declined,
  round(sum(CASE WHEN p >= 0.5 THEN 1 ELSE 0 END) * 100.0 / count(*), {ROUND}) AS fraud_rate_pct
FROM sc GROUP BY 1""")
def q_fraud_rate(spark, sf_dir):
    """DECLINE share in percent per hour."""
    f = rolling_features(transactions(spark, sf_dir), HOURLY)
    s = score(f, demo_scorer(), HOURLY)
    return rounded(fraud_rate(s, "computed_at", "1 hour"))


@register("latency_report", f"""WITH r AS (
  SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i,
    count(*) OVER (PARTITION BY event_type) AS n FROM events)
SELECT event_type, CAST(max(n) AS BIGINT) AS n,
  {', '.join(f"round(max(CASE WHEN i = least(CAST(floor(n * {p} / 100.0) AS BIGINT), n - 1) THEN value END), {ROUND}) AS p{p}"
             for p in (50, 90, 95, 99))},
  round(avg(value), {ROUND}) AS mean, round(max(value), {ROUND}) AS max
FROM r GROUP BY 1""")
def q_latency_report(spark, sf_dir):
    """Nearest-rank report (n, p50/p90/p95/p99, mean, max) of event
    values per event type, standing in for request latencies."""
    e = read_table(spark, sf_dir, "events")
    return rounded(latency_report(e, "value", ["event_type"]))


@register("throughput_report", f"""WITH {TXN}
SELECT merchant_category, CAST(count(*) AS BIGINT) AS n, round((max(us) - min(us)) / 1e6, {ROUND}) AS elapsed_s,
  round(CASE WHEN max(us) > min(us) THEN count(*) / ((max(us) - min(us)) / 1e6) END, {ROUND}) AS rows_per_s,
  round((max(us) - min(us)) / 1e6 * 1000.0 / count(*), {ROUND}) AS avg_ms
FROM txn GROUP BY 1""")
def q_throughput_report(spark, sf_dir):
    """Events, elapsed time, events/s and mean ms per category."""
    t = transactions(spark, sf_dir)
    return rounded(throughput_report(t, "us", ["merchant_category"]))


@register("throughput_windows", f"""WITH {TXN}
SELECT (us // 86400000000) * 86400000000 AS window_start_us, CAST(count(*) AS BIGINT) AS n,
  round((max(us) - min(us)) / 1e6, {ROUND}) AS elapsed_s,
  round(CASE WHEN max(us) > min(us) THEN count(*) / ((max(us) - min(us)) / 1e6) END, {ROUND}) AS rows_per_s,
  round((max(us) - min(us)) / 1e6 * 1000.0 / count(*), {ROUND}) AS avg_ms
FROM txn GROUP BY 1""")
def q_throughput_windows(spark, sf_dir):
    """A15 per fixed window (one day)."""
    t = transactions(spark, sf_dir)
    return rounded(throughput_report(t, "us", [], window_s=86400))


@register("engine_totals", f"""WITH {TXN}
SELECT CAST(count(DISTINCT entity_id) AS BIGINT) AS tracked_entities, CAST(count(*) AS BIGINT) AS total_events_ingested,
  CAST(count(*) AS BIGINT) AS total_features_computed, CAST(count(*) AS BIGINT) AS requests_served,
  count(*) > 0 AS ready
FROM txn""")
def q_engine_totals(spark, sf_dir):
    """Entities, events, feature rows and requests served."""
    txn = transactions(spark, sf_dir)
    flog = rolling_features(txn, HOURLY)
    served = requests_from_transactions(txn)
    return engine_totals(txn, flog, served)


def _latency_events(spark, sf_dir, unit: float):
    """``events.value`` as a latency in seconds (``unit`` values a second)."""
    return read_table(spark, sf_dir, "events").select((F.col("value") / F.lit(unit)).alias("seconds"), "event_type",
                                                      "event_id")


for _name, _bounds, _unit in (("latency_histogram", INFERENCE_LATENCY_BUCKETS, 1000.0),
                              ("feature_latency_histogram", FEATURE_LATENCY_BUCKETS, 50000.0)):
    def _latency_query(spark, sf_dir, bounds=_bounds, unit=_unit):
        """A10: cumulative latency histogram with +Inf, sum and count."""
        return rounded(cumulative_histogram(_latency_events(spark, sf_dir, unit), "seconds", bounds))

    register(_name, f"WITH lat AS (SELECT value / {_unit!r} AS seconds FROM events) "
                    f"{_hist_sql('lat', 'seconds', _bounds)}")(_latency_query)


@register("rate_per_window_total", f"""WITH {SCORED_LINEAR_SQL},
d AS (SELECT (us // 60000000) * 60000000 AS window_start_us,
  CASE WHEN p < 0.2 THEN 'APPROVE' WHEN p < 0.5 THEN 'REVIEW' ELSE 'DECLINE' END AS decision FROM sc)
SELECT window_start_us, decision, CAST(count(*) AS BIGINT) AS n, round(count(*) / 60.0, {ROUND}) AS rate_per_s
FROM d GROUP BY 1, 2
UNION ALL SELECT window_start_us, 'all', CAST(count(*) AS BIGINT), round(count(*) / 60.0, {ROUND}) FROM d GROUP BY 1""")
def q_rate_per_window_total(spark, sf_dir):
    """Scored rows per minute, by decision and in total."""
    s = score(rolling_features(transactions(spark, sf_dir), HOURLY), demo_scorer(), HOURLY)
    return rounded(rate_per_window(s, "computed_at", "1 minute", ("decision",), total="all"))


@register("batch_summary_failures", """SELECT 'b' || CAST(event_id // 100 AS VARCHAR) AS batch_id,
  CAST(count(*) AS BIGINT) AS total, CAST(sum(CASE WHEN event_type = 'error' THEN 0 ELSE 1 END) AS BIGINT) AS succeeded,
  CAST(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS BIGINT) AS failed,
  CAST(sum(CASE WHEN event_type <> 'error' THEN CAST(round(value * 1000) AS BIGINT) END) AS BIGINT) AS total_latency_us
FROM events GROUP BY 1""")
def q_batch_summary_failures(spark, sf_dir):
    """A16 with failures and latency: error events are failed requests,
    ``value`` the milliseconds the others took."""
    e = read_table(spark, sf_dir, "events")
    failed = F.col("event_type") == "error"
    return batch_summary(e.select(
        F.concat(F.lit("b"), F.floor(F.col("event_id") / 100).cast("string")).alias("batch_id"),
        F.when(failed, F.lit("scoring failed")).alias("error"),
        F.when(~failed, F.round(F.col("value") * 1000).cast("long")).alias("inference_latency_us")))
