"""Queries for the serving operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from velocis.operators.rolling import latest_per_entity, rolling_features
from velocis.operators.serving import (
    asof_join, cold_entities, point_in_time_features, project_features, serve_from_snapshot,
    serve_tiered,
)
from velocis.plans.catalog import ROUND, feature_sql, register, rounded
from velocis.plans.oracle import TXN, haversine_sql, rolling_select
from velocis.schemas import DEFAULT, HOURLY, WindowSet
from velocis.sources.tables import requests_from_transactions, transactions

DELAY_S = 600
# State of the snapshot table that J1 serves from, a parameter of the query:
# early enough that some entities have no snapshot yet.
AS_OF = "2024-01-02 00:00:00"
AS_OF_US = 1704153600000000
END_OF_TIME_US = 9_000_000_000_000_000


def requests_sql(delay_s: float = DELAY_S) -> str:
    d = int(delay_s * 1_000_000)
    return f"""req AS (
  SELECT 'req-' || transaction_id AS request_id, transaction_id, entity_id, amount, latitude, longitude,
    merchant_category, us + {d} AS us
  FROM txn)"""


def live_sql(windows: WindowSet, delay_s: float = DELAY_S) -> str:
    """Independent oracle for J2: requests range-joined to earlier events."""
    s, m, lg = windows.lengths
    aggs = []
    for w in windows.lengths:
        cond = f"FILTER (WHERE e.us >= r.us - {w * 1_000_000})"
        stats = ["sum", "mean", "std", "count"] + (["max", "min"] if w == lg else ["max"] if w == m else [])
        fn = {"sum": "sum(e.amount)", "mean": "avg(e.amount)", "std": "stddev_pop(e.amount)",
              "count": "count(e.amount)", "max": "max(e.amount)", "min": "min(e.amount)"}
        for st in stats:
            name = f"txn_count_{w}s" if st == "count" else f"amount_{st}_{w}s"
            aggs.append(f"{fn[st]} {cond} AS {name}")
        if w == lg:
            aggs.append(f"count(DISTINCT e.merchant_id) {cond} AS unique_merchants_{w}s")
    aggs.append("arg_max(e.latitude, (e.us, e.transaction_id)) FILTER (WHERE e.transaction_id <> r.transaction_id)"
                " AS prev_latitude")
    aggs.append("arg_max(e.longitude, (e.us, e.transaction_id)) FILTER (WHERE e.transaction_id <> r.transaction_id)"
                " AS prev_longitude")
    geo = haversine_sql("prev_latitude", "prev_longitude", "latitude", "longitude")
    return f"""{requests_sql(delay_s)},
lv0 AS (
  SELECT r.request_id, r.transaction_id, r.entity_id, r.amount, r.latitude, r.longitude, r.merchant_category,
    r.us, {', '.join(aggs)}
  FROM req r LEFT JOIN txn e ON e.entity_id = r.entity_id AND e.us <= r.us
  GROUP BY ALL),
live AS (SELECT *, coalesce({geo}, 0.0) AS geo_distance_delta FROM lv0)"""


def _live_query(windows: WindowSet, delay_s: float):
    def q(spark, sf_dir):
        txn = transactions(spark, sf_dir)
        req = requests_from_transactions(txn, delay_s)
        f = point_in_time_features(txn, req, windows)
        return rounded(f.select("request_id", "transaction_id", "entity_id", *windows.feature_columns(),
                                "merchant_category"))
    return q


def _live_oracle(windows: WindowSet, delay_s: float) -> str:
    return f"""WITH {TXN}, {live_sql(windows, delay_s)}
SELECT request_id, transaction_id, entity_id, {', '.join(feature_sql(windows))}, merchant_category
FROM live"""


register("serve_live", _live_oracle(HOURLY, DELAY_S))(_live_query(HOURLY, DELAY_S))
register("serve_live_default", _live_oracle(DEFAULT, DELAY_S))(_live_query(DEFAULT, DELAY_S))
# The reference scores a transaction 2 s after it was sent
register("serve_delayed", _live_oracle(DEFAULT, 2))(_live_query(DEFAULT, 2))

SNAP_COLS = ["amount_sum_86400s", "txn_count_86400s", "amount_std_86400s", "unique_merchants_86400s"]


def _feature_log_sql() -> str:
    geo = haversine_sql("prev_latitude", "prev_longitude", "latitude", "longitude")
    return f"""flog0 AS ({rolling_select(HOURLY.lengths)}),
flog AS (SELECT *, {geo} AS geo_distance_delta FROM flog0)"""


@register("asof_snapshot", f"""WITH {TXN}, {_feature_log_sql()}, {requests_sql()}
SELECT r.request_id, r.entity_id,
  CASE WHEN r.us - s.us <= 3600000000 THEN s.transaction_id END AS s_transaction_id,
  CASE WHEN r.us - s.us <= 3600000000 THEN s.us END AS s_asof_us,
  CASE WHEN r.us - s.us <= 3600000000 THEN round(s.amount_sum_86400s, {ROUND}) END AS s_amount_sum_86400s,
  CASE WHEN r.us - s.us <= 3600000000 THEN CAST(s.txn_count_86400s AS BIGINT) END AS s_txn_count_86400s
FROM req r ASOF LEFT JOIN flog s ON r.entity_id = s.entity_id AND r.us >= s.us""")
def q_asof_snapshot(spark, sf_dir):
    """Newest feature snapshot at or before each request, at most 1 h old."""
    txn = transactions(spark, sf_dir)
    req = requests_from_transactions(txn).withColumn("_rus", F.unix_micros("request_ts"))
    flog = rolling_features(txn, HOURLY)
    j = asof_join(req, flog, "entity_id", "_rus", "us",
                  ["transaction_id", "amount_sum_86400s", "txn_count_86400s"],
                  max_age_us=3600 * 1_000_000, prefix="s_")
    return rounded(j.select("request_id", "entity_id", "s_transaction_id", "s_asof_us",
                            "s_amount_sum_86400s", "s_txn_count_86400s"))


def _latest_snapshot_sql(cutoff_us: int) -> str:
    return f"""latest AS (
  SELECT * FROM flog WHERE us < {cutoff_us}
  QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY us DESC, transaction_id DESC) = 1)"""


def _latest_snapshot(spark, sf_dir, as_of=None):
    # the snapshot table as of an instant only needs events before it: the
    # bound goes to the parquet scan instead of filtering the feature log
    txn = transactions(spark, sf_dir, until=as_of) if as_of else transactions(spark, sf_dir)
    return latest_per_entity(rolling_features(txn, HOURLY))


@register("latest_snapshot", f"""WITH {TXN}, {_feature_log_sql()}, {_latest_snapshot_sql(END_OF_TIME_US)}
SELECT 'fs:v1:' || entity_id AS key, entity_id, transaction_id, us AS computed_at_us,
  (us + 300000000) AS expires_at_us, {', '.join(feature_sql(HOURLY))}
FROM latest""")
def q_latest_snapshot(spark, sf_dir):
    """S6 (batch form): newest snapshot per entity with key and expiry."""
    latest = _latest_snapshot(spark, sf_dir)
    from velocis.sources.sinks import snapshot_records
    rec = snapshot_records(latest, HOURLY, ttl_s=300)
    return rounded(rec.select("key", "entity_id", "transaction_id", "computed_at_us", "expires_at_us",
                              *HOURLY.feature_columns()))


@register("serve_snapshot", f"""WITH {TXN}, {_feature_log_sql()}, {_latest_snapshot_sql(AS_OF_US)},
{requests_sql()}
SELECT r.request_id, r.transaction_id, r.entity_id,
  {', '.join(c for c in feature_sql(HOURLY, amount='r.amount', src_alias='l')
             if not c.endswith(' AS amount_zscore') and not c.endswith(' AS velocity_change_ratio'))},
  round(coalesce(l.amount_zscore_s, 0.0), {ROUND}) AS amount_zscore,
  round(coalesce(l.velocity_s, 0.0), {ROUND}) AS velocity_change_ratio,
  r.merchant_category, l.entity_id IS NOT NULL AS snapshot_found
FROM req r LEFT JOIN (
  SELECT *,
    CASE WHEN amount_std_86400s >= 1e-9 THEN (amount - amount_mean_86400s) / amount_std_86400s ELSE 0.0 END
      AS amount_zscore_s,
    CAST(txn_count_3600s AS DOUBLE) / CAST(greatest(txn_count_86400s, 1) AS DOUBLE) * 60.0 AS velocity_s
  FROM latest) l ON r.entity_id = l.entity_id""")
def q_serve_snapshot(spark, sf_dir, as_of=AS_OF):
    """J1 + P5: requests served from the snapshot table as of ``as_of``;
    entities without a snapshot get zeros."""
    req = requests_from_transactions(transactions(spark, sf_dir))
    out = serve_from_snapshot(req, _latest_snapshot(spark, sf_dir, as_of), HOURLY)
    return rounded(out.select("request_id", "transaction_id", "entity_id", *HOURLY.feature_columns(),
                              "merchant_category", "snapshot_found"))


def _tiered_sql(max_age_s: int, delay_s: float) -> str:
    fcols = [c for c in HOURLY.feature_columns() if c != "current_amount"]
    age = max_age_s * 1_000_000
    sel = []
    for c in fcols:
        sel.append(f"CASE WHEN hit THEN s_{c} ELSE l_{c} END AS {c}")
    return f"""WITH {TXN}, {_feature_log_sql()}, {live_sql(HOURLY, delay_s)},
snapf AS (SELECT * FROM flog),
snap AS (
  SELECT r.request_id, r.us AS rus, s.us AS sus, r.us - s.us <= {age} AS hit,
    {', '.join(f's.{c} AS s_{c}' for c in fcols if c not in ('amount_zscore', 'velocity_change_ratio'))},
    CASE WHEN s.amount_std_86400s >= 1e-9 THEN (s.amount - s.amount_mean_86400s) / s.amount_std_86400s
         ELSE 0.0 END AS s_amount_zscore,
    CAST(s.txn_count_3600s AS DOUBLE) / CAST(greatest(s.txn_count_86400s, 1) AS DOUBLE) * 60.0
      AS s_velocity_change_ratio
  FROM req r ASOF LEFT JOIN snapf s ON r.entity_id = s.entity_id AND r.us >= s.us),
lv AS (
  SELECT request_id, transaction_id, entity_id, amount, merchant_category,
    {', '.join(f'l.{c} AS l_{c}' for c in fcols if c not in ('amount_zscore', 'velocity_change_ratio'))},
    CASE WHEN amount_std_86400s >= 1e-9 THEN (amount - amount_mean_86400s) / amount_std_86400s ELSE 0.0 END
      AS l_amount_zscore,
    CAST(coalesce(txn_count_3600s, 0) AS DOUBLE) / CAST(greatest(coalesce(txn_count_86400s, 0), 1) AS DOUBLE) * 60.0
      AS l_velocity_change_ratio
  FROM live l),
t AS (SELECT lv.request_id, lv.transaction_id, lv.entity_id, lv.amount, lv.merchant_category,
        coalesce(snap.hit, false) AS hit, snap.rus, snap.sus, {', '.join(f's_{c}, l_{c}' for c in fcols)}
      FROM lv JOIN snap USING (request_id)),
u AS (SELECT request_id, transaction_id, entity_id, amount, merchant_category, hit, rus, sus,
        {', '.join(sel)} FROM t)
SELECT request_id, transaction_id, entity_id, {', '.join(feature_sql(HOURLY, as_columns=True))}, merchant_category,
  CASE WHEN hit THEN 'snapshot' ELSE 'live' END AS served_from,
  round(CASE WHEN hit THEN (rus - sus) / 1e6 END, {ROUND}) AS snapshot_age_s
FROM u"""


TIER_MAX_AGE = 3 * 3600


def _tiered(spark, sf_dir):
    txn = transactions(spark, sf_dir)
    req = requests_from_transactions(txn, 4 * 3600)
    return serve_tiered(txn, None, req, HOURLY, max_age_s=TIER_MAX_AGE)


@register("serve_tiered", _tiered_sql(TIER_MAX_AGE, 4 * 3600))
def q_serve_tiered(spark, sf_dir):
    """Snapshot at most 3 h old, else live (requests 4 h after each event)."""
    out = _tiered(spark, sf_dir)
    return rounded(out.select("request_id", "transaction_id", "entity_id", *HOURLY.feature_columns(),
                              "merchant_category", "served_from", "snapshot_age_s"))


@register("serving_coverage", f"""WITH {TXN}, {requests_sql(4 * 3600)},
snap AS (SELECT r.request_id, r.us - s.us <= {TIER_MAX_AGE * 1_000_000} AS hit
         FROM req r ASOF LEFT JOIN txn s ON r.entity_id = s.entity_id AND r.us >= s.us)
SELECT CAST(count(*) AS BIGINT) AS requests,
  CAST(sum(CASE WHEN hit THEN 1 ELSE 0 END) AS BIGINT) AS snapshot_hits,
  round(avg(CASE WHEN hit THEN 1.0 ELSE 0.0 END), 4) AS coverage
FROM snap""")
def q_serving_coverage(spark, sf_dir):
    """Share of requests answered from a snapshot."""
    out = _tiered(spark, sf_dir)
    from velocis.operators.monitoring import serving_coverage
    return serving_coverage(out)


# Cold-start cutoff for J5: noon of the first day, when many users have no history yet.
COLD_CUTOFF = "2024-01-01 12:00:00"
COLD_CUTOFF_US = 1704110400000000


@register("cold_entities", f"""WITH {TXN}
SELECT CAST(e.user_id AS VARCHAR) AS entity_id, CAST(count(*) AS BIGINT) AS requests
FROM (SELECT * FROM events WHERE ts >= TIMESTAMP '{COLD_CUTOFF}') e
WHERE CAST(e.user_id AS VARCHAR) NOT IN (SELECT entity_id FROM txn WHERE us < {COLD_CUTOFF_US})
GROUP BY 1""")
def q_cold_entities(spark, sf_dir):
    """Requests after the cutoff from entities with no history before it."""
    before = transactions(spark, sf_dir, until=COLD_CUTOFF)
    after = requests_from_transactions(transactions(spark, sf_dir, since=COLD_CUTOFF), 0)
    cold = cold_entities(after, before)
    return cold.groupBy("entity_id").agg(F.count(F.lit(1)).alias("requests"))


@register("feature_projection", f"""WITH {TXN}, {_feature_log_sql()}
SELECT entity_id, transaction_id, CAST(txn_count_86400s AS BIGINT) AS txn_count_86400s,
  round(amount_max_86400s, {ROUND}) AS amount_max_86400s
FROM flog""")
def q_feature_projection(spark, sf_dir):
    """Chosen fields + entity_id; unknown names ignored."""
    flog = rolling_features(transactions(spark, sf_dir), HOURLY)
    p = project_features(flog, ["transaction_id", "txn_count_86400s", "amount_max_86400s", "no_such_field"])
    return rounded(p)
