"""Queries for the rolling-window operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from velocis.operators.rolling import latest_per_entity, rolling_features, rolling_features_since
from velocis.plans.catalog import ROUND, feature_sql, register, rounded
from velocis.plans.oracle import TXN, haversine_sql, rolling_select
from velocis.schemas import DEFAULT, HOURLY
from velocis.sources.tables import transactions

H = HOURLY.lengths


def _features_sql(windows, max_events=None, txn=TXN) -> str:
    geo = haversine_sql("prev_latitude", "prev_longitude", "latitude", "longitude")
    return f"""WITH {txn},
f AS ({rolling_select(windows.lengths, max_events=max_events)}),
g AS (SELECT *, {geo} AS geo_distance_delta FROM f)
SELECT transaction_id, entity_id, {', '.join(feature_sql(windows))}, merchant_category
FROM g"""


def _features(spark, sf_dir, windows, **kw):
    f = rolling_features(transactions(spark, sf_dir), windows, **kw)
    return rounded(f.select("transaction_id", "entity_id", *windows.feature_columns(),
                            "merchant_category"))


@register("rolling_features", _features_sql(HOURLY))
def q_rolling_features(spark, sf_dir):
    """W1 flagship: the 20 model features per transaction, 1 h / 6 h / 24 h."""
    return _features(spark, sf_dir, HOURLY)


@register("rolling_features_default", _features_sql(DEFAULT))
def q_rolling_features_default(spark, sf_dir):
    """W1 with the reference's default 1 s / 5 s / 60 s windows."""
    return _features(spark, sf_dir, DEFAULT)


ONE_ENTITY = TXN.replace("CAST(user_id AS VARCHAR) AS entity_id", "'all' AS entity_id")


# Means of cents over 2^k rows often end exactly on a rounding tie, and the two
# engines add in different orders: both sides move the means off the tie.
OFF_TIE = 1e-9


def _off_tie_sql(sql: str) -> str:
    for w in H:
        mean = f"CAST(coalesce(amount_mean_{w}s, 0.0) AS DOUBLE)"
        sql = sql.replace(f"round({mean}, {ROUND})", f"round({mean} + {OFF_TIE!r}, {ROUND})")
    return sql


@register("rolling_features_hot", _off_tie_sql(_features_sql(HOURLY, txn=ONE_ENTITY)))
def q_rolling_features_hot(spark, sf_dir):
    """W1 with every event on one entity: long frames, slices of a day."""
    # not a literal: a constant join key is folded away and trips the planner's column pruning
    one = transactions(spark, sf_dir).withColumn("entity_id", F.when(F.col("entity_id").isNotNull(), F.lit("all")))
    f = rolling_features(one, HOURLY, hot_rows=1000)
    f = f.withColumns({f"amount_mean_{w}s": F.col(f"amount_mean_{w}s") + F.lit(OFF_TIE) for w in H})
    return rounded(f.select("transaction_id", "entity_id", *HOURLY.feature_columns(), "merchant_category"))


# Every event on one entity and inside one long window: 30 days pressed into 18 hours.
PRESSED = ONE_ENTITY.replace("epoch_us(ts) AS us", "epoch_us(ts) // 40 AS us")


def _pressed(spark, sf_dir):
    t = transactions(spark, sf_dir)
    return t.withColumns({"entity_id": F.when(F.col("entity_id").isNotNull(), F.lit("all")),
                          "us": F.floor(F.col("us") / 40).cast("long")})


@register("rolling_features_dense", _off_tie_sql(_features_sql(HOURLY, txn=PRESSED)))
def q_rolling_features_dense(spark, sf_dir):
    """W1 with every event of one entity inside one window: time cells narrower than the windows."""
    f = rolling_features(_pressed(spark, sf_dir), HOURLY, hot_rows=200)
    f = f.withColumns({f"amount_mean_{w}s": F.col(f"amount_mean_{w}s") + F.lit(OFF_TIE) for w in H})
    return rounded(f.select("transaction_id", "entity_id", *HOURLY.feature_columns(), "merchant_category"))


def _one_stat_sql(exprs: list[str]) -> str:
    return f"""WITH {TXN}
SELECT transaction_id, entity_id, {', '.join(exprs)} FROM txn"""


def _frame(w: int) -> str:
    return (f"OVER (PARTITION BY entity_id ORDER BY us RANGE BETWEEN {w * 1_000_000} PRECEDING "
            f"AND CURRENT ROW)")


def _stat_query(stats: list[str]):
    def q(spark, sf_dir):
        f = rolling_features(transactions(spark, sf_dir), HOURLY, stats="all")
        cols = [f"{'txn_count' if s == 'count' else 'amount_' + s}_{w}s" for s in stats for w in H]
        return rounded(f.select("transaction_id", "entity_id", *cols))
    return q


def _stat_sql(stats: list[str]) -> str:
    fn = {"sum": "sum(amount)", "mean": "avg(amount)", "std": "stddev_pop(amount)",
          "count": "count(amount)", "max": "max(amount)", "min": "min(amount)"}
    exprs = []
    for s in stats:
        for w in H:
            name = f"{'txn_count' if s == 'count' else 'amount_' + s}_{w}s"
            if s == "count":
                exprs.append(f"CAST({fn[s]} {_frame(w)} AS BIGINT) AS {name}")
            else:
                exprs.append(f"round(CAST(coalesce({fn[s]} {_frame(w)}, 0.0) AS DOUBLE), {ROUND}) AS {name}")
    return _one_stat_sql(exprs)


for _name, _stats in [("roll_count", ["count"]), ("roll_sum", ["sum"]), ("roll_mean", ["mean"]),
                      ("roll_std", ["std"]), ("roll_min_max", ["min", "max"])]:
    register(_name, _stat_sql(_stats))(_stat_query(_stats))


@register("roll_unique_merchants", _one_stat_sql(
    [f"CAST(count(DISTINCT merchant_id) {_frame(w)} AS BIGINT) AS unique_merchants_{w}s" for w in H]))
def q_roll_unique_merchants(spark, sf_dir):
    """Exact distinct merchants in each window."""
    f = rolling_features(transactions(spark, sf_dir), HOURLY, unique_all=True)
    return rounded(f.select("transaction_id", "entity_id", *[f"unique_merchants_{w}s" for w in H]))


@register("geo_delta", f"""WITH {TXN},
f AS (SELECT *, last(latitude) OVER w AS prev_latitude, last(longitude) OVER w AS prev_longitude
      FROM txn WINDOW w AS (PARTITION BY entity_id ORDER BY us, transaction_id
                            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT transaction_id, entity_id, round(prev_latitude, {ROUND}) AS prev_latitude,
  round(prev_longitude, {ROUND}) AS prev_longitude,
  round({haversine_sql('prev_latitude', 'prev_longitude', 'latitude', 'longitude')}, {ROUND}) AS geo_distance_delta
FROM f""")
def q_geo_delta(spark, sf_dir):
    """Previous location of the entity and the distance to it."""
    f = rolling_features(transactions(spark, sf_dir), HOURLY)
    return rounded(f.select("transaction_id", "entity_id", "prev_latitude", "prev_longitude",
                            "geo_distance_delta"))


@register("zscore", f"""WITH {TXN}, f AS ({rolling_select(H)})
SELECT transaction_id, entity_id,
  round(CASE WHEN amount_std_{H[2]}s >= 1e-9 THEN (amount - amount_mean_{H[2]}s) / amount_std_{H[2]}s
        ELSE 0.0 END, {ROUND}) AS amount_zscore
FROM f""")
def q_zscore(spark, sf_dir):
    """Z-score of the amount against the long window (self included)."""
    f = rolling_features(transactions(spark, sf_dir), HOURLY)
    return rounded(f.select("transaction_id", "entity_id", "amount_zscore"))


@register("velocity_ratio", f"""WITH {TXN}, f AS ({rolling_select(H)})
SELECT transaction_id, entity_id,
  round(CAST(txn_count_{H[0]}s AS DOUBLE) / CAST(greatest(txn_count_{H[2]}s, 1) AS DOUBLE) * 60.0, {ROUND})
    AS velocity_change_ratio
FROM f""")
def q_velocity_ratio(spark, sf_dir):
    """Short-window count over long-window count, times 60."""
    f = rolling_features(transactions(spark, sf_dir), HOURLY)
    return rounded(f.select("transaction_id", "entity_id", "velocity_change_ratio"))


CAP = 2


def _capped_sql(n: int, txn: str = TXN) -> str:
    rng = f"RANGE BETWEEN {H[2] * 1_000_000} PRECEDING AND CURRENT ROW"
    rws = f"ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW"
    part = "PARTITION BY entity_id ORDER BY us"
    part_rows = "PARTITION BY entity_id ORDER BY us, transaction_id"
    return f"""WITH {txn},
f AS (SELECT *, count(DISTINCT merchant_id) OVER ({part} {rng}) AS u_rng,
  count(DISTINCT merchant_id) OVER ({part_rows} {rws}) AS u_rows,
  count(amount) OVER ({part} {rng}) AS c_rng, count(amount) OVER ({part_rows} {rws}) AS c_rows,
  sum(amount) OVER ({part} {rng}) AS s_rng, sum(amount) OVER ({part_rows} {rws}) AS s_rows,
  max(amount) OVER ({part} {rng}) AS x_rng, max(amount) OVER ({part_rows} {rws}) AS x_rows,
  min(amount) OVER ({part} {rng}) AS n_rng, min(amount) OVER ({part_rows} {rws}) AS n_rows,
  stddev_pop(amount) OVER ({part} {rng}) AS d_rng, stddev_pop(amount) OVER ({part_rows} {rws}) AS d_rows
  FROM txn)
SELECT transaction_id, entity_id,
  CAST(CASE WHEN c_rng > {n} THEN c_rows ELSE c_rng END AS BIGINT) AS txn_count_{H[2]}s,
  round(CASE WHEN c_rng > {n} THEN s_rows ELSE s_rng END, {ROUND}) AS amount_sum_{H[2]}s,
  round(CASE WHEN c_rng > {n} THEN x_rows ELSE x_rng END, {ROUND}) AS amount_max_{H[2]}s,
  round(CASE WHEN c_rng > {n} THEN n_rows ELSE n_rng END, {ROUND}) AS amount_min_{H[2]}s,
  round(CASE WHEN c_rng > {n} THEN d_rows ELSE d_rng END, {ROUND}) AS amount_std_{H[2]}s,
  CAST(CASE WHEN c_rng > {n} THEN u_rows ELSE u_rng END AS BIGINT) AS unique_merchants_{H[2]}s
FROM f"""


@register("rolling_features_capped", _capped_sql(CAP))
def q_rolling_features_capped(spark, sf_dir):
    """Every frame capped at the entity's last N events (here N = 2)."""
    return _capped(transactions(spark, sf_dir), CAP)


LONG_CAP = 1000


@register("rolling_features_capped_1000", _capped_sql(LONG_CAP, PRESSED))
def q_rolling_features_capped_1000(spark, sf_dir):
    """W2 with a long cap: frames of N = 1,000 rows, in time that does not depend on N."""
    return _capped(_pressed(spark, sf_dir), LONG_CAP)


def _capped(txn, n):
    f = rolling_features(txn, HOURLY, max_events=n)
    lg = H[2]
    return rounded(f.select("transaction_id", "entity_id", f"txn_count_{lg}s", f"amount_sum_{lg}s",
                            f"amount_max_{lg}s", f"amount_min_{lg}s", f"amount_std_{lg}s", f"unique_merchants_{lg}s"))


@register("latest_event", f"""WITH {TXN}
SELECT entity_id, arg_max(transaction_id, (us, transaction_id)) AS transaction_id,
  max(us) AS us, round(arg_max(amount, (us, transaction_id)), {ROUND}) AS amount
FROM txn GROUP BY entity_id""")
def q_latest_event(spark, sf_dir):
    """The newest transaction of every entity."""
    t = transactions(spark, sf_dir).select("entity_id", "transaction_id", "us", "amount")
    return rounded(latest_per_entity(t).select("entity_id", "transaction_id", "us", "amount"))


# Recompute window for the incremental query: events from SINCE on, reading
# history only back to SINCE minus the longest window.
SINCE = "2024-01-20 00:00:00"
SINCE_US = 1705708800000000
READ_FROM = "2024-01-19 00:00:00"     # SINCE - 24 h


@register("rolling_features_since", f"""WITH {TXN},
f AS ({rolling_select(HOURLY.lengths)}),
g AS (SELECT *, {haversine_sql('prev_latitude', 'prev_longitude', 'latitude', 'longitude')} AS geo_distance_delta FROM f)
SELECT transaction_id, entity_id, {', '.join(feature_sql(HOURLY))}, merchant_category
FROM g WHERE us >= {SINCE_US}""")
def q_rolling_features_since(spark, sf_dir):
    """W1 recomputed for recent events only: the source is read from
    SINCE - 24 h (a pushed filter), previous locations come from the
    entities' newest events before that (the snapshot table's content)."""
    recent = transactions(spark, sf_dir, since=READ_FROM)
    last_known = latest_per_entity(
        transactions(spark, sf_dir, until=READ_FROM).select(
            "entity_id", "transaction_id", "us", "latitude", "longitude"))
    f = rolling_features_since(recent, last_known, SINCE_US, HOURLY)
    return rounded(f.select("transaction_id", "entity_id", *HOURLY.feature_columns(), "merchant_category"))
