"""Monitoring aggregates.

All are single-pass aggregates with partial (map-side) aggregation; the only
ordered statistic (the nearest-rank latency report) goes through
``velocis.operators.ordering`` so no group is sorted in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from velocis.operators.ordering import nearest_rank_report


def engine_totals(txn: DataFrame, features: DataFrame | None = None,
                  served: DataFrame | None = None) -> DataFrame:
    """Tracked entities, events ingested, feature rows computed, requests
    served; ready when anything was ingested (A7).

    The sources are tagged and unioned, then reduced by one aggregate (the
    exact entity count is a partial distinct aggregate)."""
    parts = [txn.select(F.lit("e").alias("_src"), F.col("entity_id").cast("string").alias("_e"))]
    if features is not None:
        parts.append(features.select(F.lit("f").alias("_src"), F.lit(None).cast("string").alias("_e")))
    if served is not None:
        parts.append(served.select(F.lit("s").alias("_src"), F.lit(None).cast("string").alias("_e")))
    u = parts[0]
    for p in parts[1:]:
        u = u.unionByName(p)
    cnt = lambda tag: F.sum(F.when(F.col("_src") == tag, 1).otherwise(0)).cast("long")
    aggs = [F.count_distinct(F.when(F.col("_src") == "e", F.col("_e"))).alias("tracked_entities"),
            cnt("e").alias("total_events_ingested")]
    if features is not None:
        aggs.append(cnt("f").alias("total_features_computed"))
    if served is not None:
        aggs.append(cnt("s").alias("requests_served"))
    a = u.agg(*aggs)
    return a.withColumn("ready", F.col("total_events_ingested") > 0)


def serving_coverage(served: DataFrame) -> DataFrame:
    """Share of requests answered from a snapshot, rounded to 4."""
    hit = F.when(F.col("served_from") == "snapshot", 1).otherwise(0)
    return served.agg(F.count(F.lit(1)).alias("requests"), F.sum(hit).cast("long").alias("snapshot_hits"),
                      F.round(F.avg(hit.cast("double")), 4).alias("coverage"))


def decision_counts(scored: DataFrame) -> DataFrame:
    """Requests per decision."""
    return scored.groupBy("decision").agg(F.count(F.lit(1)).alias("requests"))


def _bound_label(b: float) -> str:
    return repr(float(b))


def cumulative_histogram(df: DataFrame, value: str, bounds: Sequence[float],
                         group: Sequence[str] = ()) -> DataFrame:
    """Cumulative ``le`` buckets with ``+Inf``, plus sum and count (A10).

    One aggregate computes every bucket (``sum(when(x <= b, 1))``); ``stack``
    unpivots them. Null values are excluded.
    """
    group = list(group)
    x = F.col(value)
    aggs = [F.sum(F.when(x <= F.lit(float(b)), 1).otherwise(0)).cast("long").alias(f"_b{i}")
            for i, b in enumerate(bounds)]
    aggs += [F.count(x).alias("_inf"), F.sum(x).alias("sum"), F.count(x).alias("count")]
    a = df.groupBy(*group).agg(*aggs)
    pairs = ", ".join([f"'{_bound_label(b)}', CAST({float(b)!r} AS DOUBLE), _b{i}" for i, b in enumerate(bounds)]
                      + ["'+Inf', CAST('Infinity' AS DOUBLE), _inf"])
    n = len(bounds) + 1
    return a.select(*group, "sum", "count",
                    F.expr(f"stack({n}, {pairs}) AS (le, le_value, bucket_count)"))


def histogram_quantile(hist: DataFrame, q: float, group: Sequence[str] = ()) -> DataFrame:
    """Quantile from cumulative buckets, linear inside the bucket.

    rank = q * total; first bucket with cumulative count >= rank; the
    answer interpolates between the previous bound (0 for the first) and
    this one. If that bucket is +Inf the highest finite bound is returned.
    The table is one row per bucket, so the window is tiny.
    """
    group = list(group)
    w = Window.partitionBy(*group).orderBy("le_value")
    h = (hist.withColumn("_prev_le", F.coalesce(F.lag("le_value").over(w), F.lit(0.0)))
         .withColumn("_prev_cnt", F.coalesce(F.lag("bucket_count").over(w), F.lit(0)))
         .withColumn("_total", F.max("bucket_count").over(Window.partitionBy(*group)))
         .withColumn("_rank", F.lit(float(q)) * F.col("_total")))
    h = h.where(F.col("bucket_count") >= F.col("_rank"))
    first = h.groupBy(*group).agg(F.min_by(F.struct("le_value", "_prev_le", "_prev_cnt", "bucket_count", "_rank"),
                                           F.col("le_value")).alias("_b"))
    b = F.col("_b")
    width = b["bucket_count"] - b["_prev_cnt"]
    interp = b["_prev_le"] + (b["le_value"] - b["_prev_le"]) * \
        F.when(width > 0, (b["_rank"] - b["_prev_cnt"]) / width).otherwise(F.lit(1.0))
    val = F.when(b["le_value"] == F.lit(float("inf")), b["_prev_le"]).otherwise(interp)
    return first.select(*group, val.alias("quantile"))


def latency_report(df: DataFrame, value: str, group: Sequence[str] = ()) -> DataFrame:
    """n, p50/p90/p95/p99, mean, max; nearest-rank rule of the reference."""
    return nearest_rank_report(df, value, group)


def throughput_report(df: DataFrame, ts_us: str = "us", group: Sequence[str] = (),
                      window_s: float | None = None) -> DataFrame:
    """Rows, elapsed seconds, rows/s and mean ms per row (A15), overall or per
    fixed window of ``window_s`` seconds."""
    group = list(group)
    if window_s:
        wus = int(window_s * 1_000_000)
        df = df.withColumn("window_start_us", F.floor(F.col(ts_us) / wus) * wus)
        group = group + ["window_start_us"]
    a = df.groupBy(*group).agg(F.count(F.lit(1)).alias("n"),
                               ((F.max(ts_us) - F.min(ts_us)) / 1e6).alias("elapsed_s"))
    return a.select(*group, "n", "elapsed_s",
                    F.when(F.col("elapsed_s") > 0, F.col("n") / F.col("elapsed_s")).alias("rows_per_s"),
                    (F.col("elapsed_s") * 1000.0 / F.col("n")).alias("avg_ms"))


def rate_per_window(df: DataFrame, ts: str, window: str = "1 minute",
                    by: Sequence[str] = ("decision",), total: str | None = None) -> DataFrame:
    """Count and per-second rate per fixed window and ``by`` (A11); with
    ``total`` also one row per window over all of them, named so in every
    ``by`` column. The totals add up the groups, the input is read once."""
    g = df.groupBy(F.window(ts, window).alias("w"), *by).agg(F.count(F.lit(1)).alias("n"))
    if total is not None:
        names = F.array(*[F.struct(F.col(c).cast("string").alias("k"), F.lit(c).alias("c")) for c in by])
        g = g.withColumn("_keep", F.explode(F.array(F.lit(True), F.lit(False)))).select(
            "w", "n", *[F.when(F.col("_keep"), names[i]["k"]).otherwise(F.lit(total)).alias(c)
                        for i, c in enumerate(by)])
        g = g.groupBy("w", *by).agg(F.sum("n").alias("n"))
    length_s = _window_seconds(window)
    return g.select(F.unix_micros(F.col("w.start")).alias("window_start_us"), *by, "n",
                    (F.col("n") / F.lit(float(length_s))).alias("rate_per_s"))


def _window_seconds(window: str) -> float:
    num, unit = window.split()
    mult = {"second": 1, "seconds": 1, "minute": 60, "minutes": 60, "hour": 3600, "hours": 3600,
            "day": 86400, "days": 86400}[unit]
    return float(num) * mult


def fraud_rate(df: DataFrame, ts: str, window: str = "1 minute") -> DataFrame:
    """DECLINE / all * 100 per fixed window."""
    g = df.groupBy(F.window(ts, window).alias("w")).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.when(F.col("decision") == "DECLINE", 1).otherwise(0)).alias("declined"))
    return g.select(F.unix_micros(F.col("w.start")).alias("window_start_us"), "n",
                    F.col("declined").cast("long").alias("declined"),
                    (F.col("declined") / F.col("n") * 100.0).alias("fraud_rate_pct"))


def batch_summary(scored: DataFrame, batch: str = "batch_id") -> DataFrame:
    """Per batch: total, succeeded, failed, total latency.

    A row failed when ``error`` is set (or the probability is missing)."""
    failed = (F.col("error").isNotNull() if "error" in scored.columns
              else F.col("fraud_probability").isNull())
    lat = F.col("inference_latency_us") if "inference_latency_us" in scored.columns else F.lit(None)
    return scored.groupBy(batch).agg(
        F.count(F.lit(1)).alias("total"),
        F.sum(F.when(failed, 0).otherwise(1)).cast("long").alias("succeeded"),
        F.sum(F.when(failed, 1).otherwise(0)).cast("long").alias("failed"),
        F.sum(lat).cast("long").alias("total_latency_us"))


def detected_vs_actual(scored: DataFrame, truth: DataFrame, key: str = "transaction_id",
                       label: str = "actual_fraud") -> DataFrame:
    """Scored rows joined to a separate truth table by id, counted per
    decision, prediction and label (J6). Truth that is delivered twice counts
    once; scored rows without truth are left out."""
    t = truth.groupBy(key).agg(F.max(label).alias(label))
    j = scored.select(key, "decision", F.col("is_fraud").alias("predicted_fraud")).join(t, key)
    return j.groupBy("decision", "predicted_fraud", label).agg(F.count(F.lit(1)).alias("transactions"))


def class_balance(df: DataFrame, label: str = "label") -> DataFrame:
    """Rows, positives, negatives, positive rate and neg/pos weight."""
    y = F.col(label).cast("int")
    a = df.agg(F.count(F.lit(1)).alias("n"), F.sum(y).cast("long").alias("positives"))
    return a.select("n", "positives", (F.col("n") - F.col("positives")).alias("negatives"),
                    (F.col("positives") / F.col("n")).alias("positive_rate"),
                    F.when(F.col("positives") > 0, (F.col("n") - F.col("positives")) / F.col("positives"))
                    .alias("pos_weight"))
