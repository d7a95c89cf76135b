"""Distributed cumulative counts in value order.

A window without ``partitionBy`` (or over one huge group) sorts everything in
one task. Instead:

1. reduce to one row per distinct ``(group, value)`` with summed weights (a
   partial aggregate) and write that table: it is the only pass over the input;
2. cut the value range into buckets at a few hundred quantiles, fetched once
   and then plain literals, so a row's bucket is a function of its value alone;
3. running sums inside each (group, bucket), by a window;
4. per (group, bucket) totals -> offsets of the smaller buckets of the group, by
   a window over that small table, joined back by (group, bucket).
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from velocis.session import scratch_path


def value_bounds(df: DataFrame, value: str, buckets: int) -> list[float]:
    """At most ``buckets - 1`` ascending bounds that cut ``value`` about evenly
    (approximate quantiles: they only balance the work)."""
    q = [i / buckets for i in range(1, buckets)]
    got = df.agg(F.percentile_approx(F.col(value).cast("double"), q, 10_000)).first()[0] if q else None
    return sorted(set(got or []))


def bounds_below(value: F.Column, bounds: Sequence[float]) -> F.Column:
    """How many of the ascending ``bounds`` are below ``value``: a binary search,
    a fold over the halving steps, so the work per row grows with the logarithm
    of their number."""
    limits = F.array(*[F.lit(float(b)) for b in bounds]).cast("array<double>")
    steps = [1 << k for k in reversed(range(max(len(bounds), 1).bit_length()))]
    # a step beyond the last bound reads null and is not taken
    return F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), lambda at, step: F.when(
        F.get(limits, at + step - 1) < value, at + step).otherwise(at))


def ranked(df: DataFrame, value: str, weights: dict[str, F.Column] | None = None,
           group: Sequence[str] = (), buckets: int | None = None) -> DataFrame:
    """Distinct ``(group, value)`` rows with, for every weight ``w``:
    ``w`` (the sum at this value), ``cum_w`` (inclusive running sum in
    ascending value order within the group) and ``total_w`` (group total).
    Without ``weights`` a single weight ``n`` counts rows. Nulls are dropped.
    """
    group = list(group)
    weights = weights or {"n": F.lit(1)}
    names = list(weights)
    spark = df.sparkSession
    d = (df.where(F.col(value).isNotNull())
         .groupBy(*group, value)
         .agg(*[F.sum(c.cast("double")).alias(n) for n, c in weights.items()]))
    path = scratch_path(spark, f"ranked/{uuid.uuid4().hex}")
    d.write.parquet(path)
    d = spark.read.schema(d.schema).parquet(path)
    bounds = value_bounds(d, value, buckets or int(spark.conf.get("spark.sql.shuffle.partitions")))
    d = d.withColumn("_b", bounds_below(F.col(value).cast("double"), bounds))
    own = Window.partitionBy(*group, "_b").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    local = d.withColumns({f"_cum_{w}": F.sum(w).over(own) for w in names})
    tot = d.groupBy(*group, "_b").agg(*[F.sum(w).alias(f"_t_{w}") for w in names])
    wo = Window.partitionBy(*group).orderBy("_b")
    wall = Window.partitionBy(*group)
    offs = tot.select(*[F.col(c).alias(f"_g_{c}") for c in group], F.col("_b").alias("_gb"), *[
        F.coalesce(F.sum(f"_t_{w}").over(wo.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
        .alias(f"_o_{w}") for w in names], *[F.sum(f"_t_{w}").over(wall).alias(f"total_{w}") for w in names])
    on = F.col("_b") == F.col("_gb")
    for c in group:
        on = on & F.col(c).eqNullSafe(F.col(f"_g_{c}"))
    j = local.join(offs, on, "inner")
    return j.select(*group, value, *names,
                    *[(F.col(f"_cum_{w}") + F.col(f"_o_{w}")).alias(f"cum_{w}") for w in names],
                    *[F.col(f"total_{w}") for w in names])


def nearest_rank_report(df: DataFrame, value: str, group: Sequence[str] = (),
                        percentiles: Sequence[float] = (50, 90, 95, 99)) -> DataFrame:
    """n, p50/p90/p95/p99, mean, max per group with the reference's rule
    ``idx = min(int(n * p / 100), n - 1)`` on the ascending values (A14, K2)."""
    group = list(group)
    r = ranked(df, value, group=group)
    n = F.col("total_n")
    aggs = [F.first(n.cast("long")).alias("n")]
    for p in percentiles:
        idx = F.least(F.floor(n * F.lit(float(p)) / 100.0), n - 1)
        hit = (F.col("cum_n") - F.col("n") <= idx) & (idx < F.col("cum_n"))
        aggs.append(F.max(F.when(hit, F.col(value))).alias(f"p{int(p)}"))
    aggs += [(F.sum(F.col(value) * F.col("n")) / F.sum("n")).alias("mean"), F.max(value).alias("max")]
    return r.groupBy(*group).agg(*aggs)
