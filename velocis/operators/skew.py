"""Skew handling for per-entity ordered operators.

Rolling windows and as-of lookups are partitioned by entity. One entity may
hold a large share of all rows, which would put it into one task. Entities
with more than ``hot_rows`` rows (a fixed group size, whatever the table's)
are therefore cut into time slices ("splits") of equal width, chosen so that a
slice holds about ``hot_rows`` rows when the entity's events are spread evenly,
and not narrower than the longest window, so that a row is copied at most once.
The operators' work per row does not depend on how many rows a slice holds.

* Rows of a hot entity get ``split = floor((us - origin) / width) + 1``;
  every other entity has ``split = 0`` (one slice, no extra work).
* Events that fall within ``context_us`` of the end of their slice are also
  copied into the next slice as *context* rows, so every RANGE frame of
  length <= ``context_us`` sees all its rows. Context rows are dropped from
  the output.
* State that reaches further back than ``context_us`` (the previous event,
  the latest snapshot) is provided by the *entry table*: for each hot
  (entity, split) the last two events strictly before
  ``start(split) - context_us``. It is built from aggregates only and holds
  at most one row per slice.

The hot table has at most N / hot_rows rows. When it is not empty it is
written to the shared checkpoint folder, its slice count is checked, and it
is broadcast only below ``broadcast_rows`` (a shuffle join beyond).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: A task sorts a group's rows several times, with a copy per window length:
#: about 7 kB of memory a row.
DEFAULT_HOT_ROWS = 50_000
#: Rows (before copies) of one partition of the operators that copy rows.
PARTITION_ROWS = 25_000
AUTO = "auto"
# ~50 bytes per slice row: 250k slices is ~12 MB per executor when broadcast
DEFAULT_BROADCAST_ROWS = 250_000


@dataclass
class SplitPlan:
    """Slices of the hot entities; ``hot`` is None when no entity is hot.
    ``peak`` is the largest number of rows of an entity in one stretch of
    ``context_us`` (None: not counted), so a frame of that length holds at most
    twice as many. ``rows`` counts all rows (None: not counted)."""

    key: str
    hot: DataFrame | None
    context_us: int
    broadcast: bool
    peak: int | None = None
    rows: int | None = None

    def spread(self, df: DataFrame, *keys: str) -> DataFrame:
        """``df`` dealt out by ``keys`` to partitions of ``PARTITION_ROWS`` rows:
        more rows make more partitions, not larger ones. Sizes in bytes, by which
        Spark joins partitions, tell little of the memory that sorted copies need.

        Without hot entities ``split`` is a constant. Spark drops it from the keys of the
        windows, which would then deal the rows out anew, to a fixed number of partitions."""
        if self.rows is None:
            return df
        if self.hot is None:
            keys = tuple(k for k in keys if k != "split")
        least = df.sparkSession.sparkContext.defaultParallelism
        return df.repartition(max(least, -(-self.rows // PARTITION_ROWS)), *keys)


def plan_splits(events: DataFrame, key: str, context_us: int,
                hot_rows: int | str | None = AUTO,
                broadcast_rows: int | None = None) -> SplitPlan:
    """Find hot entities and their slice width. One small aggregate job.

    ``events`` holds ``key`` and ``us`` of every row that will be
    partitioned by entity (for as-of passes: build and probe rows together).
    ``hot_rows="auto"`` is ``DEFAULT_HOT_ROWS``; an integer is used as is.
    """
    if not hot_rows:
        return SplitPlan(key, None, context_us, False)
    if broadcast_rows is None:
        broadcast_rows = DEFAULT_BROADCAST_ROWS
    floor_width = max(int(context_us), 1)
    # without a window there is no frame to count: one stretch
    stretch = F.floor(F.col("us") / floor_width) if context_us else F.lit(0)
    per = (events.groupBy(key, stretch.alias("_w"))
           .agg(F.count(F.lit(1)).alias("_n"), F.min("us").alias("_lo"), F.max("us").alias("_hi"))
           .groupBy(key).agg(F.sum("_n").alias("_n"), F.max("_n").alias("_peak"), F.min("_lo").alias("_lo"),
                             F.max("_hi").alias("_hi")))
    rows = DEFAULT_HOT_ROWS if hot_rows == AUTO else hot_rows
    budget = F.lit(float(rows))
    # one counting job; nothing is written when no entity is hot
    peak, n_hot, total = per.agg(F.max("_peak"), F.count_if(F.col("_n") > budget), F.sum("_n")).first()
    if not n_hot:
        return SplitPlan(key, None, context_us, False, peak or 0, total or 0)
    width = F.greatest(F.lit(floor_width).cast("long"),
                       F.ceil((F.col("_hi") - F.col("_lo") + 1) * budget / F.col("_n")).cast("long"))
    hot = per.where(F.col("_n") > budget).select(
        key, F.col("_lo").alias("split_origin"), width.alias("split_width"),
        F.col("_hi").alias("_hi"),
    ).select(key, "split_origin", "split_width",
             (F.floor((F.col("_hi") - F.col("split_origin")) / F.col("split_width")) + 1)
             .cast("long").alias("split_last"))
    hot = hot.checkpoint(eager=True)
    slices = hot.agg(F.coalesce(F.sum(F.col("split_last") + 1), F.lit(0))).first()[0]
    return SplitPlan(key, hot, context_us, slices <= broadcast_rows, peak, total)


def dense_entities(events: DataFrame, plan: SplitPlan, windows, hot_rows: int | str | None = AUTO) -> DataFrame | None:
    """``key, cell_us`` of the hot entities whose slices would hold too many
    rows, because slices are not narrower than the longest window: these are cut
    into cells (``velocis.operators.cells``). None if there is no such entity.
    """
    from velocis.operators.cells import plan_widths
    if plan.hot is None:
        return None
    budget = DEFAULT_HOT_ROWS if hot_rows == AUTO else int(hot_rows)
    key = plan.key
    full = join_null_safe(events.select(key, "us"), plan.hot.select(key), [key], "left_semi", plan.broadcast) \
        .groupBy(key, F.floor(F.col("us") / plan.context_us).alias("_w")).count() \
        .groupBy(key).agg(F.max("count").alias("_n")).where(F.col("_n") > budget)
    # many small cells make even partitions
    dense = plan_widths(events, full, key, windows, min(budget, PARTITION_ROWS // 16)).checkpoint(eager=True)
    return None if dense.isEmpty() else dense


def join_null_safe(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner",
                   small: bool = False) -> DataFrame:
    """Equi-join on ``keys`` in which null equals null: a null entity is an
    entity like others. ``right`` has no other column in common with ``left``;
    ``small`` broadcasts it (a checked size)."""
    r = right.withColumnsRenamed({k: f"__{k}" for k in keys})
    on = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    return left.join(F.broadcast(r) if small else r, on, how).drop(*[f"__{k}" for k in keys])


def _raw_split(us_col) -> F.Column:
    return F.floor((us_col - F.col("split_origin")) / F.col("split_width")) + 1


def assign_split(rows: DataFrame, plan: SplitPlan, replicate: bool) -> DataFrame:
    """Add ``split`` and ``is_ctx``; with ``replicate`` (event rows) copy the
    rows near the end of a slice into the next one as context rows. Probe
    rows (requests) are clamped to ``[1, last + 1]``: slices beyond hold no
    event within reach of the frame, so the answer is unchanged."""
    if plan.hot is None:
        return rows.withColumn("split", F.lit(0).cast("long")).withColumn("is_ctx", F.lit(False))
    cols = rows.columns
    j = join_null_safe(rows, plan.hot, [plan.key], "left", plan.broadcast)  # beyond the broadcast bound AQE splits a hot key's rows
    raw = _raw_split(F.col("us"))
    split = (F.when(F.col("split_origin").isNull(), F.lit(0))
             .otherwise(F.least(F.greatest(raw, F.lit(1)), F.col("split_last") + 1))).cast("long")
    j = j.withColumn("split", split)
    if not replicate:
        return j.select(*cols, "split", F.lit(False).alias("is_ctx"))
    slice_end = F.col("split_origin") + F.col("split") * F.col("split_width")
    in_zone = F.col("split_origin").isNotNull() & (F.col("us") >= slice_end - F.lit(plan.context_us))
    j = j.withColumn("is_ctx", F.explode(
        F.when(in_zone, F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))))
    return j.select(*cols, (F.col("split") + F.col("is_ctx").cast("long")).alias("split"), "is_ctx")


def entry_table(events: DataFrame, plan: SplitPlan, payload: list[str],
                second: bool = False) -> DataFrame | None:
    """For every hot (entity, split): the last event (and with ``second`` the
    one before it) strictly before ``start(split) - context_us``.

    Returns columns ``key, split, d1, d2`` where d1/d2 are structs of
    ``us, tid`` plus ``payload``; None when nothing is hot.

    Events are grouped by ``g = split(us + context_us)``: an event lies before
    ``start(s) - context_us`` exactly when ``g <= s - 1``, and groups are
    disjoint, increasing time ranges, so the top two up to ``g`` are the top
    two of ``g`` topped up from the previous non-empty group.
    """
    if plan.hot is None:
        return None
    key = plan.key
    ev = join_null_safe(events, plan.hot, [key], "inner", plan.broadcast)
    ev = ev.withColumn("_g", F.least(_raw_split(F.col("us") + F.lit(plan.context_us)),
                                     F.col("split_last") + 1).cast("long"))
    rec = F.struct(F.col("us"), F.col("tid"), *[F.col(c) for c in payload])
    ordk = F.struct(F.col("us"), F.col("tid"))
    top1 = ev.groupBy(key, "_g").agg(F.max_by(rec, ordk).alias("t1"))
    if second:
        t1k = top1.select(key, "_g", F.col("t1.us").alias("_u1"), F.col("t1.tid").alias("_t1"))
        rest = (join_null_safe(ev, t1k, [key, "_g"], "inner", plan.broadcast)
                .where((F.col("us") < F.col("_u1")) | ((F.col("us") == F.col("_u1")) & (F.col("tid") < F.col("_t1")))))
        top2 = rest.groupBy(key, "_g").agg(F.max_by(rec, ordk).alias("t2"))
        groups = join_null_safe(top1, top2, [key, "_g"], "left")
    else:
        groups = top1.withColumn("t2", F.lit(None).cast(top1.schema["t1"].dataType))
    wg = Window.partitionBy(key).orderBy("_g")
    groups = (groups
              .withColumn("d2", F.coalesce(F.col("t2"), F.lag("t1").over(wg)))
              .withColumn("_next", F.lead("_g").over(wg)))
    groups = join_null_safe(groups, plan.hot.select(key, "split_last"), [key], "inner", plan.broadcast)
    # group g serves splits g+1 .. next non-empty group (or the last probe slice)
    upto = F.coalesce(F.col("_next"), F.col("split_last") + 1)
    dense = groups.where(F.col("_g") + 1 <= upto).select(
        key, F.explode(F.sequence(F.col("_g") + 1, upto)).alias("split"),
        F.col("t1").alias("d1"), "d2")
    return dense
