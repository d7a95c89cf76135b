"""Per-entity rolling-window features.

One ``Window.partitionBy(entity, split)`` drives every frame: the RANGE
frames of all window lengths share the order key ``us`` (epoch micros), and
the previous-event chain uses ``(us, side, tid)``, which sorts rows in an
order that also satisfies the RANGE frames. The plan is one exchange by
(entity, split) and one sort; see ``velocis.operators.skew`` for ``split``.

Window semantics (our fixed, replayable definition): the frame of a row at
time ``t`` holds the events of the same entity with ``t - W <= ts <= t``,
both ends inclusive, events sharing ``t`` included. Empty frames give 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from velocis.functions.scalar import haversine_km, velocity_ratio, zscore
from velocis.operators import skew
from velocis.schemas import DEFAULT, WindowSet, stat_column

MICROS = 1_000_000
ALL_STATS = ("sum", "mean", "std", "count", "max", "min")


def with_event_micros(df: DataFrame) -> DataFrame:
    """Ensure a ``us`` column (epoch micros) from ``event_ts`` or ``timestamp_ms``."""
    if "us" in df.columns:
        return df
    if "event_ts" in df.columns:
        return df.withColumn("us", F.unix_micros(F.col("event_ts")))
    return df.withColumn("us", F.col("timestamp_ms") * 1000)


#: Rows of an entity in one stretch of the longest window up to which frames
#: are read row by row: at most twice as many a frame.
SHORT_FRAME = 64


def with_frames(rows: DataFrame, windows: WindowSet, key: str, amount: Column, merchant: Column,
                stats: str = "snapshot", max_events: int | None = None,
                unique_all: bool = False, plan: skew.SplitPlan | None = None) -> tuple[DataFrame, list[str]]:
    """Window aggregates of every length. Where a frame is known to hold few
    rows (the skew plan's ``peak`` up to ``SHORT_FRAME``) Spark's
    sliding frames read them, in one sort; else, or if it is not known, running
    aggregates in time linear in the rows. Both give the same statistics, in
    another order of addition."""
    if is_short(plan, max_events):
        return _sliding_frames(rows, windows, key, amount, merchant, stats, max_events, unique_all)
    return _block_frames(rows, windows, key, amount, merchant, stats, max_events, unique_all)


def is_short(plan: skew.SplitPlan | None, max_events: int | None = None) -> bool:
    """Whether every frame is known to hold few rows."""
    return plan is not None and plan.peak is not None and plan.peak <= SHORT_FRAME and (max_events or 1) <= SHORT_FRAME


def _sliding_frames(rows: DataFrame, windows: WindowSet, key: str, amount: Column, merchant: Column, stats: str,
                    max_events: int | None, unique_all: bool) -> tuple[DataFrame, list[str]]:
    """Every frame read on its own: work per row grows with the rows in its frames."""
    base = rows.columns
    over = Window.partitionBy(key, "split")
    last = over.orderBy("us", "side", "tid").rowsBetween(-(max_events - 1), 0) if max_events else None

    def read(spec, wanted, uniq):
        agg = {"count": F.count, "sum": F.sum, "mean": F.avg, "std": F.stddev_pop, "max": F.max, "min": F.min}
        out = {s: agg[s](amount).over(spec) for s in {*wanted, "count"}}
        return out | ({"uniq": F.size(F.collect_set(merchant).over(spec))} if uniq else {})

    cols: dict[str, Column] = {}
    for w in windows.lengths:
        wanted = ALL_STATS if stats == "all" else windows.stats_for(w)
        want_uniq = unique_all or w == windows.long
        f = read(over.orderBy("us").rangeBetween(-w * MICROS, 0), wanted, want_uniq)
        if max_events:
            capped, too_many = read(last, wanted, want_uniq), f["count"] > max_events
            f = {k: F.when(too_many, capped[k]).otherwise(v) for k, v in f.items()}
        uniq = f.pop("uniq", None)
        cols |= feature_columns(f, uniq, wanted, w)
    return rows.withColumns(cols).select(*base, *cols), list(cols)


def _block_frames(rows: DataFrame, windows: WindowSet, key: str, amount: Column, merchant: Column, stats: str,
                  max_events: int | None, unique_all: bool) -> tuple[DataFrame, list[str]]:
    """Window aggregates of every length, in time linear in the rows.

    ``amount``/``merchant`` are null on rows that must not count (probe rows).

    Time is cut into blocks of the window's length W. A frame ``[t - W, t]`` is
    the start of t's block up to t plus the end of the block before it from
    ``t - W`` on. Every counting row is therefore copied once per window
    length, moved W into the future: in t's block, the frame is then a *running*
    aggregate of the block's own rows (ascending) and one of the moved copies
    (descending), merged: counts, sums, extremes, and mean and squared
    deviations by the pairwise rule, so nothing is ever subtracted. No row is
    visited once per frame that holds it, and no set is kept: a merchant is in
    the frame unless it lies between its last copy and its first own row, so
    the distinct count is a running sum of those marks.

    ``max_events`` (W2): a frame of more than N rows ends at the last N. That is
    the frame ``[rank - (N - 1), rank]`` of row ranks, cut into blocks of ranks
    and summed in the same way, so the work does not depend on N.

    The caller has already partitioned ``rows`` by (key, split) for the
    previous-event chain; every window here is finer and reuses that exchange.
    """
    base = rows.columns
    roles = [0, *range(1, len(windows.lengths) + 1)]
    counts = amount.isNotNull() | merchant.isNotNull()
    rows = rows.withColumns({"_x": amount, "_m": merchant, "_rid": F.monotonically_increasing_id()})
    cap_role = len(roles)
    if max_events:
        order = Window.partitionBy(key, "split").orderBy("us", "side", "tid").rowsBetween(Window.unboundedPreceding, 0)
        rows = rows.withColumn("_rank", F.sum(F.when(F.col("side") == 0, 1).otherwise(0)).over(order))
    copied = roles + ([cap_role] if max_events and max_events > 1 else [])
    rows = rows.withColumn("_role", F.explode(F.when(counts, F.array(*[F.lit(r) for r in copied]))
                                              .otherwise(F.array(F.lit(0)))))
    moved = F.lit(0).cast("long")
    for r, w in zip(roles[1:], windows.lengths):
        moved = F.when(F.col("_role") == r, F.lit(w * MICROS)).otherwise(moved)
    rows = rows.withColumn("_vt", F.col("us") + moved)
    own = F.col("_role") == 0
    out: list[str] = []
    if max_events:
        # the last N rows are the frame [rank - (N - 1), rank]: the same sums with ranks for times
        reach = max_events - 1
        rows = rows.withColumn("_vr", F.col("_rank") + F.when(F.col("_role") == cap_role, F.lit(reach)).otherwise(0))
        rows = rows.withColumn("_br", F.floor(F.col("_vr") / max(reach, 1)))
        rows, (p, q), uniq = running_parts(rows, [key, "split", "_br"], "_vr", own, F.col("_role") == cap_role,
                                           {"n", "s", "a", "v", "hi", "lo"}, True)
        capped = statistics(merge_parts(p, q))
        rows = rows.withColumns({f"_c_{k}": c for k, c in capped.items()} | {"_c_uniq": uniq})
    for r, w in zip(roles[1:], windows.lengths):
        wanted = ALL_STATS if stats == "all" else windows.stats_for(w)
        rows = rows.withColumn(f"_b{r}", F.floor(F.col("_vt") / (w * MICROS)))
        want_uniq = unique_all or w == windows.long
        need = {"n", "s", "a", "v"} | ({"hi"} if "max" in wanted else set()) | ({"lo"} if "min" in wanted else set())
        rows, (p, q), uniq = running_parts(rows, [key, "split", f"_b{r}"], "_vt", own, F.col("_role") == r, need,
                                           want_uniq)
        frame = statistics(merge_parts(p, q))
        if max_events:
            over = frame["count"] > F.lit(max_events)
            frame = {k: F.when(over, F.col(f"_c_{k}")).otherwise(v) for k, v in frame.items()}
            uniq = F.when(over, F.col("_c_uniq")).otherwise(uniq) if want_uniq else None
        final = feature_columns(frame, uniq, wanted, w)
        rows = rows.withColumns(final)
        out += list(final)
    return rows.where(own).select(*base, *out), out


#: Aggregates of a part of a frame: count, sum, mean, population variance, extremes.
PART = {"n": F.count, "s": F.sum, "a": F.avg, "v": F.var_pop, "hi": F.max, "lo": F.min}


def running_parts(rows: DataFrame, block: list[str], pos: str, own: Column, copy: Column, need: set[str],
                  want_uniq: bool, m_own: str = "_m", m_copy: str = "_m") -> tuple[DataFrame, tuple[dict, dict], Column]:
    """Running aggregates of ``_x`` in the order of ``pos`` inside a block: of
    the ``own`` rows up to each position and of the moved ``copy`` rows from it
    on, both as dictionaries of columns, and the number of distinct merchants
    (``m_own`` of own rows, ``m_copy`` of copies) in either."""
    unlimited = Window.unboundedPreceding
    upto = Window.partitionBy(*block).orderBy(pos).rangeBetween(unlimited, 0)
    onward = Window.partitionBy(*block).orderBy(F.desc(pos)).rangeBetween(unlimited, 0)
    if want_uniq:
        rows = rows.withColumn("_mm", F.when(own, F.col(m_own)).when(copy, F.col(m_copy)))
        per = Window.partitionBy(*block, "_mm")
        place = F.struct(F.col(pos).alias("at"), F.col("_rid").alias("rid"))
        rows = rows.withColumns({
            "_last": F.max(F.when(copy & F.col("_mm").isNotNull(), place)).over(per),
            "_first": F.min(F.when(own & F.col("_mm").isNotNull(), place)).over(per)})
        apart = F.col("_last").isNull() | F.col("_first").isNull() | (F.col("_last.at") < F.col("_first.at"))
        is_last = copy & (F.col("_last") == place)
        is_first = own & (F.col("_first") == place)
        rows = rows.withColumns({
            "_there": F.when(is_last, 1).otherwise(0),
            "_gone": F.when(is_last & apart, 1).otherwise(0),
            "_come": F.when(is_first & apart, 1).otherwise(0)}).drop("_last", "_first", "_mm")
    cols = {}
    for part, spec, pick in (("p", upto, own), ("q", onward, copy)):
        x = F.when(pick, F.col("_x"))
        cols |= {f"_{part}{k}": PART[k](x).over(spec) for k in sorted(need)}
    if want_uniq:
        before = Window.partitionBy(*block).orderBy(pos).rangeBetween(unlimited, -1)
        cols |= {"_u": F.sum("_there").over(Window.partitionBy(*block))
                 + F.sum("_come").over(upto) - F.coalesce(F.sum("_gone").over(before), F.lit(0))}
    rows = rows.withColumns(cols)
    p, q = ({k: F.col(f"_{part}{k}") for k in need} for part in "pq")
    return rows, (p, q), F.col("_u") if want_uniq else None


def merge_parts(p: dict, q: dict) -> dict:
    """Two parts of a frame as one: pairwise rule for mean and squared deviations, nothing subtracted."""
    zero = F.lit(0.0)
    n = p["n"] + q["n"]
    total = F.coalesce(p["s"], zero) + F.coalesce(q["s"], zero)
    gap = p["a"] - q["a"]
    spread = (F.coalesce(p["v"] * p["n"], zero) + F.coalesce(q["v"] * q["n"], zero)
              + F.coalesce(gap * gap * p["n"] * q["n"] / n, zero))
    out = {"n": n, "s": total, "a": F.when(n > 0, total / n), "v": F.when(n > 0, spread / n)}
    if "hi" in p:
        out["hi"] = F.greatest(p["hi"], q["hi"])
    if "lo" in p:
        out["lo"] = F.least(p["lo"], q["lo"])
    return out


def statistics(part: dict) -> dict:
    """The part's aggregates by the names of the statistics."""
    named = {"count": part["n"], "sum": part["s"], "mean": part["a"], "std": F.sqrt(part["v"])}
    return named | {k: part[s] for k, s in (("max", "hi"), ("min", "lo")) if s in part}


def feature_columns(frame: dict, uniq: Column | None, wanted: tuple[str, ...], w: int) -> dict:
    """Feature columns of one window length; an empty frame gives zeros."""
    final = {stat_column(s, w): (frame[s].cast("int") if s == "count"
                                 else F.coalesce(frame[s], F.lit(0.0)).cast("double")) for s in wanted}
    if uniq is not None:
        final[f"unique_merchants_{w}s"] = uniq.cast("int")
    return final


def _prev_chain(key: str) -> Column:
    """Last event (struct tid, lat, lon, us) strictly before this row."""
    w_prev = (Window.partitionBy(key, "split").orderBy("us", "side", "tid")
              .rowsBetween(Window.unboundedPreceding, -1))
    ev = F.when(F.col("side") == 0, F.struct(F.col("tid").alias("tid"), F.col("latitude").alias("lat"),
                                             F.col("longitude").alias("lon"), F.col("us").alias("us")))
    return F.last(ev, ignorenulls=True).over(w_prev)


def _frame_rows(txn: DataFrame, key: str, emit: str | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
    cols = [F.col(key), F.col("us"), F.lit(0).alias("side"), F.col("transaction_id").alias("tid"),
            "amount", "merchant_id", "merchant_category", "latitude", "longitude"]
    if emit:
        cols.append(F.col(emit).alias("_emit"))
    base = {key, "us", "side", "tid", "amount", "merchant_id", "merchant_category", "latitude", "longitude"}
    cols += [F.col(c) for c in carry if c not in base]
    return with_event_micros(txn).select(*cols)


def rolling_features(txn: DataFrame, windows: WindowSet = DEFAULT, key: str = "entity_id",
                     max_events: int | None = None, stats: str = "snapshot",
                     hot_rows: int | str | None = skew.AUTO,
                     unique_all: bool = False, idle_ttl_s: float | None = None,
                     emit: str | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
    """Feature log: one row per transaction with the rolling features as of
    the transaction itself (the transaction counts in its own windows, as on
    the ingest path), the z-score of its amount against the long window, the
    velocity ratio, distinct merchants and the distance to the previous
    transaction of the entity.

    Output: ``entity_id, transaction_id, us, computed_at`` + feature columns +
    ``merchant_category, latitude, longitude, prev_latitude, prev_longitude``.
    Null amounts, merchants and coordinates do not count (z-score and
    current amount 0, distance 0 then).
    ``max_events`` caps every frame at the entity's last N events (W2).
    ``idle_ttl_s`` (>= the longest window) forgets the previous location
    after a longer gap, as the stream's idle expiry does (T6).
    ``emit`` names a boolean column: rows where it is false are history that
    feeds the frames but produces no output row (incremental use).
    ``carry`` passes input columns (e.g. a label) through to the output, so
    nothing has to be joined back by transaction id afterwards.
    """
    rows = _frame_rows(txn, key, emit, tuple(carry))
    if idle_ttl_s is not None and idle_ttl_s < max(windows.lengths):
        raise ValueError("idle_ttl_s must be at least the longest window")
    plan = skew.plan_splits(rows, key, max(windows.lengths) * MICROS, hot_rows)
    dense = skew.dense_entities(rows, plan, windows, hot_rows)
    if dense is not None:
        rows = skew.join_null_safe(rows, dense, [key], "left", plan.broadcast)
        dense_rows, rows = rows.where(F.col("cell_us").isNotNull()), rows.where(F.col("cell_us").isNull()).drop("cell_us")
    out, feats = _sliced_frames(rows, plan, windows, key, stats, max_events, unique_all)
    if dense is not None:
        from velocis.operators.cells import with_cell_frames
        cells, _ = with_cell_frames(dense_rows, windows, key, stats, unique_all, max_events, plan)
        cells = cells.withColumns({f"_prev_{c}": F.col(f"_prev.{c}") for c in ("lat", "lon", "us")})
        out = out.unionByName(cells.select(*out.columns))
    rows = out
    if emit:
        rows = rows.where(F.col("_emit"))
    prev_lat, prev_lon = F.col("_prev_lat"), F.col("_prev_lon")
    if idle_ttl_s is not None:
        fresh = F.col("us") - F.col("_prev_us") <= F.lit(int(idle_ttl_s * MICROS))
        prev_lat, prev_lon = F.when(fresh, prev_lat), F.when(fresh, prev_lon)
    rows = rows.withColumn("prev_latitude", prev_lat).withColumn("prev_longitude", prev_lon)

    lg, sh = windows.long, windows.short
    derived = {
        "amount_zscore": F.coalesce(zscore(F.col("amount"), F.col(f"amount_mean_{lg}s"), F.col(f"amount_std_{lg}s")),
                                    F.lit(0.0)),
        "velocity_change_ratio": velocity_ratio(F.col(f"txn_count_{sh}s"), F.col(f"txn_count_{lg}s")),
        "geo_distance_delta": haversine_km("prev_latitude", "prev_longitude", "latitude", "longitude"),
        "current_amount": F.coalesce(F.col("amount"), F.lit(0.0)),
        "computed_at": F.timestamp_micros(F.col("us")),
    }
    rows = rows.withColumns(derived)
    return rows.select(key, F.col("tid").alias("transaction_id"), "us", "computed_at", *feats,
                       "amount_zscore", "velocity_change_ratio", "geo_distance_delta",
                       "current_amount", "merchant_category", "latitude", "longitude",
                       "prev_latitude", "prev_longitude",
                       *[c for c in carry if c not in ("merchant_category", "latitude", "longitude", key)])


def _sliced_frames(rows: DataFrame, plan: skew.SplitPlan, windows: WindowSet, key: str, stats: str,
                   max_events: int | None, unique_all: bool) -> tuple[DataFrame, list[str]]:
    """Frames of entities in one slice, or in slices of at least the longest
    window: the rows with their features and ``_prev_lat, _prev_lon, _prev_us``."""
    base = rows.columns
    rows = skew.assign_split(rows, plan, replicate=True)
    entry = skew.entry_table(rows.where(~F.col("is_ctx")), plan, ["latitude", "longitude"])
    if not is_short(plan, max_events):
        rows = plan.spread(rows, key, "split")
    rows = rows.withColumn("_prev", _prev_chain(key))
    rows, feats = with_frames(rows, windows, key, F.col("amount"), F.col("merchant_id"), stats,
                              max_events, unique_all, plan)
    rows = rows.where(~F.col("is_ctx"))
    prev = {"lat": F.col("_prev.lat"), "lon": F.col("_prev.lon"), "us": F.col("_prev.us")}
    if entry is not None:
        e = entry.select(key, "split", *[F.col(f"d1.{c}").alias(f"_d1_{p}")
                                         for p, c in (("us", "us"), ("lat", "latitude"), ("lon", "longitude"))])
        # at most one row per slice; broadcast only under the checked bound
        rows = skew.join_null_safe(rows, e, [key, "split"], "left", plan.broadcast)
        inside = F.col("_prev").isNotNull()
        prev = {c: F.when(inside, v).otherwise(F.col(f"_d1_{c}")) for c, v in prev.items()}
    return rows.select(*base, *feats, *[v.alias(f"_prev_{c}") for c, v in prev.items()]), feats


def rolling_features_since(recent: DataFrame, last_known: DataFrame | None, since_us: int,
                           windows: WindowSet = DEFAULT, **kw) -> DataFrame:
    """Features of the events at or after ``since_us`` without scanning the
    whole history (the pushdown of SURVEY §4).

    ``recent`` must hold every event with ``us >= since_us - max(W)``: read it
    with a time bound on the source, so the bound reaches the scan.
    ``last_known`` (``entity_id, transaction_id, us, latitude, longitude``)
    is each entity's newest event before ``recent`` starts, typically the
    snapshot table. It joins the pass as a history row with no amount and no
    merchant, so it feeds only the previous-location chain: it is older than
    every frame that is emitted. The result equals ``rolling_features`` over
    the whole history, restricted to ``us >= since_us``.
    """
    rows = with_event_micros(recent)
    cols = ["entity_id", "transaction_id", "us", "amount", "merchant_id", "merchant_category",
            "latitude", "longitude"]
    rows = rows.select(*cols, (F.col("us") >= F.lit(since_us)).alias("_emit_since"))
    if last_known is not None:
        lk = last_known.select(
            "entity_id", "transaction_id", "us", F.lit(None).cast("double").alias("amount"),
            F.lit(None).cast("string").alias("merchant_id"), F.lit(None).cast("string").alias("merchant_category"),
            "latitude", "longitude", F.lit(False).alias("_emit_since"))
        rows = lk.unionByName(rows)
    return rolling_features(rows, windows, emit="_emit_since", **kw)


def snapshot_view(features: DataFrame, windows: WindowSet = DEFAULT) -> DataFrame:
    """The 23 snapshot fields of a feature log, in snapshot order."""
    return features.select(*windows.snapshot_columns())


def latest_per_entity(df: DataFrame, key: str = "entity_id",
                      order: tuple[str, ...] = ("us", "transaction_id")) -> DataFrame:
    """Newest row per entity by ``order``.

    ``max_by`` over a struct is a partial (map-side) aggregate, so a hot entity
    is reduced before the shuffle instead of being sorted in one task.
    """
    payload = [c for c in df.columns if c != key]
    ordk = F.struct(*[F.col(c) for c in order])
    best = df.groupBy(key).agg(F.max_by(F.struct(*[F.col(c) for c in payload]), ordk).alias("_r"))
    return best.select(key, *[F.col(f"_r.{c}").alias(c) for c in payload])
