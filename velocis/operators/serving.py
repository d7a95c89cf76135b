"""Point-in-time serving.

As-of joins are expressed as *union and window*: probe rows (requests) and
build rows (events or snapshots) are unioned with a side flag, shuffled once
by (entity, split), sorted by time, and each probe row reads the aggregates
of the build rows in its frame. No range join, no pair blow-up, one
exchange. Hot entities are split in time exactly like the rolling features
(``velocis.operators.skew``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from velocis.functions.scalar import haversine_km, velocity_ratio, zscore
from velocis.operators import skew
from velocis.operators.rolling import MICROS, _frame_rows, _prev_chain, is_short, with_frames
from velocis.schemas import DEFAULT, WindowSet


def _request_rows(requests: DataFrame, key: str, carry: tuple[str, ...] = ()) -> DataFrame:
    return requests.select(
        F.col(key), F.unix_micros(F.col("request_ts")).alias("us"), F.lit(1).alias("side"),
        F.coalesce(F.col("transaction_id"), F.col("request_id")).alias("tid"),
        "amount", F.lit(None).cast("string").alias("merchant_id"), "merchant_category",
        F.coalesce(F.col("latitude"), F.lit(0.0)).alias("latitude"),
        F.coalesce(F.col("longitude"), F.lit(0.0)).alias("longitude"),
        F.col("request_id"), F.struct(*[F.col(c) for c in carry] or [F.lit(0).alias("none")]).alias("_carry"))


def _union_pass(events: DataFrame, requests: DataFrame, windows: WindowSet, key: str,
                hot_rows: int | None, snapshot_age_us: int | None, carry: tuple[str, ...] = ()) -> DataFrame:
    """One shuffle of events + requests by (entity, split), one sort, and
    window nodes that all reuse it. Returns the request rows with live
    features (and, with ``snapshot_age_us``, the snapshot of the newest event
    at or before the request, i.e. that event's own features)."""
    rq = _request_rows(requests, key, carry)
    ev = _frame_rows(events, key).withColumns({
        "request_id": F.lit(None).cast("string"), "_carry": F.lit(None).cast(rq.schema["_carry"].dataType)})
    long_us = max(windows.lengths) * MICROS
    # a snapshot event up to ``snapshot_age_us`` before the slice start needs
    # its own frames complete, so the context reaches back that much further
    context = long_us + (snapshot_age_us or 0)
    # hot keys are counted over events and requests together: an entity with
    # few events but a flood of requests must be split as well
    plan = skew.plan_splits(ev.select(key, "us").unionByName(rq.select(key, "us")), key, context, hot_rows)
    rows = skew.assign_split(ev, plan, replicate=True).unionByName(
        skew.assign_split(rq, plan, replicate=False))

    entry = skew.entry_table(skew.assign_split(ev, plan, replicate=False), plan,
                             ["latitude", "longitude"], second=True)
    loc = lambda s: F.struct(F.col(f"{s}.tid").alias("tid"), F.col(f"{s}.latitude").alias("lat"),
                             F.col(f"{s}.longitude").alias("lon"), F.col(f"{s}.us").alias("us"))
    if entry is not None:
        e = entry.select(key, "split", loc("d1").alias("_d1"), loc("d2").alias("_d2"))
        rows = skew.join_null_safe(rows, e, [key, "split"], "left", plan.broadcast)
    else:
        null_loc = F.lit(None).cast("struct<tid:string,lat:double,lon:double,us:bigint>")
        rows = rows.withColumn("_d1", null_loc).withColumn("_d2", null_loc)

    if not is_short(plan):
        rows = plan.spread(rows, key, "split")
    is_ev = F.col("side") == 0
    rows = rows.withColumn("_p1", F.coalesce(_prev_chain(key), F.col("_d1")))
    w_prev = (Window.partitionBy(key, "split").orderBy("us", "side", "tid")
              .rowsBetween(Window.unboundedPreceding, -1))
    cand = F.when(is_ev, F.struct(F.col("tid"), F.col("latitude").alias("lat"),
                                  F.col("longitude").alias("lon"), F.col("_p1").alias("p")))
    rows = rows.withColumn("_c", F.last(cand, ignorenulls=True).over(w_prev))
    rows, _ = with_frames(rows, windows, key, F.when(is_ev, F.col("amount")), F.when(is_ev, F.col("merchant_id")),
                          plan=plan)

    # requests: newest event before t, in this slice (_c) or before it (_d1,
    # whose own predecessor is _d2), skipped once if it is the scored
    # transaction. Events: their own predecessor (_p1).
    c_lat = F.coalesce(F.col("_c.lat"), F.col("_d1.lat"))
    c_lon = F.coalesce(F.col("_c.lon"), F.col("_d1.lon"))
    c_tid = F.coalesce(F.col("_c.tid"), F.col("_d1.tid"))
    p_lat = F.when(F.col("_c").isNotNull(), F.col("_c.p.lat")).otherwise(F.col("_d2.lat"))
    p_lon = F.when(F.col("_c").isNotNull(), F.col("_c.p.lon")).otherwise(F.col("_d2.lon"))
    self_hit = c_tid.isNotNull() & (c_tid == F.col("tid"))
    rq_lat = F.when(self_hit, p_lat).otherwise(c_lat)
    rq_lon = F.when(self_hit, p_lon).otherwise(c_lon)
    rows = rows.withColumn("prev_latitude", F.when(is_ev, F.col("_p1.lat")).otherwise(rq_lat)) \
               .withColumn("prev_longitude", F.when(is_ev, F.col("_p1.lon")).otherwise(rq_lon))

    lg, sh = windows.long, windows.short
    rows = rows.withColumns({
        "amount_zscore": zscore(F.col("amount"), F.col(f"amount_mean_{lg}s"), F.col(f"amount_std_{lg}s")),
        "velocity_change_ratio": velocity_ratio(F.col(f"txn_count_{sh}s"), F.col(f"txn_count_{lg}s")),
        "geo_distance_delta": haversine_km("prev_latitude", "prev_longitude", "latitude", "longitude"),
        "current_amount": F.col("amount"),
    })
    if snapshot_age_us is not None:
        fcols = [c for c in windows.feature_columns() if c != "current_amount"]
        snap = F.when(is_ev, F.struct(F.col("us").alias("us"), *[F.col(c) for c in fcols]))
        w_snap = (Window.partitionBy(key, "split").orderBy("us", "side", "tid")
                  .rowsBetween(Window.unboundedPreceding, -1))
        rows = rows.withColumn("_snap", F.last(snap, ignorenulls=True).over(w_snap))
        rows = rows.withColumn("_snap", F.when(F.col("us") - F.col("_snap.us") <= F.lit(snapshot_age_us),
                                               F.col("_snap")))
    return rows.where(F.col("side") == 1)


def point_in_time_features(events: DataFrame, requests: DataFrame, windows: WindowSet = DEFAULT,
                           key: str = "entity_id",
                           hot_rows: int | str | None = skew.AUTO) -> DataFrame:
    """Live features for every request as of ``request_ts``.

    Window statistics cover the entity's events in ``[t - W, t]`` (the
    scored transaction counts if it is already in the history, as on the
    reference's live path). The previous location is the newest event at or
    before ``t`` other than the scored transaction itself. Requests of
    entities without history get all-zero features (J5 semantics).

    Output: ``request_id, transaction_id, entity_id, us`` + 20 features +
    ``merchant_category, latitude, longitude, prev_latitude, prev_longitude``.
    """
    rows = _union_pass(events, requests, windows, key, hot_rows, None)
    return rows.select("request_id", F.col("tid").alias("transaction_id"), key, "us",
                       *windows.feature_columns(), "merchant_category", "latitude", "longitude",
                       "prev_latitude", "prev_longitude")


def asof_join(probe: DataFrame, build: DataFrame, key: str, probe_us: Column | str,
              build_us: Column | str, payload: list[str], max_age_us: int | None = None,
              hot_rows: int | str | None = skew.AUTO, prefix: str = "") -> DataFrame:
    """For each probe row, the newest build row of the same key at or before
    the probe time (J3), optionally no older than ``max_age_us``.

    Adds ``payload`` columns (prefixed) and ``<prefix>asof_us``; all null on a
    miss. Build rows at exactly the probe time match.
    """
    pu = F.col(probe_us) if isinstance(probe_us, str) else probe_us
    bu = F.col(build_us) if isinstance(build_us, str) else build_us
    pcols = probe.columns
    b = build.select(F.col(key), bu.alias("us"), F.lit(0).alias("side"),
                     F.struct(bu.alias("us"), *[F.col(c) for c in payload]).alias("_rec"))
    p = probe.select(F.col(key), pu.alias("us"), F.lit(1).alias("side"), F.lit(None).cast(
        b.schema["_rec"].dataType).alias("_rec"), F.struct(*[F.col(c) for c in pcols]).alias("_probe"))
    b = b.withColumn("_probe", F.lit(None).cast(p.schema["_probe"].dataType))
    plan = skew.plan_splits(b.select(key, "us").unionByName(p.select(key, "us")), key, 0, hot_rows)
    rows = skew.assign_split(b, plan, replicate=False).unionByName(skew.assign_split(p, plan, replicate=False))
    w = (Window.partitionBy(key, "split").orderBy("us", "side")
         .rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("_hit", F.last("_rec", ignorenulls=True).over(w)).where(F.col("side") == 1)
    if plan.hot is not None:
        ent = skew.entry_table(
            skew.assign_split(b.withColumn("tid", F.lit("")), plan, replicate=False),
            plan, ["_rec"])
        e = ent.select(key, "split", F.col("d1._rec").alias("_d1"))
        rows = skew.join_null_safe(rows, e, [key, "split"], "left", plan.broadcast) \
                   .withColumn("_hit", F.coalesce("_hit", "_d1"))
    if max_age_us is not None:
        rows = rows.withColumn("_hit", F.when(F.col("us") - F.col("_hit.us") <= F.lit(max_age_us),
                                              F.col("_hit")))
    out = [F.col(f"_probe.{c}").alias(c) for c in pcols]
    out += [F.col(f"_hit.{c}").alias(prefix + c) for c in payload]
    out.append(F.col("_hit.us").alias(prefix + "asof_us"))
    return rows.select(*out)


def serve_from_snapshot(requests: DataFrame, latest: DataFrame, windows: WindowSet = DEFAULT,
                        key: str = "entity_id") -> DataFrame:
    """Requests left-joined to the latest snapshot per entity.

    Absent entities get an all-zero feature row. The request overlays
    ``current_amount`` and ``merchant_category`` (snapshot mode, Q9: the
    stored z-score and distance stay those of the last ingest). The snapshot
    table has one row per entity; the join is planned by Spark (broadcast
    only when AQE measures it small).
    """
    feats = [c for c in windows.feature_columns() if c != "current_amount"]
    snap = latest.select(key, *[F.col(c).alias(f"_s_{c}") for c in feats])
    j = requests.join(snap, key, "left")
    cols = []
    for c in feats:
        zero = F.lit(0) if c.startswith(("txn_count", "unique_merchants")) else F.lit(0.0)
        cols.append(F.coalesce(F.col(f"_s_{c}"), zero).alias(c))
    found = F.col(f"_s_txn_count_{windows.long}s").isNotNull()
    return j.select("request_id", "transaction_id", key, *cols,
                    F.col("amount").alias("current_amount"),
                    F.coalesce("merchant_category", F.lit("other")).alias("merchant_category"),
                    found.alias("snapshot_found"))


def serve_tiered(events: DataFrame, features: DataFrame | None, requests: DataFrame,
                 windows: WindowSet = DEFAULT, max_age_s: float = 300.0, key: str = "entity_id",
                 hot_rows: int | str | None = skew.AUTO, carry: tuple[str, ...] = ()) -> DataFrame:
    """Snapshot tier, else live compute (J4), with the tier that answered.

    A request is answered from the newest snapshot at or before
    ``request_ts`` when it is at most ``max_age_s`` old (J3, the staleness
    bound of Q10), else the features are computed live as of the request
    (J2). In both cases the request overlays ``current_amount`` and
    ``merchant_category`` (P5, Q9: the snapshot keeps its stored z-score).

    With ``features=None`` the snapshots are the feature rows of ``events``
    themselves and everything runs in one union-and-window pass (one
    shuffle). With a snapshot table ``features`` (one row per snapshot) the
    as-of join follows the live pass on its rows. Nothing is joined by request
    id: N requests in, N rows out, repeated or absent ids included. ``carry``
    passes request columns through.
    """
    fcols = [c for c in windows.feature_columns() if c != "current_amount"]
    age_us = int(max_age_s * MICROS)
    rows = _union_pass(events, requests, windows, key, hot_rows, age_us if features is None else None, carry)
    snap_us = F.col("_snap.us")
    if features is not None:
        live = rows.select("request_id", "tid", key, "us", *fcols, "amount", "merchant_category", "_carry")
        rows = asof_join(live, features, key, "us", "us", fcols, max_age_us=age_us, hot_rows=hot_rows, prefix="s_")
        rows = rows.withColumn("_snap", F.when(F.col("s_asof_us").isNotNull(), F.struct(
            F.col("s_asof_us").alias("us"), *[F.col(f"s_{c}").alias(c) for c in fcols])))
    hit = F.col("_snap").isNotNull()
    out = [F.when(hit, F.col(f"_snap.{c}")).otherwise(F.col(c)).alias(c) for c in fcols]
    return rows.select("request_id", F.col("tid").alias("transaction_id"), key, *out,
                       F.col("amount").alias("current_amount"),
                       F.coalesce("merchant_category", F.lit("other")).alias("merchant_category"),
                       F.when(hit, F.lit("snapshot")).otherwise(F.lit("live")).alias("served_from"),
                       F.when(hit, (F.col("us") - snap_us) / MICROS).alias("snapshot_age_s"),
                       *[F.col(f"_carry.{c}").alias(c) for c in carry])


def cold_entities(requests: DataFrame, events: DataFrame, key: str = "entity_id") -> DataFrame:
    """Requests whose entity has no history at all (J5). The event side is
    reduced to distinct keys first (a partial aggregate), so a hot entity
    sends one row per map task, not all its events."""
    return requests.join(events.select(key).distinct(), key, "left_anti")


def project_features(df: DataFrame, fields: list[str] | None, key: str = "entity_id") -> DataFrame:
    """Chosen fields plus the key; empty = all; unknown names ignored."""
    if not fields:
        return df
    wanted = set(fields)
    return df.select(*[c for c in df.columns if c == key or c in wanted])
