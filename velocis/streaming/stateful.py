"""Per-entity rolling features on a stream.

``transformWithState`` keyed by entity, over rows: most entities have few in a
micro-batch, and a table an entity costs more than its frames. State per entity:

* ``events`` (ListState): the entity's events that a future frame can still
  reach: within the longest window (plus the allowed lateness) of the newest
  event, and at most ``max_events`` rows when history is capped;
* ``meta`` (ValueState): newest event time seen, and the newest *evicted*
  event (time, id, location), which is the previous location when the kept
  rows hold none before a new row.

Each micro-batch's rows of one entity are sorted by ``(us, transaction_id)``
and processed in that order; frames are ``[t - W, t]`` over kept and new rows,
the same definition as the batch operator, so an in-order stream gives the
batch result row by row. Rows later than the watermark are dropped by Spark;
rows older than the entity's newest event but within the watermark are
scored as of their own time and never change snapshots already emitted.

Idle expiry (T6): with ``idle_ttl_s`` a gap longer than the TTL since the
entity's newest event clears the state first (so the batch operator with the
same ``idle_ttl_s`` agrees), and an event-time timer clears entities that
never return.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Row
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from velocis.session import ship_package
from velocis.schemas import DEFAULT, EARTH_RADIUS_KM, STD_EPSILON, WindowSet, integer_feature

INPUT_COLS = ["entity_id", "transaction_id", "us", "amount", "merchant_id", "merchant_category", "latitude", "longitude"]
EVENT_STATE = T.StructType([
    T.StructField("us", T.LongType()), T.StructField("tid", T.StringType()),
    T.StructField("amount", T.DoubleType()), T.StructField("lat", T.DoubleType()),
    T.StructField("lon", T.DoubleType()), T.StructField("merchant", T.StringType()),
])
META_STATE = T.StructType([
    T.StructField("max_us", T.LongType()), T.StructField("ev_us", T.LongType()),
    T.StructField("ev_tid", T.StringType()), T.StructField("ev_lat", T.DoubleType()),
    T.StructField("ev_lon", T.DoubleType()), T.StructField("timer_ms", T.LongType()),
])


def output_schema(windows: WindowSet = DEFAULT) -> T.StructType:
    fs = [T.StructField("entity_id", T.StringType()), T.StructField("transaction_id", T.StringType()),
          T.StructField("us", T.LongType())]
    for c in windows.feature_columns():
        fs.append(T.StructField(c, T.IntegerType() if integer_feature(c) else T.DoubleType()))
    fs += [T.StructField("merchant_category", T.StringType()), T.StructField("latitude", T.DoubleType()),
           T.StructField("longitude", T.DoubleType()), T.StructField("prev_latitude", T.DoubleType()),
           T.StructField("prev_longitude", T.DoubleType())]
    return T.StructType(fs)


def _haversine(lat1, lon1, lat2, lon2) -> np.ndarray:
    r = np.radians
    a = (np.sin(r(lat2 - lat1) / 2) ** 2
         + np.cos(r(lat1)) * np.cos(r(lat2)) * np.sin(r(lon2 - lon1) / 2) ** 2)
    km = 2.0 * EARTH_RADIUS_KM * np.arcsin(np.sqrt(np.minimum(a, 1.0)))
    return np.where(np.isnan(km) | ((lat1 == 0) & (lon1 == 0)) | ((lat2 == 0) & (lon2 == 0)), 0.0, km)


#: Values of frames looked at together.
FRAME_VALUES = 1 << 20


def frame_statistics(amount: np.ndarray, lo: np.ndarray, hi: np.ndarray, merchants: np.ndarray | None) -> dict:
    """Statistics of the (non-empty) frames ``amount[lo:hi]``; nulls (nan) do
    not count. ``merchants`` are codes, -1 for none, of which ``uniq`` counts the
    different ones. Frames are laid end to end, ``FRAME_VALUES`` at a time."""
    size = hi - lo
    parts, k = [], 0
    while k < len(lo):
        z = max(k + 1, int(np.searchsorted(np.cumsum(size[k:]), FRAME_VALUES, side="right")) + k)
        parts.append(_frame_statistics(amount, lo[k:z], size[k:z], merchants))
        k = z
    if len(parts) == 1:
        return parts[0]
    names = parts[0] if parts else _frame_statistics(amount, lo, size, merchants)
    return {c: np.concatenate([p[c] for p in parts]) if parts else names[c] for c in names}


def _frame_statistics(amount, lo, size, merchants) -> dict:
    n = len(lo)
    start = np.cumsum(size) - size
    frame = np.repeat(np.arange(n), size)
    at = np.arange(len(frame)) + np.repeat(lo - start, size)
    x = amount[at]
    there = ~np.isnan(x)
    k = np.bincount(frame[there], minlength=n)
    some = np.maximum(k, 1)
    total = np.bincount(frame[there], weights=x[there], minlength=n)
    mean = total / some
    spread = np.bincount(frame[there], weights=(x[there] - mean[frame[there]]) ** 2, minlength=n)
    out = {"count": k, "sum": total, "mean": mean, "std": np.where(k > 1, np.sqrt(spread / some), 0.0)}
    if n:
        out["max"] = np.where(k > 0, np.maximum.reduceat(np.where(there, x, -np.inf), start), 0.0)
        out["min"] = np.where(k > 0, np.minimum.reduceat(np.where(there, x, np.inf), start), 0.0)
    else:
        out["max"] = out["min"] = np.zeros(0)
    if merchants is not None:
        code = merchants[at]
        width = int(merchants.max(initial=0)) + 1
        out["uniq"] = np.bincount(np.unique(frame[code >= 0] * width + code[code >= 0]) // width, minlength=n)
    return out


def _or_none(v) -> float | None:
    return None if v is None or v != v else float(v)


class RollingFeatureProcessor(StatefulProcessor):
    """Stateful per-entity rolling features; see the module docstring."""

    def __init__(self, windows: WindowSet = DEFAULT, max_events: int | None = None,
                 lateness_s: float = 0.0, idle_ttl_s: float | None = None, timers: bool = False):
        if idle_ttl_s is not None and idle_ttl_s < max(windows.lengths):
            raise ValueError("idle_ttl_s must be at least the longest window")
        self.windows = windows
        self.max_events = max_events
        self.keep_us = int((max(windows.lengths) + lateness_s) * 1_000_000)
        self.idle_us = int(idle_ttl_s * 1_000_000) if idle_ttl_s else None
        self.timers = timers
        self.row = Row(*output_schema(windows).fieldNames())

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.events = handle.getListState("events", EVENT_STATE)
        self.meta = handle.getValueState("meta", META_STATE)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        # one array a column: a DataFrame an entity costs more than its frames
        new = dict(zip(INPUT_COLS, zip(*[[r[c] for c in INPUT_COLS] for r in rows])))
        meta = self.meta.get()
        names = EVENT_STATE.fieldNames()
        st = dict(zip(names, zip(*self.events.get()))) or {c: () for c in names}
        n_old = len(st["us"])

        def column(old, fresh, kind):
            return np.concatenate([np.array(st[old], dtype=kind), np.array(new[fresh], dtype=kind)])

        us, tid = column("us", "us", np.int64), column("tid", "transaction_id", object)
        tid = np.array([str(x) for x in tid], dtype=object)
        amt, lat, lon = column("amount", "amount", float), column("lat", "latitude", float), column("lon", "longitude", float)
        mer = column("merchant", "merchant_id", object)
        src = np.concatenate([np.full(n_old, -1), np.arange(len(new["us"]))])   # row of ``new`` or -1 for state
        # one sort per batch: kept and new rows in (time, id) order
        order = np.lexsort((tid, us))
        us, tid, amt, lat, lon, mer, src = (a[order] for a in (us, tid, amt, lat, lon, mer, src))
        n = len(us)
        # idle expiry: a gap longer than the TTL starts a new segment
        seg = np.zeros(n, dtype=np.int64)
        ev = (meta[1], meta[2], meta[3], meta[4]) if meta else (None, None, None, None)
        if self.idle_us is not None and n:
            gaps = np.nonzero(np.diff(us) > self.idle_us)[0] + 1
            if len(gaps):
                seg = np.maximum.accumulate(np.where(np.isin(np.arange(n), gaps), np.arange(n), 0))
            if ev[0] is not None and us[0] - ev[0] > self.idle_us:
                ev = (None, None, None, None)
        ws = self.windows
        lg, sh = ws.long, ws.short
        at = np.nonzero(src >= 0)[0]
        after = np.searchsorted(us, us[at], side="right")       # RANGE peers included
        code = {m: k for k, m in enumerate({m for m in mer if isinstance(m, str)})}
        merchants = np.array([code.get(m, -1) if isinstance(m, str) else -1 for m in mer], dtype=np.int64)
        rec = {"transaction_id": tid[at], "us": us[at]}
        for w_s in ws.lengths:
            lo, hi = np.maximum(np.searchsorted(us, us[at] - w_s * 1_000_000, side="left"), seg[at]), after
            if self.max_events:
                over = hi - lo > self.max_events
                lo, hi = np.where(over, np.maximum(at - self.max_events + 1, 0), lo), np.where(over, at + 1, hi)
            stats = frame_statistics(amt, lo, hi, merchants if w_s == lg else None)
            for s_ in ws.stats_for(w_s):
                rec[f"txn_count_{w_s}s" if s_ == "count" else f"amount_{s_}_{w_s}s"] = stats[s_]
            if w_s == lg:
                rec[f"unique_merchants_{w_s}s"] = stats["uniq"]
        sd, here = rec[f"amount_std_{lg}s"], amt[at]
        scored = (sd >= STD_EPSILON) & ~np.isnan(here)
        rec["amount_zscore"] = np.where(scored, (here - rec[f"amount_mean_{lg}s"]) / np.where(scored, sd, 1.0), 0.0)
        rec["velocity_change_ratio"] = rec[f"txn_count_{sh}s"] / np.maximum(rec[f"txn_count_{lg}s"], 1) * 60.0
        inside = at - 1 >= seg[at]
        plat, plon = np.where(inside, lat[at - 1], np.nan), np.where(inside, lon[at - 1], np.nan)
        if len(at) and at[0] == 0 and ev[0] is not None and (ev[0], ev[1]) < (us[0], tid[0]):
            # only if it is earlier: a late row may be older
            plat[0], plon[0] = (np.nan if v is None else v for v in ev[2:])
        rec["geo_distance_delta"] = _haversine(plat, plon, lat[at], lon[at])
        rec["current_amount"] = np.where(np.isnan(here), 0.0, here)
        rec["merchant_category"] = np.array(new["merchant_category"], dtype=object)[src[at]]
        rec["latitude"], rec["longitude"], rec["prev_latitude"], rec["prev_longitude"] = lat[at], lon[at], plat, plon
        values = {c: v.tolist() for c, v in rec.items()}
        for c in ("latitude", "longitude", "prev_latitude", "prev_longitude"):
            values[c] = [_or_none(v) for v in values[c]]
        values["entity_id"] = [key[0]] * len(at)
        out = [self.row(*r) for r in zip(*(values[c] for c in self.row))]
        last = int(seg[-1]) if n else 0
        if last > 0:
            ev = (None, None, None, None)
        self._update_state(us[last:], tid[last:], amt[last:], lat[last:], lon[last:], mer[last:], meta, ev)
        yield from out

    def _update_state(self, us, tid, amt, lat, lon, mer, meta, ev) -> None:
        """Rows arrive sorted by (us, tid). Keep what a future frame can reach;
        remember the newest dropped row as the previous location."""
        max_us = int(max(us[-1], meta[0] if meta else us[-1]))
        keep = us >= max_us - self.keep_us
        if self.max_events:
            keep[: max(len(us) - self.max_events, 0)] = False
        gone = np.nonzero(~keep)[0]
        if len(gone):
            g = gone[-1]
            if ev[0] is None or (us[g], tid[g]) > (ev[0], ev[1]):
                ev = (int(us[g]), str(tid[g]), _or_none(lat[g]), _or_none(lon[g]))
        kept = np.nonzero(keep)[0]
        if not len(kept):
            self.events.clear()
        else:  # in place of the old rows
            self.events.put([(int(us[k]), str(tid[k]), _or_none(amt[k]), _or_none(lat[k]), _or_none(lon[k]),
                              mer[k] if isinstance(mer[k], str) else None) for k in kept])
        timer = meta[5] if meta else None
        if self.timers and self.idle_us is not None:
            new_timer = (max_us + self.idle_us) // 1000
            if timer is not None and timer != new_timer:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(new_timer)
            timer = new_timer
        self.meta.update((max_us, ev[0], ev[1], ev[2], ev[3], timer))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.events.clear()
        self.meta.clear()
        yield from ()

    def close(self) -> None:
        pass


def rolling_features_stateful(txn: DataFrame, windows: WindowSet = DEFAULT, max_events: int | None = None,
                              lateness_s: float = 0.0, idle_ttl_s: float | None = None,
                              event_time: bool = False) -> DataFrame:
    """Apply the stateful processor to a (streaming) transaction DataFrame
    with ``us`` and ``event_ts`` columns. With ``event_time`` the stream must
    carry a watermark on ``event_ts`` and idle timers are enabled."""
    src = txn.select(*INPUT_COLS, "event_ts") if event_time else txn.select(*INPUT_COLS)
    spark = txn.sparkSession
    ship_package(spark)
    provider = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    if "RocksDB" not in (spark.conf.get("spark.sql.streaming.stateStore.providerClass", "") or ""):
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", provider)
    # the state-store coordinator lives in the streaming query manager; make
    # sure it exists when the processor runs on a static DataFrame
    _ = spark.streams.active
    proc = RollingFeatureProcessor(windows, max_events, lateness_s, idle_ttl_s, timers=event_time)
    return src.groupBy("entity_id").transformWithState(
        statefulProcessor=proc, outputStructType=output_schema(windows), outputMode="Append",
        timeMode="EventTime" if event_time else "None")
