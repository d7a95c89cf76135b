"""Literal transaction rows for the unit tests (FIXTURES.md section 2)."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from velocis.schemas import EARTH_RADIUS_KM

T0 = 1_700_000_000  # as-of time t, epoch seconds


def txn_df(spark, rows):
    """rows: (entity, tid, ts_seconds, amount[, merchant[, lat, lon[, category]]])."""
    out = []
    for r in rows:
        e, tid, ts, amt = r[:4]
        mer = r[4] if len(r) > 4 else "m1"
        lat, lon = (r[5], r[6]) if len(r) > 6 else (0.0, 0.0)
        cat = r[7] if len(r) > 7 else "other"
        num = lambda v: None if v is None else float(v)
        out.append((e, tid, num(amt), mer, cat, num(lat), num(lon), int(round(ts * 1_000_000))))
    df = spark.createDataFrame(out, "entity_id string, transaction_id string, amount double, merchant_id string, "
                                    "merchant_category string, latitude double, longitude double, us long")
    return df.withColumn("event_ts", F.timestamp_micros("us"))


def request_df(spark, rows):
    """rows: (request_id, entity, ts_seconds, amount[, lat, lon[, tid]])."""
    out = []
    for r in rows:
        rid, e, ts, amt = r[:4]
        lat, lon = (r[4], r[5]) if len(r) > 5 else (0.0, 0.0)
        tid = r[6] if len(r) > 6 else None
        out.append((rid, tid, e, float(amt), float(lat), float(lon), "other", int(round(ts * 1_000_000)),
                    False, False, "b0"))
    df = spark.createDataFrame(out, "request_id string, transaction_id string, entity_id string, amount double, "
                                    "latitude double, longitude double, merchant_category string, rus long, "
                                    "include_features boolean, explain boolean, batch_id string")
    return df.withColumn("request_ts", F.timestamp_micros("rus")).drop("rus")


def brute_features(events, t, own_tid, windows, max_events=None, amount=None, cat=None):
    """Plain-Python reference of one feature row as of ``t``."""
    ev = sorted(events, key=lambda r: (r["us"], r["tid"]))
    res = {}
    for w in windows.lengths:
        fr = [r for r in ev if t - w * 1_000_000 <= r["us"] <= t]
        if max_events and len(fr) > max_events:
            upto = [r for r in ev if (r["us"], r["tid"]) <= (t, own_tid)]
            fr = upto[-max_events:]
        a = [r["amount"] for r in fr]
        n = len(a)
        mean = sum(a) / n if n else 0.0
        std = math.sqrt(sum((x - mean) ** 2 for x in a) / n) if n > 1 else 0.0
        res[f"txn_count_{w}s"] = n
        res[f"amount_sum_{w}s"] = sum(a)
        res[f"amount_mean_{w}s"] = mean
        res[f"amount_std_{w}s"] = std
        res[f"amount_max_{w}s"] = max(a) if a else 0.0
        res[f"amount_min_{w}s"] = min(a) if a else 0.0
        res[f"unique_merchants_{w}s"] = len({r["merchant"] for r in fr})
    return res


def haversine(lat1, lon1, lat2, lon2):
    if lat1 is None or (lat1 == 0 and lon1 == 0) or (lat2 == 0 and lon2 == 0):
        return 0.0
    p1, p2 = math.radians(lat1), math.radians(lat2)
    dp, dl = math.radians(lat2 - lat1), math.radians(lon2 - lon1)
    a = math.sin(dp / 2) ** 2 + math.cos(p1) * math.cos(p2) * math.sin(dl / 2) ** 2
    return 2 * EARTH_RADIUS_KM * math.asin(math.sqrt(min(a, 1.0)))
