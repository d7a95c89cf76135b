"""Scalar Column expressions (F1-F9). All JVM-side, no Python UDF."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from velocis.schemas import (
    APPROVE_BELOW, CATEGORY_CODES, DEFAULT_THRESHOLD, EARTH_RADIUS_KM, REVIEW_BELOW,
    SNAPSHOT_KEY_PREFIX, STD_EPSILON,
)


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def haversine_km(lat1, lon1, lat2, lon2) -> Column:
    """Great-circle distance in km (F1).

    A (0,0) origin means "no previous location" and gives 0; a (0,0)
    destination means "request without a location" and also gives 0 (Q6).
    Nulls on either side give 0. The root is clamped to 1 for float safety.
    """
    lat1, lon1, lat2, lon2 = map(_c, (lat1, lon1, lat2, lon2))
    dphi = F.radians(lat2 - lat1) / 2
    dlam = F.radians(lon2 - lon1) / 2
    a = F.sin(dphi) * F.sin(dphi) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.sin(dlam) * F.sin(dlam)
    d = F.lit(2.0 * EARTH_RADIUS_KM) * F.asin(F.sqrt(F.least(a, F.lit(1.0))))
    # least() skips nulls, so a null coordinate must be caught before it
    missing = (lat1.isNull() | lon1.isNull() | lat2.isNull() | lon2.isNull()
               | ((lat1 == 0) & (lon1 == 0)) | ((lat2 == 0) & (lon2 == 0)))
    return F.when(missing, F.lit(0.0)).otherwise(d)


def decision(p) -> Column:
    """APPROVE / REVIEW / DECLINE band of a probability (F2)."""
    p = _c(p)
    return (F.when(p < APPROVE_BELOW, F.lit("APPROVE"))
            .when(p < REVIEW_BELOW, F.lit("REVIEW"))
            .otherwise(F.lit("DECLINE")))


def confidence(p) -> Column:
    """Confidence of the band: 1-p, 0.5, or p (F2)."""
    p = _c(p)
    return (F.when(p < APPROVE_BELOW, 1.0 - p)
            .when(p < REVIEW_BELOW, F.lit(0.5))
            .otherwise(p))


def is_fraud(p, threshold: float = DEFAULT_THRESHOLD) -> Column:
    """Strict ``p > threshold``."""
    return _c(p) > F.lit(threshold)


def category_code(cat) -> Column:
    """Fixed merchant-category code; unknown categories map to ``other``."""
    kv = []
    for k, v in CATEGORY_CODES.items():
        kv += [F.lit(k), F.lit(v)]
    return F.coalesce(F.element_at(F.create_map(*kv), _c(cat)), F.lit(CATEGORY_CODES["other"]))


def snapshot_key(entity) -> Column:
    """``fs:v1:<entity>`` key of the latest-snapshot table."""
    return F.concat(F.lit(SNAPSHOT_KEY_PREFIX), _c(entity))


def merchant_key(category, number) -> Column:
    """``merch_<category>_<0000>`` merchant identifier."""
    return F.format_string("merch_%s_%04d", _c(category), _c(number).cast("int"))


def epoch_micros(ts) -> Column:
    """Epoch microseconds of an instant (TIMESTAMP); zone-free."""
    return F.unix_micros(_c(ts))


def ntz_epoch_micros(ts) -> Column:
    """Epoch microseconds of a TIMESTAMP_NTZ column, its wall time read as
    UTC. Built from date and time-of-day parts, which involve no time zone
    (a cast to TIMESTAMP would use the session zone and its DST shifts)."""
    ts = _c(ts)
    day_us = F.unix_date(ts.cast("date")).cast("long") * F.lit(86_400_000_000)
    tod_us = (F.hour(ts).cast("long") * 3_600_000_000 + F.minute(ts).cast("long") * 60_000_000
              + (F.extract(F.lit("SECOND"), ts) * 1_000_000).cast("long"))
    return day_us + tod_us


def epoch_millis(ts) -> Column:
    """Epoch milliseconds of an instant, truncating."""
    return F.unix_millis(_c(ts))


def from_epoch_millis(ms) -> Column:
    """Epoch milliseconds to an instant."""
    return F.timestamp_millis(_c(ms))


def zscore(x, mean, std) -> Column:
    """(x - mean) / std, 0 when std is (numerically) zero."""
    x, mean, std = map(_c, (x, mean, std))
    return F.when(std >= STD_EPSILON, (x - mean) / std).otherwise(F.lit(0.0))


def velocity_ratio(count_short, count_long) -> Column:
    """count_short / max(count_long, 1) * 60."""
    return _c(count_short).cast("double") / F.greatest(_c(count_long), F.lit(1)).cast("double") * 60.0


def explanation_map(names: Sequence[str], importances: Sequence[float], vector) -> Column:
    """importance * |value| per feature name (F4); ``vector`` is an array column."""
    imp = F.array(*[F.lit(float(v)) for v in importances])
    vals = F.zip_with(imp, _c(vector), lambda i, v: (i * F.abs(v)).cast("float"))
    return F.map_from_arrays(F.array(*[F.lit(n) for n in names]), vals)
