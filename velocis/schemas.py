"""Fixed schemas, feature names and constants of the data model."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference for identical results.
# Merchant categories and their integer codes (declared, used by P8):
#   grocery 0, gas_station 1, restaurant 2, online 3, atm 4, travel 5,
#   retail 6, other 7
# Default rolling window lengths, seconds: 1, 5, 60
# Decision bands: p < 0.2 APPROVE (confidence 1-p); p < 0.5 REVIEW
#   (confidence 0.5); otherwise DECLINE (confidence p); is_fraud = p > 0.5
# Snapshot key prefix "fs:v1:"; snapshot time-to-live 300 s
# Earth radius 6371.0 km
# Histogram bucket upper bounds, seconds:
#   inference latency 0.001 0.002 0.005 0.01 0.025 0.05 0.1 0.25 0.5
#   feature latency   0.0001 0.0005 0.001 0.002 0.005 0.01
#   fraud score       0.1 0.2 0.3 0.4 0.5 0.6 0.7 0.8 0.9 1.0
# ---------------------------------------------------------------------------
CATEGORY_CODES = {
    "grocery": 0, "gas_station": 1, "restaurant": 2, "online": 3,
    "atm": 4, "travel": 5, "retail": 6, "other": 7,
}
DEFAULT_WINDOWS = (1, 5, 60)
APPROVE_BELOW = 0.2
REVIEW_BELOW = 0.5
DEFAULT_THRESHOLD = 0.5
SNAPSHOT_KEY_PREFIX = "fs:v1:"
SNAPSHOT_TTL_SECONDS = 300
EARTH_RADIUS_KM = 6371.0
INFERENCE_LATENCY_BUCKETS = (0.001, 0.002, 0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5)
FEATURE_LATENCY_BUCKETS = (0.0001, 0.0005, 0.001, 0.002, 0.005, 0.01)
SCORE_BUCKETS = (0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0)

# Guard for floating noise in the population std (decision Q3).
STD_EPSILON = 1e-9

TRANSACTION_SCHEMA = T.StructType([
    T.StructField("transaction_id", T.StringType()),
    T.StructField("entity_id", T.StringType()),
    T.StructField("amount", T.DoubleType()),
    T.StructField("merchant_id", T.StringType()),
    T.StructField("merchant_category", T.StringType()),
    T.StructField("latitude", T.DoubleType()),
    T.StructField("longitude", T.DoubleType()),
    T.StructField("timestamp_ms", T.LongType()),
    T.StructField("is_fraud", T.BooleanType()),
    T.StructField("fraud_type", T.StringType()),
])
REQUIRED_TRANSACTION_KEYS = ("transaction_id", "entity_id", "amount", "merchant_id",
                             "merchant_category", "latitude", "longitude", "timestamp_ms")
OPTIONAL_TRANSACTION_KEYS = ("is_fraud", "fraud_type")

REQUEST_SCHEMA = T.StructType([
    T.StructField("request_id", T.StringType()),
    T.StructField("transaction_id", T.StringType()),
    T.StructField("entity_id", T.StringType()),
    T.StructField("amount", T.DoubleType()),
    T.StructField("latitude", T.DoubleType()),
    T.StructField("longitude", T.DoubleType()),
    T.StructField("merchant_category", T.StringType()),
    T.StructField("request_ts", T.TimestampType()),
    T.StructField("include_features", T.BooleanType()),
    T.StructField("explain", T.BooleanType()),
    T.StructField("batch_id", T.StringType()),
])


@dataclass(frozen=True)
class WindowSet:
    """Three window lengths in seconds: short, medium, long.

    Feature columns follow the snapshot layout: the short window has
    sum/mean/std/count, the medium adds max, the long adds max and min.
    """

    short: int = 1
    medium: int = 5
    long: int = 60

    @property
    def lengths(self) -> tuple[int, int, int]:
        return (self.short, self.medium, self.long)

    def stats_for(self, w: int) -> tuple[str, ...]:
        base = ("sum", "mean", "std", "count")
        if w == self.long:
            return base + ("max", "min")
        if w == self.medium:
            return base + ("max",)
        return base

    def feature_columns(self) -> list[str]:
        """Snapshot feature names in model-vector order (20 entries)."""
        s, m, lg = self.lengths
        return [
            f"amount_sum_{s}s", f"amount_mean_{s}s", f"amount_std_{s}s", f"txn_count_{s}s",
            f"amount_sum_{m}s", f"amount_mean_{m}s", f"amount_std_{m}s", f"txn_count_{m}s",
            f"amount_max_{m}s",
            f"amount_sum_{lg}s", f"amount_mean_{lg}s", f"amount_std_{lg}s", f"txn_count_{lg}s",
            f"amount_max_{lg}s", f"amount_min_{lg}s",
            "amount_zscore", "velocity_change_ratio", f"unique_merchants_{lg}s",
            "geo_distance_delta", "current_amount",
        ]

    def snapshot_columns(self) -> list[str]:
        """The 23 snapshot fields: entity, time, 20 features, category."""
        return ["entity_id", "computed_at"] + self.feature_columns() + ["merchant_category"]


DEFAULT = WindowSet()
# Event-table windows for the driver data (users have ~1 event per 10 h).
HOURLY = WindowSet(3600, 6 * 3600, 24 * 3600)


def stat_column(stat: str, w: int) -> str:
    return f"txn_count_{w}s" if stat == "count" else f"amount_{stat}_{w}s"


def integer_feature(name: str) -> bool:
    return name.startswith("txn_count_") or name.startswith("unique_merchants_")
