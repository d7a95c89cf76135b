"""Decoding, validation and ingest defaults.

Strict decode: a message is accepted only if it is valid JSON, holds every
required key, no unknown key, and the typed fields parse. Everything else is
kept, with a reason, in the quarantine output (decision Q16: syntax errors
are quarantined too, never raised). ``from_json`` into the schema alone
would silently accept missing and extra keys, so keys come from a second
parse into a string map.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from velocis.schemas import OPTIONAL_TRANSACTION_KEYS, REQUIRED_TRANSACTION_KEYS, TRANSACTION_SCHEMA

REASONS = ("malformed_json", "missing_keys", "extra_keys", "null_value", "bad_type")


def validate(raw: DataFrame, col: str = "value", schema=TRANSACTION_SCHEMA,
             required=REQUIRED_TRANSACTION_KEYS, optional=OPTIONAL_TRANSACTION_KEYS) -> DataFrame:
    """Adds ``txn`` (parsed struct), ``reason`` (null when valid) and
    ``missing`` (array of absent required keys).

    Two parses per message: once into ``map<string,string>`` (keys and raw
    values; null for bad syntax or a non-object) and once into the typed
    schema. A required key that is JSON ``null`` has no value; one whose raw
    value is present but whose typed value is null has the wrong type."""
    raw_map = F.from_json(F.col(col), T.MapType(T.StringType(), T.StringType()))
    keys = F.map_keys(raw_map)
    req = F.array(*[F.lit(k) for k in required])
    allowed = F.array(*[F.lit(k) for k in list(required) + list(optional)])
    parsed = F.from_json(F.col(col), schema, {"mode": "PERMISSIVE"})
    no_keys = F.array().cast("array<string>")
    missing = F.array_except(req, F.coalesce(keys, no_keys))
    extra = F.array_except(F.coalesce(keys, no_keys), allowed)
    typed_null, null_value = F.lit(False), F.lit(False)
    for f in schema.fields:
        if f.name in required:
            null_value = null_value | raw_map[f.name].isNull()
            typed_null = typed_null | (raw_map[f.name].isNotNull() & parsed[f.name].isNull())
    reason = (F.when(raw_map.isNull(), F.lit("malformed_json"))
              .when(F.size(missing) > 0, F.lit("missing_keys"))
              .when(F.size(extra) > 0, F.lit("extra_keys"))
              .when(null_value, F.lit("null_value"))
              .when(typed_null, F.lit("bad_type")))
    return raw.withColumns({"txn": parsed, "reason": reason, "missing": missing})


def decode_transactions(raw: DataFrame, col: str = "value") -> tuple[DataFrame, DataFrame]:
    """(good transactions, quarantine rows with ``reason``) from JSON text."""
    v = validate(raw, col)
    good = v.where(F.col("reason").isNull()).select("txn.*")
    good = good.withColumns({"is_fraud": F.coalesce("is_fraud", F.lit(False)),
                             "fraud_type": F.coalesce("fraud_type", F.lit("none"))})
    bad = v.where(F.col("reason").isNotNull()).select(F.col(col).alias("raw"), "reason", "missing")
    return good, bad


def stamp_event_time(df: DataFrame, ms_col: str = "timestamp_ms", arrival: Column | None = None,
                     out: str = "event_ts") -> DataFrame:
    """Epoch ms -> timestamp; null or 0 becomes the arrival time."""
    arr = arrival if arrival is not None else F.current_timestamp()
    ts = F.coalesce(F.timestamp_millis(F.nullif(F.col(ms_col), F.lit(0))), arr)
    return df.withColumn(out, ts)


def ingest_defaults(df: DataFrame) -> DataFrame:
    """Missing coordinates 0, merchant ``unknown``, category ``other``."""
    return df.withColumns({
        "latitude": F.coalesce(F.col("latitude"), F.lit(0.0)),
        "longitude": F.coalesce(F.col("longitude"), F.lit(0.0)),
        "merchant_id": F.coalesce(F.col("merchant_id"), F.lit("unknown")),
        "merchant_category": F.coalesce(F.col("merchant_category"), F.lit("other")),
    })
