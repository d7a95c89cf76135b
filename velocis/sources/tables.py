"""Driver tables and their mapping onto the transaction model.

``events`` rows become transactions: ``event_id`` -> ``transaction_id``,
``user_id`` -> ``entity_id``, ``value`` -> ``amount``, ``event_type`` ->
merchant category, ``props.k`` -> merchant number. The table has no
coordinates, so they are derived from ``event_id`` by a fixed rule.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from velocis.functions.scalar import merchant_key, ntz_epoch_micros

# Fixed mapping of event types to merchant categories:
#   click -> online, view -> retail, purchase -> grocery, error -> atm,
#   anything else -> other
EVENT_CATEGORY = {"click": "online", "view": "retail", "purchase": "grocery", "error": "atm"}


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def event_category(col) -> F.Column:
    c = F.when(F.lit(False), F.lit(None))
    for k, v in EVENT_CATEGORY.items():
        c = c.when(col == k, F.lit(v))
    return c.otherwise(F.lit("other"))


def transactions_from_events(events: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Map the driver's ``events`` table onto the transaction schema.

    ``us`` (epoch micros) is computed from the TIMESTAMP_NTZ ``ts`` without
    the session zone; ``event_ts`` is the same instant as a TIMESTAMP.
    ``keep`` carries further ``events`` columns along unchanged.
    """
    cat = event_category(F.col("event_type"))
    us = ntz_epoch_micros(F.col("ts"))
    return events.select(
        F.col("event_id").cast("string").alias("transaction_id"),
        F.col("user_id").cast("string").alias("entity_id"),
        F.col("value").alias("amount"),
        merchant_key(cat, F.get_json_object("props", "$.k").cast("int")).alias("merchant_id"),
        cat.alias("merchant_category"),
        (F.lit(25.0) + (F.col("event_id") * 7919 % 2400).cast("double") / 100).alias("latitude"),
        (F.lit(-124.0) + (F.col("event_id") * 104729 % 5600).cast("double") / 100).alias("longitude"),
        F.floor(us / 1000).cast("long").alias("timestamp_ms"),
        (F.col("value") > 150).alias("is_fraud"),
        F.lit("none").alias("fraud_type"),
        F.timestamp_micros(us).alias("event_ts"),
        us.alias("us"),
        F.col("event_id"),
        *[F.col(c) for c in keep],
    )


def transactions(spark: SparkSession, sf_dir: str, keep: tuple[str, ...] = (),
                 since: str | None = None, until: str | None = None) -> DataFrame:
    """Transactions of the driver's ``events`` table, optionally restricted
    to ``since <= ts < until`` (wall-clock strings, UTC). The bounds are put on
    the raw ``ts`` column, so they reach the parquet scan as pushed filters.
    Features of an event depend only on earlier events, so ``until`` never
    changes the features of the events it keeps."""
    ev = read_table(spark, sf_dir, "events")
    if since is not None:
        ev = ev.where(F.col("ts") >= F.lit(since).cast("timestamp_ntz"))
    if until is not None:
        ev = ev.where(F.col("ts") < F.lit(until).cast("timestamp_ntz"))
    return transactions_from_events(ev, keep)


def requests_from_transactions(txn: DataFrame, delay_seconds: float = 600.0,
                               batch_size: int = 100) -> DataFrame:
    """One scoring request per transaction, ``delay_seconds`` after it.

    ``batch_id`` groups requests into batch messages by transaction number;
    the ``include_features`` / ``explain`` flags vary with it so both values
    occur (every request is kept).
    """
    delay_us = int(round(delay_seconds * 1_000_000))
    if "event_id" not in txn.columns:     # any transaction table: number by a hash of the id
        txn = txn.withColumn("event_id", F.abs(F.xxhash64("transaction_id")))
    return txn.select(
        F.concat(F.lit("req-"), F.col("transaction_id")).alias("request_id"),
        "transaction_id", "entity_id", "amount", "latitude", "longitude", "merchant_category",
        F.timestamp_micros(F.col("us") + F.lit(delay_us)).alias("request_ts"),
        (F.col("event_id") % 3 == 0).alias("include_features"),
        (F.col("event_id") % 4 == 0).alias("explain"),
        F.concat(F.lit("b"), (F.col("event_id") / F.lit(batch_size)).cast("long").cast("string")).alias("batch_id"),
    )
