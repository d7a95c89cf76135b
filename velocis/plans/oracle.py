"""DuckDB SQL equivalents of the registered queries.

Each statement reads the driver's pre-registered views. ``TXN`` maps
``events`` onto transactions exactly like ``velocis.sources.tables``.
Float outputs are rounded to 6 places on both sides; counts are BIGINT.
"""

from __future__ import annotations

CATEGORY_CASE = ("CASE event_type WHEN 'click' THEN 'online' WHEN 'view' THEN 'retail' "
                 "WHEN 'purchase' THEN 'grocery' WHEN 'error' THEN 'atm' ELSE 'other' END")

TXN = f"""txn AS (
  SELECT CAST(event_id AS VARCHAR) AS transaction_id, CAST(user_id AS VARCHAR) AS entity_id,
    value AS amount,
    printf('merch_%s_%04d', cat, CAST(json_extract_string(props, '$.k') AS INTEGER)) AS merchant_id,
    cat AS merchant_category,
    25 + CAST(event_id * 7919 % 2400 AS DOUBLE) / 100 AS latitude,
    -124 + CAST(event_id * 104729 % 5600 AS DOUBLE) / 100 AS longitude,
    epoch_us(ts) // 1000 AS timestamp_ms, value > 150 AS is_fraud,
    epoch_us(ts) AS us, event_id
  FROM (SELECT *, {CATEGORY_CASE} AS cat FROM events) e
)"""


def haversine_sql(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    a = (f"(sin(radians({lat2} - {lat1}) / 2) * sin(radians({lat2} - {lat1}) / 2) + "
         f"cos(radians({lat1})) * cos(radians({lat2})) * "
         f"sin(radians({lon2} - {lon1}) / 2) * sin(radians({lon2} - {lon1}) / 2))")
    d = f"(12742.0 * asin(sqrt(least({a}, 1.0))))"
    return (f"(CASE WHEN {lat1} IS NULL OR {lon1} IS NULL OR {lat2} IS NULL OR {lon2} IS NULL "
            f"OR ({lat1} = 0 AND {lon1} = 0) OR ({lat2} = 0 AND {lon2} = 0) THEN 0.0 ELSE {d} END)")


def rolling_select(windows: tuple[int, int, int], src: str = "txn", stats: str = "snapshot",
                   max_events: int | None = None) -> str:
    """Per-transaction rolling features as a window query over ``src``."""
    s, m, lg = windows
    cols = []
    for w in windows:
        frame = (f"OVER (PARTITION BY entity_id ORDER BY us RANGE BETWEEN {w * 1_000_000} "
                 f"PRECEDING AND CURRENT ROW)")
        wanted = ["sum", "mean", "std", "count", "max", "min"] if stats == "all" else (
            ["sum", "mean", "std", "count"] + (["max", "min"] if w == lg else ["max"] if w == m else []))
        fn = {"sum": "sum(amount)", "mean": "avg(amount)", "std": "stddev_pop(amount)",
              "count": "count(amount)", "max": "max(amount)", "min": "min(amount)"}
        for st in wanted:
            name = f"txn_count_{w}s" if st == "count" else f"amount_{st}_{w}s"
            cols.append(f"{fn[st]} {frame} AS {name}")
        if w == lg:
            cols.append(f"count(DISTINCT merchant_id) {frame} AS unique_merchants_{w}s")
    prev = ("OVER (PARTITION BY entity_id ORDER BY us, transaction_id "
            "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)")
    cols.append(f"last(latitude) {prev} AS prev_latitude")
    cols.append(f"last(longitude) {prev} AS prev_longitude")
    return f"SELECT *, {', '.join(cols)} FROM {src}"
