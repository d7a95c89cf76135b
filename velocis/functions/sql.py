"""SQL scalar functions for SQL users.

``register_sql_functions(spark)`` creates session-scoped SQL functions
(``CREATE TEMPORARY FUNCTION ... RETURN expr``); they are SQL expressions,
so Catalyst inlines them and they run inside whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from velocis.schemas import APPROVE_BELOW, DEFAULT_THRESHOLD, EARTH_RADIUS_KM, REVIEW_BELOW

FUNCTIONS = {
    "haversine_km": f"""(lat1 DOUBLE, lon1 DOUBLE, lat2 DOUBLE, lon2 DOUBLE) RETURNS DOUBLE RETURN
      CASE WHEN lat1 IS NULL OR lon1 IS NULL OR lat2 IS NULL OR lon2 IS NULL
             OR (lat1 = 0 AND lon1 = 0) OR (lat2 = 0 AND lon2 = 0) THEN 0.0
           ELSE {2.0 * EARTH_RADIUS_KM!r} * asin(sqrt(least(
             sin(radians(lat2 - lat1) / 2) * sin(radians(lat2 - lat1) / 2)
             + cos(radians(lat1)) * cos(radians(lat2)) * sin(radians(lon2 - lon1) / 2) * sin(radians(lon2 - lon1) / 2),
             1.0))) END""",
    "fraud_decision": f"""(p DOUBLE) RETURNS STRING RETURN
      CASE WHEN p < {APPROVE_BELOW!r} THEN 'APPROVE' WHEN p < {REVIEW_BELOW!r} THEN 'REVIEW' ELSE 'DECLINE' END""",
    "fraud_confidence": f"""(p DOUBLE) RETURNS DOUBLE RETURN
      CASE WHEN p < {APPROVE_BELOW!r} THEN 1.0 - p WHEN p < {REVIEW_BELOW!r} THEN 0.5 ELSE p END""",
    "fraud_flag": f"""(p DOUBLE) RETURNS BOOLEAN RETURN p > {DEFAULT_THRESHOLD!r}""",
}


def register_sql_functions(spark: SparkSession) -> list[str]:
    for name, body in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}{body}")
    return list(FUNCTIONS)
