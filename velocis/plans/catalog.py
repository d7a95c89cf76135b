"""Registered queries: one callable ``(spark, sf_dir) -> DataFrame`` per key.

Every query reads the driver tables (or data Spark derives from them) in
full. Outputs use only string / bigint / double / boolean columns; doubles
are rounded to 6 places so that engines adding in different orders agree.
The DuckDB twin of each key lives in ``ORACLE`` (filled by the modules that
register queries).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from velocis.schemas import HOURLY, WindowSet, integer_feature

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

ROUND = 6


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def rounded(df: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Round doubles/floats to ``ROUND`` places, widen integers to bigint."""
    out = []
    for f in df.schema.fields:
        if keep is not None and f.name not in keep:
            continue
        t = f.dataType.typeName()
        c = F.col(f.name)
        if t in ("double", "float"):
            c = F.round(c.cast("double"), ROUND)
        elif t in ("integer", "short", "byte"):
            c = c.cast("long")
        out.append(c.alias(f.name))
    return df.select(*out)


def feature_exprs(windows: WindowSet, amount: str = "amount", src_alias: str = "",
                  as_columns: bool = False) -> dict[str, str]:
    """Raw SQL expression of each of the 20 model features (vector order).

    With ``as_columns`` the derived features are read as stored columns."""
    p = f"{src_alias}." if src_alias else ""
    s, lg = windows.short, windows.long
    out = {}
    for name in windows.feature_columns():
        if as_columns and name != "current_amount":
            expr = f"{p}{name}"
        elif name == "amount_zscore":
            expr = (f"CASE WHEN {p}amount_std_{lg}s >= 1e-9 THEN ({amount} - {p}amount_mean_{lg}s) / "
                    f"{p}amount_std_{lg}s ELSE 0.0 END")
        elif name == "velocity_change_ratio":
            expr = (f"CAST({p}txn_count_{s}s AS DOUBLE) / CAST(greatest({p}txn_count_{lg}s, 1) AS DOUBLE) * 60.0")
        elif name == "current_amount":
            expr = amount
        else:
            expr = f"{p}{name}"
        zero = "0" if integer_feature(name) else "0.0"
        out[name] = f"coalesce({expr}, {zero})"
    return out


def feature_sql(windows: WindowSet, amount: str = "amount", src_alias: str = "",
                as_columns: bool = False) -> list[str]:
    """SQL for the 20 model features over a frame query's columns."""
    cols = []
    for name, expr in feature_exprs(windows, amount, src_alias, as_columns).items():
        if integer_feature(name):
            cols.append(f"CAST({expr} AS BIGINT) AS {name}")
        else:
            cols.append(f"round(CAST({expr} AS DOUBLE), {ROUND}) AS {name}")
    return cols


def hourly() -> WindowSet:
    return HOURLY
