"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from velocis.session import scratch_path

#: Fixed value: the ASCII white space the contracts split words at.
WHITE = r"\x20\x09-\x0D"
WORD = f"[^{WHITE}]+"


def materialise(df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it back: the
    lineage is cut by a table every executor can reread after a loss."""
    spark = df.sparkSession
    path = scratch_path(spark, f"llm/{name}-{uuid.uuid4().hex}")
    w = df.write.option("compression", "zstd")
    (w.partitionBy(partition_by) if partition_by else w).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def about(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """About ``rows`` rows of ``df``, or all if there are fewer, the same on every
    run: those whose hash of ``keys`` falls below a threshold that the number of
    different hashes fixes (within about 1 %), of rows with equal keys one.
    Nothing is sorted or gathered in one task, and copies neither swell nor
    shrink the sample."""
    steps = 1 << 30
    h = F.xxhash64(F.lit("sample"), *keys)
    total = df.select(F.approx_count_distinct(h, 0.01)).first()[0]
    take = steps if total <= rows else -(-rows * steps // total)
    return df.where(F.pmod(h, F.lit(steps)) < take).withColumn("__h", h).dropDuplicates(["__h"]).drop("__h")


def text_or_empty(col: str = "text") -> Column:
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of ``edges(a, b)``: one row ``(node, root)`` for
    every node that has an edge, ``root`` the smallest node of its component.

    Alternates large-star and small-star steps until the edges no longer
    change. Each step only groups by a node with partial aggregation and joins
    the (node, minimum) table back, so a node with a third of all edges is
    split by the skew join; the edges of each round are written to the
    checkpoint folder, and the driver sees only a count and a checksum.
    """
    e = materialise(_distinct_edges(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))),
                    "cc")
    before = _signature(e)
    for _ in range(max_rounds):
        if before[0] == 0:
            break
        # large star: every neighbour above u points to the smallest of u and its neighbours
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        e = _distinct_edges(both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")))
        # small star: every neighbour below u, and u, point to the smallest of them
        low = e.groupBy("a").agg(F.min("b").alias("m"))
        joined = e.join(low, "a")
        e = materialise(_distinct_edges(joined.select(F.col("b").alias("a"), F.col("m").alias("b"))
                                        .unionByName(low.select("a", F.col("m").alias("b")))), "cc")
        now = _signature(e)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    roots = e.select(F.col("b").alias("node")).distinct().withColumn("root", F.col("node"))
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)


def _distinct_edges(e: DataFrame) -> DataFrame:
    return e.where("a != b").distinct()


def _signature(e: DataFrame) -> tuple:
    r = e.agg(F.count(F.lit(1)), F.coalesce(F.bit_xor(F.xxhash64("a", "b")), F.lit(0))).first()
    return r[0], r[1]


def groups_of(batches: Iterator, key: str, rows: int, size=None) -> Iterator:
    """Arrow batches sorted by ``key`` -> tables that hold whole keys and at
    least ``rows`` rows (the last may hold fewer)."""
    import pyarrow as pa
    import pyarrow.compute as pc
    held, n = [], 0
    for b in batches:
        if not b.num_rows:
            continue
        t = pa.Table.from_batches([b])
        held.append(t)
        n += b.num_rows
        if n < rows:
            continue
        t = pa.concat_tables(held)
        last = t.column(key)[-1]
        same = pc.equal(t.column(key), last)
        cut = t.num_rows - int(pc.sum(same).as_py())
        if cut:
            yield t.slice(0, cut)
            t = t.slice(cut)
        held, n = [t], t.num_rows if cut else 0
    if held:
        t = pa.concat_tables(held)
        if t.num_rows:
            yield t
