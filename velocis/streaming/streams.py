"""Structured Streaming pipelines (S1, S3, S6 stream, T2-T5, T7-T9, J6, X1).

Sources are checkpointed (offsets/files are committed with the sink in the
checkpoint folder, T7); every stream runs on ``readStream`` and writes with
``writeStream``. ``run_to_table`` drives a stream to completion with
``trigger(availableNow=True)`` into a parquet folder under the shared
checkpoint location and returns it as a batch DataFrame; the registered
queries and tests use it.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQueryListener

from velocis.operators.scoring import score
from velocis.session import scratch_path
from velocis.sources.decode import validate
from velocis.sources.sinks import SnapshotTable, keyed_json
from velocis.streaming.incremental import _write_batch
from velocis.streaming.stateful import rolling_features_stateful
from velocis.schemas import DEFAULT, WindowSet

RAW_SCHEMA = T.StructType([T.StructField("value", T.StringType())])


def kafka_source(spark: SparkSession, bootstrap: str, topic: str = "transactions",
                 starting_offsets: str = "latest", max_offsets: int | None = None) -> DataFrame:
    """Transaction topic (S1): ``value`` as text; offsets live in the query's
    checkpoint, so a restart resumes where the last committed batch ended.
    Needs the Kafka connector on the classpath."""
    r = (spark.readStream.format("kafka").option("kafka.bootstrap.servers", bootstrap)
         .option("subscribe", topic).option("startingOffsets", starting_offsets))
    if max_offsets:
        r = r.option("maxOffsetsPerTrigger", max_offsets)
    return r.load().select(F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"))


def text_source(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """JSON-lines files as a stream of raw messages (S1, file form)."""
    r = spark.readStream.schema(RAW_SCHEMA)
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    return r.text(path)


def parquet_source(spark: SparkSession, path: str, schema: T.StructType,
                   max_files: int | None = None) -> DataFrame:
    r = spark.readStream.schema(schema)
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    return r.parquet(path)


def decode_stream(raw: DataFrame, col: str = "value", keep: tuple[str, ...] = ()) -> DataFrame:
    """Strict decode of a raw stream (S2): good rows get the transaction
    columns plus ``event_ts``/``us``; bad rows keep ``raw`` and ``reason``.
    ``keep`` names further columns of the source to pass on."""
    v = validate(raw, col)
    return v.select(F.col(col).alias("raw"), "reason", "txn.*", *keep)


def with_event_time(txn: DataFrame, arrival_col: str | None = None) -> DataFrame:
    """``event_ts`` and ``us`` from ``timestamp_ms`` (S4: 0/null -> arrival).
    The arrival is ``arrival_col`` (epoch micros, stamped by the source), or the
    time of the batch, which differs when the batch is replayed."""
    arrival = F.timestamp_micros(F.col(arrival_col)) if arrival_col else F.current_timestamp()
    ts = F.coalesce(F.timestamp_millis(F.nullif(F.col("timestamp_ms"), F.lit(0))), arrival)
    return txn.withColumn("event_ts", ts).withColumn("us", F.unix_micros("event_ts"))


def sliding_aggregates(txn: DataFrame, size: str, slide: str | None = None,
                       watermark: str = "0 seconds") -> DataFrame:
    """Windowed aggregates on a fixed grid per entity (T2), append mode:
    a window is emitted once the watermark passes its end.

    Distinct merchants are exact and no set is kept: a first stateful step lets
    each (entity, window, merchant) through once, a second one counts them. Its
    state is one row per (entity, window), that of the first one key per
    merchant, so a window with many merchants is spread over tasks."""
    w = F.window("event_ts", size, slide) if slide else F.window("event_ts", size)
    rows = txn.withWatermark("event_ts", watermark).select("entity_id", "merchant_id", "amount", w.alias("w"))
    none = F.lit(None)
    once = rows.where("merchant_id IS NOT NULL").select("entity_id", "merchant_id", "w").dropDuplicates() \
        .select("entity_id", "w", F.lit(1).alias("merchant"), none.cast("double").alias("amount"))
    every = rows.select("entity_id", "w", none.cast("int").alias("merchant"), "amount")
    return (every.unionByName(once).groupBy("entity_id", "w")
            .agg(F.count_if(F.col("merchant").isNull()).alias("txn_count"), F.sum("amount").alias("amount_sum"),
                 F.avg("amount").alias("amount_mean"), F.stddev_pop("amount").alias("amount_std"),
                 F.max("amount").alias("amount_max"), F.min("amount").alias("amount_min"),
                 F.count("merchant").alias("unique_merchants"))
            .select("entity_id", F.unix_micros("w.start").alias("window_start_us"),
                    F.unix_micros("w.end").alias("window_end_us"), "txn_count", "amount_sum", "amount_mean",
                    F.coalesce("amount_std", F.lit(0.0)).alias("amount_std"), "amount_max", "amount_min",
                    "unique_merchants"))


def dedup(txn: DataFrame, watermark: str = "1 hour") -> DataFrame:
    """Drop repeated deliveries of a transaction id within the watermark (T4)."""
    return txn.withWatermark("event_ts", watermark).dropDuplicatesWithinWatermark(["transaction_id"])


def delayed_requests(txn: DataFrame, delay_s: float) -> DataFrame:
    """Requests scored ``delay_s`` after each transaction."""
    return txn.withColumn("request_ts", F.timestamp_micros(F.col("us") + F.lit(int(delay_s * 1_000_000))))


def detected_vs_actual_stream(scored: DataFrame, truth: DataFrame, bound: str = "10 minutes",
                              how: str = "inner") -> DataFrame:
    """Stream-stream join of scored rows and ground truth by transaction id,
    bounded in event time by the watermarks (J6 stream). With ``leftOuter`` a
    scored row that finds no truth within ``bound`` is given out without one
    when the watermark evicts it, so every scored row ends in the result."""
    s = scored.withWatermark("scored_ts", bound).alias("s")
    t = truth.withWatermark("truth_ts", bound).alias("t")
    cond = (F.col("s.transaction_id") == F.col("t.transaction_id")) & \
        F.col("t.truth_ts").between(F.col("s.scored_ts") - F.expr(f"INTERVAL {bound}"),
                                    F.col("s.scored_ts") + F.expr(f"INTERVAL {bound}"))
    return s.join(t, cond, how).select("s.transaction_id", "s.decision", "s.is_fraud",
                                       F.col("t.actual_fraud"))


class CounterListener(StreamingQueryListener):
    """Collects ``observe`` metrics and row rates per micro-batch."""

    def __init__(self):
        self.progress: list[dict] = []

    def onQueryStarted(self, event):
        pass

    def onQueryProgress(self, event):
        p = event.progress
        self.progress.append({"batch": p.batchId, "rows": p.numInputRows,
                              "rows_per_s": p.processedRowsPerSecond,
                              "observed": {k: v.asDict() for k, v in (p.observedMetrics or {}).items()}})

    def onQueryIdle(self, event):
        pass

    def onQueryTerminated(self, event):
        pass


def observe_counters(df: DataFrame, name: str = "ingest") -> DataFrame:
    """Ingested rows and amount per micro-batch as observed metrics."""
    return df.observe(name, F.count(F.lit(1)).alias("ingested"), F.sum("amount").alias("amount"))


def run_to_table(df: DataFrame, name: str, output_mode: str = "append",
                 foreach: Callable[[DataFrame, int], None] | None = None,
                 checkpoint: str | None = None, path: str | None = None,
                 progress: list | None = None) -> str:
    """Run a streaming DataFrame to completion (availableNow) into a parquet
    folder; returns the folder. ``foreach`` replaces the sink (X1);
    ``progress`` receives the run's progress reports (T8)."""
    spark = df.sparkSession
    run = uuid.uuid4().hex[:12]
    path = path or scratch_path(spark, f"streams/{name}-{run}/out")
    checkpoint = checkpoint or scratch_path(spark, f"streams/{name}-{run}/checkpoint")
    w = df.writeStream.option("checkpointLocation", checkpoint).outputMode(output_mode) \
        .trigger(availableNow=True)
    if foreach is not None:
        q = w.foreachBatch(foreach).start()
    else:
        q = w.format("parquet").option("path", path).start()
    q.awaitTermination()
    if q.exception() is not None:
        raise RuntimeError(str(q.exception()))
    if progress is not None:
        progress.extend(q.recentProgress)
    return path


def score_stream_sinks(good_path: str, bad_path: str, model, windows: WindowSet = DEFAULT):
    """``foreachBatch`` function over feature rows: scored rows go to one
    folder, rows without a probability to the other (Q15), both written per
    ``batch_id`` in place of an earlier attempt's. ``ScoringStream`` is the
    whole path from raw messages. ``model`` may be a callable returning the
    model: it is called once per micro-batch, so a newer saved version is
    picked up without a restart (S8)."""
    def sink(batch: DataFrame, batch_id: int) -> None:
        m = model() if callable(model) and not hasattr(model, "transform") else model
        s = score(batch, m, windows).drop("features", "explanations").persist()
        try:
            ok = F.coalesce(F.col("fraud_probability").isNotNull() & ~F.isnan("fraud_probability"), F.lit(False))
            _write_batch(s.where(ok), batch_id, good_path)
            _write_batch(s.where(~ok), batch_id, bad_path)
        finally:
            s.unpersist()
    return sink


def snapshot_sink(table: SnapshotTable):
    """``foreachBatch`` function upserting feature rows into the snapshot
    table (S6, stream form); replays of a batch give the same table."""
    def sink(batch: DataFrame, batch_id: int) -> None:
        table.upsert(batch)
    return sink


def stream_rolling(spark: SparkSession, src_path: str, schema: T.StructType, windows: WindowSet = DEFAULT,
                   max_files: int | None = None, max_events: int | None = None,
                   name: str = "rolling") -> DataFrame:
    """T1 end to end over a folder of parquet transaction files."""
    txn = parquet_source(spark, src_path, schema, max_files)
    feats = rolling_features_stateful(txn, windows, max_events)
    return spark.read.parquet(run_to_table(feats, name))


def keyed_json_stream(txn: DataFrame) -> DataFrame:
    """Keyed JSON records of a transaction stream (S3)."""
    return keyed_json(txn)


def replay(df: DataFrame, time_col: str, chunks: int, make_stream: Callable[[str], DataFrame],
           name: str, output_mode: str = "append",
           foreach: Callable[[DataFrame, int], None] | None = None, fmt: str = "parquet",
           state_partitions: int | None = None) -> str:
    """Feed a table to a stream as ``chunks`` consecutive time slices.

    For each slice: append its files to the source folder, then run the
    query with ``availableNow`` and stop; the next slice restarts the query
    from the same checkpoint (T7). Returns the output folder.
    """
    spark = df.sparkSession
    run = uuid.uuid4().hex[:12]
    base = scratch_path(spark, f"streams/{name}-{run}")
    src, out, ckpt = base + "/source", base + "/out", base + "/checkpoint"
    b = df.agg(F.min(time_col).alias("lo"), F.max(time_col).alias("hi")).first()
    lo, hi = int(b["lo"]), int(b["hi"])
    step = (hi - lo) // chunks + 1
    # a stateful stream fixes its state partitions when its checkpoint is
    # created; use the cluster's parallelism rather than a session default
    parts = state_partitions or spark.sparkContext.defaultParallelism
    for k in range(chunks):
        a, z = lo + k * step, lo + (k + 1) * step
        part = df.where((F.col(time_col) >= a) & (F.col(time_col) < z))
        if fmt == "text":
            part.select("value").write.mode("append").text(src)
        else:
            part.write.mode("append").parquet(src)
        prev = spark.conf.get("spark.sql.shuffle.partitions")
        spark.conf.set("spark.sql.shuffle.partitions", str(parts))
        try:
            run_to_table(make_stream(src), name, output_mode, foreach, checkpoint=ckpt, path=out)
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", prev)
    return out


def replay_together(tables: dict[str, tuple[DataFrame, str]], chunks: int,
                    make_stream: Callable[[dict[str, str]], DataFrame], name: str,
                    last: dict[str, DataFrame] | None = None,
                    foreach: Callable[[DataFrame, int], None] | None = None) -> str:
    """``replay`` of several tables (name -> table and its time column in epoch
    micros) over the same time slices, feeding one query. ``last`` is a closing
    slice (it moves the watermarks past all rows). Returns the output folder."""
    spark = next(iter(tables.values()))[0].sparkSession
    base = scratch_path(spark, f"streams/{name}-{uuid.uuid4().hex[:12]}")
    src = {k: f"{base}/source-{k}" for k in tables}
    spans = [df.agg(F.min(c), F.max(c)).first() for df, c in tables.values()]
    lo, hi = min(int(s[0]) for s in spans), max(int(s[1]) for s in spans)
    step = (hi - lo) // chunks + 1
    slices = [{k: df.where((F.col(c) >= lo + i * step) & (F.col(c) < lo + (i + 1) * step))
               for k, (df, c) in tables.items()} for i in range(chunks)]
    for part in slices + ([last] if last else []):
        for k, df in part.items():
            df.write.mode("append").parquet(src[k])
        run_to_table(make_stream(src), name, foreach=foreach, checkpoint=f"{base}/checkpoint", path=f"{base}/out")
    return f"{base}/out"
