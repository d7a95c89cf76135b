"""Streaming rolling features over the batch operator (T1, T3, T5, second form).

``transformWithState`` keeps an entity's window and its micro-batch rows in one
task. This form instead runs the *batch* operator (``rolling_features``, with
its slices and cells) in ``foreachBatch`` over

    earlier events of the batch's entities  UNION  the new micro-batch

and emits feature rows for the new events only. Every arrival gets features as
of its own time over all events that arrived by then, whatever the order.

The earlier events (the *tail*) are append-only: a batch adds one part to each
time bucket it touches and a manifest that names the live parts; nothing is
rewritten. Buckets that no frame can reach any more are dropped whole; what a
later row still needs of them, each entity's newest event (its previous
location), is folded into a small table when they go, once per bucket. A bucket
of many parts is merged into one. What a batch reads and writes follows the
batch and the kept time, not the history. A batch reads the manifest of the
batch before it, so a replayed batch finds the same input; parts are deleted
only when no replay can name them.

Rows that get no features are set apart with their batch and a reason:

* ``late``: the row's longest frame begins in a dropped bucket. Buckets are kept
  ``lateness_s`` (by default one longest window) beyond the longest window
  before the newest accepted event;
* ``future``: the row is stamped more than ``tolerance_s`` after it arrived
  (``arrival_col``, or the time of the batch). One wrong stamp must not move the
  clock and make all that follows late;
* ``no_time``: the row has no time.

With ``revisions`` a row that arrives out of order also corrects the rows it
changes: those of its entity in the longest window after it and the event after
it (whose previous location it is). They go to a changelog (``retract`` with the
old values, ``insert`` with the new ones, ``version`` = batch), whose current
rows equal the batch operator over all accepted events.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from velocis.operators import skew
from velocis.operators.rolling import MICROS, latest_per_entity, rolling_features
from velocis.schemas import DEFAULT, WindowSet

TXN_COLS = ["entity_id", "transaction_id", "us", "amount", "merchant_id", "merchant_category",
            "latitude", "longitude"]
TXN_SCHEMA = ("entity_id string, transaction_id string, us long, amount double, merchant_id string, "
              "merchant_category string, latitude double, longitude double")


class Tail:
    """The append-only tail: parts ``events/bucket=b/part=p``, the newest
    dropped events ``dropped/upto=u``, and one manifest per batch."""

    def __init__(self, spark: SparkSession, base: str, bucket_us: int, merge_parts: int):
        self.spark, self.base, self.bucket_us, self.merge_parts = spark, base.rstrip("/"), bucket_us, merge_parts

    def manifest(self, batch_id: int) -> dict | None:
        """``clock, bound, dropped, parts`` after a batch; None if it did not commit."""
        path = f"{self.base}/manifest/batch={batch_id}"
        fs = self._fs(path)
        if not fs.exists(self._path(f"{path}/_SUCCESS")):
            return None
        return json.loads("".join(r[0] for r in self.spark.read.text(path).collect()))

    def before(self, batch_id: int) -> dict:
        """The state a batch starts from."""
        if batch_id == 0:
            return {"clock": None, "bound": None, "dropped": None, "parts": []}
        m = self.manifest(batch_id - 1)
        if m is None:
            raise RuntimeError(f"the tail of batch {batch_id - 1} is missing")
        return m

    def events(self, parts: list) -> DataFrame:
        """The rows of some parts (a list bounded by the kept time, see :meth:`commit`)."""
        if not parts:
            return self.spark.createDataFrame([], TXN_SCHEMA)
        paths = [f"{self.base}/events/bucket={b}/part={p}" for b, p in parts]
        return self.spark.read.schema(TXN_SCHEMA).parquet(*paths)

    def dropped(self, m: dict) -> DataFrame:
        """The newest dropped event of each entity."""
        if m["dropped"] is None:
            return self.spark.createDataFrame([], TXN_SCHEMA)
        return self.spark.read.schema(TXN_SCHEMA).parquet(f"{self.base}/dropped/upto={m['dropped']}")

    def commit(self, batch_id: int, m: dict, fresh: DataFrame, keep_us: int) -> None:
        """Append ``fresh``, drop what is older than ``keep_us`` before the
        clock, merge buckets of many parts, then write the manifest.

        The manifest lists ``keep_us / bucket_us + 1`` buckets with at most
        ``merge_parts`` parts each."""
        new = fresh.withColumn("bucket", F.floor(F.col("us") / self.bucket_us)).withColumn("part", F.lit(str(batch_id)))
        self._write(new)
        touched = {r["bucket"]: r["top"] for r in new.groupBy("bucket").agg(F.max("us").alias("top")).collect()}
        clock = max([x for x in (m["clock"], *touched.values()) if x is not None], default=None)
        parts = [*map(tuple, m["parts"]), *((b, str(batch_id)) for b in sorted(touched))]
        first = (clock - keep_us) // self.bucket_us if clock is not None else None
        bound = max([x for x in (m["bound"], first * self.bucket_us if first is not None else None) if x is not None],
                    default=None)
        dropped, gone = m["dropped"], [p for p in parts if p[0] * self.bucket_us < bound] if parts else []
        if gone:
            every = self.dropped(m).unionByName(self.events(gone))
            dropped = f"{bound}-{batch_id}"
            latest_per_entity(every, order=("us", "transaction_id")).select(*TXN_COLS) \
                .write.mode("overwrite").parquet(f"{self.base}/dropped/upto={dropped}")
            parts = [p for p in parts if p not in set(gone)]
        written = [(b, str(batch_id)) for b in touched]
        for b in sorted({b for b, _ in parts}):
            own = [p for p in parts if p[0] == b]
            if len(own) >= self.merge_parts:
                name = f"{batch_id}-merged"
                self._write(self.events(own).repartition("entity_id").withColumn("bucket", F.lit(b)).withColumn("part", F.lit(name)))
                parts = [p for p in parts if p[0] != b] + [(b, name)]
                written.append((b, name))
        self._commit(batch_id, {"clock": clock, "bound": bound, "dropped": dropped, "parts": parts,
                                "written": written})
        self._vacuum(batch_id)

    def _write(self, rows: DataFrame) -> None:
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic") \
            .partitionBy("bucket", "part").parquet(f"{self.base}/events")

    def _commit(self, batch_id: int, m: dict) -> None:
        self.spark.createDataFrame([(json.dumps(m),)], "value string").coalesce(1) \
            .write.mode("overwrite").text(f"{self.base}/manifest/batch={batch_id}")

    def _vacuum(self, batch_id: int) -> None:
        """Delete the parts that the last two batches named or wrote and the
        last manifest does not name: a replay of this batch starts from it."""
        old, last = (self.manifest(batch_id - k) if batch_id >= k else None for k in (2, 1))
        if not old or not last:
            return
        live = {tuple(p) for p in last["parts"]}
        known = {tuple(p) for p in old["parts"] + old["written"] + last["written"]}
        gone = [f"events/bucket={b}/part={p}" for b, p in sorted(known - live)]
        if old["dropped"] not in (None, last["dropped"]):
            gone.append(f"dropped/upto={old['dropped']}")
        for path in [*gone, f"manifest/batch={batch_id - 2}"]:
            self._fs(self.base).delete(self._path(f"{self.base}/{path}"), True)

    def _path(self, path: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(path)

    def _fs(self, path: str):
        return self._path(path).getFileSystem(self.spark._jsc.hadoopConfiguration())


class IncrementalRolling:
    """A ``foreachBatch`` function computing rolling features per micro-batch."""

    def __init__(self, base_path: str, windows: WindowSet = DEFAULT, max_events: int | None = None,
                 lateness_s: float | None = None, hot_rows: int | str | None = skew.AUTO,
                 tolerance_s: float = 60.0, arrival_col: str | None = None, revisions: bool = False,
                 bucket_s: float | None = None, merge_parts: int = 32):
        self.base = base_path.rstrip("/")
        self.windows, self.max_events, self.hot_rows = windows, max_events, hot_rows
        self.long_us = max(windows.lengths) * MICROS
        self.lateness_us = self.long_us if lateness_s is None else int(lateness_s * MICROS)
        self.tolerance_us, self.arrival_col, self.revisions = int(tolerance_s * MICROS), arrival_col, revisions
        self.bucket_us = int(bucket_s * MICROS) if bucket_s else max(self.long_us // 4, 1)
        self.merge_parts = merge_parts
        if revisions and max_events:
            raise ValueError("a capped frame has no bounded time in which a late row can change it")

    @property
    def output_path(self) -> str:
        return f"{self.base}/features"

    @property
    def late_path(self) -> str:
        """Rows without features, with their ``reason``."""
        return f"{self.base}/late"

    @property
    def changelog_path(self) -> str:
        return f"{self.base}/changelog"

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        self.run(batch, batch_id)

    def run(self, batch: DataFrame, batch_id: int) -> tuple[DataFrame, DataFrame]:
        """Write the batch's features, the rows set apart and the tail; returns
        the features and the rows set apart (both read back)."""
        spark = batch.sparkSession
        tail = Tail(spark, f"{self.base}/tail", self.bucket_us, self.merge_parts)
        m = tail.before(batch_id)
        arrival = F.col(self.arrival_col) if self.arrival_col else F.unix_micros(F.current_timestamp())
        us = F.col("us")
        lost = us - self.long_us < F.lit(m["bound"]) if m["bound"] is not None else F.lit(False)
        reason = F.when(us.isNull(), "no_time").when(us > arrival + self.tolerance_us, "future").when(lost, "late")
        # written once: its parts are the same for every step, and after a loss
        # (the time of the batch would not be)
        path = f"{self.base}/taken/batch={batch_id}"
        batch.select(*TXN_COLS, reason.alias("reason")).write.mode("overwrite").parquet(path)
        taken = spark.read.schema(f"{TXN_SCHEMA}, reason string").parquet(path)
        _write_batch(taken.where("reason IS NOT NULL"), batch_id, self.late_path)
        fresh = taken.where("reason IS NULL").drop("reason")
        schema = self._features(tail, m, fresh, batch_id).add("batch_id", T.IntegerType())
        tail.commit(batch_id, m, fresh, self.long_us + self.lateness_us)
        if batch_id >= 2:  # a replay writes its own again
            tail._fs(self.base).delete(tail._path(f"{self.base}/taken/batch={batch_id - 2}"), True)
        out = spark.read.schema(schema).parquet(self.output_path)
        return out.where(F.col("batch_id") == batch_id).drop("batch_id"), taken.where("reason IS NOT NULL")

    def _features(self, tail: Tail, m: dict, fresh: DataFrame, batch_id: int) -> T.StructType:
        entities = fresh.select("entity_id").distinct()
        history = skew.join_null_safe(tail.dropped(m).unionByName(tail.events(m["parts"])), entities, ["entity_id"],
                                      "left_semi")
        rows = history.withColumn("_new", F.lit(False)).unionByName(fresh.withColumn("_new", F.lit(True)))
        if not self.revisions:
            out = self._rolling(rows, "_new")
            _write_batch(out, batch_id, self.output_path)
            return out.schema
        marked = with_affected(rows, self.long_us)
        after = self._rolling(marked.withColumn("_emit_row", F.col("_new") | F.col("_affected")), "_emit_row", ("_new",))
        old = marked.where("NOT _new")
        before = self._rolling(old, "_affected")
        out = after.where("_new").drop("_new")
        _write_batch(out, batch_id, self.output_path)
        log = before.withColumn("op", F.lit("retract")) \
            .unionByName(after.drop("_new").withColumn("op", F.lit("insert")))
        _write_batch(log.withColumn("version", F.lit(batch_id).cast("long")), batch_id, self.changelog_path)
        return out.schema

    def _rolling(self, rows: DataFrame, emit: str, carry: tuple[str, ...] = ()) -> DataFrame:
        return rolling_features(rows, self.windows, max_events=self.max_events, hot_rows=self.hot_rows, emit=emit,
                                carry=carry).drop("computed_at")


def with_affected(rows: DataFrame, long_us: int) -> DataFrame:
    """Marks (``_affected``) the earlier rows (``_new`` false) that new rows
    change: those at most ``long_us`` after a new row of their entity, and the
    event that follows a new row.

    By cells of ``long_us``: a row is within reach of a new row if one of its
    own cell is not after it, or the newest of the cell before is within reach;
    a following event farther off is the first of its cell, after a cell that
    ends in a new row. Joins by (entity, cell) and one row per cell.
    """
    key = "entity_id"
    rows = rows.withColumn("_cell", F.floor(F.col("us") / long_us))
    place = F.struct("us", "transaction_id")
    fresh = F.when(F.col("_new"), F.col("us"))
    cells = rows.groupBy(key, "_cell").agg(
        F.min(fresh).alias("_from"), F.max(fresh).alias("_upto"), F.min(place).alias("_first"),
        F.max(F.struct("us", "transaction_id", "_new")).alias("_end"))
    over = Window.partitionBy(key).orderBy("_cell")
    cells = cells.withColumns({"_end": F.lag("_end._new").over(over), "_was": F.lag("_cell").over(over),
                               "_near": F.lag("_upto").over(over)})
    near = F.when(F.col("_was") == F.col("_cell") - 1, F.col("_near"))
    cells = cells.select(key, "_cell", "_from", near.alias("_near"),
                         F.when(F.col("_end"), F.col("_first")).alias("_next"))
    j = skew.join_null_safe(rows, cells, [key, "_cell"], "left")
    hit = (F.col("us") >= F.col("_from")) | (F.col("us") <= F.col("_near") + long_us) | (place == F.col("_next"))
    return j.withColumn("_affected", ~F.col("_new") & F.coalesce(hit, F.lit(False))) \
        .drop("_cell", "_from", "_near", "_next")


def current_rows(changelog: DataFrame) -> DataFrame:
    """The rows a changelog leaves: of each event the inserts of its newest
    version (all copies of a repeated delivery are corrected together)."""
    key = ["entity_id", "transaction_id", "us"]
    inserts = changelog.where("op = 'insert'")
    newest = inserts.groupBy(*key).agg(F.max("version").alias("_newest"))
    out = skew.join_null_safe(inserts, newest, key).where("version = _newest")
    return out.drop("_newest", "op", "version", *[c for c in ("batch_id",) if c in changelog.columns])


def _write_batch(df: DataFrame, batch_id: int, path: str) -> None:
    """Write one micro-batch's rows in place of an earlier attempt's."""
    (df.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("batch_id").parquet(path))


class ScoringStream:
    """``foreachBatch`` function of the scoring stream (T5) over raw JSON
    messages: strict decode, rolling features, model, and two outputs, both
    written per ``batch_id`` so that a replayed batch changes nothing:

    * ``scored_path``: feature and score columns of the accepted messages;
    * ``error_path``: ``raw, transaction_id, reason`` of messages that fail to
      decode, are set apart by the rolling features, or get no probability.

    ``model`` may be a callable returning the model: it is called once per
    micro-batch, so a newer saved version is picked up without a restart (S8).
    ``arrival_col`` names the source's arrival time (epoch micros): it stands in
    for a missing time, so that a replay stamps the same.
    """

    def __init__(self, base_path: str, model, windows: WindowSet = DEFAULT, col: str = "value",
                 arrival_col: str | None = None, **kw):
        self.base, self.model, self.windows, self.col = base_path.rstrip("/"), model, windows, col
        self.arrival_col, kw["arrival_col"] = arrival_col, arrival_col
        self.rolling = IncrementalRolling(f"{self.base}/rolling", windows, **kw)

    @property
    def scored_path(self) -> str:
        return f"{self.base}/scored"

    @property
    def error_path(self) -> str:
        return f"{self.base}/errors"

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        from velocis.operators.scoring import score
        from velocis.streaming.streams import decode_stream, with_event_time
        keep = (self.arrival_col,) if self.arrival_col else ()
        decoded = decode_stream(batch, self.col, keep).persist()
        try:
            good = with_event_time(decoded.where(F.col("reason").isNull()), self.arrival_col)
            feats, apart = self.rolling.run(good, batch_id)
            model = self.model() if callable(self.model) and not hasattr(self.model, "transform") else self.model
            scored = score(feats, model, self.windows).drop("features", "explanations")
            ok = F.col("fraud_probability").isNotNull() & ~F.isnan("fraud_probability")
            _write_batch(scored.where(ok), batch_id, self.scored_path)
            null = F.lit(None).cast("string")
            errors = decoded.where(F.col("reason").isNotNull()).select("raw", null.alias("transaction_id"), "reason")
            no_score = scored.where(~F.coalesce(ok, F.lit(False))).withColumn("reason", F.lit("no_score"))
            for df in (apart, no_score):
                errors = errors.unionByName(df.select(null.alias("raw"), "transaction_id", "reason"))
            _write_batch(errors, batch_id, self.error_path)
        finally:
            decoded.unpersist()
