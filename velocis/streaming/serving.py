"""Point-in-time serving on two streams (J2, J3, J4): requests against events.

Events and requests come as one tagged stream (``tagged``). A request is held
back until the watermark (newest event time less ``delay_s``) has passed it, so
that every event up to its time has arrived, and is then answered by the batch
operator (``serve_tiered``: newest snapshot within the age bound, else live
features) over the kept events of its entity. Answers therefore equal the batch
result whatever the interleaving of the two streams.

State is two tables below the checkpoint folder: the events in the append-only
tail of ``incremental``, kept for the longest window, the snapshot age, the delay
and the lateness; and the waiting requests, one folder per batch that replaces
the one before. A batch reads the state of the batch before it, so a replay finds
the same input and writes the same output. Hot entities are cut as in batch.

Set apart with a reason: events as in ``incremental`` (``late``: older than what
is kept, ``future``, ``no_time``); requests whose reach begins before what is
kept (``late_request``) or that have no time (``no_time``). An event that comes
behind the watermark still counts for all requests answered after it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from velocis.operators import skew
from velocis.operators.rolling import MICROS
from velocis.operators.serving import serve_tiered
from velocis.schemas import DEFAULT, WindowSet
from velocis.streaming.incremental import TXN_COLS, Tail, _write_batch

REQUEST_COLS = ["request_id", "transaction_id", "entity_id", "amount", "latitude", "longitude", "merchant_category",
                "request_ts"]
REQUEST_SCHEMA = ("request_id string, transaction_id string, entity_id string, amount double, latitude double, "
                  "longitude double, merchant_category string, request_ts timestamp")


def tagged(events: DataFrame, requests: DataFrame) -> DataFrame:
    """One stream of both: ``event`` or ``request``, the other one null."""
    e = events.select(F.struct(*TXN_COLS).alias("event"))
    r = requests.select(F.struct(*REQUEST_COLS).alias("request"))
    return e.unionByName(r, allowMissingColumns=True)


class ServingStream:
    """``foreachBatch`` function over a tagged stream; answers go to ``output_path``."""

    def __init__(self, base_path: str, windows: WindowSet = DEFAULT, max_age_s: float = 300.0, delay_s: float = 0.0,
                 lateness_s: float | None = None, tolerance_s: float = 60.0, hot_rows: int | str | None = skew.AUTO,
                 bucket_s: float | None = None, merge_parts: int = 32):
        self.base, self.windows, self.max_age_s, self.hot_rows = base_path.rstrip("/"), windows, max_age_s, hot_rows
        self.long_us = max(windows.lengths) * MICROS
        # how far back an answer may look: the snapshot's age and that snapshot's own window
        self.reach_us = self.long_us + int(max_age_s * MICROS)
        self.delay_us, self.tolerance_us = int(delay_s * MICROS), int(tolerance_s * MICROS)
        self.lateness_us = self.long_us if lateness_s is None else int(lateness_s * MICROS)
        self.bucket_us = int(bucket_s * MICROS) if bucket_s else max(self.long_us // 4, 1)
        self.merge_parts = merge_parts

    @property
    def output_path(self) -> str:
        return f"{self.base}/served"

    @property
    def apart_path(self) -> str:
        """Events and requests that count for nothing, with their ``reason``."""
        return f"{self.base}/apart"

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        tail = Tail(spark, f"{self.base}/tail", self.bucket_us, self.merge_parts)
        m = tail.before(batch_id)
        now = F.unix_micros(F.current_timestamp())
        event_us, asked_us = F.col("event.us"), F.unix_micros("request.request_ts")
        bound = F.lit(m["bound"]).cast("long")
        reason = F.when(F.coalesce(event_us, asked_us).isNull(), "no_time") \
            .when(event_us > now + self.tolerance_us, "future").when(event_us < bound, "late") \
            .when(asked_us - self.reach_us < bound, "late_request")
        # written once, as the time of the batch would differ in a second pass
        taken = self._written(batch.select("event", "request", reason.alias("reason")), f"taken/batch={batch_id}")
        _write_batch(taken.where("reason IS NOT NULL"), batch_id, self.apart_path)
        taken = taken.where("reason IS NULL")
        events = taken.where("event IS NOT NULL").select("event.*")
        asked = taken.where("request IS NOT NULL").select("request.*")
        if batch_id:
            asked = asked.unionByName(spark.read.schema(REQUEST_SCHEMA).parquet(f"{self.base}/waiting/batch={batch_id - 1}"))
        newest = max((x for x in (m["clock"], events.agg(F.max("us")).first()[0]) if x is not None), default=None)
        ready = F.unix_micros("request_ts") <= F.lit(None if newest is None else newest - self.delay_us).cast("long")
        ready = F.coalesce(ready, F.lit(False))
        self._written(asked.where(~ready), f"waiting/batch={batch_id}")
        self._answer(tail, m, events, asked.where(ready), batch_id)
        # a waiting request lies after the watermark, at most ``delay_s`` before the clock
        tail.commit(batch_id, m, events, self.reach_us + self.delay_us + self.lateness_us)
        for name in ("taken", "waiting"):
            if batch_id >= 2:
                tail._fs(self.base).delete(tail._path(f"{self.base}/{name}/batch={batch_id - 2}"), True)

    def _answer(self, tail: Tail, m: dict, events: DataFrame, ready: DataFrame, batch_id: int) -> None:
        known = tail.dropped(m).unionByName(tail.events(m["parts"])).unionByName(events.select(*TXN_COLS))
        own = skew.join_null_safe(known, ready.select("entity_id").distinct(), ["entity_id"], "left_semi")
        served = serve_tiered(own, None, ready, self.windows, self.max_age_s, hot_rows=self.hot_rows,
                              carry=("request_ts",))
        _write_batch(served, batch_id, self.output_path)

    def _written(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.base}/{name}"
        df.write.mode("overwrite").parquet(path)
        return df.sparkSession.read.schema(df.schema).parquet(path)

    def waiting(self, spark, batch_id: int) -> DataFrame:
        """Requests not answered yet after a batch."""
        return spark.read.schema(REQUEST_SCHEMA).parquet(f"{self.base}/waiting/batch={batch_id}")
