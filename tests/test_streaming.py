"""Streams (T1-T8, S6, S8): stream = batch, restarts, expiry, counters."""

import random
import uuid

import pytest

from pyspark.sql import functions as F

from fixtures import T0, txn_df
from velocis.operators.rolling import rolling_features
from velocis.schemas import DEFAULT
from velocis.session import scratch_path
from velocis.sources.sinks import SnapshotTable
from velocis.streaming.stateful import rolling_features_stateful
from velocis.streaming.streams import (
    CounterListener, dedup, observe_counters, parquet_source, replay, run_to_table, sliding_aggregates,
)


def _rows(seed=9, n=60):
    rnd = random.Random(seed)
    rows, t = [], T0
    for i in range(n):
        t += rnd.choice([0, 0.3, 1, 2, 4, 30, 70])
        rows.append((f"e{i % 3}", f"t{i:03d}", t, round(rnd.uniform(1, 90), 2), f"m{rnd.randint(0, 3)}",
                     rnd.uniform(-50, 50), rnd.uniform(-100, 100)))
    return rows


def _norm(df):
    return df.select([F.round(c, 9).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def test_stream_equals_batch_across_restarts(spark):
    txn = txn_df(spark, _rows())
    for cap in (None, 3):
        out = replay(txn, "us", 3, lambda src: rolling_features_stateful(
            parquet_source(spark, src, txn.schema), DEFAULT, max_events=cap), "t-stream")
        s = spark.read.parquet(out)
        b = rolling_features(txn, DEFAULT, max_events=cap).select(*s.columns)
        assert s.count() == b.count() == 60
        assert _norm(s).exceptAll(_norm(b)).count() == 0 and _norm(b).exceptAll(_norm(s)).count() == 0


def test_processor_on_static_frame_matches_batch(spark):
    txn = txn_df(spark, _rows(10, 40))
    s = rolling_features_stateful(txn, DEFAULT)
    b = rolling_features(txn, DEFAULT).select(*s.columns)
    assert _norm(s).exceptAll(_norm(b)).count() == 0


def test_idle_ttl_forgets_state(spark):
    rows = [("e", "a", T0, 5.0, "m", 10.0, 10.0), ("e", "b", T0 + 30, 5.0, "m", 11.0, 11.0),
            ("e", "c", T0 + 1000, 7.0, "m", 12.0, 12.0)]
    out = {r["transaction_id"]: r for r in rolling_features_stateful(txn_df(spark, rows), DEFAULT,
                                                                    idle_ttl_s=120).collect()}
    assert out["b"]["txn_count_60s"] == 2 and out["b"]["prev_latitude"] == 10.0
    assert out["c"]["txn_count_60s"] == 1 and out["c"]["prev_latitude"] is None
    assert out["c"]["geo_distance_delta"] == 0.0
    b = {r["transaction_id"]: r for r in rolling_features(txn_df(spark, rows), DEFAULT, idle_ttl_s=120).collect()}
    assert b["c"]["prev_latitude"] is None and b["b"]["prev_latitude"] == 10.0


def test_observed_counters_and_listener(spark):
    txn = txn_df(spark, _rows(11, 30))
    src = _write(spark, txn)
    listener = CounterListener()
    spark.streams.addListener(listener)
    progress = []
    try:
        out = run_to_table(observe_counters(parquet_source(spark, src, txn.schema, max_files=1)), "t-observe",
                           progress=progress)
    finally:
        spark.streams.removeListener(listener)
    assert spark.read.parquet(out).count() == 30
    ingested = sum(p["observedMetrics"]["ingest"]["ingested"] for p in progress
                   if p.get("observedMetrics", {}).get("ingest"))
    assert ingested == 30
    assert sum(p["numInputRows"] for p in progress) == 30


def test_dedup_within_watermark(spark):
    txn = txn_df(spark, _rows(12, 30))
    dup = txn.unionByName(txn.where(F.col("amount") > 45))
    out = replay(dup, "us", 2, lambda src: dedup(parquet_source(spark, src, txn.schema)), "t-dedup")
    got = spark.read.parquet(out)
    assert got.count() == 30 and got.select("transaction_id").distinct().count() == 30


def test_sliding_windows_emit_closed_windows_only(spark):
    txn = txn_df(spark, _rows(13, 50)).withColumn("merchant_id", F.col("merchant_id"))
    path = run_to_table(sliding_aggregates(parquet_source(spark, _write(spark, txn), txn.schema), "60 seconds",
                                           "30 seconds"), "t-slide")
    got = spark.read.parquet(path)
    mx = txn.agg(F.max("us")).first()[0]
    assert got.where(F.col("window_end_us") > mx).count() == 0
    exp = (txn.groupBy("entity_id", F.window("event_ts", "60 seconds", "30 seconds").alias("w"))
           .count().where(F.unix_micros("w.end") <= mx))
    assert got.count() == exp.count()


def _write(spark, df):
    p = scratch_path(spark, f"tests/src-{uuid.uuid4().hex[:8]}")
    df.write.parquet(p)
    return p


def test_snapshot_upsert_is_idempotent(spark):
    txn = txn_df(spark, _rows(14, 40))
    f = rolling_features(txn, DEFAULT)
    table = SnapshotTable(spark, scratch_path(spark, f"tests/snap-{uuid.uuid4().hex[:8]}"), DEFAULT, n_buckets=4)
    first = f.where(F.col("us") < (T0 + 60) * 10**6)
    table.upsert(first)
    table.upsert(f)
    a = table.read().drop("bucket").collect()
    table.upsert(f)                     # replay of the same batch
    b = table.read().drop("bucket").collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, b))
    latest = f.groupBy("entity_id").agg(F.max("us").alias("us"))
    got = table.read().select("entity_id", F.col("computed_at_us").alias("us"))
    assert got.exceptAll(latest).count() == 0 and latest.exceptAll(got).count() == 0
    assert table.lookup(10**18).count() == 0          # everything expired


def test_model_bundle_roundtrip(spark):
    from velocis.operators.training import (
        latest_bundle, load_bundle, predict, save_bundle, train_lr, training_set,
    )
    rows = [("e%d" % (i % 5), "t%04d" % i, T0 + i * 11, float(10 + (i % 40) * 9)) for i in range(200)]
    ev = txn_df(spark, rows)
    ts = training_set(rolling_features(ev), ev.select("transaction_id", (F.col("amount") > 200).alias("is_fraud")))
    model, scaler = train_lr(ts, DEFAULT, max_iter=20)
    root = scratch_path(spark, f"tests/models-{uuid.uuid4().hex[:8]}")
    save_bundle(model, f"{root}/v1", {"model_type": "lr", "version": "1", "scaler": scaler})
    save_bundle(model, f"{root}/v2", {"model_type": "lr", "version": "2", "scaler": scaler})
    path = latest_bundle(root)
    assert path.endswith("v2")
    m2, meta = load_bundle(path)
    assert meta["version"] == "2"
    a = dict(predict(model, ts).select("transaction_id", "score").collect())
    b = dict(predict(m2, ts).select("transaction_id", "score").collect())
    assert a == b


def test_late_rows_beyond_watermark_are_dropped(spark):
    """With event time, rows older than the watermark never reach state."""
    base = scratch_path(spark, f"tests/late-{uuid.uuid4().hex[:8]}")
    src, out, ckpt = base + "/src", base + "/out", base + "/ckpt"
    first = txn_df(spark, [("e", f"a{i}", T0 + i * 10, 1.0) for i in range(12)])
    schema = first.schema
    first.write.parquet(src)

    def build():
        s = parquet_source(spark, src, schema).withWatermark("event_ts", "20 seconds")
        return rolling_features_stateful(s, DEFAULT, event_time=True)

    run_to_table(build(), "late", checkpoint=ckpt, path=out)
    late = txn_df(spark, [("e", "late", T0 + 5, 100.0), ("e", "b", T0 + 200, 2.0)])
    late.write.mode("append").parquet(src)
    progress = []
    run_to_table(build(), "late", checkpoint=ckpt, path=out, progress=progress)
    got = {r["transaction_id"]: r for r in spark.read.parquet(out).collect()}
    assert "late" not in got and "b" in got and len(got) == 13
    dropped = sum(op.get("numRowsDroppedByWatermark", 0) for p in progress for op in p.get("stateOperators", []))
    assert dropped == 1


def test_stream_stream_join_with_ground_truth(spark):
    from velocis.streaming.streams import detected_vs_actual_stream
    base = scratch_path(spark, f"tests/j6-{uuid.uuid4().hex[:8]}")
    sc = spark.createDataFrame([(f"t{i}", "DECLINE" if i % 3 == 0 else "APPROVE", i % 3 == 0, T0 + i)
                                for i in range(20)], "transaction_id string, decision string, is_fraud boolean, s long")
    tr = spark.createDataFrame([(f"t{i}", i % 2 == 0, T0 + i + 30) for i in range(20)],
                               "transaction_id string, actual_fraud boolean, s long")
    sc.withColumn("scored_ts", F.timestamp_seconds("s")).drop("s").write.parquet(base + "/scored")
    tr.withColumn("truth_ts", F.timestamp_seconds("s")).drop("s").write.parquet(base + "/truth")
    s_schema = spark.read.parquet(base + "/scored").schema
    t_schema = spark.read.parquet(base + "/truth").schema
    j = detected_vs_actual_stream(parquet_source(spark, base + "/scored", s_schema),
                                  parquet_source(spark, base + "/truth", t_schema), "10 minutes")
    got = spark.read.parquet(run_to_table(j, "j6"))
    assert got.count() == 20
    assert got.where("is_fraud AND actual_fraud").count() == len([i for i in range(20) if i % 6 == 0])


def test_incremental_stream_equals_batch_with_hot_entity(spark):
    from velocis.streaming.incremental import IncrementalRolling
    rnd = random.Random(21)
    rows, t = [], T0
    for i in range(150):
        t += rnd.choice([0, 0.5, 1, 3, 20, 90])
        ent = "hot" if i % 3 else f"e{i % 4}"
        rows.append((ent, f"t{i:03d}", t, round(rnd.uniform(1, 90), 2), f"m{i % 5}", 1.0 + i, -1.0 - i))
    txn = txn_df(spark, rows)
    for cap in (None, 3):
        inc = IncrementalRolling(scratch_path(spark, f"tests/inc-{uuid.uuid4().hex[:8]}"), DEFAULT,
                                 max_events=cap, hot_rows=8)
        replay(txn, "us", 4, lambda src: parquet_source(spark, src, txn.schema), "t-inc", foreach=inc)
        s = spark.read.parquet(inc.output_path).drop("batch_id")
        b = rolling_features(txn, DEFAULT, max_events=cap, hot_rows=None).drop("computed_at").select(*s.columns)
        assert s.count() == 150
        assert _norm(s).exceptAll(_norm(b)).count() == 0 and _norm(b).exceptAll(_norm(s)).count() == 0


def test_scoring_sink_reloads_model_per_batch(spark):
    from velocis.operators.scoring import LinearScorer
    from velocis.streaming.streams import score_stream_sinks
    txn = txn_df(spark, _rows(15, 20))
    feats = rolling_features(txn, DEFAULT)
    base = scratch_path(spark, f"tests/sink-{uuid.uuid4().hex[:8]}")
    versions = iter([LinearScorer({}, -5.0, version="v1"), LinearScorer({}, 5.0, version="v2")])
    sink = score_stream_sinks(base + "/good", base + "/bad", lambda: next(versions), DEFAULT)
    sink(feats, 0)
    sink(feats, 1)
    got = spark.read.parquet(base + "/good")
    assert {r["model_version"] for r in got.collect()} == {"v1", "v2"}
    assert got.where("batch_id = 1 AND decision = 'DECLINE'").count() == 20


def test_idle_timer_clears_state(spark):
    """With event time, an entity idle past ``idle_ttl_s`` is cleared by
    its timer once the watermark passes; read back through the state source."""
    base = scratch_path(spark, f"tests/timer-{uuid.uuid4().hex[:8]}")
    src, out, ckpt = base + "/src", base + "/out", base + "/ckpt"
    first = txn_df(spark, [("e", "a", T0, 1.0), ("f", "b", T0, 1.0)])
    schema = first.schema
    first.write.parquet(src)

    def build():
        s = parquet_source(spark, src, schema).withWatermark("event_ts", "0 seconds")
        return rolling_features_stateful(s, DEFAULT, idle_ttl_s=120, event_time=True)

    run_to_table(build(), "timer", checkpoint=ckpt, path=out)
    for i, t in enumerate((T0 + 1000, T0 + 1001)):
        txn_df(spark, [("f", f"c{i}", t, 1.0)]).write.mode("append").parquet(src)
        run_to_table(build(), "timer", checkpoint=ckpt, path=out)
    meta = spark.read.format("statestore").option("stateVarName", "meta").load(ckpt).collect()
    assert [r["key"]["entity_id"] for r in meta] == ["f"]
    assert meta[0]["value"]["timer_ms"] == (T0 + 1001 + 120) * 1000
    events = spark.read.format("statestore").option("stateVarName", "events").load(ckpt).collect()
    assert sorted(r["list_element"]["tid"] for r in events) == ["c0", "c1"]


def test_incremental_stream_with_nulls_ties_late_rows_and_repeats(spark):
    """Equal to the batch operator on what is not late; late rows are set apart; replays change nothing."""
    from velocis.streaming.incremental import IncrementalRolling
    rows = [("e", "a", T0, 1.0, "m1", 1.0, 1.0), ("e", "b", T0, None, None, None, None),
            ("e", "c", T0 + 5, 2.0, "m1", 2.0, 2.0), ("f", "d", T0 + 5, 3.0, "m2", 1.0, 2.0)]
    more = [("e", "g", T0 + 20, 4.0, "m3", 3.0, 3.0), ("e", "c", T0 + 5, 2.0, "m1", 2.0, 2.0),
            ("e", "x", T0 - 500, 9.0, "m9", 3.0, 3.0), ("f", "h", T0 + 21, None, "m2", None, None)]
    inc = IncrementalRolling(scratch_path(spark, f"tests/late-{uuid.uuid4().hex[:8]}"), DEFAULT, lateness_s=30)
    first, second = txn_df(spark, rows), txn_df(spark, more)
    inc(first, 0)
    inc(second, 1)
    once = sorted(map(str, spark.read.parquet(inc.output_path).collect()))
    inc(second, 1)
    assert sorted(map(str, spark.read.parquet(inc.output_path).collect())) == once
    assert [r["transaction_id"] for r in spark.read.parquet(inc.late_path).collect()] == ["x"]
    fresh = second.where("transaction_id != 'x'")
    want0 = rolling_features(first, DEFAULT).drop("computed_at")
    want1 = rolling_features(first.unionByName(fresh), DEFAULT).drop("computed_at")
    got = spark.read.parquet(inc.output_path)
    for k, want, ids in ((0, want0, ("a", "b", "c", "d")), (1, want1, ("g", "h"))):
        g = got.where(F.col("batch_id") == k).drop("batch_id").select(*want.columns).where(
            F.col("transaction_id").isin(*ids))
        w = want.where(F.col("transaction_id").isin(*ids))
        assert g.count() == len(ids)
        assert _norm(g).exceptAll(_norm(w)).count() == 0
    # a lost tail is an error, not an empty history
    with pytest.raises(Exception):
        inc(second, 7)


def test_stateful_processor_nulls_as_in_batch(spark):
    rows = [("e", "a", T0, 1.0, "m1", 1.0, 1.0), ("e", "b", T0 + 1, None, None, None, None),
            ("e", "c", T0 + 2, 3.0, "m2", 2.0, 2.0), ("e", "d", T0 + 3, 5.0, "m1", 3.0, 3.0)]
    txn = txn_df(spark, rows)
    b = rolling_features(txn, DEFAULT).drop("computed_at")
    s = rolling_features_stateful(txn, DEFAULT)
    cols = [c for c in b.columns if c not in ("prev_latitude", "prev_longitude")]
    assert _norm(s.select(*cols)).exceptAll(_norm(b.select(*cols))).count() == 0


def test_scoring_stream_keeps_every_message_and_replays(spark):
    import json
    from velocis.operators.scoring import LinearScorer
    from velocis.streaming.incremental import ScoringStream
    good = {"transaction_id": "t1", "entity_id": "e1", "amount": 12.5, "merchant_id": "m", "merchant_category": "online",
            "latitude": 1.0, "longitude": 2.0, "timestamp_ms": int(T0 * 1000)}
    msgs = [json.dumps(dict(good, transaction_id=f"t{i}", timestamp_ms=int(T0 * 1000) + i)) for i in range(5)]
    msgs += ["{broken", json.dumps(dict(good, amount=None)), json.dumps(dict(good, extra=1))]
    raw = spark.createDataFrame([(m,) for m in msgs], "value string")
    st = ScoringStream(scratch_path(spark, f"tests/score-{uuid.uuid4().hex[:8]}"),
                       LinearScorer({"current_amount": 0.1}, -3.0), DEFAULT)
    for _ in range(2):
        st(raw, 0)
        assert spark.read.parquet(st.scored_path).count() == 5
        assert sorted(r["reason"] for r in spark.read.parquet(st.error_path).collect()) == [
            "extra_keys", "malformed_json", "null_value"]


def test_snapshot_table_survives_a_killed_writer(spark):
    txn = txn_df(spark, _rows(3, 60))
    table = SnapshotTable(spark, scratch_path(spark, f"tests/snapv-{uuid.uuid4().hex[:8]}"), DEFAULT, n_buckets=4)
    f = rolling_features(txn, DEFAULT)
    first = f.where(F.col("us") < int((T0 + 60) * 1e6))
    table.upsert(first if first.count() else f.limit(5))
    before = sorted(map(str, table.read().collect()))
    commit, table._commit = table._commit, lambda *_: (_ for _ in ()).throw(RuntimeError("killed"))
    with pytest.raises(RuntimeError):
        table.upsert(f)
    table._commit = commit
    assert sorted(map(str, table.read().collect())) == before
    assert table.upsert(f) == 2 and table.upsert(f) == 3
    got = table.read()
    assert got.count() == f.select("entity_id").distinct().count()
    assert got.select(F.input_file_name()).distinct().count() <= 4


def test_snapshot_versions_are_kept_then_dropped(spark, monkeypatch):
    txn = txn_df(spark, _rows(3, 60))
    table = SnapshotTable(spark, scratch_path(spark, f"tests/snapk-{uuid.uuid4().hex[:8]}"), DEFAULT, n_buckets=8)
    f = rolling_features(txn, DEFAULT).persist()
    assert table.vacuum() == 0
    for k in range(4):
        table.upsert(f.where(F.pmod(F.hash("transaction_id"), F.lit(4)) <= k))
    assert table.versions() == [1, 2, 3, 4]
    newest, before = (sorted(map(str, table.read(version=v).collect())) for v in (4, 3))
    # a vacuum that dies in the middle leaves what is kept as it was
    fs = type(table)._fs
    calls = []

    class Dying:
        def __init__(self, real):
            self.real = real

        def __getattr__(self, name):
            return getattr(self.real, name)

        def delete(self, *a):
            calls.append(a)
            if len(calls) > 2:
                raise RuntimeError("killed")
            return self.real.delete(*a)

    monkeypatch.setattr(SnapshotTable, "_fs", lambda self: Dying(fs(self)))
    with pytest.raises(RuntimeError):
        table.vacuum(2)
    monkeypatch.setattr(SnapshotTable, "_fs", fs)
    table.vacuum(2)
    assert table.versions() == [3, 4] and table.vacuum(2) == 0
    assert sorted(map(str, table.read().collect())) == newest
    assert sorted(map(str, table.read(version=3).collect())) == before
    assert table.upsert(f) == 5
    # a keyed lookup reads the buckets of its keys only
    keys = f.select("entity_id").distinct().limit(1)
    got = table.lookup(0, keys)
    assert got.count() == 1 and got.select("entity_id").collect() == keys.collect()
    assert len(table.read([0]).inputFiles()) <= 1
    assert table.lookup(0, keys.where("false")).count() == 0


def test_snapshot_lookup_of_unknown_entities_is_a_miss(spark):
    txn = txn_df(spark, _rows(2, 10))
    table = SnapshotTable(spark, scratch_path(spark, f"tests/snapm-{uuid.uuid4().hex[:8]}"), DEFAULT, n_buckets=4)
    table.upsert(rolling_features(txn, DEFAULT))
    assert table.lookup(0, spark.createDataFrame([("nobody",), (None,)], "entity_id string")).count() == 0


@pytest.mark.parametrize("together", [1 << 20, 5])
def test_frames_of_a_batch_are_computed_together(monkeypatch, together):
    """All frames of an entity's new rows at once, in parts of bounded size; nulls do not count."""
    import numpy as np
    from velocis.streaming import stateful
    monkeypatch.setattr(stateful, "FRAME_VALUES", together)
    x = np.array([1.0, np.nan, 4.0, 4.0, np.nan, 7.5, -2.0])
    m = np.array([0, 1, -1, 0, -1, 2, 1])
    lo, hi = np.array([0, 0, 1, 4, 1, 6]), np.array([1, 3, 2, 5, 7, 7])
    got = stateful.frame_statistics(x, lo, hi, m)
    for i, (a, z) in enumerate(zip(lo, hi)):
        v = x[a:z][~np.isnan(x[a:z])]
        want = (len(v), v.sum(), *((v.mean(), v.std(), v.max(), v.min()) if len(v) else (0, 0, 0, 0)))
        assert [got[c][i] for c in ("count", "sum", "mean", "std", "max", "min")] == pytest.approx(want)
        assert got["uniq"][i] == len(set(m[a:z]) - {-1})


def test_the_processor_gives_rows(spark):
    """Rows, not a table an entity: its cost is per entity and micro-batch."""
    from velocis.schemas import DEFAULT
    from velocis.streaming.stateful import RollingFeatureProcessor, output_schema

    class State(list):
        def get(self):
            return iter(self)

        def put(self, rows):
            self[:] = rows

    class Meta:
        value = None

        def get(self):
            return self.value

        def update(self, value):
            self.value = value

    p = RollingFeatureProcessor(DEFAULT)
    p.events, p.meta = State(), Meta()
    new = [{"entity_id": None, "transaction_id": f"t{i}", "us": i * 1_000_000, "amount": None if i == 1 else 2.0,
            "merchant_id": None if i == 2 else "m", "merchant_category": "c", "latitude": 1.0, "longitude": None}
           for i in range(4)]
    out = [*p.handleInputRows((None,), iter(new[:3]), None), *p.handleInputRows((None,), iter(new[3:]), None)]
    assert [r.transaction_id for r in out] == ["t0", "t1", "t2", "t3"]
    assert [*out[3].asDict()] == output_schema(DEFAULT).fieldNames()
    assert (out[3].txn_count_60s, out[3].amount_sum_60s, out[3].unique_merchants_60s) == (3, 6.0, 1)
    assert (out[3].longitude, out[3].prev_latitude, out[3].prev_longitude) == (None, 1.0, None)
