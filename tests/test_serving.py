"""Serving (J1-J5, P2, P5): point-in-time features, as-of snapshots, tiers."""

import random

from pyspark.sql import functions as F

import pytest


from fixtures import T0, brute_features, haversine, request_df, txn_df
from velocis.operators.rolling import latest_per_entity, rolling_features
from velocis.operators.serving import (
    asof_join, cold_entities, point_in_time_features, project_features, serve_from_snapshot, serve_tiered,
)
from velocis.schemas import DEFAULT, WindowSet


def by_req(df):
    return {r["request_id"]: r for r in df.collect()}


def test_unknown_entity_is_all_zero(spark):
    ev = txn_df(spark, [("e", "a", T0, 5.0)])
    rq = request_df(spark, [("r1", "nobody", T0, 42.0)])
    r = by_req(point_in_time_features(ev, rq))["r1"]
    assert r["txn_count_60s"] == 0 and r["amount_sum_60s"] == 0 and r["amount_zscore"] == 0
    assert r["current_amount"] == 42.0 and r["geo_distance_delta"] == 0


def test_request_sees_events_up_to_its_time_only(spark):
    ev = txn_df(spark, [("e", "a", T0 - 30, 10.0), ("e", "b", T0, 20.0), ("e", "c", T0 + 1, 999.0)])
    rq = request_df(spark, [("r1", "e", T0, 1.0)])
    r = by_req(point_in_time_features(ev, rq))["r1"]
    assert r["txn_count_60s"] == 2 and r["amount_sum_60s"] == 30.0     # c is in the future


def test_geo_skips_the_scored_transaction(spark):
    ev = txn_df(spark, [("e", "a", T0 - 10, 1.0, "m", 40.7, -74.0), ("e", "b", T0 - 2, 1.0, "m", 51.5, -0.1)])
    # request for transaction b, 2 s after it: previous location is a, not b
    rq = request_df(spark, [("r1", "e", T0, 1.0, 51.5, -0.1, "b"), ("r2", "e", T0, 1.0, 51.5, -0.1, "zz")])
    out = by_req(point_in_time_features(ev, rq))
    assert out["r1"]["geo_distance_delta"] == pytest.approx(haversine(40.7, -74.0, 51.5, -0.1))
    assert out["r2"]["geo_distance_delta"] == 0.0


def test_live_against_brute_force(spark):
    rnd = random.Random(3)
    rows, reqs = [], []
    for e in range(3):
        t = T0
        for i in range(30):
            t += rnd.choice([0, 1, 2, 5, 40, 90])
            rows.append((f"e{e}", f"e{e}-{i:02d}", t, round(rnd.uniform(1, 50), 2), f"m{rnd.randint(0, 3)}",
                         rnd.uniform(-60, 60), rnd.uniform(-120, 120)))
    for k, r in enumerate(rows):
        reqs.append((f"q{k}", r[0], r[2] + rnd.choice([0, 0.5, 3, 61]), 7.0, 10.0, 10.0, r[1]))
    ws = WindowSet(1, 5, 60)
    got = by_req(point_in_time_features(txn_df(spark, rows), request_df(spark, reqs), ws, hot_rows=None))
    got_split = by_req(point_in_time_features(txn_df(spark, rows), request_df(spark, reqs), ws, hot_rows=4))
    evs = {}
    for r in rows:
        evs.setdefault(r[0], []).append({"us": int(round(r[2] * 1e6)), "tid": r[1], "amount": r[3],
                                         "merchant": r[4], "lat": r[5], "lon": r[6]})
    for q in reqs:
        t = int(round(q[2] * 1e6))
        exp = brute_features(evs[q[1]], t, "~", ws)
        prior = sorted([x for x in evs[q[1]] if x["us"] <= t and x["tid"] != q[6]], key=lambda x: (x["us"], x["tid"]))
        geo = haversine(prior[-1]["lat"], prior[-1]["lon"], 10.0, 10.0) if prior else 0.0
        for g in (got[q[0]], got_split[q[0]]):
            for k in ("txn_count_60s", "amount_sum_60s", "amount_std_60s", "amount_max_60s", "amount_min_60s",
                      "txn_count_1s", "amount_mean_5s", "unique_merchants_60s"):
                assert g[k] == pytest.approx(exp[k], abs=1e-9), (q, k)
            assert g["geo_distance_delta"] == pytest.approx(geo, abs=1e-6), q


def test_asof_join_with_max_age(spark):
    snaps = spark.createDataFrame([("e", T0 * 10**6, 1.0), ("e", (T0 + 100) * 10**6, 2.0)],
                                  "entity_id string, us long, v double")
    probe = spark.createDataFrame([("p1", "e", (T0 + 50) * 10**6), ("p2", "e", (T0 + 100) * 10**6),
                                   ("p3", "e", (T0 + 401) * 10**6), ("p4", "e", (T0 - 1) * 10**6),
                                   ("p5", "x", T0 * 10**6)], "pid string, entity_id string, t long")
    for hot in (None, 1):
        j = {r["pid"]: r for r in asof_join(probe, snaps, "entity_id", "t", "us", ["v"], max_age_us=300 * 10**6,
                                            hot_rows=hot).collect()}
        assert j["p1"]["v"] == 1.0 and j["p2"]["v"] == 2.0          # same instant matches
        assert j["p3"]["v"] is None                                  # 301 s old > 300 s: stale (Q10)
        assert j["p4"]["v"] is None and j["p5"]["v"] is None


def test_snapshot_serving_zero_fill_and_overlay(spark):
    ev = txn_df(spark, [("e", "a", T0 - 5, 10.0), ("e", "b", T0, 30.0)])
    latest = latest_per_entity(rolling_features(ev).drop("computed_at"))
    rq = request_df(spark, [("r1", "e", T0 + 1, 99.0), ("r2", "new", T0 + 1, 5.0)])
    out = by_req(serve_from_snapshot(rq, latest))
    assert out["r1"]["txn_count_60s"] == 2 and out["r1"]["current_amount"] == 99.0 and out["r1"]["snapshot_found"]
    assert out["r2"]["txn_count_60s"] == 0 and not out["r2"]["snapshot_found"]


def test_tiered_uses_fresh_snapshot_else_live(spark):
    ev = txn_df(spark, [("e", "a", T0, 10.0), ("e", "b", T0 + 1, 30.0), ("f", "c", T0, 5.0)])
    flog = rolling_features(ev)
    rq = request_df(spark, [("r1", "e", T0 + 2, 1.0), ("r2", "f", T0 + 1000, 1.0)])
    out = by_req(serve_tiered(ev, flog, rq, DEFAULT, max_age_s=300))
    assert out["r1"]["served_from"] == "snapshot" and out["r1"]["txn_count_60s"] == 2
    assert out["r2"]["served_from"] == "live" and out["r2"]["txn_count_60s"] == 0


def test_cold_entities_and_projection(spark):
    ev = txn_df(spark, [("e", "a", T0, 1.0)])
    rq = request_df(spark, [("r1", "e", T0, 1.0), ("r2", "n", T0, 1.0)])
    assert [r["request_id"] for r in cold_entities(rq, ev).collect()] == ["r2"]
    f = rolling_features(ev)
    assert project_features(f, ["txn_count_60s", "nope"]).columns == ["entity_id", "txn_count_60s"]
    assert project_features(f, []).columns == f.columns


def test_batch_of_five_requests_gives_five_rows(spark):
    ev = txn_df(spark, [("e", "a", T0, 1.0)])
    rq = request_df(spark, [(f"r{i}", "e", T0 + i, 1.0) for i in range(5)])
    assert point_in_time_features(ev, rq).count() == 5


def test_live_plan_shuffles_events_once(spark):
    ev = txn_df(spark, [("e", "a", T0, 1.0)])
    rq = request_df(spark, [("r1", "e", T0, 1.0)])
    plan = point_in_time_features(ev, rq, hot_rows=None)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_fused_tiered_equals_asof_tiered(spark):
    rnd = random.Random(8)
    rows, reqs, t = [], [], T0
    for i in range(80):
        t += rnd.choice([0, 1, 5, 30, 200, 900])
        rows.append((f"e{i % 2}", f"t{i:03d}", t, float(i % 13), f"m{i % 4}", 5.0 + i, 7.0 - i))
    for k, r in enumerate(rows):
        reqs.append((f"q{k}", r[0], r[2] + rnd.choice([0, 2, 100, 400]), 3.0, 1.0, 1.0, r[1]))
    ev, rq = txn_df(spark, rows), request_df(spark, reqs)
    ws = WindowSet(1, 5, 60)
    ref = serve_tiered(ev, rolling_features(ev, ws, hot_rows=None), rq, ws, 300, hot_rows=None)
    for hot in (None, 6):
        fused = serve_tiered(ev, None, rq, ws, 300, hot_rows=hot)
        cols = [c for c in ref.columns]
        a = ref.select(*cols).collect()
        b = {r["request_id"]: r for r in fused.select(*cols).collect()}
        assert len(b) == len(a)
        for r in a:
            for c in cols:
                x, y = r[c], b[r["request_id"]][c]
                assert (x == y) or (isinstance(x, float) and abs(x - y) < 1e-9), (hot, r["request_id"], c, x, y)
    assert {r["served_from"] for r in a} == {"snapshot", "live"}


def test_hot_requests_split_even_with_few_events(spark):
    """An entity with few events but many requests is split too, and the
    answers do not change."""
    ev = txn_df(spark, [("e", f"t{i}", T0 + i * 50, float(i), "m", 1.0 + i, 2.0) for i in range(6)])
    rq = request_df(spark, [(f"q{k}", "e", T0 + k * 3, 1.0, 5.0, 5.0, f"t{k % 6}") for k in range(120)])
    ws = WindowSet(1, 5, 60)
    from velocis.operators import skew
    from velocis.operators.rolling import _frame_rows
    plan = skew.plan_splits(_frame_rows(ev, "entity_id").select("entity_id", "us").unionByName(
        rq.select("entity_id", F.unix_micros("request_ts").alias("us"))), "entity_id", 60 * 10**6, 20)
    assert plan.hot is not None and plan.hot.first()["split_last"] > 1
    a = point_in_time_features(ev, rq, ws, hot_rows=None).drop("us")
    b = point_in_time_features(ev, rq, ws, hot_rows=20).drop("us")
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_serve_from_stored_snapshot_table(spark):
    import uuid
    from velocis.session import scratch_path
    from velocis.sources.sinks import SnapshotTable
    ev = txn_df(spark, [("e", "a", T0 - 5, 10.0), ("e", "b", T0, 30.0), ("f", "c", T0 - 1000, 1.0)])
    table = SnapshotTable(spark, scratch_path(spark, f"tests/snap-{uuid.uuid4().hex[:8]}"), DEFAULT, n_buckets=4)
    table.upsert(rolling_features(ev))
    live = table.lookup((T0 + 10) * 10**6)          # f's snapshot expired (TTL 300 s)
    rq = request_df(spark, [("r1", "e", T0 + 10, 99.0), ("r2", "f", T0 + 10, 5.0)])
    out = by_req(serve_from_snapshot(rq, live))
    assert out["r1"]["snapshot_found"] and out["r1"]["txn_count_60s"] == 2 and out["r1"]["current_amount"] == 99.0
    assert not out["r2"]["snapshot_found"] and out["r2"]["txn_count_60s"] == 0


def test_split_paths_without_broadcast(spark, monkeypatch):
    """Above the broadcast bound the hot and entry tables are shuffle-joined;
    results must not change."""
    from velocis.operators import skew
    rnd = random.Random(13)
    rows, reqs, t = [], [], T0
    for i in range(90):
        t += rnd.choice([0, 1, 5, 30, 200])
        rows.append(("hot", f"t{i:03d}", t, float(i % 11), f"m{i % 3}", 3.0 + i, 4.0 - i))
        reqs.append((f"q{i}", "hot", t + rnd.choice([0, 2, 50]), 2.0, 1.0, 1.0, f"t{i:03d}"))
    ev, rq = txn_df(spark, rows), request_df(spark, reqs)
    ws = WindowSet(1, 5, 60)
    base_f = rolling_features(ev, ws, hot_rows=None).drop("computed_at")
    base_t = serve_tiered(ev, None, rq, ws, 300, hot_rows=None)
    monkeypatch.setattr(skew, "DEFAULT_BROADCAST_ROWS", 0)
    f = rolling_features(ev, ws, hot_rows=10).drop("computed_at")
    tt = serve_tiered(ev, None, rq, ws, 300, hot_rows=10)
    plan = f._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan
    for a, b in ((base_f, f), (base_t, tt)):
        cols = [F.round(c, 9).alias(c) if t_ == "double" else F.col(c) for c, t_ in a.dtypes]
        a, b = a.select(cols), b.select(cols)
        assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0
