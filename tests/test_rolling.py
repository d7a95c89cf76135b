"""Rolling-window features (W1-W6, A1-A6): literal fixtures, edge cases,
skew splitting and a brute-force comparison."""

import math
import random

import pytest
from pyspark.sql import functions as F

from fixtures import T0, brute_features, haversine, txn_df
from velocis.functions.scalar import haversine_km
from velocis.operators.rolling import latest_per_entity, rolling_features
from velocis.operators.scoring import model_vector
from velocis.schemas import DEFAULT, HOURLY, WindowSet


def rows_by_tid(df):
    return {r["transaction_id"]: r for r in df.collect()}


def test_single_event(spark):
    f = rows_by_tid(rolling_features(txn_df(spark, [("e", "a", T0, 42.5)])))
    r = f["a"]
    assert r["txn_count_60s"] == 1 and r["amount_sum_60s"] == 42.5 and r["amount_mean_60s"] == 42.5
    assert r["amount_std_60s"] == 0.0 and r["amount_zscore"] == 0.0


def test_window_bound_and_isolation(spark):
    f = rows_by_tid(rolling_features(txn_df(spark, [("e", "a", T0 - 10, 999), ("e", "b", T0, 10)])))
    assert f["b"]["txn_count_5s"] == 1 and f["b"]["txn_count_60s"] == 2
    f = rows_by_tid(rolling_features(txn_df(spark, [("e", "a", T0 - 6, 999), ("e", "b", T0, 10)])))
    b = f["b"]
    assert (b["txn_count_1s"], b["txn_count_5s"], b["txn_count_60s"]) == (1, 1, 2)


def test_exact_lower_bound_is_inclusive(spark):
    f = rows_by_tid(rolling_features(txn_df(spark, [("e", "a", T0 - 60, 1.0), ("e", "b", T0, 2.0),
                                                    ("e", "c", T0 + 60, 4.0), ("e", "d", T0 + 60.000001, 8.0)])))
    assert f["b"]["txn_count_60s"] == 2          # t - W exactly counts
    assert f["c"]["txn_count_60s"] == 2          # b at the bound, a out
    assert f["d"]["txn_count_60s"] == 2          # b is 1 us too old for d


def test_std_is_population(spark):
    f = rows_by_tid(rolling_features(txn_df(spark, [("e", "a", T0 - 2, 10), ("e", "b", T0 - 1, 20),
                                                    ("e", "c", T0, 30)])))
    assert f["c"]["amount_std_60s"] == pytest.approx(8.164966, abs=1e-6)
    assert f["c"]["amount_sum_60s"] == 60 and f["c"]["txn_count_60s"] == 3


def test_constant_amounts_give_zero_std_and_zscore(spark):
    f = rows_by_tid(rolling_features(txn_df(spark, [("e", str(i), T0 + i * 0.1, 0.1) for i in range(5)])))
    assert f["4"]["amount_std_60s"] == 0.0 and f["4"]["amount_zscore"] == 0.0


def test_distinct_merchants(spark):
    names = ["alpha", "beta", "alpha", "gamma", "beta"]
    f = rows_by_tid(rolling_features(txn_df(spark, [("e", str(i), T0 + i, 1.0, m) for i, m in enumerate(names)])))
    assert f["4"]["unique_merchants_60s"] == 3


def test_two_events_accumulate(spark):
    f = rows_by_tid(rolling_features(txn_df(spark, [("e", "a", T0 - 1, 50), ("e", "b", T0, 75)])))
    assert (f["b"]["txn_count_60s"], f["b"]["amount_sum_60s"], f["b"]["amount_mean_60s"]) == (2, 125, 62.5)


def test_zscore_outlier(spark):
    rnd = random.Random(7)
    rows = [("e", f"h{i:02d}", T0 - 40 + i, 20 + rnd.uniform(-2, 2)) for i in range(20)]
    rows.append(("e", "x", T0, 2000.0))
    assert rows_by_tid(rolling_features(txn_df(spark, rows)))["x"]["amount_zscore"] > 2.0
    # the current event is inside the window (ingest path), z stays large
    ws = WindowSet(1, 5, 60)
    f = rows_by_tid(rolling_features(txn_df(spark, rows), ws))
    assert f["x"]["amount_zscore"] > 4


def test_burst_velocity(spark):
    rows = [("e", f"a{i}", T0 - 30, 1.0) for i in range(5)] + [("e", f"b{i}", T0, 1.0) for i in range(5)]
    f = rows_by_tid(rolling_features(txn_df(spark, rows)))
    assert f["b4"]["velocity_change_ratio"] == pytest.approx(5 / 10 * 60)


def test_cap_keeps_last_n(spark):
    rows = [("e", f"t{i:02d}", T0, float(i)) for i in range(1, 21)]
    f = rows_by_tid(rolling_features(txn_df(spark, rows), max_events=10))
    assert f["t20"]["txn_count_60s"] == 10 and f["t20"]["amount_sum_60s"] == 155
    assert f["t20"]["amount_min_60s"] == 11 and f["t20"]["amount_max_60s"] == 20


def test_cap_with_many_same_time_peers(spark):
    """The capped frame ends at the row itself: the first of 20 tied events
    sees one row, not N, and count and sum agree."""
    rows = [("e", f"t{i:02d}", T0, float(i)) for i in range(1, 21)]
    f = rows_by_tid(rolling_features(txn_df(spark, rows), max_events=10))
    assert (f["t01"]["txn_count_60s"], f["t01"]["amount_sum_60s"]) == (1, 1.0)
    assert (f["t05"]["txn_count_60s"], f["t05"]["amount_sum_60s"]) == (5, 15.0)
    from velocis.streaming.stateful import rolling_features_stateful
    s = {r["transaction_id"]: r for r in rolling_features_stateful(txn_df(spark, rows), DEFAULT, 10).collect()}
    assert all(s[k]["txn_count_60s"] == f[k]["txn_count_60s"] for k in f)


def test_ties_uncapped_include_peers(spark):
    rows = [("e", f"t{i}", T0, 1.0) for i in range(4)]
    f = rows_by_tid(rolling_features(txn_df(spark, rows)))
    assert all(f[f"t{i}"]["txn_count_60s"] == 4 for i in range(4))


def test_previous_location_and_geo(spark):
    rows = [("e", "a", T0 - 2, 1.0, "m", 51.5, -0.1), ("e", "b", T0 - 1, 1.0, "m", 48.8, 2.3),
            ("e", "c", T0, 1.0, "m", 40.7, -74.0)]
    f = rows_by_tid(rolling_features(txn_df(spark, rows)))
    assert (f["c"]["prev_latitude"], f["c"]["prev_longitude"]) == (48.8, 2.3)
    assert f["a"]["geo_distance_delta"] == 0.0        # no previous event
    assert f["c"]["geo_distance_delta"] > 5000


def test_out_of_order_input_same_result(spark):
    rows = [("e", f"t{i}", T0 + i * 7, float(i)) for i in range(30)]
    shuffled = rows[:]
    random.Random(3).shuffle(shuffled)
    a = rolling_features(txn_df(spark, rows)).drop("computed_at")
    b = rolling_features(txn_df(spark, shuffled).repartition(5)).drop("computed_at")
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_haversine_values(spark):
    df = spark.createDataFrame([(40.7128, -74.0060, 51.5074, -0.1278), (1.0, 1.0, 1.0, 1.0),
                                (0.0, 0.0, 51.5, -0.1), (51.5074, -0.1278, 40.7128, -74.0060),
                                (None, None, 1.0, 1.0)], "a double, b double, c double, d double")
    d = [r[0] for r in df.select(haversine_km("a", "b", "c", "d")).collect()]
    assert 5500 < d[0] < 5600 and d[1] == 0 and d[2] == 0 and d[3] == pytest.approx(d[0]) and d[4] == 0


def test_model_vector_shape(spark):
    f = rolling_features(txn_df(spark, [("e", "a", T0, 5.0), ("e", "b", T0 + 1, 7.0)]))
    vecs = [r[0] for r in f.select(model_vector(DEFAULT)).collect()]
    assert all(len(v) == 20 and all(math.isfinite(x) for x in v) for v in vecs)
    assert dict(f.select(model_vector(DEFAULT).alias("v")).dtypes)["v"] == "array<float>"


def test_latest_per_entity(spark):
    df = txn_df(spark, [("e", "a", T0, 1.0), ("e", "b", T0 + 5, 2.0), ("f", "c", T0, 3.0)])
    got = {r["entity_id"]: r["transaction_id"] for r in latest_per_entity(
        df.select("entity_id", "transaction_id", "us")).collect()}
    assert got == {"e": "b", "f": "c"}


@pytest.mark.parametrize("max_events", [None, 3])
def test_brute_force_random(spark, max_events):
    rnd = random.Random(11 if max_events is None else 12)
    rows = []
    for e in range(4):
        t = T0
        for i in range(40):
            t += rnd.choice([0, 0.5, 1, 2, 3, 7, 20, 70])
            rows.append((f"e{e}", f"e{e}-{i:03d}", t, round(rnd.uniform(1, 100), 2), f"m{rnd.randint(0, 4)}"))
    ws = WindowSet(1, 5, 60)
    got = rows_by_tid(rolling_features(txn_df(spark, rows), ws, max_events=max_events, stats="all"))
    by_e = {}
    for r in rows:
        by_e.setdefault(r[0], []).append({"us": int(round(r[2] * 1e6)), "tid": r[1], "amount": r[3],
                                          "merchant": r[4]})
    for e, evs in by_e.items():
        for ev in evs:
            exp = brute_features(evs, ev["us"], ev["tid"], ws, max_events)
            g = got[ev["tid"]]
            for k, v in exp.items():
                if k.startswith("unique_merchants") and k != "unique_merchants_60s":
                    continue
                assert g[k] == pytest.approx(v, abs=1e-9), (ev["tid"], k)


@pytest.mark.parametrize("hot_rows", [3, 10])
def test_skew_split_equals_unsplit(spark, hot_rows):
    """A hot entity is cut into time slices with replicated context rows and
    the previous location carried across slices; results must not change."""
    rnd = random.Random(5)
    rows, t = [], T0
    for i in range(120):
        t += rnd.choice([0, 1, 2, 30, 200, 4000])
        rows.append(("hot", f"h{i:03d}", t, float(i % 17), f"m{i % 5}", 10 + i * 0.01, 20 - i * 0.01))
    for i in range(10):
        rows.append(("cold", f"c{i}", T0 + i * 100, 1.0, "m", 1.0, 2.0))
    df = txn_df(spark, rows)
    for ws in (DEFAULT, HOURLY):
        a = rolling_features(df, ws, hot_rows=None, max_events=4).drop("computed_at")
        b = rolling_features(df, ws, hot_rows=hot_rows, max_events=4).drop("computed_at")
        cols = [F.round(c, 9).alias(c) if t == "double" else F.col(c) for c, t in a.dtypes]
        a, b = a.select(cols), b.select(cols)
        assert b.count() == a.count()
        assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_single_exchange_for_all_windows(spark):
    f = rolling_features(txn_df(spark, [("e", "a", T0, 1.0)]), HOURLY, hot_rows=None)
    plan = f._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") <= 1


def test_oracle_haversine_matches_python(spark):
    df = txn_df(spark, [("e", "a", T0, 1.0, "m", 10.0, 20.0), ("e", "b", T0 + 1, 1.0, "m", -33.9, 151.2)])
    r = rows_by_tid(rolling_features(df))
    assert r["b"]["geo_distance_delta"] == pytest.approx(haversine(10.0, 20.0, -33.9, 151.2))


def test_distinct_merchants_in_every_window_against_sets(spark):
    """Repeats, ties, nulls and merchants that leave and come back, at block edges."""
    rnd = random.Random(11)
    times = sorted(rnd.choice([rnd.uniform(0, 400), 60.0 * rnd.randrange(7)]) for _ in range(300))
    rows = [("e", f"t{i:03d}", T0 + t, 1.0, rnd.choice(["a", "b", "c", "d", "e", None])) for i, t in enumerate(times)]
    got = rows_by_tid(rolling_features(txn_df(spark, rows), WindowSet(1, 5, 60), unique_all=True))
    us = {r["transaction_id"]: r["us"] for r in got.values()}
    for _, tid, _, _, _ in rows:
        for w in (1, 5, 60):
            want = {m for _, o, _, _, m in rows if m and us[tid] - w * 1_000_000 <= us[o] <= us[tid]}
            assert got[tid][f"unique_merchants_{w}s"] == len(want), (tid, w)


def test_hot_entity_is_spread_over_bounded_groups(spark):
    """One entity with a third of all rows: after slicing, no (entity, split)
    window group holds more than about the row budget plus its context."""
    from velocis.operators import skew
    from velocis.operators.rolling import _frame_rows
    rows = [("hot", f"h{i:04d}", T0 + i * 2.0, 1.0) for i in range(3000)]
    rows += [(f"c{i % 60}", f"c{i:04d}", T0 + i * 1.0, 1.0) for i in range(6000)]
    fr = _frame_rows(txn_df(spark, rows), "entity_id")
    budget = 200
    plan = skew.plan_splits(fr, "entity_id", 60 * 10**6, budget)
    sized = skew.assign_split(fr, plan, replicate=True).groupBy("entity_id", "split").count()
    hot = sized.where("entity_id = 'hot'").collect()
    assert len(hot) >= 3000 // budget - 1
    # budget rows per slice, plus context copies of the last 60 s (30 rows here)
    assert max(r["count"] for r in hot) <= budget + 40
    assert sized.where("entity_id != 'hot'").agg(F.max("split")).first()[0] == 0


def test_auto_budget(spark, monkeypatch):
    """``hot_rows="auto"``: max(default, total / (2 x parallelism)) via a
    scalar subquery; a lowered default makes the hot entity split, results
    unchanged."""
    from velocis.operators import skew
    from velocis.operators.rolling import _frame_rows
    rows = [("hot", f"h{i:03d}", T0 + i * 30.0, float(i % 7), f"m{i % 4}", 1.0 + i, 2.0) for i in range(120)]
    rows += [(f"c{i}", f"c{i:03d}", T0 + i, 1.0) for i in range(10)]
    df = txn_df(spark, rows)
    assert skew.plan_splits(_frame_rows(df, "entity_id"), "entity_id", 60 * 10**6).hot is None
    monkeypatch.setattr(skew, "DEFAULT_HOT_ROWS", 5)
    plan = skew.plan_splits(_frame_rows(df, "entity_id"), "entity_id", 60 * 10**6)
    assert plan.hot is not None and [r["entity_id"] for r in plan.hot.collect()] == ["hot"]
    a = rolling_features(df, DEFAULT, hot_rows=None).drop("computed_at")
    b = rolling_features(df, DEFAULT).drop("computed_at")
    cols = [F.round(c, 9).alias(c) if t == "double" else F.col(c) for c, t in a.dtypes]
    assert a.select(cols).exceptAll(b.select(cols)).count() == 0


@pytest.mark.parametrize("hot_rows,cap", [(None, None), (8, 3)])
def test_since_recompute_equals_full_history(spark, hot_rows, cap):
    from velocis.operators.rolling import rolling_features_since
    rnd = random.Random(17)
    rows, t = [], T0
    for i in range(200):
        t += rnd.choice([0, 1, 5, 20, 70, 400])
        ent = "hot" if i % 2 else f"e{i % 5}"
        rows.append((ent, f"t{i:03d}", t, round(rnd.uniform(1, 90), 2), f"m{i % 4}", 1.0 + i, 2.0 - i))
    df = txn_df(spark, rows)
    ws = WindowSet(1, 5, 60)
    since_us = int((T0 + (t - T0) / 2) * 1e6)
    read_from = since_us - 60 * 10**6
    recent = df.where(F.col("us") >= read_from)
    last_known = latest_per_entity(df.where(F.col("us") < read_from).select(
        "entity_id", "transaction_id", "us", "latitude", "longitude"))
    a = rolling_features_since(recent, last_known, since_us, ws, hot_rows=hot_rows, max_events=cap)
    b = rolling_features(df, ws, hot_rows=None, max_events=cap).where(F.col("us") >= since_us)
    a, b = a.drop("computed_at"), b.drop("computed_at").select(*a.drop("computed_at").columns)
    cols = [F.round(c, 9).alias(c) if t_ == "double" else F.col(c) for c, t_ in a.dtypes]
    assert a.count() == b.count() > 0
    assert a.select(cols).exceptAll(b.select(cols)).count() == 0


def _mixed_rows(n, seed, span_s=80):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        e = r.choice(["a", "a", "a", None, None, "b"])
        ts = T0 + (r.randrange(0, span_s * 1_000_000) / 1e6 if r.random() < .7 else r.randrange(0, 5 * span_s))
        if e == "b":
            ts += r.randrange(10_000)
        rows.append((e, f"t{i:04d}", ts, None if r.random() < .1 else round(r.uniform(1, 99), 2),
                     None if r.random() < .1 else f"m{r.randrange(12)}", r.uniform(1, 50), r.uniform(1, 50)))
    return rows


def assert_same(got, want):
    got, want = rows_by_tid(got), rows_by_tid(want)
    assert set(got) == set(want)
    for k, w in want.items():
        for c in w.asDict():
            assert got[k][c] == w[c] or got[k][c] == pytest.approx(w[c], rel=1e-9, abs=1e-7), (k, c)


@pytest.mark.parametrize("hot_rows", [100, 3])
def test_cells_equal_one_slice(spark, hot_rows):
    """Dense entities, the null entity among them, in cells narrower than a window."""
    df = txn_df(spark, _mixed_rows(500, 3))
    kw = {"unique_all": True, "stats": "all"}
    for ws in (DEFAULT, WindowSet(2, 3, 60)):
        assert_same(rolling_features(df, ws, hot_rows=hot_rows, **kw), rolling_features(df, ws, hot_rows=None, **kw))


def test_cells_of_far_apart_bursts(spark):
    """Whole cells between two bursts are empty; cells of second-level groups far apart."""
    rows = [("e", f"t{b}{i:03d}", T0 + b * 30 + i * 0.011, float(i), f"m{i % 7}", 1.0 + i, 2.0 + b)
            for b in (0, 1, 900, 90_000) for i in range(90)]
    df = txn_df(spark, rows)
    assert_same(rolling_features(df, hot_rows=5, emit=None), rolling_features(df, hot_rows=None))
    assert_same(rolling_features(df, hot_rows=5, idle_ttl_s=100), rolling_features(df, hot_rows=None, idle_ttl_s=100))


def test_one_entity_inside_one_window_is_spread(spark):
    rows = [("e", f"t{i:05d}", T0 + i * 0.007, float(i % 13), f"m{i % 31}") for i in range(8000)]
    keep = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        f = rolling_features(txn_df(spark, rows), hot_rows=20)
        per = sorted(r["count"] for r in f.groupBy(F.spark_partition_id()).count().collect())
    finally:
        for k, v in keep.items():
            spark.conf.set(k, v)
    assert len(per) == 8 and per[-1] < 3 * per[len(per) // 2]


def test_a_hot_null_entity_is_cut(spark):
    from velocis.operators import skew
    df = txn_df(spark, [(None, f"t{i}", T0 + i * 100, 1.0) for i in range(90)] + [("e", "x", T0, 1.0)])
    rows = df.withColumn("tid", F.col("transaction_id"))
    plan = skew.plan_splits(rows, "entity_id", 60_000_000, 30)
    cut = skew.assign_split(rows, plan, replicate=False).where("entity_id IS NULL").select("split").distinct().count()
    assert cut == 3
    entry = skew.entry_table(rows, plan, ["latitude"])
    assert entry.where("entity_id IS NULL").count() >= 2


@pytest.mark.parametrize("n", [1, 2, 37])
def test_capped_frames_equal_brute_force(spark, n):
    r = random.Random(n)
    rows = [(r.choice("ab"), f"t{i:03d}", T0 + r.randrange(0, 90), float(r.randrange(99)), f"m{r.randrange(9)}")
            for i in range(260)]
    f = rows_by_tid(rolling_features(txn_df(spark, rows), max_events=n))
    ev = [{"e": e, "tid": t, "us": int(s * 1e6), "amount": a, "m": m} for e, t, s, a, m in rows]
    for x in ev:
        mine = sorted((y for y in ev if y["e"] == x["e"]), key=lambda y: (y["us"], y["tid"]))
        fr = [y for y in mine if x["us"] - 60_000_000 <= y["us"] <= x["us"]]
        if len(fr) > n:
            fr = [y for y in mine if (y["us"], y["tid"]) <= (x["us"], x["tid"])][-n:]
        got = f[x["tid"]]
        a = [y["amount"] for y in fr]
        mean = sum(a) / len(a)
        assert (got["txn_count_60s"], got["amount_sum_60s"], got["amount_max_60s"], got["amount_min_60s"]) == \
            (len(a), sum(a), max(a), min(a))
        assert got["unique_merchants_60s"] == len({y["m"] for y in fr})
        assert got["amount_std_60s"] == pytest.approx(math.sqrt(sum((v - mean) ** 2 for v in a) / len(a)), abs=1e-9)


@pytest.mark.parametrize("cap", [1, 2, 7, 300])
def test_capped_cells_equal_one_slice(spark, cap):
    """Capped frames of dense entities, the null entity among them, are cut into cells and blocks of ranks."""
    df = txn_df(spark, _mixed_rows(400, 5))
    kw = {"unique_all": True, "stats": "all", "max_events": cap}
    assert_same(rolling_features(df, hot_rows=20, **kw), rolling_features(df, hot_rows=None, **kw))


def test_a_capped_entity_inside_one_window_is_spread(spark):
    rows = [("e", f"t{i:05d}", T0 + i * 0.007, float(i % 13), f"m{i % 31}") for i in range(4000)]
    keep = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        f = rolling_features(txn_df(spark, rows), hot_rows=20, max_events=50)
        per = sorted(r["count"] for r in f.groupBy(F.spark_partition_id()).count().collect())
    finally:
        for k, v in keep.items():
            spark.conf.set(k, v)
    assert len(per) > 1 and per[-1] < len(rows) // 2


def test_partitions_of_copied_rows_follow_the_rows(spark, monkeypatch):
    """A partition holds a bounded number of rows, however Spark would join partitions by their bytes."""
    from velocis.operators import skew
    monkeypatch.setattr(skew, "PARTITION_ROWS", 100)
    rows = [(f"e{i % 20}", f"t{i:05d}", T0 + i * 0.01, 1.0) for i in range(4000)]
    f = rolling_features(txn_df(spark, rows))
    assert "REPARTITION_BY_NUM" in f._jdf.queryExecution().executedPlan().toString()
    per = [r["count"] for r in f.groupBy(F.spark_partition_id()).count().collect()]
    assert len(per) > 8 and sum(per) == 4000


def test_partitions_follow_the_rows_without_hot_entities(spark, monkeypatch):
    """No entity is hot: the one exchange of the frames is that of ``spread``."""
    from velocis.operators import rolling, skew
    monkeypatch.setattr(skew, "PARTITION_ROWS", 40)
    monkeypatch.setattr(rolling, "SHORT_FRAME", 1)
    rows = spark.range(800).selectExpr(
        "concat('e', id % 40) AS entity_id", "cast(id AS string) AS transaction_id", "id * 1000000 AS us",
        "cast(id AS double) AS amount", "concat('m', id % 3) AS merchant_id", "'x' AS merchant_category",
        "1.0D AS latitude", "2.0D AS longitude")
    out = rolling.rolling_features(rows)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan and "ENSURE_REQUIREMENTS" not in plan
    assert out.rdd.getNumPartitions() == 20 and out.count() == 800
