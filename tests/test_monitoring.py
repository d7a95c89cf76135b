"""Monitoring aggregates and ordered metrics against brute force."""

import random


import numpy as np
import pytest
from pyspark.sql import functions as F

from velocis.operators.monitoring import (
    batch_summary, class_balance, cumulative_histogram, engine_totals, histogram_quantile, latency_report,
    serving_coverage, throughput_report,
)
from velocis.operators.ordering import ranked
from velocis.operators.training import average_precision, classification_report, roc_auc


def test_nearest_rank_report_matches_rule(spark):
    rnd = random.Random(1)
    vals = [round(rnd.expovariate(0.1), 3) for _ in range(997)] + [5.0] * 20
    df = spark.createDataFrame([(("a" if i % 3 else "b"), v) for i, v in enumerate(vals)], "g string, v double")
    rep = {r["g"]: r for r in latency_report(df, "v", ["g"]).collect()}
    for g in ("a", "b"):
        xs = sorted(v for i, v in enumerate(vals) if ("a" if i % 3 else "b") == g)
        n = len(xs)
        for p in (50, 90, 95, 99):
            assert rep[g][f"p{p}"] == xs[min(int(n * p / 100), n - 1)]
        assert rep[g]["n"] == n and rep[g]["max"] == max(xs)
        assert rep[g]["mean"] == pytest.approx(sum(xs) / n)


def test_ranked_prefix_sums_across_many_partitions(spark):
    rnd = random.Random(2)
    vals = [rnd.randint(0, 300) for _ in range(3000)]
    df = spark.createDataFrame([(v,) for v in vals], "v long")
    r = {row["v"]: row for row in ranked(df, "v", buckets=13).collect()}
    cum = 0
    for v in sorted(set(vals)):
        cum += vals.count(v)
        assert r[v]["cum_n"] == cum and r[v]["total_n"] == len(vals)


def _auc(scores, labels):
    order = np.argsort(scores, kind="mergesort")
    s = np.asarray(scores)[order]
    ranks = np.empty(len(s))
    i = 0
    while i < len(s):
        j = i
        while j + 1 < len(s) and s[j + 1] == s[i]:
            j += 1
        ranks[i:j + 1] = (i + j) / 2 + 1
        i = j + 1
    y = np.asarray(labels)[order]
    p = y.sum()
    return (ranks[y == 1].sum() - p * (p + 1) / 2) / (p * (len(y) - p))


def _ap(scores, labels):
    total_p = sum(labels)
    ap, prev_r = 0.0, 0.0
    for t in sorted(set(scores), reverse=True):
        tp = sum(1 for s, y in zip(scores, labels) if s >= t and y == 1)
        n = sum(1 for s in scores if s >= t)
        r = tp / total_p
        ap += (r - prev_r) * (tp / n)
        prev_r = r
    return ap


def test_auc_ap_and_report_against_brute_force(spark):
    rnd = random.Random(4)
    rows = [(round(rnd.random(), 2), int(rnd.random() < 0.3)) for _ in range(800)]
    df = spark.createDataFrame(rows, "score double, label int")
    s, y = [r[0] for r in rows], [r[1] for r in rows]
    assert roc_auc(df).first()[0] == pytest.approx(_auc(s, y))
    assert average_precision(df).first()[0] == pytest.approx(_ap(s, y))
    rep = {r["class"]: r for r in classification_report(df).collect()}
    tp = sum(1 for a, b in rows if a > 0.5 and b == 1)
    fp = sum(1 for a, b in rows if a > 0.5 and b == 0)
    assert rep["fraud"]["precision"] == pytest.approx(tp / (tp + fp))
    assert rep["fraud"]["support"] == sum(y)


def test_histogram_and_quantile(spark):
    df = spark.createDataFrame([(v,) for v in [0.05, 0.15, 0.15, 0.35, 0.95, None]], "x double")
    h = cumulative_histogram(df, "x", (0.1, 0.2, 0.5, 1.0))
    got = {r["le"]: r["bucket_count"] for r in h.collect()}
    assert got == {"0.1": 1, "0.2": 3, "0.5": 4, "1.0": 5, "+Inf": 5}
    q = histogram_quantile(h, 0.5).first()["quantile"]
    # rank 2.5 falls in (0.1, 0.2] holding counts 1..3: 0.1 + 0.1 * (2.5 - 1) / 2
    assert q == pytest.approx(0.175)


def test_small_reports(spark):
    sc = spark.createDataFrame([("b1", 0.1, None, 10), ("b1", None, "boom", 5), ("b2", 0.9, None, 7)],
                               "batch_id string, fraud_probability double, error string, inference_latency_us long")
    s = {r["batch_id"]: r for r in batch_summary(sc).collect()}
    assert (s["b1"]["total"], s["b1"]["succeeded"], s["b1"]["failed"], s["b1"]["total_latency_us"]) == (2, 1, 1, 15)
    served = spark.createDataFrame([("snapshot",), ("live",), ("snapshot",)], "served_from string")
    assert serving_coverage(served).first()["coverage"] == pytest.approx(0.6667)
    lab = spark.createDataFrame([(1,), (0,), (0,), (0,)], "label int")
    cb = class_balance(lab).first()
    assert cb["pos_weight"] == 3.0 and cb["positive_rate"] == 0.25
    t = spark.createDataFrame([("e1", 0), ("e2", 2_000_000), ("e1", 4_000_000)], "entity_id string, us long")
    tr = throughput_report(t).first()
    assert tr["n"] == 3 and tr["elapsed_s"] == 4.0 and tr["rows_per_s"] == 0.75
    tot = engine_totals(t, t, t).first()
    assert (tot["tracked_entities"], tot["total_events_ingested"], tot["requests_served"], tot["ready"]) == (2, 3, 3, True)


def test_ranked_does_not_rest_on_exchange_reuse(spark):
    rnd = random.Random(5)
    df = spark.createDataFrame([(rnd.choice("ab"), rnd.choice([0.5, rnd.random()]), rnd.random() < 0.4)
                                for _ in range(2000)], "g string, v double, y boolean")
    got = []
    for reuse in ("true", "false"):
        spark.conf.set("spark.sql.exchange.reuse", reuse)
        try:
            rows = ranked(df, "v", {"n": F.lit(1), "pos": F.col("y").cast("int")}, group=["g"], buckets=9).collect()
        finally:
            spark.conf.unset("spark.sql.exchange.reuse")
        got.append(sorted(tuple(r) for r in rows))
    assert got[0] == got[1]
    for g in "ab":
        cum = 0
        part = [r for r in got[0] if r[0] == g]
        for r in part:
            cum += r[2]
            assert r[4] == cum
        assert {r[6] for r in part} == {cum}


def test_bounds_below_is_a_binary_search(spark):
    import bisect
    import random
    from velocis.operators.ordering import bounds_below
    r = random.Random(3)
    values = [r.uniform(-5, 5) for _ in range(60)] + [-9.0, 9.0, 0.0, float("nan"), float("inf")]
    for n in (0, 1, 2, 3, 7, 8, 100):
        bounds = sorted({round(r.uniform(-5, 5), 1) for _ in range(n)} | ({0.0} if n else set()))
        df = spark.createDataFrame([(v,) for v in values], "v double")
        got = [x[0] for x in df.select(bounds_below(F.col("v"), bounds)).collect()]
        assert got == [len(bounds) if v != v else bisect.bisect_left(bounds, v) for v in values]


def test_made_request_ids_are_unique_and_the_same_again(spark):
    from velocis.operators.scoring import request_defaults
    from fixtures import request_df
    req = request_df(spark, [("r1", "e", 5.0, 1.0, 1.0, 2.0, "t1"), (None, "e", 5.0, 1.0), (None, "e", 5.0, 1.0)])
    ids = sorted(r["request_id"] for r in request_defaults(req).collect())
    assert len(set(ids)) == 3 and "r1" in ids
    assert ids == sorted(r["request_id"] for r in request_defaults(req.repartition(3)).collect())
