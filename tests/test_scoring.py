"""Scoring (M10, F2-F4, P6, P7, X2) and bands at their exact edges."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from fixtures import T0, request_df, txn_df
from velocis.operators.rolling import rolling_features
from velocis.operators.scoring import LinearScorer, batch_score, decide, optional_outputs, score_with
from velocis.schemas import DEFAULT


def test_bands_and_edges(spark):
    df = spark.createDataFrame([(p,) for p in (0.1, 0.2, 0.45, 0.5, 0.85)], "p double")
    out = [(r["decision"], r["confidence"], r["is_fraud"]) for r in decide(df, "p").orderBy("p").collect()]
    assert out[0] == ("APPROVE", pytest.approx(0.9), False)
    assert out[1][0] == "REVIEW" and out[1][1] == 0.5           # p = 0.2 is REVIEW
    assert out[2][0] == "REVIEW"
    assert out[3] == ("DECLINE", 0.5, False)                     # p = 0.5: DECLINE, is_fraud false
    assert out[4] == ("DECLINE", 0.85, True)


def test_include_features_and_explain_flags(spark):
    f = rolling_features(txn_df(spark, [("e", "a", T0, 5.0), ("e", "b", T0 + 1, 6.0)]))
    f = f.withColumn("include_features", F.col("transaction_id") == "a").withColumn("explain", F.lit(True))
    o = {r["transaction_id"]: r for r in optional_outputs(f, DEFAULT, importances=[0.05] * 20).collect()}
    assert o["a"]["features"] is not None and o["b"]["features"] is None
    assert len(o["a"]["explanations"]) == 20
    assert o["a"]["explanations"]["current_amount"] == pytest.approx(0.05 * 5.0)
    o2 = optional_outputs(f, DEFAULT).first()               # no importances: empty map
    assert o2["explanations"] == {}


def test_batch_score_end_to_end(spark):
    ev = txn_df(spark, [("e", "a", T0, 5.0), ("e", "b", T0 + 1, 500.0)])
    rq = request_df(spark, [(f"r{i}", "e", T0 + 2 + i, 10.0 * (i + 1)) for i in range(5)])
    model = LinearScorer({"current_amount": 0.1}, -3.0)
    out = batch_score(rq, ev, rolling_features(ev), model, DEFAULT, max_age_s=300).collect()
    assert len(out) == 5 and {r["request_id"] for r in out} == {f"r{i}" for i in range(5)}
    for r in out:
        p = 1 / (1 + np.exp(3.0 - 0.1 * r["current_amount"]))
        assert r["fraud_probability"] == pytest.approx(p, rel=1e-6)
        assert r["batch_id"] == "b0"


def test_score_with_any_predict_proba(spark):
    f = rolling_features(txn_df(spark, [("e", "a", T0, 5.0), ("e", "b", T0 + 1, 6.0)]))

    def proba(x):
        p = 1 / (1 + np.exp(-(x[:, 19] - 5.5)))
        return np.stack([1 - p, p], axis=1)

    out = {r["transaction_id"]: r["fraud_probability"] for r in score_with(f, proba).collect()}
    assert out["a"] == pytest.approx(1 / (1 + np.exp(0.5))) and out["b"] == pytest.approx(1 / (1 + np.exp(-0.5)))


def test_trained_models_invariants(spark):
    from velocis.operators.training import (
        feature_importances, predict, roc_auc, stratified_split, top_features, train_gbt, train_lr, training_set,
    )
    rows = [("e%d" % (i % 7), "t%04d" % i, T0 + i * 13, float(20 + (i % 50) * 7), "m%d" % (i % 3))
            for i in range(400)]
    ev = txn_df(spark, rows)
    labels = ev.select("transaction_id", (F.col("amount") > 250).alias("is_fraud"))
    ts = training_set(rolling_features(ev), labels, DEFAULT)
    train, test = stratified_split(ts)
    gbt = train_gbt(train, DEFAULT, max_iter=10, max_depth=3)
    s = predict(gbt, test)
    assert s.where((F.col("score") < 0) | (F.col("score") > 1)).count() == 0
    assert roc_auc(s).first()[0] > 0.95
    imp = feature_importances(gbt, spark, DEFAULT)
    assert abs(sum(r["importance"] for r in imp.collect()) - 1.0) < 1e-6
    # events are 13 s apart, so the 1 s window carries the same signal as the amount
    assert top_features(imp, 5).first()["feature"] in {"current_amount", "amount_sum_1s", "amount_mean_1s"}
    lr, scaler = train_lr(train, DEFAULT, max_iter=50)
    assert roc_auc(predict(lr, test)).first()[0] > 0.95


def test_batch_score_with_trained_pipeline(spark):
    from velocis.operators.training import stratified_split, train_gbt, training_set
    rows = [("e%d" % (i % 7), "t%04d" % i, T0 + i * 13, float(20 + (i % 50) * 7)) for i in range(300)]
    ev = txn_df(spark, rows).withColumn("is_fraud", F.col("amount") > 250)
    data = training_set(rolling_features(ev, carry=("is_fraud",)), None, DEFAULT)
    train, _ = stratified_split(data)
    model = train_gbt(train, DEFAULT, max_iter=5, max_depth=3)
    rq = request_df(spark, [(f"r{i}", "e1", T0 + 4000 + i, 400.0 if i % 2 else 30.0) for i in range(6)])
    out = {r["request_id"]: r for r in batch_score(rq, ev, None, model, DEFAULT).collect()}
    assert len(out) == 6 and all(0 <= r["fraud_probability"] <= 1 for r in out.values())
    assert out["r1"]["fraud_probability"] > out["r0"]["fraud_probability"]
    from velocis.operators.training import train_lr
    lr, _ = train_lr(train, DEFAULT, max_iter=50)      # scaler travels inside the pipeline
    out = {r["request_id"]: r for r in batch_score(rq, ev, None, lr, DEFAULT).collect()}
    # answered from the last event's snapshot; only the request amount differs
    assert all(r["served_from"] == "snapshot" for r in out.values())
    assert out["r1"]["fraud_probability"] > out["r0"]["fraud_probability"]


def test_n_requests_in_n_rows_out_without_ids(spark):
    """Identical requests, absent and repeated ids: one row each, generated ids unique."""
    ev = txn_df(spark, [("e", "a", T0, 5.0), ("e", "b", T0 + 1, 500.0)])
    rq = request_df(spark, [(f"r{i // 2}", "e", T0 + 2, 10.0) for i in range(4)])
    rq = rq.withColumn("request_id", F.when(F.col("request_id") == "r1", F.col("request_id"))) \
           .withColumn("transaction_id", F.lit(None).cast("string"))
    for log in (None, rolling_features(ev)):
        out = batch_score(rq, ev, log, LinearScorer({"current_amount": 0.1}, -3.0), DEFAULT).collect()
        assert len(out) == 4
        assert len({r["transaction_id"] for r in out}) == 4
        assert sorted(r["request_id"] == "r1" for r in out) == [False, False, True, True]
        assert len({r["request_id"] for r in out}) == 3


def test_newton_logistic_regression_equals_train_lr(spark):
    """Same coefficients as the quasi-Newton solver; zero gradient; constant and null features."""
    from velocis.operators.newton import lr_gradient, train_lr_newton
    from velocis.operators.training import train_lr
    from velocis.schemas import DEFAULT
    rnd = __import__("random").Random(5)
    cols = DEFAULT.feature_columns()
    rows = []
    for i in range(400):
        x = [rnd.gauss(0, 1 + k) + 100 * (k == 3) for k in range(len(cols))]
        x[7] = 4.0  # constant
        y = int(0.8 * x[0] - 0.3 * x[1] + 0.1 * x[5] + rnd.gauss(0, 1) > 1.2)
        rows.append((f"t{i}", *x, y))
    schema = "transaction_id string, " + ", ".join(f"{c} double" for c in cols) + ", label int"
    train = spark.createDataFrame(rows, schema).repartition(3)
    model = train_lr_newton(train)
    lr = train_lr(train, max_iter=2000)[0].stages[-1]
    assert model.coefficients == pytest.approx(list(lr.coefficients), abs=1e-4)
    assert model.intercept == pytest.approx(lr.intercept, abs=1e-4) and model.rounds < 20
    assert max(abs(r["gradient"]) for r in lr_gradient(train, model).collect()) < 1e-9
    holes = train.unionByName(spark.createDataFrame([("n", *[None] * len(cols), 1)], schema))
    assert train_lr_newton(holes).coefficients == pytest.approx(model.coefficients, abs=1e-9)
    with pytest.raises(ValueError):
        train_lr_newton(train.where("label = 1"))
    with pytest.raises(ValueError):
        train_lr_newton(train.where("false"))


def test_train_lr_computes_the_features_once(spark, monkeypatch):
    """Scaler, class counts, row count and fit read a written training set."""
    from conftest import SF001
    from velocis.plans import training_queries as tq

    class Seen(Exception):
        pass

    def fit(train, *_):
        raise Seen(train._jdf.queryExecution().executedPlan().toString())

    monkeypatch.setattr(tq, "train_lr", fit)
    with pytest.raises(Seen) as e:
        tq.q_train_lr(spark, SF001)
    assert "Window" not in str(e.value) and "parquet" not in str(e.value)


def test_boosted_trees_are_fitted_on_partitions_of_many_rows(spark, monkeypatch):
    """Each level of each tree is a job: its tasks follow the cores, not the partitions of the features."""
    from pyspark.ml import Pipeline
    from velocis.operators.training import train_gbt
    cores = spark.sparkContext.defaultParallelism
    cols = [f"cast(id % {k + 2} AS double) AS {c}" for k, c in enumerate(DEFAULT.feature_columns())]
    train = spark.range(400).selectExpr("id AS transaction_id", *cols, "cast(id % 3 = 0 AS int) AS label") \
        .repartition(cores * 5)
    seen, fit = [], Pipeline.fit
    monkeypatch.setattr(Pipeline, "fit", lambda self, df: seen.append(df.rdd.getNumPartitions()) or fit(self, df))
    train_gbt(train, DEFAULT, max_iter=1, max_depth=2)
    assert seen == [cores]
