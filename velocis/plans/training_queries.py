"""Queries for training and evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from velocis.operators.monitoring import class_balance
from velocis.operators.rolling import rolling_features
from velocis.operators.training import (
    average_precision, classification_report, feature_importances, fit_scaler, predict, roc_auc,
    stratified_split, top_features, train_gbt, train_lr, training_set, union_shuffle,
)
from velocis.plans.catalog import ROUND, feature_exprs, register, rounded
from velocis.plans.oracle import TXN
from velocis.plans.scoring_queries import SCORED_LINEAR_SQL, _flog_sql, demo_scorer
from velocis.schemas import HOURLY
from velocis.sources.tables import transactions


def _train_set(spark, sf_dir):
    flog = rolling_features(transactions(spark, sf_dir), HOURLY, carry=("is_fraud",))
    return training_set(flog, None, HOURLY)


def _train_set_sql() -> str:
    cols = [f"round(CAST({e} AS DOUBLE), {ROUND}) AS {n}" for n, e in feature_exprs(HOURLY).items()]
    return f"""WITH {_flog_sql()}
SELECT transaction_id, {', '.join(cols)}, CAST(is_fraud AS INTEGER) AS label FROM flog"""


@register("training_set", _train_set_sql())
def q_training_set(spark, sf_dir):
    """M1: the served features of every transaction with its label."""
    t = _train_set(spark, sf_dir)
    return rounded(t).withColumn("label", F.col("label").cast("int"))


@register("class_balance", f"""WITH {_flog_sql()}
SELECT CAST(count(*) AS BIGINT) AS n, CAST(sum(CAST(is_fraud AS INT)) AS BIGINT) AS positives,
  CAST(count(*) - sum(CAST(is_fraud AS INT)) AS BIGINT) AS negatives,
  round(sum(CAST(is_fraud AS INT)) / count(*), {ROUND}) AS positive_rate,
  round((count(*) - sum(CAST(is_fraud AS INT))) / sum(CAST(is_fraud AS INT)), {ROUND}) AS pos_weight
FROM flog""")
def q_class_balance(spark, sf_dir):
    """Class balance and the neg/pos weight of the training set."""
    return rounded(class_balance(_train_set(spark, sf_dir)))


@register("standard_scale", f"""WITH {_flog_sql()}
SELECT {', '.join(f"round(avg(CAST({e} AS DOUBLE)), {ROUND}) AS mean__{n}" for n, e in feature_exprs(HOURLY).items())},
  {', '.join(f"round(CASE WHEN coalesce(stddev_pop(CAST({e} AS DOUBLE)), 0) = 0 THEN 1.0 ELSE stddev_pop(CAST({e} AS DOUBLE)) END, {ROUND}) AS scale__{n}"
             for n, e in feature_exprs(HOURLY).items())}
FROM flog""")
def q_standard_scale(spark, sf_dir):
    """M3: population mean and scale (std, 1 when constant) per feature."""
    return rounded(fit_scaler(_train_set(spark, sf_dir), HOURLY.feature_columns()))


def _scored_labels(spark, sf_dir):
    f = rolling_features(transactions(spark, sf_dir), HOURLY, carry=("is_fraud",))
    s = demo_scorer().transform(f)
    return s.select("transaction_id", F.round("fraud_probability", ROUND).alias("score"),
                    F.col("is_fraud").cast("int").alias("label"))


_SCORE_SQL = f"""{SCORED_LINEAR_SQL}, s AS (SELECT round(p, {ROUND}) AS score, CAST(label AS INTEGER) AS y FROM sc)"""


@register("roc_auc", f"""WITH {_SCORE_SQL},
r AS (SELECT y, rank() OVER (ORDER BY score) AS rk, count(*) OVER (PARTITION BY score) AS ties FROM s),
a AS (SELECT sum(CASE WHEN y = 1 THEN rk + (ties - 1) / 2.0 ELSE 0 END) AS rs,
        CAST(sum(y) AS DOUBLE) AS P, CAST(count(*) AS DOUBLE) AS T FROM r)
SELECT round((rs - P * (P + 1) / 2.0) / (P * (T - P)), {ROUND}) AS roc_auc FROM a""")
def q_roc_auc(spark, sf_dir):
    """M6: exact ROC-AUC (average ranks for ties) of the demo scorer."""
    return rounded(roc_auc(_scored_labels(spark, sf_dir)))


@register("average_precision", f"""WITH {_SCORE_SQL},
g AS (SELECT score, CAST(count(*) AS DOUBLE) AS n, CAST(sum(y) AS DOUBLE) AS pos FROM s GROUP BY score),
c AS (SELECT *, sum(pos) OVER (ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS tp,
        sum(n) OVER (ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS allp, sum(pos) OVER () AS P FROM g)
SELECT round(sum(CASE WHEN pos > 0 THEN pos / P * (tp / allp) ELSE 0.0 END), {ROUND}) AS average_precision FROM c""")
def q_average_precision(spark, sf_dir):
    """M7: step-wise average precision of the demo scorer."""
    return rounded(average_precision(_scored_labels(spark, sf_dir)))


@register("classification_report", f"""WITH {_SCORE_SQL},
k AS (SELECT CAST(sum(CASE WHEN y = 1 AND score > 0.5 THEN 1 ELSE 0 END) AS DOUBLE) AS tp,
        CAST(sum(CASE WHEN y = 0 AND score > 0.5 THEN 1 ELSE 0 END) AS DOUBLE) AS fp,
        CAST(sum(CASE WHEN y = 1 AND score <= 0.5 THEN 1 ELSE 0 END) AS DOUBLE) AS fn,
        CAST(sum(CASE WHEN y = 0 AND score <= 0.5 THEN 1 ELSE 0 END) AS DOUBLE) AS tn FROM s),
m AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS p1, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS r1,
        CASE WHEN tn + fn > 0 THEN tn / (tn + fn) ELSE 0 END AS p0, CASE WHEN tn + fp > 0 THEN tn / (tn + fp) ELSE 0 END AS r0,
        tp + fn AS s1, tn + fp AS s0 FROM k),
f AS (SELECT *, CASE WHEN p1 + r1 > 0 THEN 2 * p1 * r1 / (p1 + r1) ELSE 0 END AS f1,
        CASE WHEN p0 + r0 > 0 THEN 2 * p0 * r0 / (p0 + r0) ELSE 0 END AS f0 FROM m),
rows AS (
  SELECT 'legit' AS class, p0 AS precision, r0 AS recall, f0 AS f1, s0 AS support FROM f
  UNION ALL SELECT 'fraud', p1, r1, f1, s1 FROM f
  UNION ALL SELECT 'macro avg', (p0 + p1) / 2, (r0 + r1) / 2, (f0 + f1) / 2, s0 + s1 FROM f
  UNION ALL SELECT 'weighted avg', (p0 * s0 + p1 * s1) / (s0 + s1), (r0 * s0 + r1 * s1) / (s0 + s1),
    (f0 * s0 + f1 * s1) / (s0 + s1), s0 + s1 FROM f
  UNION ALL SELECT 'accuracy', (tp + tn) / (s0 + s1), (tp + tn) / (s0 + s1), (tp + tn) / (s0 + s1), s0 + s1 FROM f)
SELECT class, round(precision, {ROUND}) AS precision, round(recall, {ROUND}) AS recall, round(f1, {ROUND}) AS f1,
  CAST(support AS BIGINT) AS support FROM rows""")
def q_classification_report(spark, sf_dir):
    """M8: per-class and averaged precision/recall/F1 at p > 0.5."""
    return rounded(classification_report(_scored_labels(spark, sf_dir)))


@register("stratified_split", f"""WITH {TXN}
SELECT transaction_id, CAST(is_fraud AS INTEGER) AS label FROM txn
WHERE CAST('0x' || substr(md5(transaction_id || '|42'), 1, 8) AS BIGINT) % 10000 < 2000""")
def q_stratified_split(spark, sf_dir):
    """M2: the 20 % test side of the hash split, with labels."""
    _, test = stratified_split(_train_set(spark, sf_dir))
    return test.select("transaction_id", "label")


@register("union_shuffle", f"""WITH {_flog_sql()}
SELECT transaction_id, CAST(is_fraud AS INTEGER) AS label FROM flog""")
def q_union_shuffle(spark, sf_dir):
    """Union of class subsets in a seeded pseudo-random order."""
    t = _train_set(spark, sf_dir)
    u = union_shuffle([t.where("label = 1"), t.where("label = 0")]).select("transaction_id", "label")
    return u.withColumn("label", F.col("label").cast("int"))


_MODELS: dict = {}


def _gbt(spark, sf_dir):
    key = ("gbt", sf_dir)
    if key not in _MODELS:
        train, _ = stratified_split(_train_set(spark, sf_dir))
        _MODELS[key] = train_gbt(train.checkpoint(eager=True), HOURLY)
    return _MODELS[key]


@register("train_gbt")
def q_train_gbt(spark, sf_dir):
    """M4 + M9: boosted trees (100 rounds, depth 6, rate 0.3, subsample 0.8,
    positive class weighted) -> feature importances."""
    return feature_importances(_gbt(spark, sf_dir), spark, HOURLY)


@register("top_features")
def q_top_features(spark, sf_dir):
    """K1: the five most important features of the boosted model."""
    return top_features(feature_importances(_gbt(spark, sf_dir), spark, HOURLY), 5)


@register("gbt_test_scores")
def q_gbt_test_scores(spark, sf_dir):
    """M10 with a trained model: probabilities on the held-out split."""
    _, test = stratified_split(_train_set(spark, sf_dir))
    return predict(_gbt(spark, sf_dir), test).select("transaction_id", "label", "score")


@register("train_lr")
def q_train_lr(spark, sf_dir):
    """M5: logistic regression on scaled features with balanced weights ->
    coefficients."""
    train, _ = stratified_split(_train_set(spark, sf_dir))
    # scaler, class counts, row count and fit each read it: the features are computed once
    model, _ = train_lr(train.checkpoint(eager=True), HOURLY)
    coef = model.stages[-1].coefficients.toArray().tolist()
    rows = [(n, float(c)) for n, c in zip(HOURLY.feature_columns(), coef)]
    return spark.createDataFrame(rows, "feature string, coefficient double")


@register("train_lr_newton", "SELECT feature, 0.0::DOUBLE AS gradient FROM (VALUES "
          + ", ".join(f"('{n}')" for n in [*HOURLY.feature_columns(), "(intercept)"]) + ") AS v(feature)")
def q_train_lr_newton(spark, sf_dir):
    """M5 by Newton's method: the gradient of the objective at the solution,
    from aggregates of its own, is zero in every coordinate."""
    from velocis.operators.newton import lr_gradient, train_lr_newton
    train, _ = stratified_split(_train_set(spark, sf_dir))
    train = train.checkpoint(eager=True)
    g = lr_gradient(train, train_lr_newton(train, HOURLY))
    return rounded(g).withColumn("gradient", F.col("gradient") + F.lit(0.0))
