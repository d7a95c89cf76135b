"""Scoring (M10, P4, P6, P7, F2-F4, X2).

Requests flow: features (tiered or live) -> 20-float vector -> model ->
probability -> decision band, confidence, ``is_fraud`` -> optional
features struct and explanation map. One lazy plan; Spark ML models run in
the JVM on the executors, arbitrary Python models run batched through
``mapInPandas`` with the model broadcast once.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from velocis.functions.scalar import confidence, decision, explanation_map, is_fraud
from velocis.schemas import DEFAULT, DEFAULT_THRESHOLD, WindowSet
from velocis.session import ship_package


def model_vector(windows: WindowSet = DEFAULT) -> Column:
    """The 20 features as ``array<float>`` in the fixed model order."""
    return F.array(*[F.coalesce(F.col(c), F.lit(0)).cast("float") for c in windows.feature_columns()])


def with_vector(df: DataFrame, windows: WindowSet = DEFAULT, name: str = "features_vec") -> DataFrame:
    """Adds the ML ``Vector`` column built from the float32-narrowed features."""
    from pyspark.ml.functions import array_to_vector
    return df.withColumn(name, array_to_vector(model_vector(windows)))


def request_defaults(requests: DataFrame) -> DataFrame:
    """Request defaults (P6): lat/lon 0, category ``other``, flags false, and
    a deterministic id (sha2 of the row) when an id is absent. Identical
    requests without an id are numbered, so every request has its own."""
    cols = ["entity_id", "amount", "request_ts", "request_id", "transaction_id", "latitude", "longitude",
            "merchant_category", "include_features", "explain", "batch_id"]
    rid = F.sha2(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("\\N")) for c in cols]), 256)
    # only rows without an id are numbered, and so exchanged
    absent = F.col("request_id").isNull() | F.col("transaction_id").isNull()
    n = F.row_number().over(Window.partitionBy("_rid").orderBy("_rid"))
    made = requests.where(absent).withColumn("_rid", rid)
    made = made.withColumn("_rid", F.concat(F.substring("_rid", 1, 16), F.when(n > 1, F.concat(
        F.lit("-"), n.cast("string"))).otherwise(F.lit(""))))
    requests = requests.where(~absent).withColumn("_rid", F.lit(None).cast("string")).unionByName(made)
    return requests.select(
        F.coalesce("request_id", F.concat(F.lit("req-"), "_rid")).alias("request_id"),
        F.coalesce("transaction_id", F.concat(F.lit("txn-"), "_rid")).alias("transaction_id"),
        "entity_id", "amount",
        F.coalesce("latitude", F.lit(0.0)).alias("latitude"),
        F.coalesce("longitude", F.lit(0.0)).alias("longitude"),
        F.coalesce("merchant_category", F.lit("other")).alias("merchant_category"),
        "request_ts",
        F.coalesce("include_features", F.lit(False)).alias("include_features"),
        F.coalesce("explain", F.lit(False)).alias("explain"),
        "batch_id")


class LinearScorer:
    """Fixed-coefficient logistic scorer: p = sigmoid(b + sum(w_i * z_i)),
    with z the optionally standardised features. Used for deterministic,
    SQL-checkable scoring and as the form of a fitted logistic model."""

    def __init__(self, coefficients: dict[str, float], intercept: float,
                 mean: dict[str, float] | None = None, scale: dict[str, float] | None = None,
                 version: str = "linear-1", importances: Sequence[float] | None = None):
        self.coefficients, self.intercept = coefficients, intercept
        self.mean, self.scale = mean or {}, scale or {}
        self.version = version
        self.importances = importances

    def margin(self) -> Column:
        m = F.lit(float(self.intercept))
        for c, w in self.coefficients.items():
            x = F.coalesce(F.col(c), F.lit(0)).cast("float").cast("double")
            if c in self.mean:
                x = (x - F.lit(self.mean[c])) / F.lit(self.scale.get(c, 1.0) or 1.0)
            m = m + F.lit(float(w)) * x
        return m

    def probability(self) -> Column:
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-self.margin()))

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumn("fraud_probability", self.probability())


def decide(df: DataFrame, prob: str = "fraud_probability",
           threshold: float = DEFAULT_THRESHOLD) -> DataFrame:
    """Decision band, confidence and ``is_fraud``."""
    return df.withColumns({"decision": decision(prob), "confidence": confidence(prob),
                           "is_fraud": is_fraud(prob, threshold)})


def optional_outputs(df: DataFrame, windows: WindowSet = DEFAULT,
                     feature_names: Sequence[str] | None = None,
                     importances: Sequence[float] | None = None) -> DataFrame:
    """``features`` struct when ``include_features``; ``explanations`` map
    when ``explain`` and the model has importances, else empty (P7, F4)."""
    names = list(feature_names or windows.feature_columns())
    feats = F.struct(*[F.col(c) for c in ["entity_id"] + windows.feature_columns() + ["merchant_category"]])
    inc = F.coalesce(F.col("include_features"), F.lit(False)) if "include_features" in df.columns else F.lit(False)
    exp = F.coalesce(F.col("explain"), F.lit(False)) if "explain" in df.columns else F.lit(False)
    empty = F.create_map().cast(T.MapType(T.StringType(), T.FloatType()))
    if importances is not None:
        emap = F.when(exp, explanation_map(names, importances, model_vector(windows))).otherwise(empty)
    else:
        emap = empty
    return df.withColumns({"features": F.when(inc, feats), "explanations": emap})


def score(features: DataFrame, model, windows: WindowSet = DEFAULT, threshold: float = DEFAULT_THRESHOLD,
          model_version: str | None = None, importances: Sequence[float] | None = None) -> DataFrame:
    """Score feature rows with a ``LinearScorer`` or a fitted Spark ML model:
    a ``PipelineModel`` with its own ``VectorAssembler`` (as ``train_gbt`` /
    ``train_lr`` build, scaler included) reads the feature columns; any other
    model reads the float32 ``features_vec`` vector (P4)."""
    if isinstance(model, LinearScorer):
        out = model.transform(features)
        version = model_version or model.version
        importances = importances if importances is not None else model.importances
    else:
        from pyspark.ml import PipelineModel
        from pyspark.ml.feature import VectorAssembler
        from pyspark.ml.functions import vector_to_array
        if isinstance(model, PipelineModel) and any(isinstance(st, VectorAssembler) for st in model.stages):
            out = model.transform(features)     # the pipeline scales/assembles as in training
        else:
            out = model.transform(with_vector(features, windows))
        out = out.withColumn("fraud_probability", vector_to_array("probability").getItem(1)) \
                 .drop("features_vec", "rawPrediction", "probability", "prediction",
                       *[f"{c}__z" for c in windows.feature_columns()])
        version = model_version or "spark-ml"
    out = decide(out, "fraud_probability", threshold).withColumn("model_version", F.lit(version))
    return optional_outputs(out, windows, importances=importances)


def batch_score(requests: DataFrame, events: DataFrame, feature_log: DataFrame | None, model,
                windows: WindowSet = DEFAULT, max_age_s: float = 300.0,
                threshold: float = DEFAULT_THRESHOLD, importances: Sequence[float] | None = None) -> DataFrame:
    """Batch scoring (M10): tiered features per request, model, decisions.

    ``feature_log=None`` serves snapshots from the events' own feature rows in
    the same pass (see ``serve_tiered``). Carries ``request_id`` and
    ``batch_id`` (Q14) through the pass: N requests in, N rows out."""
    from velocis.operators.serving import serve_tiered
    req = request_defaults(requests)
    feats = serve_tiered(events, feature_log, req, windows, max_age_s,
                         carry=("include_features", "explain", "batch_id", "request_ts"))
    return score(feats, model, windows, threshold, importances=importances)


def score_with(df: DataFrame, predict_proba: Callable[[np.ndarray], np.ndarray],
               windows: WindowSet = DEFAULT, batch_rows: int = 10_000) -> DataFrame:
    """Any model with ``predict_proba`` (X2): batched through ``mapInPandas``;
    the function is pickled once per task, rows arrive as Arrow batches."""
    cols = windows.feature_columns()
    schema = T.StructType(df.schema.fields + [T.StructField("fraud_probability", T.DoubleType())])

    def run(it):
        for whole in it:
            for i in range(0, len(whole), batch_rows):
                pdf = whole.iloc[i:i + batch_rows].copy()
                x = pdf[cols].fillna(0).to_numpy(dtype=np.float32)
                p = np.asarray(predict_proba(x))
                p = p[:, 1] if p.ndim == 2 else p
                pdf["fraud_probability"] = p.astype("float64")
                yield pdf

    spark = df.sparkSession
    ship_package(spark)
    return df.mapInPandas(run, schema)

