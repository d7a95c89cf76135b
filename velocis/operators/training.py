"""Training set, split, scaling, models and evaluation.

The training set is the same feature log that is served (decision Q18):
features as of each transaction joined to its label. Splits and sampling
are hash-based (md5 of the id and a seed), so they need no sort
and are reproducible. Evaluation metrics are DataFrame aggregates; the
ordered ones (AUC, average precision) use the distributed prefix sums of
``velocis.operators.ordering``.
"""

from __future__ import annotations

import json
import os
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from velocis.operators.ordering import ranked
from velocis.schemas import DEFAULT, WindowSet

HASH_BUCKETS = 10_000
#: Training rows (about 200 bytes each, binned and kept in memory) of one partition of a fit.
FIT_ROWS = 1_000_000


def _hash_bucket(id_col: str, seed: int) -> F.Column:
    """A number below ``HASH_BUCKETS`` from the first 32 bits of md5(id|seed); null for a null id."""
    digest = F.md5(F.concat(F.col(id_col).cast("string"), F.lit(f"|{seed}")))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % F.lit(HASH_BUCKETS)


def training_set(feature_log: DataFrame, labels: DataFrame | None, windows: WindowSet = DEFAULT,
                 label_col: str = "is_fraud", negative_keep: float = 1.0, seed: int = 42) -> DataFrame:
    """Features + label per transaction (M1). ``labels`` has
    ``transaction_id`` and ``label_col`` (joined by id); with ``labels=None``
    the label is a column of the feature log itself (carried through the
    feature pass, no join). ``negative_keep`` < 1 keeps that share of
    negatives (hash threshold) to raise the positive rate."""
    if labels is None:
        j = feature_log.withColumn("label", F.col(label_col).cast("int"))
    else:
        lab = labels.select("transaction_id", F.col(label_col).cast("int").alias("label"))
        j = feature_log.join(lab, "transaction_id", "inner")
    if negative_keep < 1.0:
        keep = (F.col("label") == 1) | (_hash_bucket("transaction_id", seed) < F.lit(int(negative_keep * HASH_BUCKETS)))
        j = j.where(keep)
    return j.select("transaction_id", *[F.col(c).cast("double").alias(c) for c in windows.feature_columns()],
                    "label")


def stratified_split(df: DataFrame, test_fraction: float = 0.2, seed: int = 42,
                     id_col: str = "transaction_id") -> tuple[DataFrame, DataFrame]:
    """80/20 split by hash of the id (M2): each class goes 20 % to test in
    expectation; no shuffle, no sort."""
    # rows without an id stay in training
    is_test = F.coalesce(_hash_bucket(id_col, seed) < F.lit(int(test_fraction * HASH_BUCKETS)), F.lit(False))
    return df.where(~is_test), df.where(is_test)


def union_shuffle(parts: Sequence[DataFrame], seed: int = 42, id_col: str = "transaction_id") -> DataFrame:
    """UNION ALL of class subsets, then a seeded pseudo-random order."""
    u = parts[0]
    for p in parts[1:]:
        u = u.unionByName(p)
    return u.orderBy(F.xxhash64(F.col(id_col).cast("string"), F.lit(seed)), id_col)


def fit_scaler(train: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Population mean and std per column on the training data; a
    zero-variance column gets scale 1 (M3). One aggregate, one row."""
    aggs = []
    for c in columns:
        aggs += [F.avg(c).alias(f"mean__{c}"), F.stddev_pop(c).alias(f"std__{c}")]
    row = train.agg(*aggs)
    return row.select(*[F.col(f"mean__{c}") for c in columns],
                      *[F.when(F.coalesce(F.col(f"std__{c}"), F.lit(0.0)) == 0, F.lit(1.0))
                        .otherwise(F.col(f"std__{c}")).alias(f"scale__{c}") for c in columns])


def apply_scaler(df: DataFrame, scaler_row: dict, columns: Sequence[str]) -> DataFrame:
    """Standardise with a fitted scaler given as a dict (one small row)."""
    return df.withColumns({c: (F.col(c) - F.lit(scaler_row[f"mean__{c}"])) / F.lit(scaler_row[f"scale__{c}"])
                           for c in columns})


def class_counts(train: DataFrame) -> tuple[int, int]:
    """Rows and positives."""
    counts = train.agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("pos")).first()
    return counts["n"], counts["pos"] or 0


def class_weights(train: DataFrame, mode: str = "pos", counts: tuple[int, int] | None = None) -> DataFrame:
    """Row weights: ``pos`` = positives weighted neg/pos (M4, A17);
    ``balanced`` = n / (2 * n_class) (M5). ``counts`` are those of ``class_counts``, if known."""
    n, pos = counts or class_counts(train)
    neg = n - pos
    if mode == "balanced":
        wp = n / (2.0 * pos) if pos else 1.0
        wn = n / (2.0 * neg) if neg else 1.0
    else:
        wp, wn = (neg / pos if pos else 1.0), 1.0
    return train.withColumn("weight", F.when(F.col("label") == 1, F.lit(wp)).otherwise(F.lit(wn)))


def train_gbt(train: DataFrame, windows: WindowSet = DEFAULT, max_iter: int = 100, max_depth: int = 6,
              step: float = 0.3, subsample: float = 0.8, col_subsample: str = "0.8", seed: int = 42):
    """Boosted trees with the positive class weighted neg/pos (M4).

    Every level of every tree is a job over all partitions (700 jobs with the
    defaults). The features come in partitions small enough to sort, many more
    than there are cores; the fit only sums bins over them, so they are joined
    to ``FIT_ROWS`` rows each, or one a core."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler
    counts = class_counts(train)
    cores = train.sparkSession.sparkContext.defaultParallelism
    w = class_weights(train.coalesce(max(cores, -(-counts[0] // FIT_ROWS))), "pos", counts)
    asm = VectorAssembler(inputCols=windows.feature_columns(), outputCol="features_vec")
    gbt = GBTClassifier(featuresCol="features_vec", labelCol="label", weightCol="weight",
                        maxIter=max_iter, maxDepth=max_depth, stepSize=step, subsamplingRate=subsample,
                        featureSubsetStrategy=col_subsample, seed=seed)
    return Pipeline(stages=[asm, gbt]).fit(w)


def train_lr(train: DataFrame, windows: WindowSet = DEFAULT, max_iter: int = 500, c: float = 1.0):
    """Logistic regression on standardised features, balanced class weights
    (M5): ``regParam = 1 / (C * n)``, no internal standardisation.

    The fitted population scaler (M3) is the pipeline's first stage (a
    ``SQLTransformer`` with the means and scales as literals), so the saved
    model scales at serving exactly as in training. Returns (model, scaler)."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import SQLTransformer, VectorAssembler
    cols = windows.feature_columns()
    scaler = fit_scaler(train, cols).first().asDict()
    weighted = class_weights(train, "balanced")
    n = weighted.count()
    scaled = ", ".join(f"(CAST({c_} AS DOUBLE) - {float(scaler[f'mean__{c_}'])!r}) / "
                       f"{float(scaler[f'scale__{c_}'])!r} AS {c_}__z" for c_ in cols)
    scale = SQLTransformer(statement=f"SELECT *, {scaled} FROM __THIS__")
    asm = VectorAssembler(inputCols=[f"{c_}__z" for c_ in cols], outputCol="features_vec")
    lr = LogisticRegression(featuresCol="features_vec", labelCol="label", weightCol="weight",
                            maxIter=max_iter, regParam=1.0 / (c * max(n, 1)), standardization=False)
    return Pipeline(stages=[scale, asm, lr]).fit(weighted), scaler


def predict(model, df: DataFrame, scaler: dict | None = None, windows: WindowSet = DEFAULT) -> DataFrame:
    """Probability of the positive class from a fitted pipeline. ``scaler``
    applies a separately fitted scaler first (pipelines from ``train_lr``
    carry theirs)."""
    from pyspark.ml.functions import vector_to_array
    if scaler:
        df = apply_scaler(df, scaler, windows.feature_columns())
    out = model.transform(df)
    return out.withColumn("score", vector_to_array("probability").getItem(1)) \
              .drop("features_vec", "rawPrediction", "probability",
                    *[f"{c}__z" for c in windows.feature_columns()])


def roc_auc(scored: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    """Exact ROC-AUC by the rank formula with average ranks for ties (M6):
    (sum of positive ranks - P(P+1)/2) / (P * N)."""
    r = ranked(scored, score, {"n": F.lit(1), "pos": F.col(label).cast("int")})
    avg_rank = F.col("cum_n") - (F.col("n") - 1) / 2.0
    a = r.agg(F.sum(F.col("pos") * avg_rank).alias("rs"), F.first("total_pos").alias("P"),
              F.first("total_n").alias("T"))
    neg = F.col("T") - F.col("P")
    return a.select(((F.col("rs") - F.col("P") * (F.col("P") + 1) / 2.0) / (F.col("P") * neg)).alias("roc_auc"))


def average_precision(scored: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    """Step-wise average precision over distinct thresholds (M7):
    sum_k (R_k - R_{k-1}) * P_k with thresholds in decreasing order."""
    r = ranked(scored, score, {"n": F.lit(1), "pos": F.col(label).cast("int")})
    # rows with score >= s: everything from this value upward
    tp = F.col("total_pos") - F.col("cum_pos") + F.col("pos")
    allp = F.col("total_n") - F.col("cum_n") + F.col("n")
    term = F.when(F.col("pos") > 0, F.col("pos") / F.col("total_pos") * (tp / allp)).otherwise(F.lit(0.0))
    return r.agg(F.sum(term).alias("average_precision"))


def classification_report(scored: DataFrame, score: str = "score", label: str = "label",
                          threshold: float = 0.5) -> DataFrame:
    """Precision, recall, F1, support per class (``legit``, ``fraud``),
    accuracy, macro and weighted averages, predicting fraud when
    ``score > threshold`` (M8); 0 where a denominator is 0. One aggregate."""
    y = F.col(label).cast("int")
    yhat = (F.col(score) > F.lit(threshold)).cast("int")
    a = scored.agg(
        F.sum(((y == 1) & (yhat == 1)).cast("long")).alias("tp"),
        F.sum(((y == 0) & (yhat == 1)).cast("long")).alias("fp"),
        F.sum(((y == 1) & (yhat == 0)).cast("long")).alias("fn"),
        F.sum(((y == 0) & (yhat == 0)).cast("long")).alias("tn"))

    def safe(n, d):
        return F.when(d > 0, n / d).otherwise(F.lit(0.0))

    tp, fp, fn, tn = (F.col(c).cast("double") for c in ("tp", "fp", "fn", "tn"))
    p1, r1 = safe(tp, tp + fp), safe(tp, tp + fn)
    p0, r0 = safe(tn, tn + fn), safe(tn, tn + fp)
    f1 = lambda p, r: safe(2 * p * r, p + r)
    s1, s0 = tp + fn, tn + fp
    rows = [("legit", p0, r0, f1(p0, r0), s0), ("fraud", p1, r1, f1(p1, r1), s1),
            ("macro avg", (p0 + p1) / 2, (r0 + r1) / 2, (f1(p0, r0) + f1(p1, r1)) / 2, s0 + s1),
            ("weighted avg", safe(p0 * s0 + p1 * s1, s0 + s1), safe(r0 * s0 + r1 * s1, s0 + s1),
             safe(f1(p0, r0) * s0 + f1(p1, r1) * s1, s0 + s1), s0 + s1),
            ("accuracy", safe(tp + tn, s0 + s1), safe(tp + tn, s0 + s1), safe(tp + tn, s0 + s1), s0 + s1)]
    structs = [F.struct(F.lit(n).alias("class"), p.alias("precision"), r.alias("recall"), f.alias("f1"),
                        s.cast("long").alias("support")) for n, p, r, f, s in rows]
    return a.select(F.explode(F.array(*structs)).alias("r")).select("r.*")


def feature_importances(model, spark: SparkSession, windows: WindowSet = DEFAULT) -> DataFrame:
    """(position, feature, importance) of a fitted tree pipeline (M9)."""
    imp = model.stages[-1].featureImportances.toArray().tolist()
    rows = [(i, n, float(v)) for i, (n, v) in enumerate(zip(windows.feature_columns(), imp))]
    return spark.createDataFrame(rows, "position int, feature string, importance double")


def top_features(importances: DataFrame, k: int = 5) -> DataFrame:
    """Top-k features by importance, ties in vector order (K1)."""
    return importances.orderBy(F.desc("importance"), F.asc("position")).limit(k)


def save_bundle(model, path: str, meta: dict) -> None:
    """Model bundle (S8): the ``PipelineModel`` directory plus a metadata
    JSON (names, type, AUCs, threshold, version) next to it."""
    model.write().overwrite().save(os.path.join(path, "model"))
    spark = SparkSession.getActiveSession()
    spark.createDataFrame([(json.dumps(meta, sort_keys=True),)], "meta string") \
        .coalesce(1).write.mode("overwrite").text(os.path.join(path, "meta"))


def load_bundle(path: str):
    from pyspark.ml import PipelineModel
    spark = SparkSession.getActiveSession()
    model = PipelineModel.load(os.path.join(path, "model"))
    meta = json.loads(spark.read.text(os.path.join(path, "meta")).first()[0])
    return model, meta


def latest_bundle(root: str) -> str | None:
    """Newest version folder under ``root`` (``v<number>``), for reloads.
    Reads the small metadata files and takes the highest version number."""
    from pyspark.errors import AnalysisException
    spark = SparkSession.getActiveSession()
    try:
        metas = spark.read.text(root.rstrip("/") + "/v*/meta").select(F.col("_metadata.file_path").alias("p"))
    except AnalysisException:
        return None
    v = metas.select(F.regexp_extract("p", r"/v([0-9]+)/meta/", 1).cast("long").alias("v")).agg(F.max("v")).first()[0]
    return None if v is None else root.rstrip("/") + f"/v{v}"
