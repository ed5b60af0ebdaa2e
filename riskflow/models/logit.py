"""Logistic classifier training (M5) with pyspark.ml.

Objective: class-balanced log loss + (regParam / 2) * ||w||^2 with
regParam = 1e-4, no standardisation: the same convex objective as the
reference's stochastic learner (balanced weights sum to n, so the weighted
mean equals its per-sample mean), solved deterministically by L-BFGS.
Training uses the first 80 % in (nameOrig, timestamp, ingest) order,
validation the rest (K4).
"""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskflow.contract import FEATURES_V1, TRAIN_FRACTION
from riskflow.models.base import feature_refs
from riskflow.models.params import LogitParams
from riskflow.operators.evaluate import holdout_evaluation, positional_split

REG_PARAM = 1e-4
MAX_ITER = 1000


def required_columns(df: DataFrame, cols: list[str]) -> None:
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise ValueError(f"Missing required columns: {missing}")


def train_logit(features: DataFrame, order: list, label: str = "isFraud",
                fraction: float = TRAIN_FRACTION) -> tuple[LogitParams, DataFrame]:
    """Fit on the train part, evaluate on the validation part.

    Returns the parameters and a one-row metrics DataFrame.
    """
    required_columns(features, FEATURES_V1 + [label])
    s = positional_split(features, order, fraction)
    train = s.where(F.col("split") == "train")
    counts = {int(r[label]): int(r["count"]) for r in train.groupBy(label).count().collect()}  # <= 2 rows
    n = sum(counts.values())
    weight = F.lit(0.0)
    for c, nc in counts.items():
        weight = F.when(F.col(label) == c, F.lit(n / (2.0 * nc))).otherwise(weight)
    assembled = VectorAssembler(inputCols=FEATURES_V1, outputCol="_x").transform(
        train.select(*FEATURES_V1, F.col(label).cast("double").alias("_y"), weight.alias("_w"))
    )
    lr = LogisticRegression(featuresCol="_x", labelCol="_y", weightCol="_w", regParam=REG_PARAM,
                            elasticNetParam=0.0, standardization=False, maxIter=MAX_ITER, fitIntercept=True)
    model = lr.fit(assembled)
    params = LogitParams([float(v) for v in model.coefficients.toArray()], float(model.intercept))
    val = s.where(F.col("split") == "validation").withColumn("_score", F.expr(params.sql(feature_refs())))
    m = holdout_evaluation(val, "_score", label, 0.5)
    fraud_train = counts.get(1, 0)
    metrics = m.select(
        F.lit(n).alias("rows_train"),
        F.col("rows_holdout").alias("rows_val"),
        F.lit(fraud_train).alias("fraud_train"),
        F.col("n_pos").alias("fraud_val"),
        F.col("pr_auc").alias("val_pr_auc"),
        F.col("precision_at_0_5").alias("val_precision_at_0_5"),
        F.col("recall_at_0_5").alias("val_recall_at_0_5"),
        F.lit(model.summary.totalIterations).alias("iterations"),
    )
    return params, metrics
