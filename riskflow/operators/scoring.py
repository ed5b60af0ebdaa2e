"""Ensemble scoring (M2, M4, M6, M7) and threshold routing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskflow.contract import AE_THRESHOLD_EPS, DEFAULT_THRESHOLD, DEFAULT_WEIGHTS, TOPIC_ANOMALY, TOPIC_NORMAL
from riskflow.functions.features import normalize_weights
from riskflow.models.base import ModelSet, clip_sql, feature_refs, fmt, sigmoid_sql


def score_sql(models: ModelSet, weights=DEFAULT_WEIGHTS, prefix: str = "") -> dict[str, str]:
    """SQL text of the four scores (only for models that render to SQL)."""
    w_if, w_ae, w_sgd = normalize_weights(weights)
    x = feature_refs(prefix)
    if_score = sigmoid_sql(f"-({models.if_decision.sql(x)})")
    thr = max(float(models.ae_threshold), AE_THRESHOLD_EPS)
    ae_score = clip_sql(f"({models.ae_mse.sql(x)}) / {fmt(thr)}", 0.0, 1.0)
    sgd_score = f"({models.proba.sql(x)})"
    return {
        "if_score": if_score,
        "ae_score": ae_score,
        "sgd_score": sgd_score,
        "ensemble_score": f"({fmt(w_if)} * ({if_score}) + {fmt(w_ae)} * ({ae_score}) + {fmt(w_sgd)} * ({sgd_score}))",
    }


def _add_model_column(df: DataFrame, model, x: list[str], name: str) -> DataFrame:
    if hasattr(model, "apply"):  # staged model (one projection per layer)
        return model.apply(df, x, name)
    if hasattr(model, "column"):  # Column builder, e.g. an Arrow UDF
        return df.withColumn(name, model.column(x))
    return df.withColumn(name, F.expr(model.sql(x)))


def score(df: DataFrame, models: ModelSet, weights=DEFAULT_WEIGHTS, prefix: str = "") -> DataFrame:
    """Add if_score, ae_score, sgd_score, ensemble_score (weights folded on the driver)."""
    staged = any(hasattr(m, "apply") or hasattr(m, "column") for m in (models.if_decision, models.ae_mse, models.proba))
    if not staged:
        exprs = score_sql(models, weights, prefix)
        return df.select("*", *[F.expr(v).alias(k) for k, v in exprs.items()])
    w_if, w_ae, w_sgd = normalize_weights(weights)
    x = feature_refs(prefix)
    thr = max(float(models.ae_threshold), AE_THRESHOLD_EPS)
    d = _add_model_column(df, models.if_decision, x, "_if_decision")
    d = _add_model_column(d, models.ae_mse, x, "_ae_mse")
    d = _add_model_column(d, models.proba, x, "sgd_score")
    d = d.withColumn("if_score", F.lit(1.0) / (F.lit(1.0) + F.exp(F.col("_if_decision"))))
    d = d.withColumn("ae_score", F.least(F.greatest(F.col("_ae_mse") / F.lit(thr), F.lit(0.0)), F.lit(1.0)))
    d = d.withColumn(
        "ensemble_score",
        F.lit(w_if) * F.col("if_score") + F.lit(w_ae) * F.col("ae_score") + F.lit(w_sgd) * F.col("sgd_score"),
    )
    cols = [c for c in d.columns if c not in ("_if_decision", "_ae_mse", "if_score", "ae_score", "sgd_score", "ensemble_score")]
    return d.select(*cols, "if_score", "ae_score", "sgd_score", "ensemble_score")


def route_topic(score_col: Column, threshold: float | Column = DEFAULT_THRESHOLD,
                anomaly_topic: str = TOPIC_ANOMALY, normal_topic: str = TOPIC_NORMAL) -> Column:
    """Score >= threshold -> anomaly topic; NaN goes to the normal topic.

    Spark orders NaN above every number, so the NaN guard is explicit.
    """
    t = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    return F.when(~F.isnan(score_col) & (score_col >= t), F.lit(anomaly_topic)).otherwise(F.lit(normal_topic))
