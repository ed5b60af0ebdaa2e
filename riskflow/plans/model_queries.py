"""Registered queries: fixed-model scoring and evaluation over the feature table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskflow.contract import FEATURES_V1, PROMOTION_MIN, SEED
from riskflow.models.base import feature_refs
from riskflow.models.demo import demo_models
from riskflow.models.fixed import FIXED_FOREST, FIXED_LOGIT, fixed_autoencoder
from riskflow.models.params import AutoencoderParams, ae_apply
from riskflow.operators import evaluate as EV
from riskflow.operators.ordering import exact_quantiles, previous_value
from riskflow.operators.scoring import score
from riskflow.plans.table_queries import features
from riskflow.sources.tables import events

R = 9
BUDGET_RATIO = 0.05
SPLIT_ORDER = ["nameOrig", "step", "event_id"]  # (nameOrig, timestamp) then ingest order
SAMPLE_SIZE = 1000


def feats(spark, sf_dir) -> DataFrame:
    return features(spark, sf_dir).select("event_id", "nameOrig", "step", "type", "isFraud", *FEATURES_V1)


def demo_scored(spark, sf_dir) -> DataFrame:
    return score(feats(spark, sf_dir), demo_models())


def logit_scored(spark, sf_dir) -> DataFrame:
    return feats(spark, sf_dir).withColumn("score", F.expr(FIXED_LOGIT.sql(feature_refs())))


def split(spark, sf_dir) -> DataFrame:
    return EV.positional_split(feats(spark, sf_dir), SPLIT_ORDER)


def q_logit_score(spark, sf_dir):
    return logit_scored(spark, sf_dir).select("event_id", F.round("score", R).alias("score"))


def q_ae_score_fixed_net(spark, sf_dir):
    net = fixed_autoencoder()
    d = ae_apply(net, feats(spark, sf_dir), feature_refs(), "ae_mse")
    return d.select(
        "event_id",
        F.round("ae_mse", R).alias("ae_mse"),
        F.round(F.least(F.greatest(F.col("ae_mse") / F.lit(net.threshold), F.lit(0.0)), F.lit(1.0)), R).alias("ae_score"),
    )


def q_if_score_fixed_forest(spark, sf_dir):
    d = feats(spark, sf_dir).withColumn("decision", F.expr(FIXED_FOREST.sql(feature_refs())))
    return d.select(
        "event_id",
        F.round("decision", R).alias("decision"),
        F.round(F.lit(1.0) / (F.lit(1.0) + F.exp(F.col("decision"))), R).alias("if_score"),
    )


def q_positional_split(spark, sf_dir):
    return split(spark, sf_dir).select("event_id", "row_index", "split")


def _scaled(spark, sf_dir):
    s = split(spark, sf_dir)
    mins, maxs = EV.minmax_fit(s.where(F.col("split") == "train"))
    return EV.minmax_transform(s, mins, maxs, suffix="_scaled")


def q_minmax_scale(spark, sf_dir):
    t = _scaled(spark, sf_dir)
    return t.select("event_id", "split", *[F.round(f"{c}_scaled", R).alias(f"{c}_scaled") for c in FEATURES_V1])


def q_reconstruction_threshold(spark, sf_dir):
    t = _scaled(spark, sf_dir).where(F.col("split") == "validation")
    fixed = fixed_autoencoder()
    identity = AutoencoderParams([0.0] * 7, [1.0] * 7, fixed.layers, fixed.threshold)
    d = ae_apply(identity, t, [f"{c}_scaled" for c in FEATURES_V1], "row_mse")
    q = exact_quantiles(d, "row_mse", [0.99])
    return q.select(F.col("n").alias("n_validation"), F.round("q_0", R).alias("threshold_p99"))


def q_balanced_weights(spark, sf_dir):
    s = split(spark, sf_dir).where(F.col("split") == "train")
    w = EV.balanced_weights(s, "isFraud")
    return w.withColumn("weight", F.round("weight", R))


def _holdout(spark, sf_dir):
    return EV.holdout_evaluation(logit_scored(spark, sf_dir), "score", "isFraud", 0.5)


def q_holdout_metrics(spark, sf_dir):
    m = _holdout(spark, sf_dir)
    return m.select("rows_holdout", "tp", "fp", "fn",
                    F.round("precision_at_0_5", R).alias("precision_at_0_5"),
                    F.round("recall_at_0_5", R).alias("recall_at_0_5"))


def q_average_precision(spark, sf_dir):
    m = _holdout(spark, sf_dir)
    return m.select(F.round("pr_auc", R).alias("pr_auc"), "n_pos", F.col("rows_holdout").alias("n"))


def q_promotion_check(spark, sf_dir):
    out = EV.promotion_check(_holdout(spark, sf_dir), PROMOTION_MIN["precision"], PROMOTION_MIN["recall"],
                             PROMOTION_MIN["pr_auc"])
    return out.select(*[F.round(c, R).alias(c) for c in ("precision_at_0_5", "recall_at_0_5", "pr_auc")], "passed", "reasons")


def q_alert_budget(spark, sf_dir):
    a = EV.alert_budget(demo_scored(spark, sf_dir), "ensemble_score", "event_id", BUDGET_RATIO)
    return a.select("event_id", F.round("ensemble_score", R).alias("ensemble_score"), "alert_rank")


def q_quality_at_budget(spark, sf_dir):
    q = EV.quality_at_budget(demo_scored(spark, sf_dir), "ensemble_score", "event_id", "isFraud", BUDGET_RATIO)
    return q.select("alerts_sent", "tp", "positives", F.round("precision", R).alias("precision"),
                    F.round("recall", R).alias("recall"))


def q_adaptive_threshold(spark, sf_dir):
    a = EV.adaptive_threshold(demo_scored(spark, sf_dir), "ensemble_score")
    return a.select("n", F.round("quantile_value", R).alias("quantile_value"), F.round("threshold", R).alias("threshold"))


def q_adaptive_threshold_by_type(spark, sf_dir):
    a = EV.adaptive_threshold(demo_scored(spark, sf_dir), "ensemble_score", ["type"])
    return a.select("type", "n", F.round("quantile_value", R).alias("quantile_value"),
                    F.round("threshold", R).alias("threshold"))


def q_latency_summary(spark, sf_dir):
    """A9 over a measure derived from arrivals: the gap (ms) to the previous event."""
    e = events(spark, sf_dir).select("event_id", "ts")
    after = previous_value(e, ["ts", "event_id"], "ts", "prev_ts")
    gaps = after.select((F.timestamp_diff("MICROSECOND", F.col("prev_ts"), F.col("ts")) / F.lit(1000.0)).alias("gap_ms"))
    q = exact_quantiles(gaps, "gap_ms", [0.5, 0.95, 1.0])
    return q.select("n", F.round("q_0", 6).alias("p50_ms"), F.round("q_1", 6).alias("p95_ms"), F.round("q_2", 6).alias("max_ms"))


def q_seeded_sample(spark, sf_dir):
    normal = feats(spark, sf_dir).where(F.col("isFraud") == 0)
    return EV.seeded_sample(normal, "event_id", SAMPLE_SIZE, SEED).select("event_id", *FEATURES_V1)


QUERIES = {
    "logit_score": q_logit_score,
    "ae_score_fixed_net": q_ae_score_fixed_net,
    "if_score_fixed_forest": q_if_score_fixed_forest,
    "positional_split": q_positional_split,
    "minmax_scale": q_minmax_scale,
    "reconstruction_threshold": q_reconstruction_threshold,
    "balanced_weights": q_balanced_weights,
    "holdout_metrics": q_holdout_metrics,
    "average_precision": q_average_precision,
    "promotion_check": q_promotion_check,
    "alert_budget": q_alert_budget,
    "quality_at_budget": q_quality_at_budget,
    "adaptive_threshold": q_adaptive_threshold,
    "adaptive_threshold_by_type": q_adaptive_threshold_by_type,
    "latency_summary": q_latency_summary,
    "seeded_sample": q_seeded_sample,
}
