"""Registered queries over the transaction table: validation, profile, batch features."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskflow.contract import EXPECTED_COLUMNS
from riskflow.operators import profile as P
from riskflow.operators.batch_features import add_training_features
from riskflow.sources import adapters
from riskflow.sources.tables import events

R = 9  # digits kept for doubles (summation order differs between engines)


def txn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapters.txn(events(spark, sf_dir))


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return add_training_features(txn(spark, sf_dir))


def q_table_validation(spark, sf_dir):
    return P.validate_table(txn(spark, sf_dir).select(*EXPECTED_COLUMNS))


def q_unknown_types(spark, sf_dir):
    return P.unknown_types(txn(spark, sf_dir))


def q_profile_overall(spark, sf_dir):
    p = P.profile_overall(txn(spark, sf_dir).select(*EXPECTED_COLUMNS))
    return p.select(*[F.round(c, R).alias(c) if c in ("fraud_rate", "class_imbalance_ratio") else c for c in p.columns])


def q_profile_by_type(spark, sf_dir):
    p = P.profile_by_type(txn(spark, sf_dir))
    return p.withColumn("fraud_rate", F.round("fraud_rate", R))


def q_amount_stats(spark, sf_dir):
    a = P.amount_stats(txn(spark, sf_dir))
    return a.select(*[F.round(c, 6).alias(c) for c in a.columns])


def q_invalid_fraud_types(spark, sf_dir):
    return P.invalid_fraud_types(txn(spark, sf_dir))


def q_batch_features(spark, sf_dir):
    f = features(spark, sf_dir)
    return f.select(
        "event_id", "nameOrig", "step", "timestamp", "amount",
        F.round("amount_ratio", R).alias("amount_ratio"),
        F.round("balance_diff_orig", R).alias("balance_diff_orig"),
        "is_transfer", "is_cashout", "hour_of_day", "txn_velocity_1h", "isFraud",
    )


def q_txn_velocity(spark, sf_dir):
    return features(spark, sf_dir).select("event_id", "nameOrig", "step", "txn_velocity_1h")


def q_feature_table(spark, sf_dir):
    """S2 + K1 + S3: write the feature table range-partitioned and sorted by (nameOrig, timestamp),
    then scan it back with the required-column check."""
    import uuid

    from riskflow.operators.batch_features import read_feature_table, write_feature_table
    from riskflow.session import checkpoint_dir

    path = f"{checkpoint_dir(spark).rstrip('/')}/feature_tables/{uuid.uuid4().hex}"
    write_feature_table(features(spark, sf_dir), path)
    f = read_feature_table(spark, path)
    return f.select(
        "event_id", "nameOrig", "step", "timestamp", "amount",
        F.round("amount_ratio", R).alias("amount_ratio"),
        F.round("balance_diff_orig", R).alias("balance_diff_orig"),
        "is_transfer", "is_cashout", "hour_of_day", "txn_velocity_1h", "isFraud",
    )


QUERIES = {
    "feature_table": q_feature_table,
    "table_validation": q_table_validation,
    "unknown_types": q_unknown_types,
    "profile_overall": q_profile_overall,
    "profile_by_type": q_profile_by_type,
    "amount_stats": q_amount_stats,
    "invalid_fraud_types": q_invalid_fraud_types,
    "batch_features": q_batch_features,
    "txn_velocity": q_txn_velocity,
}
