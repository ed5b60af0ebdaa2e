"""Batch feature table (F1, F2, W1, K1) and its sink/scan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskflow.contract import FEATURES_V1
from riskflow.functions import features as FX
from riskflow.operators.ordering import grouped_row_number
from riskflow.session import target_partitions


def add_training_features(txn: DataFrame, ingest_col: str = "event_id") -> DataFrame:
    """Transactions + ``timestamp`` + the seven contract features.

    Velocity (W1) is the running count inside (nameOrig, step) in ingest
    order: all rows of a group share one timestamp, so the ingest key is the
    order.  The only shuffle is the skew-safe grouped numbering.
    """
    ts = FX.timestamp_from_step(F.col("step"))
    base = txn.select("*", ts.alias("timestamp"))
    numbered = grouped_row_number(base, ["nameOrig", "step"], ingest_col, "txn_velocity_1h")
    feats = FX.feature_columns(
        F.col("amount"),
        F.col("oldbalanceOrg"),
        F.col("newbalanceOrig"),
        F.col("type"),
        F.hour(F.col("timestamp")),
        F.col("txn_velocity_1h"),
    )
    keep = [c for c in numbered.columns if c not in FEATURES_V1]
    return numbered.select(*keep, *[c for c in feats])


def write_feature_table(features: DataFrame, path: str, partitions: int | None = None) -> None:
    """S2 + K1: write ordered by (nameOrig, timestamp): range partitions, sorted inside."""
    n = partitions or target_partitions(features)
    (
        features.repartitionByRange(n, "nameOrig", "timestamp")
        .sortWithinPartitions("nameOrig", "timestamp")
        .write.mode("overwrite")
        .parquet(path)
    )


def read_feature_table(spark, path: str, required: list[str] | None = None) -> DataFrame:
    """S3: scan with a required-column check on the driver (before any job)."""
    df = spark.read.parquet(path)
    need = required if required is not None else FEATURES_V1
    missing = [c for c in need if c not in df.columns]
    if missing:
        raise ValueError(f"Missing required columns: {missing}")
    return df
