"""Table validation (V9), profile (A1-A4) and the type set difference.

Each check is one pass: a single ``agg`` with partial aggregation; the only
per-value state is the set of *unknown* type names (the error message lists
them all by definition).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskflow.contract import (
    ALLOWED_FRAUD_TYPES,
    ALLOWED_TYPES,
    EXPECTED_COLUMNS,
    FLAGGED_SPARSE_MAX,
    FRAUD_TYPES_NORMALISED,
    MSG_FLAGGED_SPARSE,
    MSG_FRAUD_OUTSIDE,
    MSG_MISSING_COLUMNS,
    MSG_STEP_SMALL,
    MSG_STEP_START,
    MSG_UNKNOWN_TYPES,
    STEP_MAX_EXPECTED,
    STEP_MIN_ALLOWED,
)
from riskflow.functions.features import normalize_txn_type
from riskflow.functions.jsonrules import py_list_text
from riskflow.operators.ordering import exact_quantiles


def type_text(t: Column) -> Column:
    """``astype(str)`` of a type value: a missing type reads as 'nan'."""
    return F.coalesce(t.cast("string"), F.lit("nan"))


def validate_table(df: DataFrame) -> DataFrame:
    """V9: one row (rows, cols, ok, n_errors, n_warnings, errors, warnings).

    Missing columns are found on the driver from the schema (no job); each
    other check is skipped when its column is absent, as specified.
    """
    cols = set(df.columns)
    missing = [c for c in EXPECTED_COLUMNS if c not in cols]
    aggs = [F.count(F.lit(1)).alias("rows")]
    if "type" in cols:
        unknown = F.when(~type_text(F.col("type")).isin(*ALLOWED_TYPES), type_text(F.col("type")))
        aggs.append(F.sort_array(F.collect_set(unknown)).alias("_unknown"))
    if "isFraud" in cols and "type" in cols:
        outside = (F.col("isFraud") == 1) & ~normalize_txn_type(type_text(F.col("type"))).isin(*FRAUD_TYPES_NORMALISED)
        aggs.append(F.count_if(outside).alias("_outside"))
    if "isFlaggedFraud" in cols:
        aggs.append(F.count_if(F.col("isFlaggedFraud") == 1).alias("_flagged"))
    if "step" in cols:
        aggs += [F.min("step").alias("_step_min"), F.max("step").alias("_step_max")]
    a = df.agg(*aggs)

    errors: list[Column] = []
    warnings: list[Column] = []
    if missing:
        errors.append(F.lit(MSG_MISSING_COLUMNS + ", ".join(missing)))
    if "type" in cols:
        errors.append(F.when(F.size("_unknown") > 0, F.concat(F.lit(MSG_UNKNOWN_TYPES), py_list_text(F.col("_unknown")))))
    if "isFraud" in cols and "type" in cols:
        errors.append(F.when(F.col("_outside") > 0, F.lit(MSG_FRAUD_OUTSIDE)))
    if "isFlaggedFraud" in cols:
        warnings.append(F.when(F.col("_flagged") <= FLAGGED_SPARSE_MAX, F.lit(MSG_FLAGGED_SPARSE)))
    if "step" in cols:
        errors.append(F.when(F.col("_step_min") < STEP_MIN_ALLOWED, F.lit(MSG_STEP_START)))
        warnings.append(F.when(F.col("_step_max") < STEP_MAX_EXPECTED, F.lit(MSG_STEP_SMALL)))
    err = F.array_compact(F.array(*errors)) if errors else F.array().cast("array<string>")
    warn = F.array_compact(F.array(*warnings)) if warnings else F.array().cast("array<string>")
    return a.select(
        F.col("rows"),
        F.lit(len(df.columns)).alias("cols"),
        (F.size(err) == 0).alias("ok"),
        F.size(err).alias("n_errors"),
        F.size(warn).alias("n_warnings"),
        F.array_join(err, " | ").alias("errors"),
        F.array_join(warn, " | ").alias("warnings"),
    )


def unknown_types(df: DataFrame) -> DataFrame:
    """Seen type names minus the allowed set (distributed distinct + filter)."""
    t = type_text(F.col("type"))
    return df.select(t.alias("type")).where(~F.col("type").isin(*ALLOWED_TYPES)).distinct()


def invalid_fraud_types(df: DataFrame) -> DataFrame:
    """A4: types seen on fraud rows that are not fraud types."""
    t = type_text(F.col("type"))
    return (
        df.where(F.col("isFraud") == 1).select(t.alias("type"))
        .where(~F.col("type").isin(*ALLOWED_FRAUD_TYPES)).distinct()
    )


def profile_overall(df: DataFrame, n_cols: int | None = None) -> DataFrame:
    """A1: rows, cols, fraud count/rate, imbalance, step range (one pass)."""
    a = df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.sum("isFraud").alias("fraud_count"),
        F.avg("isFraud").alias("fraud_rate"),
        F.count_if(F.col("isFraud") == 0).alias("_neg"),
        F.count_if(F.col("isFraud") == 1).alias("_pos"),
        F.min("step").alias("step_min"),
        F.max("step").alias("step_max"),
    )
    return a.select(
        "rows",
        F.lit(n_cols if n_cols is not None else len(df.columns)).alias("cols"),
        F.col("fraud_count").cast("long").alias("fraud_count"),
        "fraud_rate",
        (F.col("_neg") / F.greatest(F.col("_pos"), F.lit(1))).alias("class_imbalance_ratio"),
        "step_min",
        "step_max",
        (F.col("step_max") - F.col("step_min")).alias("timestamp_hours_span_from_step"),
    )


def profile_by_type(df: DataFrame) -> DataFrame:
    """A2: per type (null kept as a group): count of non-null labels, sum, mean."""
    return df.groupBy("type").agg(
        F.count("isFraud").alias("count"),
        F.sum("isFraud").cast("long").alias("fraud_count"),
        F.avg("isFraud").alias("fraud_rate"),
    )


def amount_stats(df: DataFrame, col: str = "amount") -> DataFrame:
    """A3: min, p50, p95, p99, max (linear interpolation, exact; min/max are q=0/q=1)."""
    q = exact_quantiles(df, col, [0.0, 0.5, 0.95, 0.99, 1.0])
    return q.select(
        F.col("q_0").alias("min"),
        F.col("q_1").alias("p50"),
        F.col("q_2").alias("p95"),
        F.col("q_3").alias("p99"),
        F.col("q_4").alias("max"),
    )
