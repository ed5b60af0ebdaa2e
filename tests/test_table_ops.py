import numpy as np
import pytest
from pyspark.sql import functions as F

from riskflow.contract import TXN_SCHEMA
from riskflow.operators import profile as P
from riskflow.operators.batch_features import add_training_features

ROWS_OK = [
    (1, "PAYMENT", 10.0, "C1", 100.0, 90.0, "M1", 0.0, 0.0, 0, 0),
    (1, "TRANSFER", 500.0, "C2", 500.0, 0.0, "C3", 0.0, 0.0, 1, 0),
    (2, "CASH_OUT", 400.0, "C3", 400.0, 0.0, "M2", 0.0, 0.0, 1, 0),
    (3, "DEBIT", 5.0, "C4", 50.0, 45.0, "M3", 0.0, 0.0, 0, 0),
    (200, "CASH-IN", 20.0, "C5", 0.0, 20.0, "M4", 0.0, 0.0, 0, 0),
]


def _txn(spark, rows):
    return spark.createDataFrame(rows, TXN_SCHEMA)


def test_validation_ok_table_has_only_the_sparse_warning(spark):
    r = P.validate_table(_txn(spark, ROWS_OK)).first()
    assert r["ok"] and r["rows"] == 5 and r["cols"] == 11
    assert r["warnings"] == "isFlaggedFraud is sparse and should not be used as target."


def test_validation_fraud_outside_allowed_types(spark):
    rows = ROWS_OK + [(4, "PAYMENT", 1.0, "C9", 1.0, 0.0, "M9", 0.0, 0.0, 1, 0)]
    r = P.validate_table(_txn(spark, rows)).first()
    assert not r["ok"]
    assert "Found fraudulent rows outside TRANSFER/CASH-OUT." in r["errors"]


def test_validation_unknown_types_sorted_and_missing_columns(spark):
    rows = ROWS_OK + [(4, "WIRE", 1.0, "C9", 1.0, 0.0, "M9", 0.0, 0.0, 0, 0),
                      (4, "ACH", 1.0, "C9", 1.0, 0.0, "M9", 0.0, 0.0, 0, 0)]
    r = P.validate_table(_txn(spark, rows).drop("nameDest")).first()
    assert r["errors"].startswith("Missing required columns: nameDest")
    assert "Unknown transaction types: ['ACH', 'WIRE']" in r["errors"]


def test_profile_and_invalid_fraud_types(spark):
    rows = ROWS_OK + [(4, "PAYMENT", 1.0, "C9", 1.0, 0.0, "M9", 0.0, 0.0, 1, 0)]
    t = _txn(spark, rows)
    o = P.profile_overall(t).first()
    assert o["rows"] == 6 and o["fraud_count"] == 3 and o["class_imbalance_ratio"] == 1.0
    assert o["timestamp_hours_span_from_step"] == 199
    bad = [r["type"] for r in P.invalid_fraud_types(t).collect()]
    assert bad == ["PAYMENT"]
    by = {r["type"]: (r["count"], r["fraud_count"]) for r in P.profile_by_type(t).collect()}
    assert by["PAYMENT"] == (2, 1)


def test_amount_stats_match_numpy_linear(spark):
    t = _txn(spark, ROWS_OK)
    r = P.amount_stats(t).first()
    a = np.array([x[2] for x in ROWS_OK])
    assert r["p50"] == pytest.approx(np.quantile(a, 0.5))
    assert r["p95"] == pytest.approx(np.quantile(a, 0.95))
    assert r["min"] == a.min() and r["max"] == a.max()


def test_velocity_counts_within_user_hour(spark):
    rows = [(1, "TRANSFER", 10.0, "C1", 100.0, 90.0, "M1", 0.0, 0.0, 0, 0),
            (1, "TRANSFER", 20.0, "C1", 90.0, 70.0, "M1", 0.0, 0.0, 0, 0),
            (2, "TRANSFER", 20.0, "C1", 70.0, 50.0, "M1", 0.0, 0.0, 0, 0)]
    t = _txn(spark, rows).withColumn("event_id", F.monotonically_increasing_id())
    f = add_training_features(t).orderBy("event_id").collect()
    assert [r["txn_velocity_1h"] for r in f] == [1, 2, 1]
    assert [r["hour_of_day"] for r in f] == [1, 1, 2]
    assert str(f[0]["timestamp"]) == "2024-01-01 01:00:00"
