"""DuckDB oracle SQL for the transaction-table queries."""

from __future__ import annotations

from riskflow.contract import (
    ALLOWED_FRAUD_TYPES,
    ALLOWED_TYPES,
    FLAGGED_SPARSE_MAX,
    MSG_FLAGGED_SPARSE,
    MSG_FRAUD_OUTSIDE,
    MSG_STEP_SMALL,
    MSG_STEP_START,
    MSG_UNKNOWN_TYPES,
    STEP_MAX_EXPECTED,
    STEP_MIN_ALLOWED,
)
from riskflow.plans.oracle_views import with_views

R = 9


def _in(vals) -> str:
    return "(" + ", ".join(f"'{v}'" for v in vals) + ")"


FEATURES_CTE = """
feat AS (
  SELECT t.*,
    TIMESTAMP '2024-01-01 00:00:00' + to_hours(step) AS timestamp,
    amount / (oldbalanceOrg + 1.0) AS amount_ratio,
    oldbalanceOrg - newbalanceOrig - amount AS balance_diff_orig,
    CAST(CASE WHEN type = 'TRANSFER' THEN 1 ELSE 0 END AS INTEGER) AS is_transfer,
    CAST(CASE WHEN type IN ('CASH-OUT', 'CASH_OUT') THEN 1 ELSE 0 END AS INTEGER) AS is_cashout,
    CAST(hour(TIMESTAMP '2024-01-01 00:00:00' + to_hours(step)) AS INTEGER) AS hour_of_day,
    CAST(row_number() OVER (PARTITION BY nameOrig, step ORDER BY event_id) AS INTEGER) AS txn_velocity_1h
  FROM txn t
)"""


def oracle() -> dict[str, str]:
    t = "coalesce(type, 'nan')"
    validation = f"""
SELECT rows, 11 AS cols, (n_errors = 0) AS ok, n_errors, n_warnings, errors, warnings FROM (
  SELECT rows,
    CAST((coalesce(len(unk), 0) > 0) AS INTEGER) + CAST((outside > 0) AS INTEGER) + CAST((smin < {STEP_MIN_ALLOWED}) AS INTEGER) AS n_errors,
    CAST((flagged <= {FLAGGED_SPARSE_MAX}) AS INTEGER) + CAST((smax < {STEP_MAX_EXPECTED}) AS INTEGER) AS n_warnings,
    concat_ws(' | ',
      CASE WHEN coalesce(len(unk), 0) > 0 THEN '{MSG_UNKNOWN_TYPES}[' || array_to_string(list_transform(unk, lambda x: '''' || x || ''''), ', ') || ']' END,
      CASE WHEN outside > 0 THEN '{MSG_FRAUD_OUTSIDE}' END,
      CASE WHEN smin < {STEP_MIN_ALLOWED} THEN '{MSG_STEP_START}' END) AS errors,
    concat_ws(' | ',
      CASE WHEN flagged <= {FLAGGED_SPARSE_MAX} THEN '{MSG_FLAGGED_SPARSE}' END,
      CASE WHEN smax < {STEP_MAX_EXPECTED} THEN '{MSG_STEP_SMALL}' END) AS warnings
  FROM (
    SELECT count(*) AS rows,
      list_sort(array_agg(DISTINCT {t}) FILTER (WHERE {t} NOT IN {_in(ALLOWED_TYPES)})) AS unk,
      count(*) FILTER (WHERE isFraud = 1 AND replace({t}, '_', '-') NOT IN ('TRANSFER', 'CASH-OUT')) AS outside,
      count(*) FILTER (WHERE isFlaggedFraud = 1) AS flagged,
      min(step) AS smin, max(step) AS smax
    FROM txn
  ) a
) b"""
    return {
        "table_validation": with_views(["txn"], [], validation),
        "unknown_types": with_views(
            ["txn"], [], f"SELECT DISTINCT {t} AS type FROM txn WHERE {t} NOT IN {_in(ALLOWED_TYPES)}"
        ),
        "profile_overall": with_views(["txn"], [], f"""
SELECT count(*) AS rows, 11 AS cols, CAST(sum(isFraud) AS BIGINT) AS fraud_count,
  round(avg(isFraud), {R}) AS fraud_rate,
  round(count(*) FILTER (WHERE isFraud = 0) / greatest(count(*) FILTER (WHERE isFraud = 1), 1), {R}) AS class_imbalance_ratio,
  min(step) AS step_min, max(step) AS step_max, max(step) - min(step) AS timestamp_hours_span_from_step
FROM txn"""),
        "profile_by_type": with_views(["txn"], [], f"""
SELECT type, count(isFraud) AS count, CAST(sum(isFraud) AS BIGINT) AS fraud_count, round(avg(isFraud), {R}) AS fraud_rate
FROM txn GROUP BY type"""),
        "amount_stats": with_views(["txn"], [], """
SELECT round(min(amount), 6) AS min, round(quantile_cont(amount, 0.5), 6) AS p50,
  round(quantile_cont(amount, 0.95), 6) AS p95, round(quantile_cont(amount, 0.99), 6) AS p99,
  round(max(amount), 6) AS max
FROM txn"""),
        "invalid_fraud_types": with_views(
            ["txn"], [],
            f"SELECT DISTINCT {t} AS type FROM txn WHERE isFraud = 1 AND {t} NOT IN {_in(ALLOWED_FRAUD_TYPES)}",
        ),
        "batch_features": with_views(["txn"], [FEATURES_CTE], f"""
SELECT event_id, nameOrig, step, timestamp, amount, round(amount_ratio, {R}) AS amount_ratio,
  round(balance_diff_orig, {R}) AS balance_diff_orig, is_transfer, is_cashout, hour_of_day, txn_velocity_1h, isFraud
FROM feat"""),
        "feature_table": with_views(["txn"], [FEATURES_CTE], f"""
SELECT event_id, nameOrig, step, timestamp, amount, round(amount_ratio, {R}) AS amount_ratio,
  round(balance_diff_orig, {R}) AS balance_diff_orig, is_transfer, is_cashout, hour_of_day, txn_velocity_1h, isFraud
FROM feat"""),
        "txn_velocity": with_views(["txn"], [FEATURES_CTE], "SELECT event_id, nameOrig, step, txn_velocity_1h FROM feat"),
    }
