"""DuckDB oracle SQL for the fixed-model and evaluation queries."""

from __future__ import annotations

from riskflow.contract import ADAPTIVE_DEFAULTS as AD
from riskflow.contract import FEATURES_V1, PROMOTION_MIN
from riskflow.plans import model_sql
from riskflow.plans.model_queries import BUDGET_RATIO
from riskflow.plans.oracle_views import with_views
from riskflow.plans.table_oracle import FEATURES_CTE

R = 9


def _w(extra: list[str], body: str) -> str:
    return with_views(["txn"], [FEATURES_CTE] + extra, body)


SPLIT_CTE = """
split AS (
  SELECT f.*, row_number() OVER (ORDER BY nameOrig, step, event_id) - 1 AS row_index,
         CASE WHEN row_number() OVER (ORDER BY nameOrig, step, event_id) - 1 < CAST(floor(0.8 * count(*) OVER ()) AS BIGINT)
              THEN 'train' ELSE 'validation' END AS split
  FROM feat f
)"""

BOUNDS_CTE = "bounds AS (SELECT " + ", ".join(
    f"min({c}) AS mn_{c}, max({c}) AS mx_{c}" for c in FEATURES_V1
) + " FROM split WHERE split = 'train')"

SCALED_CTE = "scaled AS (SELECT s.event_id, s.split, " + ", ".join(
    f"(CAST(s.{c} AS DOUBLE) - b.mn_{c}) / (CASE WHEN b.mx_{c} - b.mn_{c} <> 0 THEN b.mx_{c} - b.mn_{c} ELSE 1.0 END) AS {c}_scaled"
    for c in FEATURES_V1
) + " FROM split s, bounds b)"

LOGIT_CTE = f"lscored AS (SELECT *, {model_sql.LOGIT} AS score FROM feat)"

HOLDOUT_CTE = """
per_score AS (SELECT score AS s, sum(CASE WHEN isFraud = 1 THEN 1 ELSE 0 END) AS pos,
                     sum(CASE WHEN isFraud = 1 THEN 0 ELSE 1 END) AS neg FROM lscored GROUP BY score),
cum AS (SELECT s, pos, neg,
          sum(pos) OVER (ORDER BY s DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cp,
          sum(neg) OVER (ORDER BY s DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cn
        FROM per_score),
hold AS (
  SELECT rows_holdout, tp, fp, fn, n_pos,
    CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END AS precision_at_0_5,
    CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END AS recall_at_0_5,
    CASE WHEN n_pos > 0 THEN num / n_pos ELSE 0.0 END AS pr_auc
  FROM (SELECT sum(pos * (cp / (cp + cn))) AS num, CAST(sum(pos) AS BIGINT) AS n_pos,
               CAST(sum(pos + neg) AS BIGINT) AS rows_holdout,
               CAST(sum(CASE WHEN s >= 0.5 THEN pos ELSE 0 END) AS BIGINT) AS tp,
               CAST(sum(CASE WHEN s >= 0.5 THEN neg ELSE 0 END) AS BIGINT) AS fp,
               CAST(sum(CASE WHEN s < 0.5 THEN pos ELSE 0 END) AS BIGINT) AS fn FROM cum) a
)"""


def _demo_cte() -> str:
    return f"dscored AS (SELECT *, {model_sql.DEMO_ENSEMBLE} AS ensemble_score FROM feat)"


def _adaptive(by: str | None) -> str:
    g = f"{by}, " if by else ""
    grp = f"GROUP BY {by}" if by else ""
    return f"""
SELECT {g}count(*) AS n, round(quantile_cont(ensemble_score, {AD['quantile']}), {R}) AS quantile_value,
  round(CASE WHEN count(*) < {AD['min_samples']} THEN {AD['current_threshold']}
             ELSE least(greatest(quantile_cont(ensemble_score, {AD['quantile']}), {AD['floor']}), {AD['ceiling']}) END, {R}) AS threshold
FROM dscored {grp}"""


def oracle() -> dict[str, str]:
    ae_fixed = "ae AS (" + model_sql.net_error(model_sql.scaled("feat")) + ")"
    validation = "SELECT event_id, [" + ", ".join(f"{c}_scaled" for c in FEATURES_V1) + "] AS s FROM scaled WHERE split = 'validation'"
    ae_val = "aev AS (" + model_sql.net_error(validation) + ")"
    pm = PROMOTION_MIN
    budget = f"greatest(1, CAST(round_even(count(*) OVER () * {BUDGET_RATIO!r}, 0) AS BIGINT))"
    return {
        "logit_score": _w([LOGIT_CTE], f"SELECT event_id, round(score, {R}) AS score FROM lscored"),
        "ae_score_fixed_net": _w([ae_fixed], f"""
SELECT event_id, round(ae_mse, {R}) AS ae_mse,
  round(least(greatest(ae_mse / {model_sql.AE_THRESHOLD}, 0.0), 1.0), {R}) AS ae_score FROM ae"""),
        "if_score_fixed_forest": _w([], f"""
SELECT event_id, round(d, {R}) AS decision, round(1.0 / (1.0 + exp(d)), {R}) AS if_score
FROM ({model_sql.forest_decision('feat')}) z"""),
        "positional_split": _w([SPLIT_CTE], "SELECT event_id, row_index, split FROM split"),
        "minmax_scale": _w([SPLIT_CTE, BOUNDS_CTE, SCALED_CTE], "SELECT event_id, split, " + ", ".join(
            f"round({c}_scaled, {R}) AS {c}_scaled" for c in FEATURES_V1) + " FROM scaled"),
        "reconstruction_threshold": _w([SPLIT_CTE, BOUNDS_CTE, SCALED_CTE, ae_val], f"""
SELECT count(*) AS n_validation, round(quantile_cont(ae_mse, 0.99), {R}) AS threshold_p99 FROM aev"""),
        "balanced_weights": _w([SPLIT_CTE], f"""
SELECT isFraud, count(*) AS n, round(sum(count(*)) OVER () / (2.0 * count(*)), {R}) AS weight
FROM split WHERE split = 'train' GROUP BY isFraud"""),
        "holdout_metrics": _w([LOGIT_CTE, HOLDOUT_CTE], f"""
SELECT rows_holdout, tp, fp, fn, round(precision_at_0_5, {R}) AS precision_at_0_5,
  round(recall_at_0_5, {R}) AS recall_at_0_5 FROM hold"""),
        "average_precision": _w([LOGIT_CTE, HOLDOUT_CTE], f"""
SELECT round(pr_auc, {R}) AS pr_auc, n_pos, rows_holdout AS n FROM hold"""),
        "promotion_check": _w([LOGIT_CTE, HOLDOUT_CTE], f"""
SELECT round(precision_at_0_5, {R}) AS precision_at_0_5, round(recall_at_0_5, {R}) AS recall_at_0_5,
  round(pr_auc, {R}) AS pr_auc,
  (precision_at_0_5 >= {pm['precision']} AND recall_at_0_5 >= {pm['recall']} AND pr_auc >= {pm['pr_auc']}) AS passed,
  concat_ws('; ',
    CASE WHEN precision_at_0_5 < {pm['precision']} THEN 'precision_at_0_5=' || printf('%.6f', precision_at_0_5) || ' below min_precision={pm['precision']:.6f}' END,
    CASE WHEN recall_at_0_5 < {pm['recall']} THEN 'recall_at_0_5=' || printf('%.6f', recall_at_0_5) || ' below min_recall={pm['recall']:.6f}' END,
    CASE WHEN pr_auc < {pm['pr_auc']} THEN 'pr_auc=' || printf('%.6f', pr_auc) || ' below min_pr_auc={pm['pr_auc']:.6f}' END) AS reasons
FROM hold"""),
        "alert_budget": _w([_demo_cte()], f"""
SELECT event_id, round(ensemble_score, {R}) AS ensemble_score, alert_rank FROM (
  SELECT event_id, ensemble_score, row_number() OVER (ORDER BY ensemble_score DESC, event_id ASC) AS alert_rank,
         {budget} AS k
  FROM dscored) z WHERE alert_rank <= k"""),
        "quality_at_budget": _w([_demo_cte()], f"""
SELECT alerts_sent, tp, positives,
  round(CASE WHEN alerts_sent > 0 THEN tp / alerts_sent ELSE 0.0 END, {R}) AS precision,
  round(CASE WHEN positives > 0 THEN tp / positives ELSE 0.0 END, {R}) AS recall
FROM (SELECT count(*) FILTER (WHERE r <= k) AS alerts_sent, count(*) FILTER (WHERE r <= k AND isFraud = 1) AS tp,
             count(*) FILTER (WHERE isFraud = 1) AS positives
      FROM (SELECT isFraud, row_number() OVER (ORDER BY ensemble_score DESC, event_id ASC) AS r, {budget} AS k
            FROM dscored) z) a"""),
        "adaptive_threshold": _w([_demo_cte()], _adaptive(None)),
        "adaptive_threshold_by_type": _w([_demo_cte()], _adaptive("type")),
        "latency_summary": """
SELECT count(*) AS n, round(quantile_cont(g, 0.5), 6) AS p50_ms, round(quantile_cont(g, 0.95), 6) AS p95_ms,
  round(max(g), 6) AS max_ms
FROM (SELECT (epoch_us(ts) - lag(epoch_us(ts)) OVER (ORDER BY ts, event_id)) / 1000.0 AS g FROM events) z
WHERE g IS NOT NULL""",
    }
