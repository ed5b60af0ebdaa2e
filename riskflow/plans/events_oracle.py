"""DuckDB oracle SQL for the event-flow queries (same column names as the Spark side)."""

from __future__ import annotations

from riskflow.contract import LEAKAGE_FIELDS, EVENT_SCHEMA_V1
from riskflow.plans import model_sql
from riskflow.plans.events_queries import BENCH_THRESHOLD, SCORE_DIGITS
from riskflow.plans.oracle_rules import hour_sql, iso_valid_sql, parsed_events_cte
from riskflow.plans.oracle_views import with_views

KNOWN = sorted(set(EVENT_SCHEMA_V1["properties"]) | set(LEAKAGE_FIELDS))
KNOWN_SQL = ", ".join(f"'{k}'" for k in KNOWN)

PARSED = parsed_events_cte()

SANITISED = f"list_filter(json_keys(j_ok), lambda k: k NOT IN ({', '.join(repr(k) for k in LEAKAGE_FIELDS)}))"

FEATURES_CTE = f"""
efeat AS (
  SELECT p.*,
    CASE WHEN p.error IS NULL AND NOT {iso_valid_sql('p.timestamp')}
         THEN 'Invalid isoformat string: ''' || p.timestamp || '''' END AS stage_error
  FROM parsed p
),
feat2 AS (
  SELECT event_id, ts, raw, coalesce(error, stage_error) AS error,
    CASE WHEN coalesce(error, stage_error) IS NULL THEN amount END AS amount,
    CASE WHEN coalesce(error, stage_error) IS NULL THEN amount / (old_balance_orig + 1.0) END AS amount_ratio,
    CASE WHEN coalesce(error, stage_error) IS NULL THEN old_balance_orig - new_balance_orig - amount END AS balance_diff_orig,
    CASE WHEN coalesce(error, stage_error) IS NULL THEN CASE WHEN type = 'TRANSFER' THEN 1 ELSE 0 END END AS is_transfer,
    CASE WHEN coalesce(error, stage_error) IS NULL THEN CASE WHEN type IN ('CASH-OUT', 'CASH_OUT') THEN 1 ELSE 0 END END AS is_cashout,
    CASE WHEN coalesce(error, stage_error) IS NULL THEN {hour_sql('timestamp')} END AS hour_of_day,
    CASE WHEN coalesce(error, stage_error) IS NULL THEN 1 END AS txn_velocity_1h
  FROM efeat
)"""


def _scored_cte(threshold: float) -> str:
    return f"""
scored AS (
  SELECT *, CASE WHEN error IS NOT NULL THEN 'dead-letter' ELSE {model_sql.topic(threshold)} END AS topic
  FROM (
    SELECT *,
      CASE WHEN error IS NULL THEN {model_sql.DEMO_IF} END AS if_score,
      CASE WHEN error IS NULL THEN {model_sql.DEMO_AE} END AS ae_score,
      CASE WHEN error IS NULL THEN {model_sql.DEMO_SGD} END AS sgd_score,
      CASE WHEN error IS NULL THEN {model_sql.DEMO_ENSEMBLE} END AS ensemble_score
    FROM feat2
  ) z
)"""


def _w(body: str, extra: list[str]) -> str:
    return with_views(["raw_event"], [PARSED] + extra, body)


def oracle() -> dict[str, str]:
    d = SCORE_DIGITS
    return {
        "parse_route": _w(
            "SELECT event_id, CASE WHEN error IS NULL THEN 'parsed-events' ELSE 'dead-letter' END AS topic, error FROM parsed",
            [],
        ),
        "parse_valid": _w(
            f"""SELECT event_id, timestamp, user_id, type, amount, old_balance_orig, new_balance_orig,
                 array_to_string(list_sort(list_distinct(list_filter(json_keys(j_ok), lambda k: k NOT IN ({KNOWN_SQL})))), ',') AS extra_keys
               FROM parsed WHERE error IS NULL""",
            [],
        ),
        "dlq_by_error": _w("SELECT error, count(*) AS n FROM parsed WHERE error IS NOT NULL GROUP BY error", []),
        "hour_from_offset": _w(
            f"""SELECT event_id, timestamp, {iso_valid_sql('timestamp')} AS ts_valid,
                 CASE WHEN {iso_valid_sql('timestamp')} THEN {hour_sql('timestamp')} END AS hour_of_day
               FROM parsed WHERE error IS NULL""",
            [],
        ),
        "stream_features": _w(
            f"""SELECT event_id, amount, round(amount_ratio, {d}) AS amount_ratio,
                 round(balance_diff_orig, {d}) AS balance_diff_orig, is_transfer, is_cashout, hour_of_day, txn_velocity_1h
               FROM feat2 WHERE error IS NULL""",
            [FEATURES_CTE],
        ),
        "ensemble_score": _w(
            f"""SELECT event_id, round(if_score, {d}) AS if_score, round(ae_score, {d}) AS ae_score,
                 round(sgd_score, {d}) AS sgd_score, round(ensemble_score, {d}) AS ensemble_score
               FROM scored WHERE topic <> 'dead-letter'""",
            [FEATURES_CTE, _scored_cte(0.5)],
        ),
        "score_route": _w(
            f"SELECT event_id, round(ensemble_score, {d}) AS ensemble_score, topic FROM scored WHERE topic <> 'dead-letter'",
            [FEATURES_CTE, _scored_cte(BENCH_THRESHOLD)],
        ),
        "event_routing": _w("SELECT event_id, topic, error FROM scored", [FEATURES_CTE, _scored_cte(0.5)]),
        "sink_contents": _w(
            f"""SELECT s.event_id, s.topic, CAST(s.event_id AS VARCHAR) AS key,
                 CASE WHEN p.error IS NOT NULL THEN 'error,raw_event,received_at'
                      WHEN s.error IS NOT NULL THEN 'error,raw_event'
                      ELSE array_to_string(list_sort(list_distinct(list_concat({SANITISED}, ['features', 'scores']))), ',') END AS members,
                 s.error, CASE WHEN s.error IS NULL THEN p.user_id END AS user_id, s.amount,
                 CASE WHEN s.error IS NULL THEN json_extract_string(j_ok, '$.channel') END AS channel,
                 CASE WHEN s.error IS NULL THEN CAST(json_extract_string(j_ok, '$.device.n') AS INTEGER) END AS device_n,
                 coalesce(s.error IS NULL AND json_type(j_ok::JSON, '$.risk') = 'UBIGINT', false) AS risk_is_number,
                 round(s.balance_diff_orig, {d}) + 0.0 AS balance_diff_orig, s.hour_of_day,
                 round(s.ensemble_score, {d}) AS ensemble_score,
                 CASE WHEN p.error IS NOT NULL THEN p.raw END AS raw_text,
                 CASE WHEN p.error IS NULL AND s.error IS NOT NULL
                      THEN array_to_string(list_sort(list_distinct({SANITISED})), ',') END AS raw_members
               FROM scored s JOIN parsed p USING (event_id)""",
            [FEATURES_CTE, _scored_cte(0.5)],
        ),
        "route_counts": _w(
            """SELECT count(*) AS events_in,
                 count(*) FILTER (WHERE topic <> 'dead-letter') AS scored,
                 count(*) FILTER (WHERE topic = 'anomalies') AS anomalies,
                 count(*) FILTER (WHERE topic = 'metrics') AS normal,
                 count(*) FILTER (WHERE topic = 'dead-letter') AS dead_letter
               FROM scored""",
            [FEATURES_CTE, _scored_cte(0.5)],
        ),
    }
