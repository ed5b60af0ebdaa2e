"""DuckDB oracle SQL for the feedback queries."""

from __future__ import annotations

from riskflow.contract import FEATURES_V1, FEEDBACK_FIELDS, ONLINE_BATCH_SIZE
from riskflow.models.fixed import FIXED_LOGIT
from riskflow.operators import feedback as FB
from riskflow.plans.events_oracle import FEATURES_CTE as EVENT_FEATURES_CTE
from riskflow.plans.events_oracle import PARSED, _scored_cte
from riskflow.plans.oracle_views import with_views

R = 9
FIELDS = ", ".join(f"'{f}'" for f in FEEDBACK_FIELDS)


def _q(t: str) -> str:
    return "'" + t.replace("'", "''") + "'"


def _kind(path: str) -> str:
    return f"json_type(j::JSON, '$.{path}')"


FB_PARSED = f"""
fbp AS (
  SELECT event_id, raw, j,
    CASE WHEN j IS NULL THEN 'Invalid JSON payload'
         WHEN json_type(j::JSON) <> 'OBJECT' THEN 'Payload JSON must decode to an object.' END AS decode_error,
    {', '.join(f"{_kind(f)} AS k_{f}" for f in FEEDBACK_FIELDS)},
    json_extract_string(j, '$.anomaly_id') AS anomaly_id,
    json_extract_string(j, '$.label') AS label,
    json_extract_string(j, '$.analyst_id') AS analyst_id,
    CASE WHEN json_type(j::JSON) = 'OBJECT' THEN json_keys(j) END AS keys
  FROM (SELECT event_id, raw, CASE WHEN json_valid(raw) THEN raw END AS j FROM feedback_text) s
)"""


def _validation_error() -> str:
    checks = ["decode_error"]
    for f in ("anomaly_id", "label", "analyst_id"):
        checks.append(f"CASE WHEN k_{f} IS NULL THEN {_q(FB.MSG_REQUIRED.format(f=f))} END")
        checks.append(f"CASE WHEN k_{f} <> 'VARCHAR' THEN {_q(FB.MSG_STRING.format(f=f))} END")
        if f == "label":
            checks.append(f"CASE WHEN label NOT IN ('true_positive', 'false_positive') THEN {_q(FB.MSG_LABEL)} END")
        else:
            checks.append(f"CASE WHEN length({f}) < 1 THEN {_q(FB.MSG_MIN_LEN.format(f=f))} END")
    checks.append(f"CASE WHEN k_features IS NOT NULL AND k_features NOT IN ('NULL', 'OBJECT') THEN {_q(FB.MSG_FEATURES)} END")
    checks.append(f"CASE WHEN k_notes IS NOT NULL AND k_notes NOT IN ('NULL', 'VARCHAR') THEN {_q(FB.MSG_NOTES)} END")
    extra = f"list_sort(list_filter(keys, lambda x: x NOT IN ({FIELDS})))"
    checks.append(
        f"CASE WHEN len({extra}) > 0 THEN {_q(FB.MSG_EXTRA)} || '[' || "
        f"array_to_string(list_transform({extra}, lambda x: '''' || x || ''''), ', ') || ']' END"
    )
    return "coalesce(" + ", ".join(checks) + ")"


VALIDATED = f"""
fbv AS (
  SELECT event_id, anomaly_id, label, analyst_id, err AS error,
         CASE WHEN err IS NULL THEN 'accepted' ELSE 'rejected' END AS status
  FROM (SELECT *, {_validation_error()} AS err FROM fbp) z
)"""


def _value(n: str) -> str:
    k = _kind(f"features.{n}")
    return (f"CASE WHEN {k} IN ('BIGINT', 'UBIGINT', 'DOUBLE', 'HUGEINT') THEN CAST(json_extract(j, '$.features.{n}') AS DOUBLE) "
            f"WHEN {k} = 'VARCHAR' THEN TRY_CAST(trim(json_extract_string(j, '$.features.{n}')) AS DOUBLE) "
            f"WHEN {k} = 'BOOLEAN' THEN CASE WHEN json_extract_string(j, '$.features.{n}') = 'true' THEN 1.0 ELSE 0.0 END END")


ACCEPT = f"""
fba AS (
  SELECT event_id, anomaly_id, reason IS NULL AS accepted,
    CASE WHEN reason IS NULL THEN CASE WHEN label = 'true_positive' THEN 1 ELSE 0 END END AS y,
    reason AS skip_reason,
    {', '.join(f"CASE WHEN reason IS NULL THEN {n} END AS {n}" for n in FEATURES_V1)}
  FROM (
    SELECT *, CASE
      WHEN NOT coalesce(decode_error IS NULL AND k_label = 'VARCHAR' AND label IN ('true_positive', 'false_positive'), false)
        THEN '{FB.SKIP_LABEL}'
      WHEN coalesce(k_features, '') <> 'OBJECT' THEN '{FB.SKIP_FEATURES}'
      WHEN NOT ({' AND '.join(f'{n} IS NOT NULL' for n in FEATURES_V1)}) THEN '{FB.SKIP_VECTOR}'
    END AS reason
    FROM (SELECT *, {', '.join(f'{_value(n)} AS {n}' for n in FEATURES_V1)} FROM fbp) v
  ) r
)"""

BATCHED = f"""
fbb AS (
  SELECT *, CAST(floor((row_number() OVER (ORDER BY event_id) - 1) / {ONLINE_BATCH_SIZE}) AS BIGINT) AS batch_no
  FROM fba WHERE accepted
)"""


def oracle() -> dict[str, str]:
    w = FIXED_LOGIT.weights
    z = " + ".join(f"(CAST({n} AS DOUBLE)) * CAST({wi!r} AS DOUBLE)" for n, wi in zip(FEATURES_V1, w)) + \
        f" + CAST({FIXED_LOGIT.bias!r} AS DOUBLE)"
    eps = 1e-15
    grads = ", ".join(
        f"round(avg((p - y) * CAST({n} AS DOUBLE)) + {1e-4 * wi!r}, 6) AS grad_{i}" for i, (n, wi) in enumerate(zip(FEATURES_V1, w))
    )
    out = {
        "feedback_request_validation": with_views(
            ["feedback_text"], [FB_PARSED, VALIDATED], "SELECT event_id, anomaly_id, status, error FROM fbv"),
        "feedback_accept": with_views(["feedback_text"], [FB_PARSED, ACCEPT], f"""
SELECT event_id, anomaly_id, accepted, y, skip_reason, {', '.join(f'round({n}, {R}) AS {n}' for n in FEATURES_V1)} FROM fba"""),
        "feedback_join": with_views(
            ["raw_event", "feedback_text"],
            [PARSED, EVENT_FEATURES_CTE, _scored_cte(0.5), FB_PARSED, VALIDATED],
            f"""
SELECT s.event_id, round(s.ensemble_score, {R}) AS ensemble_score, v.label, v.analyst_id
FROM scored s JOIN fbv v ON CAST(s.event_id AS VARCHAR) = v.anomaly_id
WHERE s.topic = 'anomalies' AND v.status = 'accepted'"""),
        "feedback_batches": with_views(["feedback_text"], [FB_PARSED, ACCEPT, BATCHED], f"""
SELECT batch_no, count(*) AS n, CAST(sum(y) AS BIGINT) AS positives,
  CASE WHEN count(*) = {ONLINE_BATCH_SIZE} THEN 'update' ELSE 'final_flush' END AS status
FROM fbb GROUP BY batch_no"""),
        "online_gradient_step": with_views(["feedback_text"], [FB_PARSED, ACCEPT, BATCHED], f"""
SELECT batch_no, count(*) AS n,
  round(avg(-(y * ln(least(greatest(p, {eps!r}), {1 - eps!r})) + (1 - y) * ln(1.0 - least(greatest(p, {eps!r}), {1 - eps!r})))), 6) AS loss,
  round(avg(p - y), 6) AS grad_bias, {grads}
FROM (SELECT *, 1.0 / (1.0 + exp(-({z}))) AS p FROM fbb) z GROUP BY batch_no"""),
    }
    # feedback carries the time of its event, which is in reach of the time range
    return out | {"feedback_stream_join": out["feedback_join"]}
