"""DuckDB SQL text for the event rules (twin of riskflow.functions.jsonrules).

Used only to build oracle queries for the correctness gate.  ``j`` must be the
raw text when it is valid JSON and NULL otherwise (so no JSON function sees an
invalid document).
"""

from __future__ import annotations

from riskflow.contract import EVENT_SCHEMA_V1, MSG_INVALID_JSON, MSG_MISSING_FIELDS, MSG_NOT_OBJECT

DUCK_NUMERIC = "('BIGINT', 'UBIGINT', 'DOUBLE', 'HUGEINT')"


def _s(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def kind(j: str, name: str) -> str:
    return f"json_type({j}::JSON, '$.{name}')"


def schema_error_sql(raw: str, j: str, schema: dict = EVENT_SCHEMA_V1) -> str:
    required = list(schema.get("required", []))
    props = schema.get("properties", {})
    checks: list[str] = []
    if required:
        missing_any = " OR ".join(f"{kind(j, k)} IS NULL" for k in required)
        names = ", ".join(f"CASE WHEN {kind(j, k)} IS NULL THEN {_s(repr(k))} END" for k in required)
        checks.append(f"CASE WHEN {missing_any} THEN {_s(MSG_MISSING_FIELDS)} || '[' || concat_ws(', ', {names}) || ']' END")
    for name, spec in props.items():
        t = spec.get("type")
        present = f"{kind(j, name)} IS NOT NULL"
        if t == "string":
            checks.append(f"CASE WHEN {present} AND {kind(j, name)} <> 'VARCHAR' THEN {_s(f'Field {name!r} must be a string.')} END")
            ml = spec.get("minLength")
            if isinstance(ml, int):
                checks.append(
                    f"CASE WHEN {present} AND length(json_extract_string({j}, '$.{name}')) < {ml} "
                    f"THEN {_s(f'Field {name!r} must have length >= {ml}.')} END"
                )
        elif t == "number":
            checks.append(f"CASE WHEN {present} AND {kind(j, name)} NOT IN {DUCK_NUMERIC} THEN {_s(f'Field {name!r} must be numeric.')} END")
    for name, spec in props.items():
        if "enum" in spec:
            allowed = ", ".join(_s(a) for a in spec["enum"])
            checks.append(
                f"CASE WHEN {kind(j, name)} IS NOT NULL AND json_extract_string({j}, '$.{name}') NOT IN ({allowed}) "
                f"THEN {_s(f'Invalid value for {name!r}: ')} || json_extract_string({j}, '$.{name}') END"
            )
    for name, spec in props.items():
        if "minimum" in spec:
            lo = float(spec["minimum"])
            checks.append(
                f"CASE WHEN {kind(j, name)} IS NOT NULL AND {kind(j, name)} NOT IN {DUCK_NUMERIC} "
                f"THEN {_s(f'Field {name!r} must be numeric.')} "
                f"WHEN {kind(j, name)} IS NOT NULL AND CAST(json_extract({j}, '$.{name}') AS DOUBLE) < {lo!r} "
                f"THEN {_s(f'Field {name!r} must be >= {lo!r}.')} END"
            )
    rules = "coalesce(" + ", ".join(checks) + ")"
    return (
        f"CASE WHEN {j} IS NULL THEN {_s(MSG_INVALID_JSON)} "
        f"WHEN json_type({j}::JSON) <> 'OBJECT' THEN {_s(MSG_NOT_OBJECT)} "
        f"ELSE {rules} END"
    )


def parsed_events_cte(source: str = "raw_event", name: str = "parsed") -> str:
    """CTE with event_id, ts, raw, error and typed fields (NULL on failures)."""
    err = schema_error_sql("raw", "j")
    return f"""
{name} AS (
  SELECT event_id, ts, raw, error,
    CASE WHEN error IS NULL THEN json_extract_string(j, '$.event_id') END AS ev_id,
    CASE WHEN error IS NULL THEN json_extract_string(j, '$.timestamp') END AS timestamp,
    CASE WHEN error IS NULL THEN json_extract_string(j, '$.user_id') END AS user_id,
    CASE WHEN error IS NULL THEN json_extract_string(j, '$.type') END AS type,
    CASE WHEN error IS NULL THEN CAST(json_extract(j, '$.amount') AS DOUBLE) END AS amount,
    CASE WHEN error IS NULL THEN CAST(json_extract(j, '$.old_balance_orig') AS DOUBLE) END AS old_balance_orig,
    CASE WHEN error IS NULL THEN CAST(json_extract(j, '$.new_balance_orig') AS DOUBLE) END AS new_balance_orig,
    CASE WHEN error IS NULL THEN j END AS j_ok
  FROM (
    SELECT event_id, ts, raw, j, {err} AS error
    FROM (SELECT event_id, ts, raw, CASE WHEN json_valid(raw) THEN raw END AS j FROM {source}) s0
  ) s1
)"""


# ISO date-time check in DuckDB (twin of riskflow.functions.features.iso_valid).
from riskflow.functions.features import ISO_DATETIME as ISO_RE  # noqa: E402
from riskflow.functions.features import OFFSET_HH, TIME_MM, TIME_SS  # noqa: E402


def iso_valid_sql(ts: str) -> str:
    def grp(text: str, pattern: str, i: int) -> str:
        return f"TRY_CAST(nullif(regexp_extract({text}, '{pattern}', {i}), '') AS INTEGER)"

    tail = f"substr({ts}, 14)"
    return (
        f"coalesce(regexp_full_match({ts}, '{ISO_RE}') "
        f"AND try_strptime(substr({ts}, 1, 10), '%Y-%m-%d') IS NOT NULL "
        f"AND (length({ts}) < 13 OR (TRY_CAST(substr({ts}, 12, 2) AS INTEGER) <= 23 "
        f"AND coalesce({grp(ts, TIME_MM, 1)} <= 59, true) "
        f"AND coalesce({grp(ts, TIME_SS, 1)} <= 59, true) "
        f"AND coalesce({grp(tail, OFFSET_HH, 1)}, 0) * 3600 + coalesce({grp(tail, OFFSET_HH, 2)}, 0) * 60 "
        f"+ coalesce({grp(tail, OFFSET_HH, 3)}, 0) < 86400)), false)"
    )


def hour_sql(ts: str) -> str:
    return f"CASE WHEN length({ts}) >= 13 THEN TRY_CAST(substr({ts}, 12, 2) AS INTEGER) ELSE 0 END"
