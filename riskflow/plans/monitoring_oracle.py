"""DuckDB oracle SQL for the monitoring queries."""

from __future__ import annotations

from riskflow.contract import ALERT_RULES, ONLINE_BATCH_SIZE
from riskflow.plans import feedback_oracle as FO
from riskflow.plans.events_oracle import FEATURES_CTE as EVENT_FEATURES_CTE
from riskflow.plans.events_oracle import PARSED, _scored_cte
from riskflow.plans.model_oracle import _demo_cte
from riskflow.plans.monitoring_queries import INCREASE_RANGE_S, LATENCY_SLO_MS, RATE_RANGE_S
from riskflow.plans.model_queries import BUDGET_RATIO
from riskflow.plans.oracle_views import with_views
from riskflow.plans.table_oracle import FEATURES_CTE as TABLE_FEATURES_CTE

R = 9

DELTAS = """
deltas AS (
  SELECT name, ts, value, CAST(epoch(ts) AS BIGINT) AS t,
    CASE WHEN lag(value) OVER w IS NULL THEN 0.0
         WHEN value < lag(value) OVER w THEN value
         ELSE value - lag(value) OVER w END AS delta
  FROM metric_samples WINDOW w AS (PARTITION BY name ORDER BY ts)
)"""


def _inc(range_s: int) -> str:
    return f"sum(delta) OVER (PARTITION BY name ORDER BY t RANGE BETWEEN {range_s - 1} PRECEDING AND CURRENT ROW)"


COUNTERS = """
per_hour AS (
  SELECT date_trunc('hour', ts) AS ts, count(*) AS stream_events_in_total,
    count(*) FILTER (WHERE topic = 'anomalies') AS stream_events_anomaly_total,
    count(*) FILTER (WHERE topic = 'metrics') AS stream_events_normal_total,
    count(*) FILTER (WHERE topic = 'dead-letter') AS stream_events_dlq_total
  FROM scored GROUP BY 1
),
counters AS (
  SELECT ts, name, 'counter' AS kind,
    CAST(sum(n) OVER (PARTITION BY name ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DOUBLE) AS value
  FROM (UNPIVOT per_hour ON stream_events_in_total, stream_events_anomaly_total, stream_events_normal_total,
        stream_events_dlq_total INTO NAME name VALUE n) u
)"""


FB_METRICS = f"""
fb_agg AS (
  SELECT max(t.ts) AS ts, CAST(count(*) AS DOUBLE) AS r, CAST(count(*) FILTER (WHERE a.accepted) AS DOUBLE) AS a
  FROM fba a JOIN feedback_text t ON a.event_id = t.event_id
),
all_metrics AS (
  SELECT ts, name, kind, value FROM counters
  UNION ALL SELECT ts, 'online_feedback_received_total', 'counter', r FROM fb_agg
  UNION ALL SELECT ts, 'online_feedback_accepted_total', 'counter', a FROM fb_agg
  UNION ALL SELECT ts, 'online_feedback_skipped_total', 'counter', r - a FROM fb_agg
  UNION ALL SELECT ts, 'online_updater_buffer_size', 'gauge', a % {float(ONLINE_BATCH_SIZE)} FROM fb_agg
)"""


def _alerts_sql() -> str:
    parts = []
    for alert, metric, range_s, op, hold_s, severity, service in ALERT_RULES:
        cond = f"({_inc(range_s)}) > 0" if op == ">" else f"({_inc(range_s)}) = 0"
        parts.append(
            f"SELECT '{alert}' AS alertname, '{severity}' AS severity, '{service}' AS service, {hold_s} AS hold, "
            f"ts, t, {cond} AS c FROM deltas WHERE name = '{metric}'"
        )
    u = " UNION ALL ".join(parts)
    return f"""
SELECT alertname, severity, service, min(ts) AS active_since,
  min(CASE WHEN t - st >= hold THEN ts END) AS fired_at, max(ts) AS last_true
FROM (
  SELECT *, min(t) OVER (PARTITION BY alertname, grp) AS st FROM (
    SELECT *, row_number() OVER (PARTITION BY alertname ORDER BY t) - row_number() OVER (PARTITION BY alertname, c ORDER BY t) AS grp
    FROM ({u}) a
  ) b WHERE c
) i
GROUP BY alertname, severity, service, grp
HAVING min(CASE WHEN t - st >= hold THEN ts END) IS NOT NULL"""


def _events_w(extra: list[str], body: str, more_views: list[str] | None = None) -> str:
    return with_views(["raw_event"] + (more_views or []), [PARSED, EVENT_FEATURES_CTE, _scored_cte(0.5)] + extra, body)


def oracle() -> dict[str, str]:
    budget = f"greatest(1, CAST(round_even(count(*) OVER () * {BUDGET_RATIO!r}, 0) AS BIGINT))"
    readiness = f"""
SELECT 'demo_has_anomalies' AS "check", (SELECT count(*) FROM scored WHERE topic = 'anomalies') >= 1 AS ok
UNION ALL SELECT 'demo_has_feedback', (SELECT count(*) FROM scored s JOIN fbv v ON CAST(s.event_id AS VARCHAR) = v.anomaly_id
                                        WHERE s.topic = 'anomalies' AND v.status = 'accepted') >= 1
UNION ALL SELECT 'demo_online_updated', (SELECT count(*) FROM scored s JOIN fbv v ON CAST(s.event_id AS VARCHAR) = v.anomaly_id
    JOIN fba a ON a.event_id = v.event_id WHERE s.topic = 'anomalies' AND v.status = 'accepted' AND a.accepted) >= 1
UNION ALL SELECT 'benchmark_latency_slo_met', (SELECT round(quantile_cont(g, 0.95), 6) FROM (
    SELECT (epoch_us(ts) - lag(epoch_us(ts)) OVER (ORDER BY ts, event_id)) / 1000.0 AS g FROM events) z WHERE g IS NOT NULL) <= {LATENCY_SLO_MS}
UNION ALL SELECT 'benchmark_quality_fields_present', (SELECT count(*) FROM (SELECT {budget} AS k FROM dscored) q) > 0"""
    readiness_all = f"""
SELECT * FROM r UNION ALL SELECT 'overall_ok', bool_and(ok) FROM r"""
    return {
        "stream_counters": _events_w([COUNTERS], "SELECT ts, name, kind, value FROM counters"),
        "metrics_exposition": _events_w([COUNTERS, FO.FB_PARSED, FO.ACCEPT, FB_METRICS], """
SELECT r * 2 AS line_no, '# TYPE ' || name || ' ' || kind AS line FROM (
  SELECT name, kind, value, row_number() OVER (ORDER BY CASE WHEN kind = 'counter' THEN 0 ELSE 1 END, name) - 1 AS r
  FROM (SELECT name, kind, max_by(value, ts) AS value FROM all_metrics GROUP BY name, kind) a) b
UNION ALL
SELECT r * 2 + 1, name || ' ' || CASE WHEN value = floor(value) AND abs(value) < 1e16
                                      THEN CAST(CAST(value AS BIGINT) AS VARCHAR) || '.0' ELSE CAST(value AS VARCHAR) END FROM (
  SELECT name, kind, value, row_number() OVER (ORDER BY CASE WHEN kind = 'counter' THEN 0 ELSE 1 END, name) - 1 AS r
  FROM (SELECT name, kind, max_by(value, ts) AS value FROM all_metrics GROUP BY name, kind) a) b""", ["feedback_text"]),
        "event_rate_sliding": with_views(["metric_samples"], [DELTAS], f"""
SELECT name, ts, round({_inc(RATE_RANGE_S)}, {R}) AS increase_5m,
  round({_inc(RATE_RANGE_S)} / {float(RATE_RANGE_S)}, {R}) AS rate_per_s FROM deltas"""),
        "counter_increase": with_views(["metric_samples"], [DELTAS], f"""
SELECT name, ts, round({_inc(INCREASE_RANGE_S)}, {R}) AS increase_1h FROM deltas"""),
        "anomaly_ratio_window": with_views(["metric_samples"], [DELTAS], f"""
SELECT a.ts, round(a.r / greatest(b.r, 1e-9), {R}) AS ratio
FROM (SELECT ts, {_inc(RATE_RANGE_S)} / {float(RATE_RANGE_S)} AS r, name FROM deltas) a
JOIN (SELECT ts, {_inc(RATE_RANGE_S)} / {float(RATE_RANGE_S)} AS r, name FROM deltas) b ON a.ts = b.ts
WHERE a.name = 'stream_events_anomaly_total' AND b.name = 'stream_events_in_total'"""),
        "alerts_fired": with_views(["metric_samples"], [DELTAS], _alerts_sql()),
        "readiness_gate": with_views(
            ["raw_event", "feedback_text"],
            [PARSED, EVENT_FEATURES_CTE, _scored_cte(0.5), FO.FB_PARSED, FO.VALIDATED, FO.ACCEPT,
             TABLE_FEATURES_CTE, _demo_cte(), "r AS (" + readiness + ")"],
            readiness_all,
        ),
    }
