"""DuckDB oracle SQL for the streaming queries (the batch result they must equal)."""

from __future__ import annotations

from riskflow.contract import ONLINE_BATCH_SIZE
from riskflow.plans import events_oracle
from riskflow.plans import feedback_oracle as FO
from riskflow.plans.oracle_rules import iso_valid_sql
from riskflow.plans.oracle_views import with_views
from riskflow.plans.stream_queries import PIECES


def oracle() -> dict[str, str]:
    # micro-batches are id ranges; an hour is closed once it ends an hour before the latest event of the batches before
    arrived = f"""
arrived AS (
  SELECT event_id, user_id, epoch(TRY_CAST(timestamp AS TIMESTAMPTZ)) AS et,
    floor(epoch(TRY_CAST(timestamp AS TIMESTAMPTZ)) / 3600) AS hour, event_id * {PIECES} // (SELECT max(event_id) + 1 FROM events) AS batch_id
  FROM parsed WHERE error IS NULL AND {iso_valid_sql('timestamp')} AND TRY_CAST(timestamp AS TIMESTAMPTZ) IS NOT NULL
),
marks AS (
  SELECT batch_id, max(max(et)) OVER (ORDER BY batch_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - 3600 AS mark
  FROM arrived GROUP BY batch_id
),
judged AS (
  SELECT a.*, coalesce((a.hour + 1) * 3600 <= m.mark, false) AS late FROM arrived a JOIN marks m USING (batch_id)
),
velocities AS (
  SELECT event_id, user_id, CAST(row_number() OVER (PARTITION BY user_id, hour ORDER BY event_id) AS INTEGER) AS txn_velocity_1h
  FROM judged WHERE NOT late
)"""
    b = ONLINE_BATCH_SIZE
    # messages are sent on the day of their id's last digit, and read from the third day on
    sent = f"""
routed_messages AS (
  SELECT event_id, event_id * {PIECES} // (SELECT max(event_id) + 1 FROM events) AS batch_id, event_id % 50 = 19 AS bytes_replaced,
    CASE WHEN event_id % 50 = 19 THEN 'Invalid JSON payload' ELSE error END AS error,
    CASE WHEN event_id % 50 = 19 OR error IS NOT NULL THEN 'payments-refused'
         WHEN ensemble_score >= 0.6 THEN 'payments-alerts' ELSE 'payments-passed' END AS topic
  FROM scored WHERE event_id % 10 >= 2
),
batch_counts AS (
  SELECT batch_id, count(*) AS stream_events_in_total, 0 AS stream_events_valid_total,
    count(*) FILTER (WHERE topic = 'payments-alerts') AS stream_events_anomaly_total,
    count(*) FILTER (WHERE topic = 'payments-passed') AS stream_events_normal_total,
    count(*) FILTER (WHERE topic = 'payments-refused') AS stream_events_dlq_total
  FROM routed_messages GROUP BY batch_id
)"""
    scored = [events_oracle.PARSED, events_oracle.FEATURES_CTE, events_oracle._scored_cte(0.5), sent]
    full = f"count(*) FILTER (WHERE accepted) % {b} = 0"
    return {
        "payload_routing": with_views(["raw_event"], scored, "SELECT event_id, topic, error, bytes_replaced FROM routed_messages"),
        "stream_metrics": with_views(["raw_event"], scored, """
SELECT batch_id, name, 'counter' AS kind, CAST(sum(n) OVER (PARTITION BY name ORDER BY batch_id) AS DOUBLE) AS value
FROM (UNPIVOT batch_counts ON COLUMNS(* EXCLUDE (batch_id)) INTO NAME name VALUE n) u"""),
        "feedback_loop_metrics": with_views(["feedback_text"], [FO.FB_PARSED, FO.ACCEPT, f"""
loop AS (
  SELECT CAST(count(*) AS DOUBLE) AS messages, CAST(count(*) FILTER (WHERE accepted) AS DOUBLE) AS accepted,
    CAST((count(*) FILTER (WHERE accepted) + {b - 1}) // {b} AS DOUBLE) AS updates,
    CAST(CASE WHEN {full} THEN least(count(*) FILTER (WHERE accepted), {b}) ELSE count(*) FILTER (WHERE accepted) % {b} END AS DOUBLE) AS last_size
  FROM fba
)"""], """
SELECT unnest(['online_consumer_messages_total', 'online_feedback_received_total', 'online_feedback_accepted_total',
    'online_feedback_skipped_total', 'online_updates_total', 'promotions_judged', 'online_updater_buffer_size',
    'online_last_update_batch_size']) AS name,
  unnest(['counter', 'counter', 'counter', 'counter', 'counter', 'counter', 'gauge', 'gauge']) AS kind,
  unnest([messages, messages, accepted, messages - accepted, updates, updates, 0.0, last_size]) AS value
FROM loop"""),
        "feedback_loop_counts": with_views(["feedback_text"], [FO.FB_PARSED, FO.ACCEPT], f"""
SELECT count(*) AS messages_seen, count(*) FILTER (WHERE accepted) AS accepted,
  count(*) FILTER (WHERE NOT accepted) AS skipped,
  CAST((count(*) FILTER (WHERE accepted) + {b - 1}) // {b} AS BIGINT) AS updates,
  CASE WHEN count(*) FILTER (WHERE accepted) % {b} = 0 THEN least(count(*) FILTER (WHERE accepted), {b})
       ELSE count(*) FILTER (WHERE accepted) % {b} END AS last_batch_size
FROM fba"""),
        "stream_scoring": events_oracle.oracle()["event_routing"],
        "stream_scoring_velocity": with_views(
            ["raw_event"], [events_oracle.PARSED, arrived, events_oracle.FEATURES_CTE, events_oracle._scored_cte(0.5)], """
SELECT s.event_id, s.topic, CASE WHEN s.topic <> 'dead-letter' THEN coalesce(v.txn_velocity_1h, 1) END AS txn_velocity_1h
FROM scored s LEFT JOIN velocities v USING (event_id)"""),
        "stream_velocity": with_views(["raw_event"], [events_oracle.PARSED, arrived], "SELECT event_id, user_id, txn_velocity_1h FROM velocities"),
        "stream_velocity_batches": with_views(["raw_event"], [events_oracle.PARSED, arrived], """
SELECT batch_id, count(*) AS rows, count(*) FILTER (WHERE late) AS late FROM judged GROUP BY batch_id"""),
    }
