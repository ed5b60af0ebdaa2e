"""DuckDB twins of the adapter views (see riskflow.sources.adapters).

Each oracle query is ``WITH <views needed> <query>``; the driver registers the
parquet tables (``events`` ...) as views, so these CTEs read the same data.
"""

from __future__ import annotations

TXN = """
txn AS (
  SELECT
    event_id,
    ts,
    CAST(1 + floor((epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01 00:00:00')) / 3600000000) AS INTEGER) AS step,
    ttype AS type,
    value AS amount,
    'C' || CAST(user_id AS VARCHAR) AS nameOrig,
    old AS oldbalanceOrg,
    greatest(old - value, 0.0) AS newbalanceOrig,
    'M' || CAST(event_id % 97 AS VARCHAR) AS nameDest,
    0.0 AS oldbalanceDest,
    value AS newbalanceDest,
    CASE WHEN ttype IN ('TRANSFER', 'CASH_OUT') AND value > 200.0 THEN 1 ELSE 0 END AS isFraud,
    0 AS isFlaggedFraud
  FROM (
    SELECT *,
      CASE event_type WHEN 'purchase' THEN 'PAYMENT' WHEN 'click' THEN 'CASH_IN' WHEN 'view' THEN 'DEBIT'
                      WHEN 'signup' THEN 'TRANSFER' ELSE 'CASH_OUT' END AS ttype,
      10.0 * CAST(json_extract_string(props, '$.k') AS DOUBLE) AS old
    FROM events
  ) t0
)"""

RAW_EVENT = """
raw_event AS (
  SELECT event_id, ts,
    CASE
      WHEN m = 5 THEN '{bad json}'
      WHEN m = 11 THEN '[' || body || ']'
      WHEN m = 14 THEN body || ' x'
      ELSE body
    END AS raw
  FROM (
    SELECT event_id, ts, m,
      '{' || concat_ws(',',
        '"event_id":"' || CAST(event_id AS VARCHAR) || '"',
        CASE WHEN m <> 17 THEN '"timestamp":' ||
          CASE WHEN m = 3 THEN CAST(event_id AS VARCHAR)
               WHEN m = 7 THEN '"not-a-date"'
               WHEN m = 15 THEN '"' || strftime(ts, '%Y-%m-%dT%H:%M:%S') || '+05:00"'
               ELSE '"' || strftime(ts, '%Y-%m-%dT%H:%M:%S') || 'Z"' END END,
        CASE WHEN m <> 1 THEN '"user_id":' ||
          CASE WHEN m = 6 THEN '""' WHEN m = 12 THEN 'null'
               ELSE '"C' || CAST(user_id AS VARCHAR) || '"' END END,
        '"type":' || CASE WHEN m = 2 THEN '"WIRE"' WHEN m = 13 THEN '"CASH_OUT"'
                          ELSE '"' || replace(ttype, '_', '-') || '"' END,
        '"amount":' || CASE WHEN m = 4 THEN '-' || amt_s WHEN m = 9 THEN '"' || amt_s || '"'
                            WHEN m = 10 THEN 'true' ELSE amt_s END,
        '"old_balance_orig":' || CAST(old AS VARCHAR),
        CASE WHEN m <> 17 THEN '"new_balance_orig":' || CAST(greatest(old - amt, CAST(0 AS DECIMAL(18,2))) AS VARCHAR) END,
        CASE WHEN m IN (7, 8) THEN '"is_fraud":1,"isFraud":1,"label":"fraud"' END,
        CASE WHEN m = 16 THEN '"amount":' || amt_s END,
        CASE WHEN m = 18 THEN '"channel":"web","device":{"os":"x","n":5},"risk":2,"features":"own"' END
      ) || '}' AS body
    FROM (
      SELECT event_id, ts, user_id, event_id % 50 AS m,
        CAST(value AS DECIMAL(18,2)) AS amt,
        CAST(CAST(value AS DECIMAL(18,2)) AS VARCHAR) AS amt_s,
        CAST(CAST(json_extract_string(props, '$.k') AS BIGINT) * 10 AS DECIMAL(18,2)) AS old,
        CASE event_type WHEN 'purchase' THEN 'PAYMENT' WHEN 'click' THEN 'CASH_IN' WHEN 'view' THEN 'DEBIT'
                        WHEN 'signup' THEN 'TRANSFER' ELSE 'CASH_OUT' END AS ttype
      FROM events
    ) b0
  ) b1
)"""

FEEDBACK_TEXT = """
feedback_text AS (
  SELECT event_id, ts,
    CASE WHEN m = 9 THEN '[' WHEN m = 10 THEN '{' ELSE '' END || '{' || concat_ws(',',
      '"anomaly_id":"' || CAST(event_id AS VARCHAR) || '"',
      CASE WHEN m <> 11 THEN '"label":"' || CASE WHEN m = 1 THEN 'maybe'
                          WHEN isFraud = 1 OR event_id % 10 = 0 THEN 'true_positive'
                          ELSE 'false_positive' END || '"' END,
      '"analyst_id":' || CASE WHEN m = 8 THEN '""' ELSE '"a' || CAST(event_id % 5 AS VARCHAR) || '"' END,
      '"features":' || CASE WHEN m = 2 THEN 'null' ELSE '{' || concat_ws(',',
          '"amount":' || CASE WHEN m = 4 THEN '"' || CAST(amt AS VARCHAR) || '"'
                              WHEN m = 12 THEN '"' || CAST(amt AS VARCHAR) || 'd"' ELSE CAST(amt AS VARCHAR) END,
          '"amount_ratio":' || CAST(CAST(round(amount / (oldbalanceOrg + 1.0), 6) AS DECIMAL(24,6)) AS VARCHAR),
          '"balance_diff_orig":' || CAST(old - greatest(old - amt, CAST(0 AS DECIMAL(18,2))) - amt AS VARCHAR),
          '"is_transfer":' || CASE WHEN m = 6 THEN CASE WHEN type = 'TRANSFER' THEN 'true' ELSE 'false' END
                                   ELSE CASE WHEN type = 'TRANSFER' THEN '1' ELSE '0' END END,
          '"is_cashout":' || CASE WHEN type IN ('CASH-OUT', 'CASH_OUT') THEN '1' ELSE '0' END,
          '"hour_of_day":' || CASE WHEN m = 5 THEN 'null' ELSE CAST(step % 24 AS VARCHAR) END,
          CASE WHEN m <> 3 THEN '"txn_velocity_1h":1' END
        ) || '}' END,
      CASE WHEN m = 7 THEN '"priority":"high"' END
    ) || '}' || CASE WHEN m = 9 THEN ']' ELSE '' END AS raw
  FROM (
    SELECT *, event_id % 23 AS m, CAST(amount AS DECIMAL(18,2)) AS amt,
           CAST(oldbalanceOrg AS DECIMAL(18,2)) AS old
    FROM txn
  ) f0
)"""

METRIC_SAMPLES = """
metric_counts AS (
  SELECT name, day, bucket_end AS ts, count(*) AS n
  FROM (
    SELECT
      CASE event_type WHEN 'purchase' THEN 'stream_events_in_total'
                      WHEN 'click' THEN 'online_consumer_messages_total'
                      WHEN 'view' THEN 'stream_events_anomaly_total'
                      WHEN 'signup' THEN 'promotion_fail_total'
                      WHEN 'error' THEN 'feedback_publish_errors_total' END AS name,
      CAST(CAST(ts AS DATE) AS TIMESTAMP) AS day,
      make_timestamp(CAST((floor(epoch_us(ts) / 300000000) + 1) * 300000000 AS BIGINT)) AS bucket_end
    FROM events
  ) e
  WHERE name IS NOT NULL
  GROUP BY 1, 2, 3
),
metric_grid AS (
  SELECT name, day, unnest(generate_series(day, day + INTERVAL 1435 MINUTE, INTERVAL 5 MINUTE)) AS ts
  FROM (SELECT DISTINCT name, day FROM metric_counts) d
),
metric_samples AS (
  SELECT g.ts, g.name, 'counter' AS kind,
         CAST(sum(coalesce(c.n, 0)) OVER (PARTITION BY g.name, g.day ORDER BY g.ts
              ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DOUBLE) AS value
  FROM metric_grid g LEFT JOIN metric_counts c ON g.name = c.name AND g.day = c.day AND g.ts = c.ts
)"""

VIEWS = {
    "txn": (TXN, []),
    "raw_event": (RAW_EVENT, []),
    "feedback_text": (FEEDBACK_TEXT, ["txn"]),
    "metric_samples": (METRIC_SAMPLES, []),
}


def with_views(names: list[str], extra_ctes: list[str], body: str) -> str:
    """Build ``WITH`` + the requested adapter views (dependencies first) + extra CTEs + body."""
    ordered: list[str] = []

    def add(n: str) -> None:
        if n in ordered:
            return
        for dep in VIEWS[n][1]:
            add(dep)
        ordered.append(n)

    for n in names:
        add(n)
    ctes = [VIEWS[n][0].strip() for n in ordered] + [c.strip() for c in extra_ctes]
    if not ctes:
        return body.strip()
    return "WITH " + ",\n".join(ctes) + "\n" + body.strip()
