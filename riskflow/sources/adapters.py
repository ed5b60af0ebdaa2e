"""Adapter views: the driver's `events` table seen as payment data.

The driver ships no payments table, so `events(event_id, ts, user_id,
event_type, value, props)` is mapped onto the shapes the engine works on:

* ``txn``            transaction table (11 columns + ingest key ``event_id`` and ``ts``)
* ``raw_event``      JSON text per event, with one corruption family per ``event_id % 50``
* ``feedback_text``  analyst feedback JSON per transaction, corruptions per ``event_id % 23``
* ``metric_samples`` cumulative counters sampled every 5 minutes, reset at midnight

All of them are narrow projections (no shuffle) except ``metric_samples``,
which aggregates to a fixed 5-minute grid.  The same definitions are written
in DuckDB SQL in :mod:`riskflow.plans.oracle` for the correctness gate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed mapping event_type -> transaction type (anything else is CASH_OUT).
TYPE_MAP = [("purchase", "PAYMENT"), ("click", "CASH_IN"), ("view", "DEBIT"), ("signup", "TRANSFER")]
# Fixed mapping event_type -> counter name for metric samples.
COUNTER_MAP = [
    ("purchase", "stream_events_in_total"),
    ("click", "online_consumer_messages_total"),
    ("view", "stream_events_anomaly_total"),
    ("signup", "promotion_fail_total"),
    ("error", "feedback_publish_errors_total"),
]
FRAUD_AMOUNT = 200.0
SAMPLE_MINUTES = 5


def _case(col: Column, pairs, default) -> Column:
    out = None
    for k, v in pairs:
        out = F.when(col == k, F.lit(v)) if out is None else out.when(col == k, F.lit(v))
    return out.otherwise(F.lit(default) if not isinstance(default, Column) else default)


def step_of(ts: Column) -> Column:
    """Hour counter: 1 + whole hours since 2024-01-01 (floor)."""
    micros = F.timestamp_diff("MICROSECOND", F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"), ts)
    return (F.floor(micros / F.lit(3_600_000_000)) + 1).cast("int")


def txn(events: DataFrame) -> DataFrame:
    """Transaction table view over `events` (pure projection)."""
    k = F.get_json_object("props", "$.k").cast("double")
    ttype = _case(F.col("event_type"), TYPE_MAP, "CASH_OUT")
    old = F.lit(10.0) * k
    return events.select(
        "event_id",
        "ts",
        step_of(F.col("ts")).alias("step"),
        ttype.alias("type"),
        F.col("value").alias("amount"),
        F.concat(F.lit("C"), F.col("user_id").cast("string")).alias("nameOrig"),
        old.alias("oldbalanceOrg"),
        F.greatest(old - F.col("value"), F.lit(0.0)).alias("newbalanceOrig"),
        F.concat(F.lit("M"), (F.col("event_id") % 97).cast("string")).alias("nameDest"),
        F.lit(0.0).alias("oldbalanceDest"),
        F.col("value").alias("newbalanceDest"),
        F.when(ttype.isin("TRANSFER", "CASH_OUT") & (F.col("value") > FRAUD_AMOUNT), 1).otherwise(0).alias("isFraud"),
        F.lit(0).alias("isFlaggedFraud"),
    )


def _type_case_sql(col: str) -> str:
    whens = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in TYPE_MAP)
    return f"CASE {col} {whens} ELSE 'CASH_OUT' END"


def raw_event(events: DataFrame) -> DataFrame:
    """One JSON text per event; ``event_id % 50`` selects a corruption family (SQL text, one projection)."""
    base = events.selectExpr(
        "event_id", "ts", "user_id", "event_id % 50 AS m",
        "CAST(CAST(value AS DECIMAL(18,2)) AS STRING) AS amt_s",
        "CAST(value AS DECIMAL(18,2)) AS amt",
        "CAST(CAST(get_json_object(props, '$.k') AS BIGINT) * 10 AS DECIMAL(18,2)) AS old",
        f"replace({_type_case_sql('event_type')}, '_', '-') AS ttype",
        "date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss\") AS ts_text",
    )
    body = """concat('{', concat_ws(',',
        concat('"event_id":"', CAST(event_id AS STRING), '"'),
        CASE WHEN m <> 17 THEN concat('"timestamp":',
          CASE WHEN m = 3 THEN CAST(event_id AS STRING)
               WHEN m = 7 THEN '"not-a-date"'
               WHEN m = 15 THEN concat('"', ts_text, '+05:00"')
               ELSE concat('"', ts_text, 'Z"') END) END,
        CASE WHEN m <> 1 THEN concat('"user_id":',
          CASE WHEN m = 6 THEN '""' WHEN m = 12 THEN 'null'
               ELSE concat('"C', CAST(user_id AS STRING), '"') END) END,
        concat('"type":', CASE WHEN m = 2 THEN '"WIRE"' WHEN m = 13 THEN '"CASH_OUT"'
                               ELSE concat('"', ttype, '"') END),
        concat('"amount":', CASE WHEN m = 4 THEN concat('-', amt_s) WHEN m = 9 THEN concat('"', amt_s, '"')
                                 WHEN m = 10 THEN 'true' ELSE amt_s END),
        concat('"old_balance_orig":', CAST(old AS STRING)),
        CASE WHEN m <> 17 THEN concat('"new_balance_orig":',
          CAST(greatest(old - amt, CAST(0 AS DECIMAL(18,2))) AS STRING)) END,
        CASE WHEN m IN (7, 8) THEN '"is_fraud":1,"isFraud":1,"label":"fraud"' END,
        CASE WHEN m = 16 THEN concat('"amount":', amt_s) END,
        CASE WHEN m = 18 THEN '"channel":"web","device":{"os":"x","n":5},"risk":2,"features":"own"' END
      ), '}')"""
    raw = f"""CASE WHEN m = 5 THEN '{{bad json}}'
                   WHEN m = 11 THEN concat('[', {body}, ']')
                   WHEN m = 14 THEN concat({body}, ' x')
                   ELSE {body} END AS raw"""
    return base.selectExpr("event_id", "ts", raw)


def feedback_text(events: DataFrame) -> DataFrame:
    """Analyst feedback JSON per transaction; ``event_id % 23`` picks a corruption (SQL text)."""
    t = txn(events).selectExpr(
        "*", "event_id % 23 AS m", "CAST(amount AS DECIMAL(18,2)) AS amt", "CAST(oldbalanceOrg AS DECIMAL(18,2)) AS old",
    )
    features = """concat('{', concat_ws(',',
        concat('"amount":', CASE WHEN m = 4 THEN concat('"', CAST(amt AS STRING), '"')
                                 WHEN m = 12 THEN concat('"', CAST(amt AS STRING), 'd"') ELSE CAST(amt AS STRING) END),
        concat('"amount_ratio":', CAST(CAST(round(amount / (oldbalanceOrg + 1.0), 6) AS DECIMAL(24,6)) AS STRING)),
        concat('"balance_diff_orig":', CAST(old - greatest(old - amt, CAST(0 AS DECIMAL(18,2))) - amt AS STRING)),
        concat('"is_transfer":', CASE WHEN m = 6 THEN CASE WHEN type = 'TRANSFER' THEN 'true' ELSE 'false' END
                                      ELSE CASE WHEN type = 'TRANSFER' THEN '1' ELSE '0' END END),
        concat('"is_cashout":', CASE WHEN type IN ('CASH-OUT', 'CASH_OUT') THEN '1' ELSE '0' END),
        concat('"hour_of_day":', CASE WHEN m = 5 THEN 'null' ELSE CAST(step % 24 AS STRING) END),
        CASE WHEN m <> 3 THEN '"txn_velocity_1h":1' END
      ), '}')"""
    body = f"""concat(CASE WHEN m = 9 THEN '[' WHEN m = 10 THEN '{{' ELSE '' END, '{{', concat_ws(',',
        concat('"anomaly_id":"', CAST(event_id AS STRING), '"'),
        CASE WHEN m <> 11 THEN concat('"label":"', CASE WHEN m = 1 THEN 'maybe'
                                 WHEN isFraud = 1 OR event_id % 10 = 0 THEN 'true_positive'
                                 ELSE 'false_positive' END, '"') END,
        concat('"analyst_id":', CASE WHEN m = 8 THEN '""' ELSE concat('"a', CAST(event_id % 5 AS STRING), '"') END),
        concat('"features":', CASE WHEN m = 2 THEN 'null' ELSE {features} END),
        CASE WHEN m = 7 THEN '"priority":"high"' END
      ), '}}', CASE WHEN m = 9 THEN ']' ELSE '' END) AS raw"""
    return t.selectExpr("event_id", "ts", body)


def metric_samples(events: DataFrame) -> DataFrame:
    """Counter samples every 5 minutes, per counter and day, restarted at midnight.

    The grid is generated per (name, day) present in the data with
    ``sequence``; event counts are pre-aggregated per 5-minute bucket before
    the join, so the shuffle carries buckets, not events.
    """
    name = _case(F.col("event_type"), COUNTER_MAP, None)
    step_us = SAMPLE_MINUTES * 60 * 1_000_000
    e = events.select(name.alias("name"), "ts").where(F.col("name").isNotNull())
    day = F.to_date("ts").cast("timestamp_ntz")
    us = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col("ts"))
    bucket_end_us = (F.floor(us / F.lit(step_us)) + 1) * F.lit(step_us)
    counts = (
        e.select("name", day.alias("day"), F.timestamp_micros(bucket_end_us).cast("timestamp_ntz").alias("ts"))
        .groupBy("name", "day", "ts")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    grid = (
        counts.select("name", "day").distinct()
        .select(
            "name",
            "day",
            F.explode(
                F.sequence(
                    F.col("day"),
                    F.col("day") + F.expr(f"INTERVAL {24 * 60 - SAMPLE_MINUTES} MINUTES"),
                    F.expr(f"INTERVAL {SAMPLE_MINUTES} MINUTES"),
                )
            ).alias("ts"),
        )
    )
    from pyspark.sql import Window

    w = Window.partitionBy("name", "day").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    return (
        grid.join(counts, ["name", "day", "ts"], "left")
        .select(
            "ts",
            "name",
            F.lit("counter").alias("kind"),
            F.sum(F.coalesce(F.col("n"), F.lit(0))).over(w).cast("double").alias("value"),
        )
    )
