"""Monitoring as data (O1-O6): counters, exposition text, rates, ratios, alerts.

Metric series are keyed by name; windows run per name over time-ordered
samples, so their size grows with the time span, not with the event volume
(events are reduced to per-interval counts before any window).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskflow.contract import ALERT_RULES, TOPIC_ANOMALY, TOPIC_DLQ, TOPIC_NORMAL

EPOCH_TEXT = "1970-01-01 00:00:00"

# Fixed names of the event-flow counters, by topic.
TOPIC_COUNTERS = [
    ("stream_events_in_total", None),
    ("stream_events_anomaly_total", TOPIC_ANOMALY),
    ("stream_events_normal_total", TOPIC_NORMAL),
    ("stream_events_dlq_total", TOPIC_DLQ),
]


def seconds(ts: Column) -> Column:
    return F.timestamp_diff("SECOND", F.lit(EPOCH_TEXT).cast("timestamp_ntz"), ts)


def stream_counters(routed: DataFrame, ts_col: str = "ts", unit: str = "hour") -> DataFrame:
    """O1: cumulative counters per time unit (ts, name, kind, value) from routed events.

    Events are reduced to one row per unit with conditional counts (partial
    aggregation), unpivoted, then summed cumulatively per counter name.
    """
    per = routed.groupBy(F.date_trunc(unit, F.col(ts_col)).alias("ts")).agg(
        *[
            (F.count(F.lit(1)) if topic is None else F.count_if(F.col("topic") == topic)).alias(name)
            for name, topic in TOPIC_COUNTERS
        ]
    )
    names = [n for n, _ in TOPIC_COUNTERS]
    long = per.select("ts", F.explode(F.map_from_arrays(F.array(*[F.lit(n) for n in names]),
                                                        F.array(*[F.col(n) for n in names]))).alias("name", "n"))
    w = Window.partitionBy("name").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    return long.select("ts", "name", F.lit("counter").alias("kind"), F.sum("n").over(w).cast("double").alias("value"))


def py_float_text(v: Column) -> Column:
    """Python's repr of a float for counter values (integral values print as N.0)."""
    integral = (v == F.floor(v)) & (F.abs(v) < F.lit(1e16))
    return F.when(integral, F.concat(v.cast("long").cast("string"), F.lit(".0"))).otherwise(v.cast("string"))


def exposition(samples: DataFrame) -> DataFrame:
    """O2: latest value per metric -> '# TYPE name kind' and 'name value' lines.

    Counters first, then gauges, each sorted by name; one row per line.
    """
    latest = samples.groupBy("name", "kind").agg(F.max_by("value", "ts").alias("value"))
    order = Window.orderBy(F.when(F.col("kind") == "counter", 0).otherwise(1), "name")  # one row per metric
    ranked = latest.withColumn("_r", F.row_number().over(order) - 1)
    lines = ranked.select(
        "_r",
        F.posexplode(F.array(
            F.concat(F.lit("# TYPE "), F.col("name"), F.lit(" "), F.col("kind")),
            F.concat(F.col("name"), F.lit(" "), py_float_text(F.col("value"))),
        )).alias("_p", "line"),
    )
    return lines.select((F.col("_r") * 2 + F.col("_p")).alias("line_no"), "line")


def with_deltas(samples: DataFrame) -> DataFrame:
    """Per-sample counter increase with reset handling (O5): v - prev, or v after a reset."""
    w = Window.partitionBy("name").orderBy("ts")
    prev = F.lag("value").over(w)
    delta = F.when(prev.isNull(), F.lit(0.0)).when(F.col("value") < prev, F.col("value")).otherwise(F.col("value") - prev)
    return samples.select("*", delta.alias("delta"), seconds(F.col("ts")).alias("_t"))


def increase(range_s: int) -> Column:
    """Sum of deltas of the samples in (t - range, t] (no extrapolation at the edges)."""
    w = Window.partitionBy("name").orderBy("_t").rangeBetween(-(range_s - 1), 0)
    return F.sum("delta").over(w)


def rates(samples: DataFrame, range_s: int) -> DataFrame:
    """O3: increase and per-second rate over a sliding range ending at each sample."""
    d = with_deltas(samples)
    inc = increase(range_s)
    return d.select("name", "ts", inc.alias("increase"), (inc / F.lit(float(range_s))).alias("rate_per_s"))


def ratio(samples: DataFrame, num_name: str, den_name: str, range_s: int) -> DataFrame:
    """rate(num) / clamp_min(rate(den), 1e-9) at each common sample time.

    Both series come from one pass; a series has one sample a time.
    """
    r = rates(samples.where(F.col("name").isin(num_name, den_name)), range_s)
    both = r.groupBy("ts").agg(
        F.max(F.when(F.col("name") == num_name, F.col("rate_per_s"))).alias("_num"),
        F.max(F.when(F.col("name") == den_name, F.col("rate_per_s"))).alias("_den"),
    ).where("_num is not null and _den is not null")
    return both.select("ts", (F.col("_num") / F.greatest(F.col("_den"), F.lit(1e-9))).alias("ratio"))


def alerts(samples: DataFrame, rules=ALERT_RULES) -> DataFrame:
    """Alert episodes: condition true on consecutive samples for at least the hold time.

    Gaps-and-islands per rule: island = run of consecutive true samples; the
    alert fires at the first sample whose distance to the island start
    reaches the hold time (evaluation happens at sample times).

    The samples are read once: the increases of all ranges share one window
    partitioning, and each sample then meets the rules of its metric.
    """
    d = with_deltas(samples.where(F.col("name").isin(sorted({r[1] for r in rules}))))
    d = d.select("name", "ts", "_t", *[increase(s).alias(f"_inc_{s}") for s in sorted({r[2] for r in rules})])
    met = []
    for alert, metric, range_s, op, hold_s, severity, service in rules:
        inc = F.col(f"_inc_{range_s}")
        met.append(F.struct(
            F.lit(metric).alias("_metric"), F.lit(alert).alias("alertname"), F.lit(severity).alias("severity"),
            F.lit(service).alias("service"), F.lit(hold_s).alias("_hold"), ((inc > 0) if op == ">" else (inc == 0)).alias("_cond"),
        ))
    u = d.select("name", "ts", "_t", F.inline(F.array(*met))).where("name = _metric").drop("name", "_metric")
    w_all = Window.partitionBy("alertname").orderBy("_t")
    w_cond = Window.partitionBy("alertname", "_cond").orderBy("_t")
    g = u.withColumn("_grp", F.row_number().over(w_all) - F.row_number().over(w_cond)).where("_cond")
    w_isl = Window.partitionBy("alertname", "_grp")
    g = g.withColumn("_start", F.min("_t").over(w_isl))
    isl = g.groupBy("alertname", "severity", "service", "_grp").agg(
        F.min("ts").alias("active_since"),
        F.min(F.when(F.col("_t") - F.col("_start") >= F.col("_hold"), F.col("ts"))).alias("fired_at"),
        F.max("ts").alias("last_true"),
    )
    return isl.where(F.col("fired_at").isNotNull()).drop("_grp")


def feedback_metrics(accepted: DataFrame, batch_size: int, ts_col: str = "ts") -> DataFrame:
    """O1 for the learning loop: received / accepted / skipped counters and the
    pending-buffer gauge (accepted rows not yet in a full batch), one aggregation."""
    a = accepted.agg(
        F.max(ts_col).alias("ts"),
        F.count(F.lit(1)).cast("double").alias("r"),
        F.count_if("accepted").cast("double").alias("a"),
    )
    rows = F.array(
        F.struct(F.lit("online_feedback_received_total").alias("name"), F.lit("counter").alias("kind"), F.col("r").alias("value")),
        F.struct(F.lit("online_feedback_accepted_total").alias("name"), F.lit("counter").alias("kind"), F.col("a").alias("value")),
        F.struct(F.lit("online_feedback_skipped_total").alias("name"), F.lit("counter").alias("kind"),
                 (F.col("r") - F.col("a")).alias("value")),
        F.struct(F.lit("online_updater_buffer_size").alias("name"), F.lit("gauge").alias("kind"),
                 (F.col("a") % F.lit(float(batch_size))).alias("value")),
    )
    return a.select("ts", F.inline(rows))
