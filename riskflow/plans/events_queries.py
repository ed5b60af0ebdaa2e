"""Registered queries over the event flow: parse, features, scoring, routing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskflow.contract import TOPIC_ANOMALY, TOPIC_DLQ, TOPIC_NORMAL
from riskflow.functions import features as FX
from riskflow.models.demo import demo_models
from riskflow.operators.events import parse_events, parse_route, route_events, sink_records
from riskflow.sources import adapters
from riskflow.sources.tables import events

BENCH_THRESHOLD = 0.65  # alert threshold of the benchmark run
SCORE_DIGITS = 9


def raw_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapters.raw_event(events(spark, sf_dir))


def routed(spark: SparkSession, sf_dir: str, threshold: float = 0.5) -> DataFrame:
    return route_events(raw_events(spark, sf_dir), demo_models(), threshold=threshold)


def q_parse_route(spark, sf_dir):
    return parse_route(raw_events(spark, sf_dir)).select("event_id", "topic", "error")


def q_parse_valid(spark, sf_dir):
    p = parse_events(raw_events(spark, sf_dir)).where(F.col("error").isNull())
    return p.select(
        "event_id",
        *[F.col(f"event.{c}").alias(c) for c in
          ("timestamp", "user_id", "type", "amount", "old_balance_orig", "new_balance_orig")],
        F.array_join(F.array_sort(F.map_keys("event.extras")), ",").alias("extra_keys"),
    )


def q_dlq_by_error(spark, sf_dir):
    p = parse_events(raw_events(spark, sf_dir)).where(F.col("error").isNotNull())
    return p.groupBy("error").agg(F.count(F.lit(1)).alias("n"))


def q_hour_from_offset(spark, sf_dir):
    p = parse_events(raw_events(spark, sf_dir)).where(F.col("error").isNull())
    ts = F.col("event.timestamp")
    ok = FX.iso_valid(ts)
    return p.select(
        "event_id",
        ts.alias("timestamp"),
        ok.alias("ts_valid"),
        F.when(ok, FX.hour_from_text(ts)).alias("hour_of_day"),
    )


def q_stream_features(spark, sf_dir):
    r = route_events(raw_events(spark, sf_dir), None).where(F.col("topic") != TOPIC_DLQ)
    return r.select(
        "event_id",
        F.col("amount"),
        F.round("amount_ratio", SCORE_DIGITS).alias("amount_ratio"),
        F.round("balance_diff_orig", SCORE_DIGITS).alias("balance_diff_orig"),
        "is_transfer",
        "is_cashout",
        "hour_of_day",
        "txn_velocity_1h",
    )


def q_ensemble_score(spark, sf_dir):
    r = routed(spark, sf_dir).where(F.col("topic") != TOPIC_DLQ)
    return r.select("event_id", *[F.round(c, SCORE_DIGITS).alias(c)
                                  for c in ("if_score", "ae_score", "sgd_score", "ensemble_score")])


def q_score_route(spark, sf_dir):
    r = routed(spark, sf_dir, BENCH_THRESHOLD).where(F.col("topic") != TOPIC_DLQ)
    return r.select("event_id", F.round("ensemble_score", SCORE_DIGITS).alias("ensemble_score"), "topic")


def q_event_routing(spark, sf_dir):
    return routed(spark, sf_dir).select("event_id", "topic", "error")


def q_route_counts(spark, sf_dir):
    r = routed(spark, sf_dir)
    return r.agg(
        F.count(F.lit(1)).alias("events_in"),
        F.count_if(F.col("topic") != TOPIC_DLQ).alias("scored"),
        F.count_if(F.col("topic") == TOPIC_ANOMALY).alias("anomalies"),
        F.count_if(F.col("topic") == TOPIC_NORMAL).alias("normal"),
        F.count_if(F.col("topic") == TOPIC_DLQ).alias("dead_letter"),
    )


def q_sink_contents(spark, sf_dir):
    """The members of every sink record (without the value of ``received_at``)."""
    s = sink_records(routed(spark, sf_dir))
    text = lambda path: F.get_json_object("value", path)
    return s.select(
        "event_id", "topic", "key",
        F.array_join(F.array_sort(F.json_object_keys("value")), ",").alias("members"),
        text("$.error").alias("error"), text("$.user_id").alias("user_id"),
        text("$.amount").cast("double").alias("amount"),
        text("$.channel").alias("channel"), text("$.device.n").cast("int").alias("device_n"),
        F.coalesce(F.col("value").contains('"risk":2'), F.lit(False)).alias("risk_is_number"),
        (F.round(text("$.features.balance_diff_orig").cast("double"), SCORE_DIGITS) + F.lit(0.0)).alias("balance_diff_orig"),
        text("$.features.hour_of_day").cast("int").alias("hour_of_day"),
        F.round(text("$.scores.ensemble_score").cast("double"), SCORE_DIGITS).alias("ensemble_score"),
        F.when(text("$.received_at").isNotNull(), text("$.raw_event")).alias("raw_text"),
        F.array_join(F.array_sort(F.json_object_keys(F.when(text("$.received_at").isNull(), text("$.raw_event")))), ",")
        .alias("raw_members"),
    )


QUERIES = {
    "sink_contents": q_sink_contents,
    "parse_route": q_parse_route,
    "parse_valid": q_parse_valid,
    "dlq_by_error": q_dlq_by_error,
    "hour_from_offset": q_hour_from_offset,
    "stream_features": q_stream_features,
    "ensemble_score": q_ensemble_score,
    "score_route": q_score_route,
    "event_routing": q_event_routing,
    "route_counts": q_route_counts,
}
