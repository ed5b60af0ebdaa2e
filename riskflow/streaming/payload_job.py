"""The event flow over a payload topic, wired by the configuration.

payloads -> parse -> features -> score -> topic -> sink, with the counters of
each micro-batch recorded (O1).  Models come from the registry that the configuration names
(all members must be there, S12), or are given.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from riskflow.models.base import ModelSet
from riskflow.models.registry import ModelRegistry, load_model_set
from riskflow.operators.events import route_events, sink_records
from riskflow.sources.payloads import payloads
from riskflow.streaming.config import StreamConfig
from riskflow.streaming.jobs import run_available_now
from riskflow.streaming.metrics import MetricsLog, with_counters


def routed_payloads(messages: DataFrame, config: StreamConfig, models: ModelSet | None) -> DataFrame:
    """Messages with parsed fields, features, scores, error and the configured topic."""
    return route_events(
        messages, models, raw_col="value", weights=config.weights, threshold=config.score_threshold, valid_topic=config.valid_topic,
        dlq_topic=config.dlq_topic, anomaly_topic=config.anomaly_topic, normal_topic=config.normal_topic)


def run_payload_job(spark: SparkSession, root: str, location: str, config: StreamConfig, models: ModelSet | None = None,
                    metrics: MetricsLog | None = None) -> DataFrame:
    """Route what the raw topic has and stop; the next call goes on from there.  Returns the whole sink."""
    if models is None and config.model_root is not None:
        models = load_model_set(ModelRegistry(spark, config.model_root))
    messages = payloads(spark, root, config.raw_topic, config.source, location)
    routed = with_counters(routed_payloads(messages, config, models), config)
    records = sink_records(routed, "value", "message_key")
    out, ckpt = f"{location}/out", f"{location}/checkpoint"
    if metrics is None:
        run_available_now(records, out, ckpt, ["topic"])
    else:
        with metrics.recording() as name:
            run_available_now(records, out, ckpt, ["topic"], name=name)
    return spark.read.schema(records.schema).parquet(out)
