"""Registered queries run as Structured Streaming jobs (availableNow), read back as tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskflow.contract import FEATURES_V1
from riskflow.models.demo import demo_models
from riskflow.operators.events import sink_records
from riskflow.session import cut_lineage
from riskflow.sources import adapters
from riskflow.sources.payloads import SourceOptions, publish_records
from riskflow.sources.tables import spread, table
from riskflow.streaming import jobs
from riskflow.streaming.config import StreamConfig
from riskflow.streaming.metrics import MetricsLog, feedback_loop_samples
from riskflow.streaming.payload_job import run_payload_job
from riskflow.streaming.velocity import VelocityLog, scored_with_velocity


def q_stream_scoring(spark, sf_dir):
    """The routed event flow as a stream; sink partitioned by topic."""
    out, ckpt = jobs.stream_location(spark, "scoring")
    stream = jobs.scoring_stream(jobs.event_source(spark, sf_dir), demo_models(), threshold=0.5)
    jobs.run_available_now(sink_records(stream), out, ckpt, partition_by=["topic"])
    return spark.read.parquet(out).select("event_id", "topic", "error")


PIECES = 3  # micro-batches that the events arrive in, by id


def _velocity_run(spark, sf_dir, then=None):
    """The events landed piece by piece, each picked up by a run that goes on from the checkpoint."""
    out, ckpt = jobs.stream_location(spark, "velocity")
    events = table(spark, sf_dir, "events")
    log = VelocityLog(spark, f"{out}/velocity")
    for k in range(PIECES):
        jobs.land(events, f"{out}/landing", k, PIECES)
        source = jobs.event_source(spark, f"{out}/landing", file_glob="*.parquet", schema=events.schema)
        raw = adapters.raw_event(source)
        log.run(raw, ckpt) if then is None else then(log, raw, f"{out}/sink", ckpt)
    return log, f"{out}/sink"


def q_stream_velocity(spark, sf_dir):
    """Keyed per-user one-hour velocity over several micro-batches; late rows have none."""
    log, _ = _velocity_run(spark, sf_dir)
    return log.rows().where("txn_velocity_1h is not null").select("event_id", "user_id", "txn_velocity_1h")


def q_stream_velocity_batches(spark, sf_dir):
    """Rows with an event hour and late ones among them, by micro-batch."""
    log, _ = _velocity_run(spark, sf_dir)
    return log.progress().select(F.col("batch_id").cast("long").alias("batch_id"), "rows", "late")


def q_stream_scoring_velocity(spark, sf_dir):
    """T1 with T2 in front: the sink's features carry the streamed velocity."""
    _, sink = _velocity_run(spark, sf_dir, lambda log, raw, out, ckpt: scored_with_velocity(log, raw, demo_models(), out, ckpt))
    velocity = F.get_json_object("value", "$.features.txn_velocity_1h").cast("int").alias("txn_velocity_1h")
    return spark.read.parquet(sink).select("event_id", "topic", velocity)


# Topics, threshold and start of the payload queries; all but the source differ from the defaults.
PAYLOAD_CONFIG = StreamConfig(
    raw_topic="payments-raw", valid_topic="payments-features", anomaly_topic="payments-alerts", normal_topic="payments-passed",
    dlq_topic="payments-refused", score_threshold=0.6, source=SourceOptions("records", "2024-01-03T00:00:00Z"))


def _payload_run(spark, sf_dir):
    """The events as byte payloads of two topics, one of them read from a start time, in runs that follow each other.

    An event is sent on one of ten days by its id; one in 50 has a byte that is not UTF-8.
    """
    out, _ = jobs.stream_location(spark, "payloads")
    events, log = table(spark, sf_dir, "events"), MetricsLog(spark, f"{out}/metrics")
    for k in range(PIECES):
        raw = adapters.raw_event(spread(jobs.piece_of(events, k, PIECES), "event_id")).selectExpr(
            "CAST(event_id AS STRING) AS key", "IF(event_id % 50 = 19, concat(CAST(raw AS BINARY), X'FF'), CAST(raw AS BINARY)) AS value",
            "timestamp '2024-01-01 12:00:00' + make_interval(0, 0, 0, CAST(event_id % 10 AS INT)) AS sent_at")
        for topic in (PAYLOAD_CONFIG.raw_topic, "payments-other"):
            publish_records(raw, f"{out}/topics", topic)
        sink = run_payload_job(spark, f"{out}/topics", out, PAYLOAD_CONFIG, demo_models(), log)
    return sink, log


def q_payload_routing(spark, sf_dir):
    """Binary payloads of the configured topic from the start position on, routed to the configured topics."""
    sink, _ = _payload_run(spark, sf_dir)
    mended = F.endswith(F.get_json_object("value", "$.raw_event"), F.lit("\ufffd"))
    return sink.select(F.col("message_key").cast("long").alias("event_id"), "topic", "error", F.coalesce(mended, F.lit(False)).alias("bytes_replaced"))


def q_stream_metrics(spark, sf_dir):
    """O1: the counters after each micro-batch (latency is measured, so not here; see ``stream_latency``)."""
    _, log = _payload_run(spark, sf_dir)
    return log.samples().where("name not like '%latency%'").select("batch_id", "name", "kind", "value")


def q_stream_latency(spark, sf_dir):
    """A9/O4 from the progress of the stream: the latency of its events, and their number."""
    _, log = _payload_run(spark, sf_dir)
    return log.latency_summary()


def _feedback_loop(spark, sf_dir):
    """The feedback stream loop, run to the end of its input."""
    from riskflow.models.registry import ModelRegistry
    from riskflow.plans.model_queries import feats
    from riskflow.streaming.feedback_loop import FeedbackLoop

    out, ckpt = jobs.stream_location(spark, "feedback-loop")
    holdout = cut_lineage(feats(spark, sf_dir).select(*FEATURES_V1, "isFraud"))  # read once a window of updates
    loop = FeedbackLoop(spark, holdout, out, ModelRegistry(spark, out + "/registry"))
    src = adapters.feedback_text(jobs.event_source(spark, sf_dir))
    loop.run_stream(src.select("event_id", "raw"), ckpt)
    return loop


def q_feedback_stream_loop(spark, sf_dir):
    """T5 as a stream: feedback -> acceptance -> batch updates with promotion guard, a last one from the remainder."""
    return _feedback_loop(spark, sf_dir).summary()


def q_feedback_loop_metrics(spark, sf_dir):
    """O1 of the learning loop at its end; which updates pass depends on the model, how many are judged does not."""
    samples = feedback_loop_samples(spark, _feedback_loop(spark, sf_dir).state_dir)
    judged = F.col("name").isin("promotion_pass_total", "promotion_fail_total")
    kept = samples.where(~F.col("name").isin("promotion_rollback_total", "online_update_count"))
    last = kept.groupBy("name", "kind").agg(F.max_by("value", F.struct("batch_id", "step")).alias("value"))
    return last.groupBy(F.when(judged, "promotions_judged").otherwise(F.col("name")).alias("name"), "kind").agg(F.sum("value").alias("value"))


def q_feedback_loop_counts(spark, sf_dir):
    """T5: the counts of the stream loop that do not depend on the model."""
    return q_feedback_stream_loop(spark, sf_dir).select("messages_seen", "accepted", "skipped", "updates", "last_batch_size")


QUERIES = {
    "feedback_loop_metrics": q_feedback_loop_metrics,
    "payload_routing": q_payload_routing,
    "stream_latency": q_stream_latency,
    "stream_metrics": q_stream_metrics,
    "feedback_loop_counts": q_feedback_loop_counts,
    "feedback_stream_loop": q_feedback_stream_loop,
    "stream_scoring": q_stream_scoring,
    "stream_scoring_velocity": q_stream_scoring_velocity,
    "stream_velocity": q_stream_velocity,
    "stream_velocity_batches": q_stream_velocity_batches,
}
