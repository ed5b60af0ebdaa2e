"""Counters of the streams as a table of samples.

``MetricsLog`` listens to the progress of a named query and keeps one row per
micro-batch: the counters observed in it, its rows and its duration.  A micro-batch that
is run again replaces its row, so a retry is not counted twice.  Events arrive
at the driver one a micro-batch; events of the stream itself never do.

The latency of an event is the time that its micro-batch took from trigger to
commit: nothing leaves the batch earlier.  ``stream_process_latency_ms_total``
sums it over events, so its rate over the rate of the events is their average.
"""

from __future__ import annotations

import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from riskflow.models.registry import read_or_none
from riskflow.operators.monitoring import ratio
from riskflow.streaming.config import StreamConfig

OBSERVED = "stream_counters"
LATENCY_TOTAL = "stream_process_latency_ms_total"
LATENCY_LAST = "stream_last_process_latency_ms"
EVENTS_IN = "stream_events_in_total"
BATCHES = "query string, batch_id long, at timestamp, rows long, duration_ms double, counters map<string, double>"
END_WAIT_S = 60.0


def counter_columns(config: StreamConfig) -> list[Column]:
    """The event-flow counters over routed rows, by the configured topics."""
    topic = F.col("topic")
    return [
        F.count(F.lit(1)).alias(EVENTS_IN),
        F.count_if(topic == config.valid_topic).alias("stream_events_valid_total"),
        F.count_if(topic == config.anomaly_topic).alias("stream_events_anomaly_total"),
        F.count_if(topic == config.normal_topic).alias("stream_events_normal_total"),
        F.count_if(topic == config.dlq_topic).alias("stream_events_dlq_total"),
    ]


def with_counters(routed: DataFrame, config: StreamConfig = StreamConfig()) -> DataFrame:
    """The same rows; their counters arrive with the progress of each micro-batch."""
    return routed.observe(OBSERVED, *counter_columns(config))


class MetricsLog:
    """Rows of ``BATCHES`` below ``path``, one folder per query and micro-batch."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.path = path.rstrip("/")

    @contextmanager
    def recording(self) -> Iterator[str]:
        """Record the query that is started with the given name inside the block; wait for its last event at the end."""
        listener = _Recorder(self, f"recorded-{uuid.uuid4().hex}")
        self.spark.streams.addListener(listener)
        try:
            yield listener.query_name
            listener.wait()
        finally:
            self.spark.streams.removeListener(listener)
        if listener.failure is not None:
            raise listener.failure

    def write(self, query: str, batch_id: int, at: str, rows: int, duration_ms: float, counters: dict[str, float]) -> None:
        """Keep (or replace) the row of a micro-batch; ``at`` is ISO text."""
        row = self.spark.createDataFrame([(query, batch_id, at, rows, duration_ms, counters)], BATCHES.replace("at timestamp", "at string"))
        row.withColumn("at", F.col("at").cast("timestamp")).coalesce(1) \
            .write.mode("overwrite").parquet(f"{self.path}/query_id={query}/batch={batch_id}")

    def batches(self) -> DataFrame:
        got = read_or_none(self.spark, self.path, BATCHES)
        return self.spark.createDataFrame([], BATCHES) if got is None else got.select("query", "batch_id", "at", "rows", "duration_ms", "counters")

    def samples(self) -> DataFrame:
        """(ts, query, batch_id, name, kind, value): counters are totals over the micro-batches so far, gauges their last value.

        One row per micro-batch and name goes through the window, however many events the micro-batch had.
        """
        total = F.create_map(F.lit(LATENCY_TOTAL), F.col("rows") * F.col("duration_ms"))
        b = self.batches().withColumn("ts", F.col("at").cast("timestamp_ntz"))
        steps = b.select("ts", "query", "batch_id", F.explode(F.map_concat("counters", total)).alias("name", "step"))
        w = Window.partitionBy("name").orderBy("ts", "query", "batch_id").rowsBetween(Window.unboundedPreceding, 0)
        counters = steps.select("ts", "query", "batch_id", "name", F.lit("counter").alias("kind"), F.sum("step").over(w).alias("value"))
        last = b.select("ts", "query", "batch_id", F.lit(LATENCY_LAST).alias("name"), F.lit("gauge").alias("kind"), F.col("duration_ms").alias("value"))
        return counters.unionByName(last)

    def average_latency(self, range_s: int) -> DataFrame:
        """(ts, ratio), the average latency in ms of the events of the last ``range_s`` seconds, at each micro-batch."""
        per_time = self.samples().where("kind = 'counter'").groupBy("ts", "name").agg(F.max("value").alias("value"))
        return ratio(per_time, LATENCY_TOTAL, EVENTS_IN, range_s)

    def latency_summary(self) -> DataFrame:
        """A9 of the streams: events, mean, median, 95th percentile and maximum of their latency (null without events)."""
        return self.batches().where("rows > 0").agg(
            F.coalesce(F.sum("rows"), F.lit(0)).alias("n"),
            (F.sum(F.col("rows") * F.col("duration_ms")) / F.sum("rows")).alias("mean_ms"),
            F.expr("percentile(duration_ms, 0.5, rows)").alias("p50_ms"),  # state: one cell per distinct duration
            F.expr("percentile(duration_ms, 0.95, rows)").alias("p95_ms"),
            F.max("duration_ms").alias("max_ms"),
        )


class _Recorder(StreamingQueryListener):
    """Writes the progress of one named query; a failure is kept for the caller."""

    def __init__(self, log: MetricsLog, query_name: str):
        self.log, self.query_name = log, query_name
        self.run_id, self.failure, self.ended = None, None, threading.Event()

    def onQueryStarted(self, event):
        if event.name == self.query_name:
            self.run_id = event.runId

    def onQueryProgress(self, event):
        p = event.progress
        if p.name != self.query_name or OBSERVED not in p.observedMetrics or p.numInputRows == 0:
            return
        try:
            counters = {k: float(v) for k, v in p.observedMetrics[OBSERVED].asDict().items()}
            self.log.write(str(p.id), p.batchId, p.timestamp, counters_rows(counters), float(p.durationMs["triggerExecution"]), counters)
        except Exception as e:  # raised by recording(), not lost in the listener's thread
            self.failure = e

    def onQueryIdle(self, event):
        pass

    def onQueryTerminated(self, event):
        if event.runId == self.run_id:
            self.ended.set()

    def wait(self) -> None:
        if self.run_id is not None and not self.ended.wait(END_WAIT_S):
            raise TimeoutError(f"the end of query {self.query_name} was not reported in {END_WAIT_S} s")


def counters_rows(counters: dict[str, float]) -> int:
    """Events of a micro-batch (rows read by the source may be counted once per scan)."""
    return int(counters[EVENTS_IN])


def feedback_loop_samples(spark: SparkSession, state_dir: str) -> DataFrame:
    """O1 of the learning loop: (ts, name, kind, value) from the state that each micro-batch and flush left.

    The buffer is what was pending then; the time is that of the state's file.
    """
    from riskflow.streaming.feedback_loop import PENDING_SCHEMA, STATE_SCHEMA

    keys = ["batch_id", "step"]
    state = spark.read.schema(STATE_SCHEMA).parquet(f"{state_dir}/state")
    state = state.select("*", F.col("_metadata.file_modification_time").cast("timestamp_ntz").alias("ts"))
    pending = spark.read.schema(PENDING_SCHEMA + ", batch_id long, step long").parquet(f"{state_dir}/pending")
    s = state.join(pending.groupBy(*keys).agg(F.count(F.lit(1)).alias("buffered")), keys, "left")
    counters = {
        "online_consumer_messages_total": F.col("messages"),
        "online_feedback_received_total": F.col("messages"),
        "online_feedback_accepted_total": F.col("accepted"),
        "online_feedback_skipped_total": F.col("messages") - F.col("accepted"),
        "online_updates_total": F.col("updates"),
        "promotion_pass_total": F.col("passed"),
        "promotion_fail_total": F.col("failed"),
        "promotion_rollback_total": F.col("failed"),
    }
    gauges = {
        "online_updater_buffer_size": F.coalesce("buffered", F.lit(0)),
        "online_last_update_batch_size": F.col("last_batch_size"),
        "online_update_count": F.col("update_count"),
    }
    cells = [F.struct(F.lit(n).alias("name"), F.lit(kind).alias("kind"), c.cast("double").alias("value"))
             for kind, cols in (("counter", counters), ("gauge", gauges)) for n, c in cols.items()]
    return s.select("ts", *keys, F.inline(F.array(*cells)))


def counters_as_samples(wide: DataFrame) -> DataFrame:
    """One-row counters (such as those of publishing) as (ts, name, kind, value) at the current time."""
    cells = [F.struct(F.lit(c).alias("name"), F.lit("counter").alias("kind"), F.col(c).cast("double").alias("value")) for c in wide.columns]
    return wide.select(F.current_timestamp().cast("timestamp_ntz").alias("ts"), F.inline(F.array(*cells)))
