"""Structured Streaming jobs.

* The routed event flow is the same lazy transformation as the batch one
  (:func:`riskflow.operators.events.route_events`), applied to a
  ``readStream`` source; the multi-topic sink is one file sink partitioned by
  ``topic`` (exactly-once through the sink's commit log).  Where a Kafka
  connector is deployed, the same frame goes to ``format("kafka")`` with the
  ``topic`` column.
* Keyed one-hour velocity (T2) is in :mod:`riskflow.streaming.velocity`.
* ``availableNow`` runs the stream over what is there and stops (T4).

All outputs and checkpoints live under the shared checkpoint folder.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskflow.contract import TOPIC_DLQ
from riskflow.functions import features as FX
from riskflow.models.base import ModelSet
from riskflow.operators.events import route_events
from riskflow.session import checkpoint_dir
from riskflow.sources import adapters
from riskflow.sources.tables import even_tasks, spread


def stream_location(spark: SparkSession, name: str, run_id: str | None = None) -> tuple[str, str]:
    """(output path, checkpoint path) under the shared checkpoint folder."""
    base = f"{checkpoint_dir(spark).rstrip('/')}/streams/{name}-{run_id or uuid.uuid4().hex}"
    return f"{base}/out", f"{base}/checkpoint"


def event_source(spark: SparkSession, sf_dir: str, max_files_per_trigger: int | None = None,
                 file_glob: str = "events.parquet", schema=None) -> DataFrame:
    """Streaming scan of the events files in a folder (file source; schema from a footer)."""
    static = spark.read.option("pathGlobFilter", file_glob).parquet(sf_dir)
    if schema is None:
        schema = static.schema
    r = spark.readStream.schema(schema).option("pathGlobFilter", file_glob)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    stream = r.parquet(sf_dir)
    # same rule as the batch scan: a landing folder of one large row group would put all per-row work in one task
    tasks = even_tasks(static)
    if tasks is not None:
        stream = stream.repartition(tasks, "event_id")
    return stream


def scoring_stream(events_stream: DataFrame, models: ModelSet | None, threshold: float = 0.5) -> DataFrame:
    """T1 on a stream: raw JSON -> parse -> features -> score -> topic.

    O1: per micro-batch counters are attached with ``observe`` (:mod:`riskflow.streaming.metrics` records them).
    """
    from riskflow.streaming.metrics import with_counters

    return with_counters(route_events(adapters.raw_event(events_stream), models, threshold=threshold))


def run_available_now(df: DataFrame, out: str, ckpt: str, partition_by: list[str] | None = None,
                      timeout_s: int | None = None, name: str | None = None) -> str:
    """T4 + S7: run a stream over the available input, exactly-once file sink, then stop.

    Without a limit the stream runs to the end of its input; a limit that is hit raises.
    """
    w = df.writeStream.format("parquet").option("path", out).option("checkpointLocation", ckpt).outputMode("append")
    if partition_by:
        w = w.partitionBy(*partition_by)
    if name:
        w = w.queryName(name)
    await_end(w.trigger(availableNow=True).start(), timeout_s)
    return out


def await_end(q, timeout_s: int | None = None) -> None:
    """Wait until a bounded stream has read its whole input; raise if it fails or an explicit limit is hit."""
    try:
        ended = q.awaitTermination(timeout_s) if timeout_s is not None else q.awaitTermination() or True
    finally:
        if q.isActive:
            q.stop()
    if q.exception() is not None:
        raise RuntimeError(str(q.exception()))
    if not ended:
        raise TimeoutError(f"the stream had not read its input after {timeout_s} s; its output is incomplete")


def piece_of(events: DataFrame, piece: int, pieces: int) -> DataFrame:
    """One of ``pieces`` id ranges of the events."""
    top = events.agg(F.max("event_id")).first()[0]
    of = F.expr(f"event_id * {pieces} div {0 if top is None else top + 1}") if top is not None else F.lit(0)
    return events.where(of == piece)


def land(events: DataFrame, path: str, piece: int, pieces: int) -> None:
    """Append one of ``pieces`` id ranges of the events to a landing folder."""
    spread(piece_of(events, piece, pieces), "event_id").write.mode("append").parquet(path)


def keyed_velocity_batch(parsed: DataFrame, ingest_col: str = "event_id") -> DataFrame:
    """Batch twin of T2 (W2): row_number in (user_id, event hour) by ingest order."""
    from riskflow.operators.ordering import grouped_row_number

    ts = F.col("event.timestamp")
    valid = parsed.where(F.col("error").isNull() & FX.iso_valid(ts))
    e = valid.select(
        F.col(ingest_col).cast("long").alias("ingest_id"),
        F.col("event.user_id").alias("user_id"),
        F.date_trunc("hour", F.try_to_timestamp(ts)).alias("hour_start"),
    ).where(F.col("hour_start").isNotNull())
    return grouped_row_number(e, ["user_id", "hour_start"], "ingest_id", "txn_velocity_1h")


__all__ = [
    "TOPIC_DLQ", "event_source", "scoring_stream", "run_available_now", "keyed_velocity_batch", "land", "stream_location",
]
