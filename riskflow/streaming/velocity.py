"""Keyed one-hour velocity on a stream (T2, W2) and in front of the scored flow.

Velocity is the number of an event among its user's events of the same event hour, in ingest order.
State lives in a log of tables, one entry a micro-batch, in the shared folder: an entry holds the counts
per (user, hour) that its micro-batch added, and every ``COMPACT_EVERY``-th one a snapshot of all open
hours.  A micro-batch numbers its rows in pieces of a bounded number of ids (``grouped_row_number``), whose
offsets are the counts of earlier micro-batches plus those of the pieces before: a user with a third of the
rows is spread over as many tasks as it has pieces, and nothing is gathered per user.  (State operators key
their rows by user, so that such a user is one task; counts of slices of the same micro-batch are not known
to each other there.)

Event hours close ``WATERMARK_S`` after their end, judged by the latest event time of the micro-batches
before, as a watermark is; closed hours leave the state.  Rows of a closed hour are late: they keep a null
velocity and are counted in the progress table.  Everything a micro-batch writes goes to folders named by its
id and is overwritten by a retry, which reads only entries of smaller ids; the progress row comes last.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskflow.functions import features as FX
from riskflow.models.base import ModelSet
from riskflow.models.registry import read_or_none
from riskflow.operators.events import parse_events, route_events, sink_records
from riskflow.operators.ordering import grouped_row_number
from riskflow.streaming.jobs import await_end

WATERMARK_S = 3600
HOUR_S = 3600
COMPACT_EVERY = 16
KEYS = ["user_id", "hour_start"]
COUNTS = "user_id string, hour_start timestamp, n long, batch_id long"
PROGRESS = "rows long, late long, max_event timestamp, snapshot boolean, batch_id long"


def keyed_events(raw: DataFrame, ingest_col: str = "event_id") -> DataFrame:
    """The input with ``user_id``, ``event_time`` and ``hour_start``; null where the event is invalid."""
    parsed = parse_events(raw)
    ts = F.col("event.timestamp")
    ok = F.col("error").isNull() & FX.iso_valid(ts)
    timed = parsed.select(*raw.columns, F.when(ok, F.col("event.user_id")).alias("user_id"), F.when(ok, F.try_to_timestamp(ts)).alias("event_time"))
    return timed.withColumn("hour_start", F.date_trunc("hour", "event_time"))


class VelocityLog:
    """Numbers the rows of one micro-batch after another; the state survives restarts and retries."""

    def __init__(self, spark: SparkSession, root: str, ingest_col: str = "event_id", compact_every: int = COMPACT_EVERY):
        self.spark, self.root, self.ingest_col, self.compact_every = spark, root.rstrip("/"), ingest_col, compact_every

    def _part(self, table: str, batch_id: int) -> str:
        return f"{self.root}/{table}/batch_id={batch_id}"

    def progress(self) -> DataFrame:
        """Rows with an hour, late ones among them and the latest event time of each micro-batch."""
        got = read_or_none(self.spark, f"{self.root}/progress", PROGRESS)
        return self.spark.createDataFrame([], PROGRESS) if got is None else got

    def _before(self, batch_id: int) -> tuple[int | None, object]:
        """The last snapshot and the watermark (closed hours end at or before it) that hold for a micro-batch."""
        r = self.progress().where(F.col("batch_id") < batch_id).agg(
            F.max(F.when(F.col("snapshot"), F.col("batch_id"))).alias("base"),
            (F.max("max_event") - F.expr(f"interval {WATERMARK_S} seconds")).alias("mark")).first()
        return r["base"], r["mark"]

    def counts(self, batch_id: int, base: int | None, mark) -> DataFrame:
        """Events per user and open hour of the micro-batches before this one."""
        log = read_or_none(self.spark, f"{self.root}/counts", COUNTS)
        if log is None:
            return self.spark.createDataFrame([], COUNTS).drop("batch_id")
        log = log.where((F.col("batch_id") < batch_id) & (F.col("batch_id") >= (0 if base is None else base)) & ~self._closed(mark))
        return log.groupBy(*KEYS).agg(F.sum("n").alias("n"))

    @staticmethod
    def _closed(mark):
        if mark is None:
            return F.lit(False)
        return F.coalesce(F.col("hour_start") + F.expr(f"interval {HOUR_S} seconds") <= F.lit(mark), F.lit(False))

    def number(self, rows: DataFrame, batch_id: int) -> DataFrame:
        """The rows (as ``keyed_events`` gives them) with ``txn_velocity_1h`` and ``late``, written and read back."""
        rows = rows.persist(StorageLevel.MEMORY_AND_DISK)  # parsed once: read by the pieces, the numbering and the rest
        try:
            return self._number(rows, batch_id)
        finally:
            rows.unpersist()

    def _number(self, rows: DataFrame, batch_id: int) -> DataFrame:
        base, mark = self._before(batch_id)
        prior = self.counts(batch_id, base, mark)
        open_ = F.col("hour_start").isNotNull() & F.col("user_id").isNotNull() & ~self._closed(mark)
        numbered = grouped_row_number(rows.where(open_), KEYS, self.ingest_col, "txn_velocity_1h", start=prior)
        rest = rows.where(~open_).withColumn("txn_velocity_1h", F.lit(None).cast("int"))
        out = numbered.unionByName(rest).withColumn("late", self._closed(mark) & F.col("hour_start").isNotNull())
        out.write.mode("overwrite").parquet(self._part("rows", batch_id))
        done = self.spark.read.schema(out.schema).parquet(self._part("rows", batch_id))

        added = done.where(F.col("txn_velocity_1h").isNotNull()).groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n"))
        snapshot = batch_id % self.compact_every == self.compact_every - 1
        if snapshot:
            added = prior.unionByName(added).groupBy(*KEYS).agg(F.sum("n").alias("n"))
        added.write.mode("overwrite").parquet(self._part("counts", batch_id))
        seen = done.where(F.col("hour_start").isNotNull())
        seen.agg(F.count(F.lit(1)).alias("rows"), F.count_if("late").alias("late"), F.max("event_time").alias("max_event"), F.lit(snapshot).alias("snapshot")) \
            .write.mode("overwrite").parquet(self._part("progress", batch_id))
        return done

    def rows(self) -> DataFrame:
        """All rows numbered so far."""
        return self.spark.read.parquet(f"{self.root}/rows")

    def run(self, raw_stream: DataFrame, checkpoint: str, then: Callable[[DataFrame, int], None] | None = None, timeout_s: int | None = None) -> None:
        """Number what a raw event stream has (``availableNow``); ``then`` gets the numbered rows of each micro-batch."""

        def batch(df: DataFrame, batch_id: int) -> None:
            done = self.number(keyed_events(df, self.ingest_col), batch_id)
            if then is not None:
                then(done, batch_id)

        q = raw_stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        await_end(q, timeout_s)


def scored_with_velocity(log: VelocityLog, raw_stream: DataFrame, models: ModelSet | None, out: str, checkpoint: str, threshold: float = 0.5) -> None:
    """T1 with streamed velocity: number, then parse, score and route; the sink is partitioned by micro-batch and topic.

    Late events are scored with a velocity of 1, as any event without known predecessors in its hour.
    """

    def sink(done: DataFrame, batch_id: int) -> None:
        inputs = done.withColumn("_velocity", F.coalesce("txn_velocity_1h", F.lit(1))).drop("user_id", "event_time", "hour_start", "txn_velocity_1h", "late")
        routed = route_events(inputs, models, velocity=F.col("_velocity"), threshold=threshold)
        sink_records(routed).write.mode("overwrite").partitionBy("topic").parquet(f"{out}/batch_id={batch_id}")

    log.run(raw_stream, checkpoint, sink)
