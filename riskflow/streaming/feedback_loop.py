"""Feedback learning loop as a stream (T5), the one-shot updater (T6) and the publish path.

Per micro-batch (``foreachBatch``):
  1. V11 acceptance; counters observed on the batch (O1);
  2. accepted rows are appended to the rows still pending from earlier
     batches and numbered in arrival order (K5);
  3. each full batch of ``batch_size`` rows is one update (M12) of the live
     logistic model; the candidate is evaluated on the holdout (M9/M10)
     before it goes live (M11) - a failing candidate never becomes live, so
     the rollback is "the pointer stays"; each update emits a signal (S9).
     Updates are computed and judged by windows (``update_chain``);
  4. the remainder is written as the new pending table; at the end of the
     stream it is one last update.
Loop state (live version, update count) is stored per batch id next to the
pending rows, so a retried batch recomputes from the previous batch's state
(idempotent under at-least-once ``foreachBatch``); nothing buffered is lost
on a crash.
"""

from __future__ import annotations

import json
import time

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from riskflow.streaming.jobs import await_end
from riskflow.contract import FEATURES_V1, ONLINE_BATCH_SIZE, PROMOTION_MIN
from riskflow.models.fixed import FIXED_LOGIT
from riskflow.models.params import LogitParams
from riskflow.models.registry import ModelRegistry, read_or_none
from riskflow.operators import feedback as FB
from riskflow.session import cut_lineage
from riskflow.sources.files import append_signals, publish_json
from riskflow.streaming.holdout_region import packed_rows, totals
from riskflow.streaming.update_chain import packed_batches, passes, run_chain

PENDING_SCHEMA = "event_id long, y int, " + ", ".join(f"{c} double" for c in FEATURES_V1)


STATE_SCHEMA = ("live string, update_count long, messages long, accepted long, updates long, passed long, failed long, "
                "last_batch_size long, batch_id long, step long")


class FeedbackLoop:
    def __init__(self, spark: SparkSession, holdout: DataFrame, state_dir: str, registry: ModelRegistry,
                 batch_size: int = ONLINE_BATCH_SIZE, learning_rate: float = 1e-5,
                 minimums: dict | None = None, model_name: str = "online_logit",
                 initial: LogitParams | None = None):
        if batch_size <= 0:
            raise ValueError("batch_size must be > 0")
        self.spark = spark
        self.holdout = holdout
        self.state_dir = state_dir.rstrip("/")
        self.registry = registry
        self.batch_size = batch_size
        self.lr = learning_rate
        self.minimums = minimums or PROMOTION_MIN
        self.model_name = model_name
        self.initial = initial or LogitParams(list(FIXED_LOGIT.weights), FIXED_LOGIT.bias, version=0)
        self._rows = None

    # -- state -----------------------------------------------------------
    # A state row and the pending rows are written per (micro-batch, step): step 0 is the micro-batch
    # itself, later steps are flushes and one-shot updates after it.  A retry overwrites its own folder.
    def _state(self, before_batch: int | None = None) -> dict:
        """The latest state (of the micro-batches before ``before_batch``); the initial one if there is none."""
        st = read_or_none(self.spark, f"{self.state_dir}/state", STATE_SCHEMA)
        if st is not None and before_batch is not None:
            st = st.where(F.col("batch_id") < before_batch)
        row = None if st is None else st.orderBy(F.col("batch_id").desc(), F.col("step").desc()).first()
        if row is None:
            return {"batch_id": -1, "step": -1, "live": json.dumps({
                "weights": self.initial.weights, "bias": self.initial.bias, "version": self.initial.version}),
                "update_count": 0, "messages": 0, "accepted": 0, "updates": 0, "passed": 0, "failed": 0,
                "last_batch_size": 0}
        return row.asDict()

    def _pending(self, state: dict) -> DataFrame:
        if state["step"] < 0:
            return self.spark.createDataFrame([], PENDING_SCHEMA)
        return self.spark.read.schema(PENDING_SCHEMA).parquet(self._part("pending", state["batch_id"], state["step"]))

    def _part(self, table: str, batch_id: int, step: int) -> str:
        return f"{self.state_dir}/{table}/batch_id={batch_id}/step={step}"

    # -- one micro-batch -------------------------------------------------
    def process(self, batch_df: DataFrame, batch_id: int, force_flush: bool = False) -> dict:
        """One micro-batch: an update per full batch, the remainder kept (or flushed too)."""
        return self._advance(self._state(batch_id), batch_df, batch_id, 0, force_flush)

    def flush(self) -> dict:
        """Update from the rows still pending, if there are any."""
        prev = self._state()
        return self._advance(prev, None, prev["batch_id"], prev["step"] + 1, True)

    def update_once(self, feedback: DataFrame, force_flush: bool = True) -> dict:
        """One update from everything buffered and given; without the force only from ``batch_size`` rows on."""
        prev = self._state()
        return self._advance(prev, feedback, prev["batch_id"], prev["step"] + 1, force_flush, whole=True)

    def _advance(self, prev: dict, batch_df: DataFrame | None, batch_id: int, step: int, force_flush: bool,
                 whole: bool = False) -> dict:
        live_d = json.loads(prev["live"])
        live = LogitParams(live_d["weights"], live_d["bias"], version=live_d["version"])
        rows, messages, accepted = self._pending(prev), 0, 0
        if batch_df is not None:
            acc = cut_lineage(FB.accept_for_learning(batch_df).select("event_id", "y", "accepted", *FEATURES_V1))  # parsed once
            counts = acc.agg(F.count(F.lit(1)).alias("m"), F.count_if("accepted").alias("a")).first()
            messages, accepted = int(counts["m"]), int(counts["a"])
            rows = rows.unionByName(acc.where("accepted").select(
                F.col("event_id").cast("long"), F.col("y").cast("int"), *[F.col(c).cast("double") for c in FEATURES_V1]))
        if whole:
            numbered = cut_lineage(rows.withColumn("batch_no", F.lit(0).cast("long")))
        else:
            numbered = FB.cut_batches(rows, "event_id", self.batch_size)  # reads a checkpoint
        n = numbered.count()
        if whole:
            n_updates = int(n > 0 and (force_flush or n >= self.batch_size))
        else:
            n_updates = -(-n // self.batch_size) if force_flush else n // self.batch_size
        stats = {"updates": 0, "passed": 0, "failed": 0}
        update_count, last_size = int(prev["update_count"]), int(prev["last_batch_size"])
        for window in self._updates(numbered, n_updates, live, whole):
            signals, made = [], []
            for _, size, cand, ok in window:
                signals.append(("logistic", f"{self.registry.root}/{self.model_name}", update_count + 1, size))
                last_size = size
                if ok:
                    update_count += 1
                    live = cand
                    made.append((cand.version, {"weights": cand.weights, "bias": cand.bias, "online_update_count": update_count}))
            append_signals(self.spark, f"{self._part('signals', batch_id, step)}/update={window[0][0]}", signals)
            if made:
                self.registry.save_all(self.model_name, "logistic", made)
                self.registry.set_live(self.model_name, live.version)
            stats["updates"] += len(window)
            stats["passed"] += len(made)
            stats["failed"] += len(window) - len(made)
        remainder = numbered.where(F.col("batch_no") >= n_updates).drop("batch_no")
        remainder.write.mode("overwrite").parquet(self._part("pending", batch_id, step))
        state = {
            "live": json.dumps({"weights": live.weights, "bias": live.bias, "version": live.version}),
            "update_count": update_count,
            "messages": int(prev["messages"]) + messages,
            "accepted": int(prev["accepted"]) + accepted,
            "updates": int(prev["updates"]) + stats["updates"],
            "passed": int(prev["passed"]) + stats["passed"],
            "failed": int(prev["failed"]) + stats["failed"],
            "last_batch_size": last_size,
        }
        self.spark.createDataFrame([tuple(state.values())], STATE_SCHEMA.split(", batch_id")[0]).coalesce(1) \
            .write.mode("overwrite").parquet(self._part("state", batch_id, step))
        return state | {"batch_id": batch_id, "step": step}

    def _updates(self, numbered: DataFrame, n_updates: int, live: LogitParams, whole: bool):
        """Windows of (batch_no, rows, candidate, passed)."""
        if not n_updates:
            return
        if whole:  # one update from all rows: a distributed aggregation
            g = FB.gradient_step(numbered, live.weights, live.bias).first()
            cand = LogitParams([w - self.lr * g[f"grad_{i}"] for i, w in enumerate(live.weights)],
                               live.bias - self.lr * g["grad_bias"], version=live.version + 1)
            yield [(0, int(g["n"]), cand, passes(self.holdout, [cand], self.minimums)[0])]
        else:
            packed = packed_batches(numbered.where(F.col("batch_no") < n_updates))
            if self._rows is None:  # packed once, whatever the number of micro-batches
                rows = packed_rows(self.holdout)
                self._rows = rows, totals(rows)
            yield from run_chain(packed, n_updates, live, self.lr, self.holdout, self.minimums, True, *self._rows)

    def summary(self) -> DataFrame:
        """messages_seen, accepted, skipped, updates, promotion_passed/failed, rollbacks (latest state)."""
        st = self.spark.read.schema(STATE_SCHEMA).parquet(f"{self.state_dir}/state")
        last = st.orderBy(F.col("batch_id").desc(), F.col("step").desc()).limit(1)
        return last.select(
            F.col("messages").alias("messages_seen"), F.col("accepted"),
            (F.col("messages") - F.col("accepted")).alias("skipped"), F.col("updates"),
            F.col("passed").alias("promotion_passed"), F.col("failed").alias("promotion_failed"),
            F.col("failed").alias("rollbacks"), F.col("update_count").alias("online_update_count"),
            "last_batch_size",
        )

    def run_stream(self, feedback_stream: DataFrame, checkpoint: str, timeout_s: int | None = None,
                   force_flush: bool = True, max_messages: int | None = None, max_idle_polls: int | None = None,
                   poll_s: float = 1.0) -> None:
        """T5: every micro-batch, then (by default) an update from the remainder.

        Without limits the stream runs to the end of what is there.  With ``max_messages`` or ``max_idle_polls`` it
        goes on polling every ``poll_s`` seconds, and stops behind the micro-batch that reaches the messages, or
        after so many polls in a row without input; what it has not read stays for the next run.
        """
        for name, v in (("max_messages", max_messages), ("max_idle_polls", max_idle_polls), ("poll_s", poll_s)):
            if v is not None and v <= 0:
                raise ValueError(f"{name} must be > 0")
        seen = {"messages": 0, "batches": 0}

        def batch(df: DataFrame, batch_id: int) -> None:
            if max_messages is not None and seen["messages"] >= max_messages:
                raise _Enough  # not processed: its offsets are not committed
            before = self._state(batch_id)["messages"]
            seen["messages"] += self.process(df, batch_id)["messages"] - before
            seen["batches"] += 1

        writer = feedback_stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
        if max_messages is None and max_idle_polls is None:
            await_end(writer.trigger(availableNow=True).start(), timeout_s)
        else:
            self._poll(writer.trigger(processingTime=f"{poll_s} seconds").start(), seen, max_messages, max_idle_polls, poll_s, timeout_s)
        if force_flush:
            self.flush()

    @staticmethod
    def _poll(q, seen: dict, max_messages: int | None, max_idle_polls: int | None, poll_s: float, timeout_s: int | None) -> None:
        idle, last, began = 0, 0, time.monotonic()
        try:
            while q.isActive:
                time.sleep(poll_s)
                enough = max_messages is not None and seen["messages"] >= max_messages
                busy = seen["batches"] > last or q.status["isTriggerActive"] or q.status["isDataAvailable"]
                idle, last = 0 if busy else idle + 1, seen["batches"]
                if enough or (max_idle_polls is not None and idle >= max_idle_polls):
                    break
                if timeout_s is not None and time.monotonic() - began > timeout_s:
                    raise TimeoutError(f"no limit was reached in {timeout_s} s")
        finally:
            q.stop()
        if q.exception() is not None and _Enough.__name__ not in str(q.exception()):
            raise RuntimeError(str(q.exception()))


class _Enough(Exception):
    """The stream has more input than it may read."""


def run_updater_once(loop: FeedbackLoop, feedback: DataFrame, force_flush: bool = True) -> DataFrame:
    """One update from everything given, continuing from the saved state, then the summary."""
    loop.update_once(feedback, force_flush)
    return loop.summary()


def publish_feedback(requests: DataFrame, sink_path: str) -> DataFrame:
    """Validate requests (V10), publish the accepted ones with ``received_at``.

    Returns the counters: a request counts once it passed validation; a failed
    write raises, so the errors of a finished call are 0.
    """
    ok = FB.validate_requests(requests).where(F.col("status") == "accepted").select(
        "anomaly_id", "label", "analyst_id",
        F.variant_get(F.col("_v"), "$.features", "variant").alias("features"),
        F.variant_get(F.col("_v"), "$.notes", "string").alias("notes"),
        F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("received_at"),
    )
    seen = Observation()
    publish_json(ok.observe(seen, F.count(F.lit(1)).alias("n")), sink_path)
    n = float(seen.get["n"])
    return requests.sparkSession.createDataFrame(
        [(n, n, 0.0)],
        "feedback_requests_total double, feedback_published_total double, feedback_publish_errors_total double")
