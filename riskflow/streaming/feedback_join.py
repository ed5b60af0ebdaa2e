"""J1 on streams: feedback meets its anomaly within a time range, state is dropped behind the watermarks.

Both sides have a watermark of ``DELAY`` on their own times.  Feedback counts for an anomaly from the anomaly's
time to ``WITHIN`` after it; that condition lets the join drop an anomaly once all feedback in reach must
have come, and feedback once all anomalies in reach must have.  Feedback that leaves the state without an anomaly
comes out with ``matched`` false and null anomaly columns, so it can be counted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DELAY = "1 hour"
WITHIN = "1 day"


def join_streams(anomalies: DataFrame, feedback: DataFrame, within: str = WITHIN, delay: str = DELAY, unmatched: bool = False) -> DataFrame:
    """``anomalies`` (event_id, event_time, any more) and ``feedback`` (anomaly_id, received_at, any more) joined on the id.

    With ``unmatched`` also the feedback that no anomaly was found for, once that is sure.
    """
    a = anomalies.withColumn("_aid", F.col("event_id").cast("string")).withWatermark("event_time", delay)
    f = feedback.withWatermark("received_at", delay)
    same = F.expr(f"_aid = anomaly_id and received_at >= event_time and received_at <= event_time + interval {within}")
    out = f.join(a, same, "left_outer" if unmatched else "inner")
    return out.withColumn("matched", F.col("_aid").isNotNull()).drop("_aid")
