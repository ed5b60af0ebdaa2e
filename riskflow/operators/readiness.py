"""Readiness (O7): judged from the reports that the demo run and the benchmark run left behind.

A check whose report, or whose field in it, is missing fails; it never fails the query.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskflow.contract import TOPIC_ANOMALY, TOPIC_DLQ, TOPIC_NORMAL
from riskflow.sources.files import write_report

DEMO_REPORT = ("events_in long, anomalies long, metrics long, dlq long, feedback_published long, online_updated boolean, "
               "online_update_count long")
BENCHMARK_REPORT = ("latency_ms struct<p50: double, p95: double, max: double>, "
                    "quality_at_budget struct<alerts_sent: long, tp: long, positives: long, precision: double, recall: double>")


def one_row(*parts: DataFrame) -> DataFrame:
    """The columns of one-row frames in one row (a column of nulls stays null)."""
    u = parts[0]
    for p in parts[1:]:
        u = u.unionByName(p, allowMissingColumns=True)
    return u.agg(*[F.first(c, ignorenulls=True).alias(c) for c in u.columns])


def demo_report(routed: DataFrame, published: int, loop_summary: DataFrame) -> DataFrame:
    """One row: routed events by topic, feedback published for them, and what the learning loop made of it."""
    topic = F.col("topic")
    counts = routed.agg(
        F.count(F.lit(1)).alias("events_in"), F.count_if(topic == TOPIC_ANOMALY).alias("anomalies"),
        F.count_if(topic == TOPIC_NORMAL).alias("metrics"), F.count_if(topic == TOPIC_DLQ).alias("dlq"),
        F.lit(published).cast("long").alias("feedback_published"))
    return one_row(counts, loop_summary.select((F.col("updates") >= 1).alias("online_updated"), "online_update_count"))


def benchmark_report(latency: DataFrame, quality: DataFrame) -> DataFrame:
    """One row: latency (p50_ms, p95_ms, max_ms) and quality under the alert budget."""
    lat = latency.select(F.struct(*[F.col(f"{n}_ms").alias(n) for n in ("p50", "p95", "max")]).alias("latency_ms"))
    return one_row(lat, quality.select(F.struct("alerts_sent", "tp", "positives", "precision", "recall").alias("quality_at_budget")))


def read_report(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The one row of a written report; a row of nulls if there is none."""
    try:
        return one_row(spark.read.schema(schema).json(path))
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return one_row(spark.createDataFrame([], schema))


def readiness(spark: SparkSession, demo_path: str, benchmark_path: str, latency_slo_ms: float) -> DataFrame:
    """(check, ok), and ``overall_ok`` = all checks pass."""
    demo = read_report(spark, demo_path, DEMO_REPORT)
    bench = read_report(spark, benchmark_path, BENCHMARK_REPORT)
    checks = {
        "demo_has_anomalies": F.col("anomalies") >= 1,
        "demo_has_feedback": F.col("feedback_published") >= 1,
        "demo_online_updated": F.col("online_updated"),
        "benchmark_latency_slo_met": F.col("latency_ms.p95") <= latency_slo_ms,
        "benchmark_quality_fields_present": F.col("quality_at_budget.precision").isNotNull() & F.col("quality_at_budget.recall").isNotNull(),
    }
    rows = F.array(*[F.struct(F.lit(n).alias("check"), F.coalesce(c, F.lit(False)).alias("ok")) for n, c in checks.items()])
    judged = one_row(demo, bench).select(rows.alias("r"))
    overall = F.struct(F.lit("overall_ok").alias("check"), F.forall("r", lambda x: x["ok"]).alias("ok"))
    return judged.select(F.inline(F.concat("r", F.array(overall))))


def write_readiness(spark: SparkSession, demo_path: str, benchmark_path: str, latency_slo_ms: float, path: str) -> bool:
    """Write the readiness report with the reports it was judged from; True if all checks pass."""
    checks = readiness(spark, demo_path, benchmark_path, latency_slo_ms)
    report = checks.where("check <> 'overall_ok'").agg(F.map_from_entries(F.collect_list(F.struct("check", "ok"))).alias("checks"))  # five checks
    report = report.select(F.forall(F.map_values("checks"), lambda x: x).alias("overall_ok"), F.lit(latency_slo_ms).alias("latency_slo_ms"), "checks")
    demo = read_report(spark, demo_path, DEMO_REPORT).select(F.struct("*").alias("demo"))
    bench = read_report(spark, benchmark_path, BENCHMARK_REPORT).select(F.struct("*").alias("benchmark"))
    write_report(one_row(report, demo, bench), path)
    return bool(spark.read.json(path).first()["overall_ok"])
