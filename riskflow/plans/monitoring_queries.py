"""Registered queries: counters, exposition, rates, ratios, alerts, readiness."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from riskflow.contract import FEATURES_V1, TOPIC_ANOMALY
from riskflow.operators import feedback as FB
from riskflow.operators import monitoring as MON
from riskflow.operators import readiness as RD
from riskflow.plans import feedback_queries as FQ
from riskflow.plans import model_queries as MQ
from riskflow.plans.events_queries import routed
from riskflow.session import checkpoint_dir, cut_lineage
from riskflow.sources import adapters
from riskflow.sources.files import write_report
from riskflow.sources.tables import events

R = 9
LATENCY_SLO_MS = 500.0
RATE_RANGE_S = 300  # rate(...[5m])
INCREASE_RANGE_S = 3600


def samples(spark, sf_dir):
    return adapters.metric_samples(events(spark, sf_dir))


def counters(spark, sf_dir):
    return MON.stream_counters(routed(spark, sf_dir), "ts", "hour")


def q_stream_counters(spark, sf_dir):
    return counters(spark, sf_dir)


def q_metrics_exposition(spark, sf_dir):
    from riskflow.contract import ONLINE_BATCH_SIZE
    fb = FB.accept_for_learning(FQ.feedback_raw(spark, sf_dir))
    metrics = counters(spark, sf_dir).unionByName(MON.feedback_metrics(fb, ONLINE_BATCH_SIZE))
    return MON.exposition(metrics)


def q_event_rate_sliding(spark, sf_dir):
    r = MON.rates(samples(spark, sf_dir), RATE_RANGE_S)
    return r.select("name", "ts", F.round("increase", R).alias("increase_5m"), F.round("rate_per_s", R).alias("rate_per_s"))


def q_counter_increase(spark, sf_dir):
    r = MON.rates(samples(spark, sf_dir), INCREASE_RANGE_S)
    return r.select("name", "ts", F.round("increase", R).alias("increase_1h"))


def q_anomaly_ratio_window(spark, sf_dir):
    r = MON.ratio(samples(spark, sf_dir), "stream_events_anomaly_total", "stream_events_in_total", RATE_RANGE_S)
    return r.select("ts", F.round("ratio", R).alias("ratio"))


def q_alerts_fired(spark, sf_dir):
    return MON.alerts(samples(spark, sf_dir))


def q_readiness_gate(spark, sf_dir):
    """A demo run (route, publish feedback on the anomalies, update once) and a benchmark leave reports, which are judged."""
    from riskflow.models.registry import ModelRegistry
    from riskflow.streaming.feedback_loop import FeedbackLoop, run_updater_once

    base = f"{checkpoint_dir(spark).rstrip('/')}/reports/{uuid.uuid4().hex}"
    flow = cut_lineage(routed(spark, sf_dir).select("event_id", "topic"))  # read by the join and by the report
    anomalies = flow.where(F.col("topic") == TOPIC_ANOMALY).select(F.col("event_id").cast("string").alias("anomaly_id"))
    valid = FB.validate_requests(FQ.feedback_raw(spark, sf_dir)).where(F.col("status") == "accepted")
    published = cut_lineage(valid.join(anomalies, "anomaly_id").select("event_id", "raw"))  # read by the count and by the update
    loop = FeedbackLoop(spark, MQ.feats(spark, sf_dir).select(*FEATURES_V1, "isFraud"), f"{base}/loop", ModelRegistry(spark, f"{base}/models"))
    write_report(RD.demo_report(flow, published.count(), run_updater_once(loop, published)), f"{base}/demo")
    write_report(RD.benchmark_report(MQ.q_latency_summary(spark, sf_dir), MQ.q_quality_at_budget(spark, sf_dir)), f"{base}/benchmark")
    return RD.readiness(spark, f"{base}/demo", f"{base}/benchmark", LATENCY_SLO_MS)


QUERIES = {
    "stream_counters": q_stream_counters,
    "metrics_exposition": q_metrics_exposition,
    "event_rate_sliding": q_event_rate_sliding,
    "counter_increase": q_counter_increase,
    "anomaly_ratio_window": q_anomaly_ratio_window,
    "alerts_fired": q_alerts_fired,
    "readiness_gate": q_readiness_gate,
}
