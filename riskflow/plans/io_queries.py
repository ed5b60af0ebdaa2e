"""Registered queries over file sources/sinks, fed with data Spark derives from the driver's tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from riskflow.contract import EXPECTED_COLUMNS, FEATURES_V1
from riskflow.operators import feedback as FB
from riskflow.operators.profile import validate_table
from riskflow.plans.feedback_queries import feedback_raw
from riskflow.plans.table_queries import txn
from riskflow.session import checkpoint_dir
from riskflow.sources.files import feedback_dead_letters, read_feedback_jsonl, read_transactions_csv
from riskflow.streaming.feedback_loop import publish_feedback

R = 9


def _scratch(spark, name: str) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/io/{name}-{uuid.uuid4().hex}"


def q_txn_csv_validation(spark, sf_dir):
    """S1 + V9: the transaction table written as header CSV, scanned back with the schema, validated."""
    path = _scratch(spark, "txn-csv")
    txn(spark, sf_dir).select(*EXPECTED_COLUMNS).write.option("header", True).csv(path)
    return validate_table(read_transactions_csv(spark, path))


def q_feedback_jsonl_accept(spark, sf_dir):
    """S4 + V11: feedback as JSON lines, scanned back (blank/non-object lines dropped), accepted for learning."""
    path = _scratch(spark, "feedback-jsonl")
    feedback_raw(spark, sf_dir).select("raw").write.text(path)
    a = FB.accept_for_learning(read_feedback_jsonl(spark, path))
    return a.select("anomaly_id", "accepted", "y", "skip_reason", *[F.round(c, R).alias(c) for c in FEATURES_V1])


def q_feedback_publish(spark, sf_dir):
    """T7 + S8: validated requests published as JSON lines; request/publish/error counters."""
    return publish_feedback(feedback_raw(spark, sf_dir), _scratch(spark, "published"))


def q_feedback_publish_accept(spark, sf_dir):
    """T7 -> S4 -> V11: what was published, read back and accepted for learning."""
    path = _scratch(spark, "published")
    publish_feedback(feedback_raw(spark, sf_dir), path)
    a = FB.accept_for_learning(read_feedback_jsonl(spark, path))
    return a.select("anomaly_id", "accepted", "y", "skip_reason", *[F.round(c, R).alias(c) for c in FEATURES_V1])


def q_feedback_dead_lines(spark, sf_dir):
    """The lines of a feedback file that do not decode to an object, with their error."""
    path = _scratch(spark, "feedback-jsonl")
    feedback_raw(spark, sf_dir).select("raw").write.text(path)
    return feedback_dead_letters(spark, path)


QUERIES = {
    "txn_csv_validation": q_txn_csv_validation,
    "feedback_jsonl_accept": q_feedback_jsonl_accept,
    "feedback_publish": q_feedback_publish,
    "feedback_publish_accept": q_feedback_publish_accept,
    "feedback_dead_lines": q_feedback_dead_lines,
}
