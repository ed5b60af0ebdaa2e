"""Payload sources, the configured job over them, and the counters that it leaves."""

import datetime as dt
import os
import time

import pytest
from pyspark.sql import functions as F

from conftest import event
from riskflow.models.demo import demo_models
from riskflow.sources.payloads import SourceOptions, payloads, publish_records
from riskflow.streaming import metrics as M
from riskflow.streaming.config import StreamConfig
from riskflow.streaming.payload_job import run_payload_job

DAY = dt.datetime(2025, 7, 3)


def _records(spark, root, rows, topic="raw-events"):
    """(key, bytes, day) rows as one more file of a topic."""
    df = spark.createDataFrame([(k, bytearray(v), DAY + dt.timedelta(days=d)) for k, v, d in rows], "key string, value binary, sent_at timestamp")
    publish_records(df.coalesce(1), root, topic)


def test_configuration_from_the_environment():
    c = StreamConfig.from_env({"RAW_EVENTS_TOPIC": "in", "DLQ_TOPIC": "bad", "ANOMALY_THRESHOLD": "0.7", "PAYLOAD_FORMAT": "lines",
                               "STARTING_POSITION": "latest", "MAX_FILES_PER_POLL": "4"})
    assert (c.raw_topic, c.dlq_topic, c.anomaly_topic, c.score_threshold) == ("in", "bad", "anomalies", 0.7)
    assert c.source == SourceOptions("lines", "latest", max_files=4)
    assert StreamConfig.from_env({}) == StreamConfig()


@pytest.mark.parametrize("env", [{"ANOMALY_THRESHOLD": "1.5"}, {"DLQ_TOPIC": "anomalies"}, {"RAW_EVENTS_TOPIC": ""}, {"PAYLOAD_FORMAT": "xml"},
                                 {"STARTING_POSITION": "yesterday"}, {"MAX_FILES_PER_POLL": "0"}, {"MAX_BYTES_PER_POLL": "-1"},
                                 {"MAX_FILES_PER_POLL": "1", "MAX_BYTES_PER_POLL": "1"}])
def test_configuration_refuses_what_cannot_run(env):
    with pytest.raises(ValueError):
        StreamConfig.from_env(env)


def test_records_lines_and_files_give_the_same_messages(spark, tmp_path):
    texts = [event(event_id="a").encode(), event(event_id="b").encode() + b"\xff", "ü".encode()]
    _records(spark, f"{tmp_path}/r", [("k", t, 0) for t in texts], "in")
    for name in ("l/in", "f/in"):
        os.makedirs(tmp_path / name)
    (tmp_path / "l/in/part").write_bytes(b"\n".join(texts) + b"\n\n  \n")
    for i, t in enumerate(texts):
        (tmp_path / f"f/in/m{i}").write_bytes(t)
    got = {}
    for fmt in ("records", "lines", "files"):
        rows = payloads(spark, f"{tmp_path}/{fmt[0]}", "in", SourceOptions(fmt), streaming=False)
        got[fmt] = sorted(bytes(r["value"]) for r in rows.collect())
        assert rows.columns == ["topic_read", "message_key", "value", "sent_at"]
    assert got["records"] == got["lines"] == got["files"] == sorted(texts)
    keys = payloads(spark, f"{tmp_path}/f", "in", SourceOptions("files"), streaming=False)
    assert sorted(r[0] for r in keys.select("message_key").collect()) == ["m0", "m1", "m2"]


def test_a_topic_nobody_wrote_to_is_empty(spark, tmp_path):
    sink = run_payload_job(spark, f"{tmp_path}/in", f"{tmp_path}/out", StreamConfig(), demo_models())
    assert sink.count() == 0


def test_job_goes_on_from_its_checkpoint_and_reads_its_topic_only(spark, tmp_path):
    config = StreamConfig(dlq_topic="bad", source=SourceOptions(starting="2025-07-04"))
    log = M.MetricsLog(spark, f"{tmp_path}/metrics")
    run = lambda: run_payload_job(spark, f"{tmp_path}/in", f"{tmp_path}/job", config, demo_models(), log)
    _records(spark, f"{tmp_path}/in", [("early", event().encode(), 0), ("a", event(amount=900.0).encode(), 1), ("b", b"\xff", 1)])
    _records(spark, f"{tmp_path}/in", [("x", event().encode(), 5)], "other")
    assert {r["message_key"] for r in run().collect()} == {"a", "b"}
    _records(spark, f"{tmp_path}/in", [("c", event(amount=1.0).encode(), 2), (None, b"[]", 3)])
    rows = {r["message_key"]: (r["topic"], r["error"]) for r in run().collect()}
    assert rows == {"a": ("anomalies", None), "b": ("bad", "Invalid JSON payload"), "c": ("metrics", None),
                    None: ("bad", "Payload JSON must decode to an object.")}
    value = {(r["batch_id"], r["name"]): r["value"] for r in log.samples().collect()}
    assert [value[i, "stream_events_in_total"] for i in (0, 1)] == [2.0, 4.0]
    assert [value[i, "stream_events_dlq_total"] for i in (0, 1)] == [1.0, 2.0]
    assert value[1, "stream_events_anomaly_total"] == value[1, "stream_events_normal_total"] == 1.0
    took = [value[i, M.LATENCY_LAST] for i in (0, 1)]
    assert min(took) > 0 and value[1, M.LATENCY_TOTAL] == 2 * sum(took)


def test_without_models_valid_events_go_to_the_feature_topic(spark, tmp_path):
    _records(spark, f"{tmp_path}/in", [("a", event().encode(), 0)])
    sink = run_payload_job(spark, f"{tmp_path}/in", f"{tmp_path}/job", StreamConfig())
    assert [(r["topic"], r["message_key"]) for r in sink.collect()] == [("feature-events", "a")]


def test_missing_models_of_a_configured_registry_are_refused(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        run_payload_job(spark, f"{tmp_path}/in", f"{tmp_path}/job", StreamConfig(model_root=f"{tmp_path}/models"))


def test_latest_starts_at_the_first_start_and_keeps_it(spark, tmp_path):
    os.makedirs(tmp_path / "in/raw-events")
    old = tmp_path / "in/raw-events/old"
    old.write_text(event(event_id="old"))
    os.utime(old, (time.time() - 3600,) * 2)
    config = StreamConfig(source=SourceOptions("lines", "latest"))
    run = lambda: run_payload_job(spark, f"{tmp_path}/in", f"{tmp_path}/job", config)
    assert run().count() == 0
    time.sleep(1.1)  # file times may be whole seconds
    (tmp_path / "in/raw-events/new").write_text(event(event_id="new"))
    time.sleep(1.1)
    assert [r[0] for r in run().select(F.get_json_object("value", "$.event_id")).collect()] == ["new"]
    with pytest.raises(ValueError):
        payloads(spark, f"{tmp_path}/in", "raw-events", config.source)


def test_poll_size_cuts_micro_batches(spark, tmp_path):
    for i in range(3):
        _records(spark, f"{tmp_path}/in", [(str(i), event().encode(), 0)])
    log = M.MetricsLog(spark, f"{tmp_path}/metrics")
    run_payload_job(spark, f"{tmp_path}/in", f"{tmp_path}/job", StreamConfig(source=SourceOptions(max_files=1)), demo_models(), log)
    assert sorted(r["rows"] for r in log.batches().collect()) == [1, 1, 1]


def test_samples_of_written_batches(spark, tmp_path):
    log = M.MetricsLog(spark, f"{tmp_path}/metrics")
    assert log.samples().count() == 0 and log.latency_summary().first()["n"] == 0
    log.write("q", 0, "2025-07-03T10:00:00Z", 10, 100.0, {M.EVENTS_IN: 10.0})
    log.write("q", 1, "2025-07-03T10:01:00Z", 99, 999.0, {M.EVENTS_IN: 99.0})
    log.write("q", 1, "2025-07-03T10:01:00Z", 30, 200.0, {M.EVENTS_IN: 30.0})  # run again: replaced, not added
    log.write("q", 2, "2025-07-03T10:09:00Z", 20, 50.0, {M.EVENTS_IN: 20.0})
    s = log.latency_summary().first()
    assert (s["n"], s["p50_ms"], s["max_ms"]) == (60, 150.0, 200.0)
    assert s["mean_ms"] == pytest.approx((10 * 100 + 30 * 200 + 20 * 50) / 60)
    average = {r["ts"].minute: r["ratio"] for r in log.average_latency(300).collect()}
    assert average[1] == pytest.approx(200.0) and average[9] == pytest.approx(50.0)


def test_a_failed_write_is_raised(spark, tmp_path, monkeypatch):
    log = M.MetricsLog(spark, f"{tmp_path}/metrics")
    _records(spark, f"{tmp_path}/in", [("a", event().encode(), 0)])

    def broken(*_):
        raise OSError("disk")

    monkeypatch.setattr(log, "write", broken)
    with pytest.raises(OSError):
        run_payload_job(spark, f"{tmp_path}/in", f"{tmp_path}/job", StreamConfig(), demo_models(), log)
