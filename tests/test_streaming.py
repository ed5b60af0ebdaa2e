import tempfile

from pyspark.sql import functions as F

from conftest import SF_SMALL
from riskflow.models.demo import demo_models
from riskflow.operators.events import parse_events, route_events
from riskflow.sources import adapters
from riskflow.streaming import jobs


def _landing(spark):
    """Two event files (earlier ids/times first) in a fresh landing folder."""
    d = tempfile.mkdtemp(prefix="riskflow-landing-", dir="/tmp")
    ev = spark.read.parquet(f"{SF_SMALL}/events.parquet")
    ev.where("event_id < 500").coalesce(1).write.parquet(f"{d}/a")
    ev.where("event_id >= 500").coalesce(1).write.parquet(f"{d}/b")
    return d, ev


def test_stream_restart_equals_batch(spark):
    d, ev = _landing(spark)
    landing = tempfile.mkdtemp(prefix="riskflow-in-", dir="/tmp")
    import glob
    import shutil

    out, ckpt = jobs.stream_location(spark, "test-restart")
    files_a = glob.glob(f"{d}/a/*.parquet")
    files_b = glob.glob(f"{d}/b/*.parquet")
    shutil.copy(files_a[0], f"{landing}/part-a.parquet")

    def run():
        src = jobs.event_source(spark, landing, file_glob="*.parquet", schema=ev.schema)
        s = jobs.scoring_stream(src, demo_models()).select("event_id", "error", "topic")
        jobs.run_available_now(s, out, ckpt, partition_by=["topic"])

    run()
    first = spark.read.parquet(out).count()
    assert first == 500
    shutil.copy(files_b[0], f"{landing}/part-b.parquet")
    run()  # resumes from the checkpoint: only the new file is processed
    got = spark.read.parquet(out).select("event_id", "topic", "error")
    want = route_events(adapters.raw_event(ev), demo_models()).select("event_id", "topic", "error")
    assert got.count() == 1000
    assert got.exceptAll(want).count() == 0


def _raw(rows):
    """(id, user, minutes after noon) as raw events."""
    import json

    return [(i, json.dumps({"event_id": str(i), "timestamp": f"2025-07-03T{12 + m // 60:02d}:{m % 60:02d}:00Z", "user_id": u, "type": "DEBIT",
                            "amount": 1.0, "old_balance_orig": 0.0, "new_balance_orig": 0.0})) for i, u, m in rows]


def test_velocity_over_micro_batches_with_a_hot_user(spark, tmp_path, monkeypatch):
    import random

    from riskflow.operators import ordering
    from riskflow.streaming import velocity

    monkeypatch.setattr(ordering, "BUCKET_ROWS", 16)
    monkeypatch.setattr(ordering.grouped_row_number, "__defaults__", ("rn", 16, None))
    rnd = random.Random(3)
    rows = [(i, "hot" if rnd.random() < 0.4 else f"u{rnd.randint(0, 9)}", i * 400 // 600) for i in range(600)]
    rows[450] = (450, "hot", 10)  # noon's hour is closed long before
    rows[130] = (130, "hot", 50)  # a batch later, but its hour is open
    log = velocity.VelocityLog(spark, str(tmp_path / "log"), compact_every=2)
    for b in range(4):
        part = spark.createDataFrame([*_raw(rows[b * 150:b * 150 + 150]), (1000 + b, "{bad json}")], "event_id long, raw string").repartition(3)
        log.number(velocity.keyed_events(part), b)
        if b == 2:
            log.number(velocity.keyed_events(part), b)  # a retry changes nothing
    got = {r.event_id: (r.txn_velocity_1h, r.late) for r in log.rows().collect()}
    seen, want = {}, {}
    for i, u, m in rows:
        if i == 450:
            want[i] = (None, True)
            continue
        seen[u, m // 60] = seen.get((u, m // 60), 0) + 1
        want[i] = (seen[u, m // 60], False)
    assert got == want | {1000 + b: (None, False) for b in range(4)}
    assert sorted((r.batch_id, r.rows, r.late, r.snapshot) for r in log.progress().collect()) == [(0, 150, 0, False), (1, 150, 0, True), (2, 150, 0, False), (3, 150, 1, True)]
    # the last snapshot holds the open hours only
    hours = {r.hour_start.hour for r in spark.read.parquet(str(tmp_path / "log/counts/batch_id=3")).select("hour_start").distinct().collect()}
    assert hours and min(hours) >= 15


def test_velocity_stream_goes_on_after_a_restart(spark, tmp_path):
    from riskflow.streaming import velocity

    ev = spark.read.parquet(f"{SF_SMALL}/events.parquet")
    log = velocity.VelocityLog(spark, str(tmp_path / "log"))
    for k in range(2):
        jobs.land(ev, str(tmp_path / "in"), k, 2)
        source = jobs.event_source(spark, str(tmp_path / "in"), file_glob="*.parquet", schema=ev.schema)
        velocity.scored_with_velocity(log, adapters.raw_event(source), demo_models(), str(tmp_path / "sink"), str(tmp_path / "ck"))
    rows = log.rows().where("txn_velocity_1h is not null")
    want = jobs.keyed_velocity_batch(parse_events(adapters.raw_event(ev))).select("ingest_id", "txn_velocity_1h")
    late = log.progress().agg(F.sum("late")).first()[0]
    assert rows.count() + late == want.count()
    assert late or rows.select("event_id", "txn_velocity_1h").exceptAll(want).count() == 0
    sink = spark.read.parquet(str(tmp_path / "sink"))
    velocities = sink.select("event_id", F.get_json_object("value", "$.features.txn_velocity_1h").cast("int").alias("v")).where("v is not null")
    assert sink.count() == 1000 and velocities.join(rows, "event_id").where("v <> txn_velocity_1h").count() == 0


def test_sink_records_carry_dead_letter_and_enriched_payloads(spark):
    import json

    from riskflow.operators.events import sink_records

    base = {"event_id": "p-31", "timestamp": "2025-07-03T06:40:00Z", "user_id": "U8", "type": "TRANSFER",
            "amount": 910.0, "old_balance_orig": 1000.0, "new_balance_orig": 90.0, "isFraud": 1,
            "risk": 5, "device": {"os": "x", "ids": [1, 2]}, "scores": "own", "none": None}
    df = spark.createDataFrame([(1, json.dumps(base)), (2, "{bad json}"), (3, json.dumps({**base, "timestamp": "soon"})),
                                (4, None)], "event_id long, raw string")
    rec = {r["event_id"]: r for r in sink_records(route_events(df, demo_models())).collect()}
    good = json.loads(rec[1]["value"])
    assert rec[1]["topic"] == "anomalies" and "isFraud" not in good
    assert good["features"]["is_transfer"] == 1 and good["scores"]["ensemble_score"] >= 0.7
    dlq = json.loads(rec[2]["value"])
    assert rec[2]["topic"] == "dead-letter"
    assert dlq["error"] == "Invalid JSON payload" and dlq["raw_event"] == "{bad json}" and dlq["received_at"]
    assert good["risk"] == 5 and good["device"] == base["device"] and good["none"] is None
    stage = json.loads(rec[3]["value"])
    assert set(stage) == {"error", "raw_event"} and stage["error"].startswith("Invalid isoformat")
    assert stage["raw_event"] == {k: v for k, v in base.items() if k != "isFraud"} | {"timestamp": "soon"}
    assert json.loads(rec[4]["value"])["raw_event"] is None


def test_explicit_stream_limit_raises(spark, tmp_path):
    import pytest

    from riskflow.streaming.jobs import run_available_now

    src = tmp_path / "in"
    spark.range(20).repartition(4).write.parquet(str(src))
    stream = spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(str(src))
    with pytest.raises(TimeoutError):
        run_available_now(stream, str(tmp_path / "out"), str(tmp_path / "ck"), timeout_s=0.001)
    run_available_now(stream, str(tmp_path / "out2"), str(tmp_path / "ck2"))
    assert spark.read.parquet(str(tmp_path / "out2")).count() == 20


def test_stream_join_counts_feedback_without_an_anomaly(spark, tmp_path):
    from riskflow.streaming.feedback_join import join_streams

    day = "2025-07-03 "

    def run(step, anomalies, feedback):
        for name, rows, schema in (("a", anomalies, "event_id long, t string, score double"), ("f", feedback, "anomaly_id string, t string, label string")):
            spark.createDataFrame(rows, schema).selectExpr("*", "cast(t as timestamp) as at").drop("t").coalesce(1).write.mode("append").parquet(str(tmp_path / name))
        a = spark.readStream.schema("event_id long, score double, at timestamp").parquet(str(tmp_path / "a")).withColumnRenamed("at", "event_time")
        f = spark.readStream.schema("anomaly_id string, label string, at timestamp").parquet(str(tmp_path / "f")).withColumnRenamed("at", "received_at")
        jobs.run_available_now(join_streams(a, f, within="2 hours", unmatched=True), str(tmp_path / "out"), str(tmp_path / "ck"))

    run(0, [(1, day + "10:00", 0.9), (2, day + "10:30", 0.8)], [("1", day + "10:05", "tp"), ("7", day + "10:10", "none")])
    run(1, [(3, day + "13:30", 0.7)], [("2", day + "12:20", "fp"), ("3", day + "13:20", "early"), ("1", day + "12:30", "over")])
    run(2, [(4, day + "20:00", 0.6)], [("4", day + "20:00", "tp")])
    run(3, [(5, day + "23:00", 0.6)], [("5", day + "23:30", "tp")])
    got = {(r["label"], r["anomaly_id"]): (r["matched"], r["event_id"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {("tp", "1"): (True, 1), ("fp", "2"): (True, 2), ("tp", "4"): (True, 4), ("tp", "5"): (True, 5),
                   ("none", "7"): (False, None), ("early", "3"): (False, None), ("over", "1"): (False, None)}
