import json
import tempfile

from pyspark.sql import functions as F

from conftest import SF_SMALL
from riskflow.models.registry import ModelRegistry
from riskflow.plans.model_queries import feats
from riskflow.sources.files import feedback_dead_letters, read_feedback_jsonl, read_transactions_csv, missing_columns
from riskflow.streaming.feedback_loop import FeedbackLoop, publish_feedback, run_updater_once

FEATS = {"amount": 900.0, "amount_ratio": 0.9, "balance_diff_orig": 0.0, "is_transfer": 1, "is_cashout": 0,
         "hour_of_day": 8, "txn_velocity_1h": 1}


def _fb(i, label="true_positive"):
    return json.dumps({"anomaly_id": f"e{i}", "label": label, "analyst_id": "a", "features": FEATS})


def test_batches_across_micro_batches_and_forced_flush(spark):
    d = tempfile.mkdtemp(prefix="riskflow-loop-", dir="/tmp")
    hold = feats(spark, SF_SMALL).cache()
    loop = FeedbackLoop(spark, hold, d, ModelRegistry(spark, d + "/reg"), batch_size=3,
                        minimums={"precision": 0.0, "recall": 0.0, "pr_auc": 0.0})
    b0 = spark.createDataFrame([(i, _fb(i)) for i in range(2)] + [(2, "{bad json}")], "event_id long, raw string")
    s0 = loop.process(b0, 0)
    assert s0["updates"] == 0 and s0["accepted"] == 2  # 2 rows pending
    b1 = spark.createDataFrame([(i, _fb(i, "false_positive")) for i in range(3, 7)], "event_id long, raw string")
    s1 = loop.process(b1, 1)
    assert s1["updates"] == 2 and s1["update_count"] == 2  # 6 rows -> two full batches
    s1b = loop.process(b1, 1)  # retried batch recomputes from batch 0 state: same result
    assert s1b["update_count"] == 2
    assert spark.read.parquet(f"{d}/pending/batch_id=1").count() == 0
    summ = loop.summary().first()
    assert (summ["messages_seen"], summ["accepted"], summ["updates"]) == (7, 6, 2)
    assert spark.read.parquet(f"{d}/signals").count() == 2  # the retry replaced its signals
    loop.process(spark.createDataFrame([(9, _fb(9))], "event_id long, raw string"), 2)
    s3 = loop.flush()
    assert (s3["updates"], s3["last_batch_size"], s3["step"]) == (3, 1, 1)
    assert loop.flush()["updates"] == 3  # nothing pending
    # the next micro-batch continues from the flush
    s4 = loop.process(spark.createDataFrame([(i, _fb(i)) for i in range(10, 13)], "event_id long, raw string"), 3)
    assert (s4["updates"], s4["update_count"]) == (4, 4)


def test_failing_candidate_never_goes_live(spark):
    d = tempfile.mkdtemp(prefix="riskflow-loop-", dir="/tmp")
    hold = feats(spark, SF_SMALL).cache()
    reg = ModelRegistry(spark, d + "/reg")
    loop = FeedbackLoop(spark, hold, d, reg, batch_size=2, minimums={"precision": 1.1, "recall": 0.0, "pr_auc": 0.0})
    b = spark.createDataFrame([(i, _fb(i)) for i in range(2)], "event_id long, raw string")
    s = loop.process(b, 0)
    assert s["failed"] == 1 and s["update_count"] == 0
    assert reg.validate(["online_logit"]) == {"online_logit": False}


def test_one_shot_updater_flushes_everything(spark):
    d = tempfile.mkdtemp(prefix="riskflow-loop-", dir="/tmp")
    loop = FeedbackLoop(spark, feats(spark, SF_SMALL), d, ModelRegistry(spark, d + "/reg"), batch_size=500,
                        minimums={"precision": 0.0, "recall": 0.0, "pr_auc": 0.0})
    b = spark.createDataFrame([(i, _fb(i)) for i in range(3)], "event_id long, raw string")
    r = run_updater_once(loop, b).first()
    assert r["updates"] == 1 and r["online_update_count"] == 1
    # a second run is one update of everything, from the model of the first, whatever the batch size
    again = FeedbackLoop(spark, feats(spark, SF_SMALL), d, ModelRegistry(spark, d + "/reg"), batch_size=2,
                         minimums={"precision": 0.0, "recall": 0.0, "pr_auc": 0.0})
    r = run_updater_once(again, spark.createDataFrame([(i, _fb(i)) for i in range(3, 10)], "event_id long, raw string")).first()
    assert (r["updates"], r["online_update_count"], r["last_batch_size"]) == (2, 2, 7)
    assert ModelRegistry(spark, d + "/reg").live_version("online_logit") == 2


def test_unreadable_state_fails_the_run(spark, tmp_path):
    import pytest

    folder = tmp_path / "state" / "batch_id=0" / "step=0"
    folder.mkdir(parents=True)
    (folder / "part-0.parquet").write_text("no parquet file")
    loop = FeedbackLoop(spark, feats(spark, SF_SMALL), str(tmp_path), ModelRegistry(spark, str(tmp_path / "reg")))
    with pytest.raises(Exception, match="(?i)parquet|footer|magic"):
        loop.process(spark.createDataFrame([(1, _fb(1))], "event_id long, raw string"), 1)


def test_live_pointer_moves_back_and_forth(spark, tmp_path):
    reg = ModelRegistry(spark, str(tmp_path))
    for v in (1, 2):
        reg.save("m", v, "logistic", {"v": v})
    assert reg.live_version("m") == 2  # no pointer: the newest
    reg.set_live("m", 2)
    reg.set_live("m", 1)
    assert reg.live_version("m") == 1 and reg.load("m")["params"] == {"v": 1}
    assert reg.versions("nothing") == []


def test_two_writers_of_the_pointer_lose_no_change(spark, tmp_path):
    a, b = ModelRegistry(spark, str(tmp_path)), ModelRegistry(spark, str(tmp_path))
    a.set_live_all({"forest": 1, "net": 1, "logit": 1})
    seen = a._last_entry()
    b.set_live("logit", 2)  # between a's read and its write
    assert not a._commit(seen[0] + 1, seen[1] | {"forest": 3})  # the entry is taken
    a.set_live("forest", 3)
    assert [r.live_version(n) for r in (a, b) for n in ("forest", "net", "logit")] == [3, 1, 2] * 2
    from concurrent.futures import ThreadPoolExecutor

    with ThreadPoolExecutor(4) as pool:
        list(pool.map(lambda k: ModelRegistry(spark, str(tmp_path)).live_version("net"), range(8)))
    assert [p.name for p in (tmp_path / "_live").iterdir() if p.name.endswith(".tmp")] == []


def test_csv_files_are_read_by_their_own_headers(spark, tmp_path):
    folder = tmp_path / "some files"
    folder.mkdir()
    (folder / "a.csv").write_text('"step","type",amount\n1,DEBIT,2.5\n2,DEBIT,3.5\n')
    assert read_transactions_csv(spark, str(folder)).columns == ["step", "type", "amount"]
    (folder / "b.csv").write_text("amount,type,step\n7.0,TRANSFER,3\n")
    (folder / "c.csv").write_text("amount,step,isFraud,extra\n8.0,4,1,x\n")
    t = read_transactions_csv(spark, str(folder))
    got = {r["step"]: (r["type"], r["amount"], r["isFraud"], r["extra"]) for r in t.collect()}
    assert got == {1: ("DEBIT", 2.5, None, None), 2: ("DEBIT", 3.5, None, None), 3: ("TRANSFER", 7.0, None, None), 4: (None, 8.0, 1, "x")}
    assert t.schema["step"].dataType.typeName() == "integer"


def test_jsonl_and_csv_sources_and_publish(spark):
    d = tempfile.mkdtemp(prefix="riskflow-io-", dir="/tmp")
    with open(f"{d}/fb.jsonl", "w") as fh:
        fh.write(_fb(1) + "\n\n   \n[1, 2]\n" + _fb(2) + "\n")
    fb = read_feedback_jsonl(spark, f"{d}/fb.jsonl")
    assert fb.count() == 2
    dead = feedback_dead_letters(spark, f"{d}/fb.jsonl").collect()
    assert [(r["raw"], r["error"]) for r in dead] == [("[1, 2]", "Payload JSON must decode to an object.")]
    with open(f"{d}/t.csv", "w") as fh:
        fh.write("step,type,amount,nameOrig,isFraud\n1,PAYMENT,9.5,C1,0\n2,TRANSFER,300.0,C2,1\n")
    t = read_transactions_csv(spark, f"{d}/t.csv")
    assert t.schema["amount"].dataType.typeName() == "double"
    assert missing_columns(t) == ["oldbalanceOrg", "newbalanceOrig", "nameDest", "oldbalanceDest",
                                  "newbalanceDest", "isFlaggedFraud"]
    req = spark.createDataFrame([(1, _fb(1)), (2, '{"label": "x"}')], "event_id long, raw string")
    c = publish_feedback(req, f"{d}/published").first()
    assert c.asDict() == {"feedback_requests_total": 1.0, "feedback_published_total": 1.0, "feedback_publish_errors_total": 0.0}
    line = json.loads(spark.read.text(f"{d}/published").first()[0])
    assert line["anomaly_id"] == "e1" and line["received_at"].endswith("Z")
    assert line["features"] == FEATS and line["notes"] is None


def test_report_sink_writes_one_json_row(spark):
    from riskflow.plans.table_queries import q_profile_overall
    from riskflow.sources.files import write_report

    d = tempfile.mkdtemp(prefix="riskflow-report-", dir="/tmp")
    write_report(q_profile_overall(spark, SF_SMALL), f"{d}/eda")
    rows = [json.loads(line) for line in (r[0] for r in spark.read.text(f"{d}/eda").collect())]
    assert len(rows) == 1 and rows[0]["rows"] == 1000 and rows[0]["cols"] == 11
