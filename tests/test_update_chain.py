"""The speculative chain against one update after another, with exact evaluations."""

import random

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from riskflow.contract import FEATURES_V1
from riskflow.models.base import feature_refs
from riskflow.models.fixed import FIXED_LOGIT
from riskflow.models.params import LogitParams
from riskflow.models.registry import ModelRegistry
from riskflow.operators import evaluate as EV
from riskflow.operators import feedback as FB
from riskflow.plans.model_queries import feats
from riskflow.streaming import update_chain as UC
from riskflow.streaming.feedback_loop import FeedbackLoop

START = LogitParams(list(FIXED_LOGIT.weights), FIXED_LOGIT.bias, version=0)


@pytest.fixture(scope="module")
def holdout(spark):
    return feats(spark, SF_SMALL).select(*FEATURES_V1, "isFraud").cache()


@pytest.fixture(scope="module")
def numbered(spark, holdout):
    rnd = random.Random(1)
    rows = [(i, rnd.randint(0, 1), *[float(v) for v in (rnd.expovariate(1 / 200), rnd.random(), rnd.gauss(0, 50), rnd.randint(0, 1), rnd.randint(0, 1), rnd.randint(0, 23), rnd.randint(1, 3))]) for i in range(230)]
    df = spark.createDataFrame(rows, "event_id long, y int, " + ", ".join(f"{c} double" for c in FEATURES_V1)).repartition(4)
    return FB.cut_batches(df, "event_id", 20)


def measured(holdout, m):
    return EV.holdout_evaluation(holdout.withColumn("_s", F.expr(m.sql(feature_refs()))), "_s", "isFraud").first()


def one_by_one(numbered, holdout, lr, minimums):
    live, out = START, []
    for b in range(12):
        g = FB.gradient_step(numbered.where(F.col("batch_no") == b), live.weights, live.bias).first()
        cand = LogitParams([w - lr * g[f"grad_{i}"] for i, w in enumerate(live.weights)], live.bias - lr * g["grad_bias"], version=live.version + 1)
        m = measured(holdout, cand)
        ok = m["precision_at_0_5"] >= minimums["precision"] and m["recall_at_0_5"] >= minimums["recall"] and m["pr_auc"] >= minimums["pr_auc"]
        out.append((b, int(g["n"]), cand.version, ok, cand))
        live = cand if ok else live
    return out


def test_chain_equals_single_updates(spark, numbered, holdout, monkeypatch):
    monkeypatch.setattr(UC, "WINDOW", 5)
    lr = 3e-4
    free = one_by_one(numbered, holdout, lr, {"precision": 0.0, "recall": 0.0, "pr_auc": 0.0})
    aps = sorted(measured(holdout, c)["pr_auc"] for *_, c in free)
    packed = UC.packed_batches(numbered)
    mixed = 0
    for least in (0.0, aps[len(aps) // 2], 1.1):  # all pass, some, none
        minimums = {"precision": 0.0, "recall": 0.0, "pr_auc": least}
        want = one_by_one(numbered, holdout, lr, minimums)
        windows = list(UC.run_chain(packed, 12, START, lr, holdout, minimums))
        got = [x for w in windows for x in w]
        assert [(b, n, c.version, ok) for b, n, c, ok in got] == [x[:4] for x in want]
        for (_, _, c, _), (*_, w) in zip(got, want, strict=True):
            assert c.weights == pytest.approx(w.weights, rel=1e-9) and c.bias == pytest.approx(w.bias, rel=1e-9)
        switches = sum(a != b for a, b in zip([True, *(x[3] for x in want)], [x[3] for x in want], strict=False))
        assert len(windows) <= 12 // 5 + 1 + switches
        mixed += 0 < sum(x[3] for x in want) < 12
    assert mixed or aps[0] == aps[-1]


def test_bounds_hold_the_exact_measures(spark, holdout):
    rnd = random.Random(2)
    models = [LogitParams([w * rnd.uniform(-2, 3) for w in START.weights], START.bias + rnd.gauss(0, 1)) for _ in range(6)]
    exact = {r["cand"]: r for r in UC.exact(holdout, models).collect()}
    for r in UC.bounds(holdout, models).collect():
        m = measured(holdout, models[r["cand"]])
        assert (r["tp"], r["fp"], r["rows_holdout"], r["odd"]) == (m["tp"], m["fp"], m["rows_holdout"], 0)
        assert r["ap_low"] <= m["pr_auc"] * (1 + 1e-12) and m["pr_auc"] <= r["ap_high"] * (1 + 1e-12)
        e = exact[r["cand"]]
        assert (e["precision_at_0_5"], e["recall_at_0_5"]) == (m["precision_at_0_5"], m["recall_at_0_5"]) and e["pr_auc"] == pytest.approx(m["pr_auc"], rel=1e-12)
    gaps = holdout.withColumn(FEATURES_V1[0], F.when(F.rand(1) < 0.1, None).otherwise(F.col(FEATURES_V1[0])))
    assert UC.bounds(gaps, models[:1]).first()["odd"] > 0 and len(UC.passes(gaps, models[:2], {"precision": 0.0, "recall": 0.0, "pr_auc": 0.0})) == 2
    assert UC.passes(holdout.limit(0), models[:2], {"precision": 0.0, "recall": 0.0, "pr_auc": 0.1}) == [False, False]


def _feedback(i):
    import json

    return json.dumps({"anomaly_id": f"e{i}", "label": "true_positive", "analyst_id": "a", "features": {c: 1.0 for c in FEATURES_V1}})


def test_limits_of_the_consumer(spark, holdout, tmp_path):
    for k in range(4):
        spark.createDataFrame([(10 * k + i, _feedback(10 * k + i)) for i in range(10)], "event_id long, raw string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = lambda: spark.readStream.schema("event_id long, raw string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    loop = FeedbackLoop(spark, holdout, str(tmp_path / "state"), ModelRegistry(spark, str(tmp_path / "reg")), batch_size=4, minimums={"precision": 0.0, "recall": 0.0, "pr_auc": 0.0})
    with pytest.raises(ValueError, match="max_messages"):
        loop.run_stream(source(), str(tmp_path / "ck"), max_messages=0)
    with pytest.raises(ValueError, match="max_idle_polls"):
        loop.run_stream(source(), str(tmp_path / "ck"), max_idle_polls=-1)
    loop.run_stream(source(), str(tmp_path / "ck"), max_messages=15, poll_s=0.2, timeout_s=120, force_flush=False)
    assert loop.summary().first()["messages_seen"] == 20
    loop.run_stream(source(), str(tmp_path / "ck"), max_idle_polls=5, poll_s=0.2, timeout_s=120)
    s = loop.summary().first()
    assert (s["messages_seen"], s["accepted"], s["updates"], s["online_update_count"]) == (40, 40, 10, 10)
