"""Stream features and routing on generated events, against the formulas in plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from conftest import event
from riskflow.functions.features import feature_columns, normalize_weights
from riskflow.models.demo import demo_models
from riskflow.operators.events import route_events
from riskflow.operators.scoring import route_topic

TYPES = ["PAYMENT", "TRANSFER", "CASH-OUT", "DEBIT", "CASH-IN"]


def routed(spark, payloads, models=None, **how):
    df = spark.createDataFrame(list(enumerate(payloads)), "i long, raw string")
    return [r for _, r in sorted((r["i"], r) for r in route_events(df, models, **how).collect())]


def generated(n):
    rnd = random.Random(20)
    for _ in range(n):
        yield {
            "type": rnd.choice(TYPES), "amount": round(rnd.expovariate(1 / 300), 2), "old_balance_orig": round(rnd.uniform(0, 900), 2),
            "new_balance_orig": round(rnd.uniform(0, 900), 2), "timestamp": f"2025-0{rnd.randint(1, 9)}-1{rnd.randint(0, 9)}T{rnd.randint(0, 23):02d}:{rnd.randint(0, 59):02d}:07" + rnd.choice(["Z", "+05:30", "-08:00", ""]),
        }


@pytest.mark.parametrize("velocity", [1, 4])
def test_features_of_generated_events(spark, velocity):
    events = list(generated(60))
    for e, r in zip(events, routed(spark, [event(**e) for e in events], velocity=velocity), strict=True):
        assert (r["topic"], r["error"]) == ("feature-events", None)
        assert r["amount_ratio"] == pytest.approx(e["amount"] / (e["old_balance_orig"] + 1))
        assert r["balance_diff_orig"] == pytest.approx(e["old_balance_orig"] - e["new_balance_orig"] - e["amount"], abs=1e-9)
        # the hour is read as written, whatever the offset
        assert (r["is_transfer"], r["is_cashout"], r["hour_of_day"], r["txn_velocity_1h"]) == (
            int(e["type"] == "TRANSFER"), int(e["type"] == "CASH-OUT"), int(e["timestamp"][11:13]), velocity)


def test_a_date_is_midnight_and_other_text_a_dead_letter(spark):
    date, text = routed(spark, [event(timestamp="2025-11-30"), event(timestamp="half past nine")])
    assert (date["hour_of_day"], date["error"]) == (0, None)
    assert (text["topic"], text["error"], text["amount_ratio"]) == ("dead-letter", "Invalid isoformat string: 'half past nine'", None)


def test_spellings_of_cash_out(spark):
    df = spark.createDataFrame([(t,) for t in ("CASH_OUT", "DEBIT", "CASH-OUT", "cash-out", None)], "t string")
    flag = next(c for c in feature_columns(F.lit(7.0), F.lit(2.0), F.lit(0.0), F.col("t"), F.lit(13), F.lit(2)) if "is_cashout" in str(c))
    assert [bool(r[0]) for r in df.select(flag).collect()] == [True, False, True, False, False]


def test_topics_follow_the_ensemble(spark):
    payloads = [event(**e) for e in generated(40)] + ["[]", event(timestamp="soon")]
    for r in routed(spark, payloads, demo_models(), threshold=0.4):
        want = "dead-letter" if r["error"] is not None else "anomalies" if r["ensemble_score"] >= 0.4 else "metrics"
        assert r["topic"] == want
    assert {r["topic"] for r in routed(spark, payloads, demo_models(), threshold=0.4)} == {"anomalies", "metrics", "dead-letter"}


def test_weights_add_up_to_one():
    for w in ((1, 1, 2), (0.2, 0.7, 0.1), (30, 0, 10)):
        assert normalize_weights(w) == pytest.approx(tuple(x / sum(w) for x in w))
    for w in ((0, 0, 0), (1, -2, 0)):
        with pytest.raises(ValueError):
            normalize_weights(w)


@pytest.mark.parametrize("threshold", [0.25, 0.9])
def test_a_score_at_the_threshold_is_an_anomaly_and_nan_is_none(spark, threshold):
    df = spark.createDataFrame([(threshold + d,) for d in (0.0, -1e-9, 1e-9)] + [(float("nan"),)], "s double")
    assert [r[0] for r in df.select(route_topic(F.col("s"), threshold)).collect()] == ["anomalies", "metrics", "anomalies", "metrics"]
