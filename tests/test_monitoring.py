import datetime as dt

import pytest
from pyspark.sql import functions as F

from riskflow.operators import monitoring as MON


def _samples(spark, name, values, step_min=5):
    t0 = dt.datetime(2024, 1, 1)
    rows = [(t0 + dt.timedelta(minutes=step_min * i), name, "counter", float(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "ts timestamp_ntz, name string, kind string, value double")


def test_increase_handles_resets(spark):
    s = _samples(spark, "c", [0, 2, 5, 1, 4])  # reset before the 4th sample
    r = [x["increase"] for x in MON.rates(s, 3600).orderBy("ts").collect()]
    assert r == [0.0, 2.0, 5.0, 6.0, 9.0]
    r5 = [x["increase"] for x in MON.rates(s, 300).orderBy("ts").collect()]
    assert r5 == [0.0, 2.0, 3.0, 1.0, 3.0]


def test_exposition_lines(spark):
    s = _samples(spark, "b_total", [1, 3]).unionByName(_samples(spark, "a_total", [7]))
    lines = [r["line"] for r in MON.exposition(s).orderBy("line_no").collect()]
    assert lines == ["# TYPE a_total counter", "a_total 7.0", "# TYPE b_total counter", "b_total 3.0"]


def test_alert_fires_after_hold(spark):
    s = _samples(spark, "promotion_fail_total", [0, 0, 1, 2, 3, 3, 3, 3])
    rules = [("PromotionFailuresDetected", "promotion_fail_total", 900, ">", 60, "critical", "online_consumer")]
    a = MON.alerts(s, rules).collect()
    assert len(a) == 1
    assert a[0]["active_since"] == dt.datetime(2024, 1, 1, 0, 10)
    assert a[0]["fired_at"] == dt.datetime(2024, 1, 1, 0, 15)
    assert a[0]["last_true"] == dt.datetime(2024, 1, 1, 0, 30)


def test_stalled_rule_uses_equality(spark):
    s = _samples(spark, "online_consumer_messages_total", [1, 2, 2, 2, 2, 2])
    rules = [("OnlineConsumerStalled", "online_consumer_messages_total", 300, "==", 600, "warning", "online_consumer")]
    a = MON.alerts(s, rules).collect()
    assert len(a) == 1 and a[0]["fired_at"] == dt.datetime(2024, 1, 1, 0, 20)


def test_alerts_and_ratio_read_the_samples_once(spark, tmp_path):
    path = str(tmp_path / "samples")
    _samples(spark, "a", [0, 1, 2]).unionByName(_samples(spark, "b", [0, 4])).write.parquet(path)
    s = spark.read.parquet(path)
    r = MON.ratio(s, "a", "b", 300)
    assert [x["ratio"] for x in r.orderBy("ts").collect()] == [0.0, 0.25]  # the third sample of a has no partner
    for df in (r, MON.alerts(s)):
        assert df._jdf.queryExecution().optimizedPlan().toString().count("Relation [") == 1
