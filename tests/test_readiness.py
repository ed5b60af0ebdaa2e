"""Readiness from written reports, and the record of trained members."""

import json

import pytest

from riskflow.models.fixed import FIXED_FOREST, FIXED_LOGIT, fixed_autoencoder
from riskflow.models.registry import ModelRegistry, load_model_set, record_training
from riskflow.operators import readiness as RD

DEMO = {"events_in": 3, "anomalies": 1, "metrics": 1, "dlq": 1, "feedback_published": 1, "online_updated": True, "online_update_count": 1}
BENCH = {"latency_ms": {"p50": 2.0, "p95": 9.0, "max": 11.0}, "quality_at_budget": {"precision": 0.0, "recall": 0.5}}


def _write(folder, demo, bench):
    for name, report in (("demo", demo), ("bench", bench)):
        if report is not None:
            (folder / name).mkdir()
            (folder / name / "part-0.json").write_text(json.dumps(report))
    return f"{folder}/demo", f"{folder}/bench"


@pytest.mark.parametrize("demo, bench, failing", [
    (DEMO, BENCH, []),
    (DEMO | {"anomalies": 0}, BENCH, ["demo_has_anomalies"]),
    (DEMO | {"online_updated": False}, BENCH, ["demo_online_updated"]),
    (DEMO, BENCH | {"latency_ms": {"p95": 500.1}}, ["benchmark_latency_slo_met"]),
    (DEMO, BENCH | {"quality_at_budget": {"precision": 0.3}}, ["benchmark_quality_fields_present"]),
    (DEMO, None, ["benchmark_latency_slo_met", "benchmark_quality_fields_present"]),
    (None, BENCH, ["demo_has_anomalies", "demo_has_feedback", "demo_online_updated"]),
])
def test_checks_of_reports(spark, tmp_path, demo, bench, failing):
    paths = _write(tmp_path, demo, bench)
    got = {r["check"]: r["ok"] for r in RD.readiness(spark, *paths, 500.0).collect()}
    assert [c for c, ok in got.items() if not ok and c != "overall_ok"] == failing
    assert len(got) == 6 and got["overall_ok"] == (not failing)


def test_readiness_report_is_written(spark, tmp_path):
    paths = _write(tmp_path, DEMO, BENCH)
    assert RD.write_readiness(spark, *paths, 500.0, f"{tmp_path}/report") is True
    r = spark.read.json(f"{tmp_path}/report").first()
    assert r["checks"]["demo_online_updated"] and r["latency_slo_ms"] == 500.0
    assert (r["demo"]["events_in"], r["benchmark"]["latency_ms"]["p95"]) == (3, 9.0)
    assert RD.write_readiness(spark, *paths, 5.0, f"{tmp_path}/report") is False


def test_trained_members_are_saved_and_their_runs_logged(spark, tmp_path):
    reg = ModelRegistry(spark, str(tmp_path))
    net = fixed_autoencoder()
    with pytest.raises(FileNotFoundError):
        load_model_set(reg)
    for name, model in (("isolation_forest", FIXED_FOREST), ("autoencoder", net), ("logit", FIXED_LOGIT)):
        assert record_training(reg, name, model, {"seed": 42, "note": None}, {"rows": 10, "text": "x"}) == 1
    assert record_training(reg, "logit", FIXED_LOGIT, {}, {}) == 2
    models = load_model_set(reg)
    assert models.proba.weights == FIXED_LOGIT.weights and models.ae_threshold == net.threshold
    assert models.if_decision.forest == FIXED_FOREST and models.ae_mse.layers == net.layers
    runs = {r["run_name"]: r for r in spark.read.parquet(f"{tmp_path}/_training_runs").collect()}
    assert set(runs) == {"isolation_forest_v1", "autoencoder_v1", "logit_v1", "logit_v2"}
    assert runs["logit_v1"]["metrics"] == {"rows": 10.0, "version": 1.0} and "note" not in runs["logit_v1"]["params"]
