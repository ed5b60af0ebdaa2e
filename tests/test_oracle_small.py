"""Spark queries vs their DuckDB oracle on the smallest fixture (a slice of the driver's gate)."""

import duckdb
import pytest

import __spark_entry__ as E
from conftest import SF_SMALL
from riskflow.plans.verify import canonical, register_duckdb_views
from riskflow.sources.tables import TABLES

KEYS = ["parse_route", "event_routing", "table_validation", "profile_by_type", "amount_stats",
        "batch_features", "average_precision", "alert_budget", "feedback_accept", "alerts_fired",
        "adaptive_threshold_by_type", "online_gradient_step"]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    register_duckdb_views(c, SF_SMALL, TABLES)
    return c


@pytest.mark.parametrize("key", KEYS)
def test_query_matches_oracle(spark, con, key):
    df = E.queries()[key](spark, SF_SMALL)
    got = canonical(df.columns, [tuple(r) for r in df.collect()])
    res = con.execute(E.oracle_sql()[key])
    cols = [d[0] for d in res.description]
    assert sorted(cols) == sorted(df.columns)
    assert got == canonical(cols, res.fetchall())


def test_user_model_plugs_in(spark):
    import numpy as np
    from pyspark.sql import functions as F

    from riskflow.models.base import ModelSet, PandasModel
    from riskflow.models.demo import demo_models
    from riskflow.operators.scoring import score
    from riskflow.plans.model_queries import feats

    f = feats(spark, SF_SMALL)
    d = demo_models()
    user = ModelSet(if_decision=PandasModel(lambda x: -(x[:, 0] - 100.0) / 100.0), ae_mse=d.ae_mse,
                    ae_threshold=d.ae_threshold, proba=d.proba)
    a = score(f, d).select("event_id", F.col("if_score").alias("a"))
    b = score(f, user).select("event_id", F.col("if_score").alias("b"))
    diff = a.join(b, "event_id").agg(F.max(F.abs(F.col("a") - F.col("b")))).first()[0]
    assert diff < 1e-12
