import __spark_entry__ as E

from conftest import SF_SMALL


def test_entry_runs_on_smoke_data(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) > 0
    assert {"event_id", "topic", "error"} <= set(df.columns)
    topics = {r["topic"] for r in rows}
    assert topics <= {"anomalies", "metrics", "dead-letter"}


def test_every_oracle_key_is_a_query():
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q)
    assert not any("pipeline" in k for k in q if k != "pipeline")  # the optional pipeline alone has that name


def test_route_counts_add_up(spark):
    r = E.queries()["route_counts"](spark, SF_SMALL).first()
    assert r["events_in"] == r["scored"] + r["dead_letter"] == r["anomalies"] + r["normal"] + r["dead_letter"]


def test_workers_find_the_package_outside_its_folder(tmp_path):
    """A session started in another folder, without PYTHONPATH, runs a Python function of the package."""
    import os
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = f"""
import sys
sys.path.insert(0, {root!r})
from riskflow.session import local_session
from riskflow.models.iforest import _tree_builder
from riskflow.contract import FEATURES_V1
spark = local_session(2, 2)
df = spark.range(8).selectExpr("cast(0 as int) as tree", "id as _h", *[f"cast(id as double) as {{c}}" for c in FEATURES_V1])
print("NODES", df.groupBy("tree").applyInPandas(_tree_builder(1, 3), "tree int, node int, feature int, threshold double, left int, right int, n_samples long").count())
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=120)
    assert "NODES" in done.stdout, done.stderr[-2000:]
