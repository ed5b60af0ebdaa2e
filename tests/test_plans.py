"""Plan-shape checks: pruning and pushdown reach the scan, no single-partition exchange on
full data, the event flow stays one narrow code-generated stage."""

from pyspark.sql import functions as F

from conftest import SF_SMALL
from riskflow.models.demo import demo_models
from riskflow.operators.batch_features import add_training_features
from riskflow.operators.events import route_events
from riskflow.sources import adapters
from riskflow.sources.tables import table


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_pruning_and_pushdown_reach_the_scan(spark):
    ev = table(spark, SF_SMALL, "events").where(F.col("event_id") < 100)
    p = adapters.txn(ev).groupBy("type").agg(F.sum("isFraud"))
    plan = _plan(p)
    assert "PushedFilters: [IsNotNull(event_id), LessThan(event_id,100)]" in plan
    read = plan[plan.index("ReadSchema:"):].split("\n")[0]
    assert "user_id" not in read and "ts" not in read  # only the columns the query needs


def test_event_flow_is_one_narrow_codegen_stage(spark):
    ev = table(spark, SF_SMALL, "events")
    r = route_events(adapters.raw_event(ev), demo_models()).select("event_id", "topic", "error")
    plan = _plan(r)
    assert "Exchange" not in plan  # parse, rules, features, scores, topic: no shuffle
    assert "WholeStageCodegen" in plan or "*(" in plan
    assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan  # no Python in the flow


def test_velocity_never_uses_a_single_partition_exchange(spark):
    t = adapters.txn(table(spark, SF_SMALL, "events"))
    f = add_training_features(t)
    f.write.format("noop").mode("overwrite").save()
    plan = f._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan


def test_forest_scoring_is_vectorised(spark):
    from riskflow.models.fixed import FIXED_FOREST
    from riskflow.models.iforest import ForestUDF

    df = spark.createDataFrame([(float(i), 1.0, 0.0, 1, 0, 3, 1) for i in range(10)],
                               "a double, b double, c double, d int, e int, f int, g int")
    s = df.select(ForestUDF(FIXED_FOREST).column([F.col(c) for c in df.columns]).alias("s"))
    plan = _plan(s)
    assert "ArrowEvalPython" in plan and "BatchEvalPython" not in plan
    # same values as the SQL rendering of the same forest
    sql = df.selectExpr(f"{FIXED_FOREST.sql([f'CAST({c} AS DOUBLE)' for c in df.columns])} AS s")
    a = sorted(r[0] for r in s.collect())
    b = sorted(r[0] for r in sql.collect())
    assert all(abs(x - y) < 1e-12 for x, y in zip(a, b))
