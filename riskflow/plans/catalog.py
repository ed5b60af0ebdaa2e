"""Registry of every query key -> Spark callable, and key -> DuckDB oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from riskflow.session import ensure_conf


def _wrap(fn):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ensure_conf(spark)
        return fn(spark, sf_dir)

    run.__name__ = getattr(fn, "__name__", "query")
    run.__doc__ = fn.__doc__
    return run


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from riskflow.plans import events_queries, feedback_queries, io_queries, model_queries, monitoring_queries, stream_queries, table_queries, training_queries

    out: dict[str, Callable] = {}
    for mod in (events_queries, table_queries, model_queries, feedback_queries, monitoring_queries, io_queries, stream_queries, training_queries):
        out.update(mod.QUERIES)
    return {k: _wrap(v) for k, v in out.items()}


def all_oracle_sql() -> dict[str, str]:
    from riskflow.plans import events_oracle, feedback_oracle, io_oracle, model_oracle, monitoring_oracle, stream_oracle, table_oracle

    out: dict[str, str] = {}
    for mod in (events_oracle, table_oracle, model_oracle, feedback_oracle, monitoring_oracle, io_oracle, stream_oracle):
        out.update(mod.oracle())
    return out
