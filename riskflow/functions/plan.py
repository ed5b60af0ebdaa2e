"""Plan-shape helpers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fence(df: DataFrame) -> DataFrame:
    """Projection fence: stop Catalyst from inlining large expressions downstream.

    CollapseProject substitutes a column's defining expression into every
    consumer; a wide rule expression (the JSON checks) referenced by many
    feature and score columns then grows the plan multiplicatively.  A
    one-element ``inline`` is a Generate node, which projections are not
    collapsed across; it stays narrow (no shuffle) and inside codegen.
    """
    cols = df.columns
    return df.select(F.inline(F.array(F.struct(*[F.col(f"`{c}`") for c in cols]))))
