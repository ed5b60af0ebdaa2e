"""Property: velocity numbers each (user, hour) group 1..size in ingest order, for any layout,
including a user holding a third of all rows (hot key split into small pieces)."""

from collections import defaultdict

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from riskflow.operators.ordering import grouped_row_number


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.integers(0, 4), st.integers(1, 3)), min_size=1, max_size=120),
       st.integers(1, 16))
def test_velocity_is_rank_in_group(spark, layout, bucket):
    hot = [(0, 1)] * (len(layout) // 2)  # one (user, hour) holding a third of the rows
    rows = [(i, u, h) for i, (u, h) in enumerate(layout + hot)]
    df = spark.createDataFrame(rows, "id long, user int, hour int")
    got = {r["id"]: r["v"] for r in grouped_row_number(df, ["user", "hour"], "id", "v", bucket_rows=bucket).collect()}
    seen = defaultdict(int)
    for i, u, h in rows:
        seen[(u, h)] += 1
        assert got[i] == seen[(u, h)]
