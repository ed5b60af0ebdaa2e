"""The timestamp rule (validity + hour as written) against Python's datetime.fromisoformat."""

import itertools
from datetime import datetime

from pyspark.sql import functions as F

from riskflow.functions.features import hour_from_text, iso_valid

DATES = ["2026-02-16", "2024-02-29", "2026-02-30", "2026-13-01", "2026-2-16"]
TIMES = ["", "T23", "T23:45", "T23:45:59", "T23:45:60", "T24:00", "T07:61", "T23:45:00.5", "T23:45:00,123456789",
         " 08:15", "t08:15", "T0815", "T081530", "T0875", "T23:4", "T", "x08"]
ZONES = ["", "Z", "+05:00", "-0530", "+05", "+05:30:15", "+24:00", "+05:61", "+5"]


def _python(ts: str):
    t = ts[:-1] + "+00:00" if ts.endswith("Z") else ts
    try:
        return datetime.fromisoformat(t).hour
    except ValueError:
        return None


def test_rule_matches_fromisoformat(spark):
    cases = sorted({d + t + (z if t else "") for d, t, z in itertools.product(DATES, TIMES, ZONES)} | {"not-a-date", ""})
    df = spark.createDataFrame([(c,) for c in cases], "ts string")
    got = {r["ts"]: (r["ok"], r["h"]) for r in
           df.select("ts", iso_valid(F.col("ts")).alias("ok"), hour_from_text(F.col("ts")).alias("h")).collect()}
    bad = []
    for c in cases:
        want = _python(c)
        ok, h = got[c]
        if (want is not None) != ok or (ok and want != h):
            bad.append((c, want, ok, h))
    assert not bad, bad[:10]
