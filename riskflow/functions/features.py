"""Feature expressions (one builder shared by the batch table and the event stream)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from riskflow.contract import CASHOUT_SPELLINGS, FEATURE_TYPES, FEATURES_V1, STEP_BASE

# ISO-8601 forms accepted by Python's datetime.fromisoformat for a date-time:
# YYYY-MM-DD, then any one separator character and HH[:MM[:SS[.f+]]] or the
# basic HHMM[SS[.f+]], then optionally Z or +-HH[[:]MM[[:]SS[.f+]]].  Fixed pattern.
ISO_DATETIME = (
    r"^\d{4}-\d{2}-\d{2}"
    r"(.(\d{2}(:\d{2}(:\d{2}([.,]\d+)?)?)?|\d{4}(\d{2}([.,]\d+)?)?)"
    r"(Z|[+-]\d{2}(:?\d{2}(:?\d{2}([.,]\d+)?)?)?)?)?$"
)
# Minutes / seconds of the time part (colon or basic form), offset hours and minutes.
TIME_MM = r"^.{13}:?(\d{2})"
TIME_SS = r"^.{13}:?\d{2}:?(\d{2})"
OFFSET_HH = r"[+-](\d{2})(?::?(\d{2})(?::?(\d{2})(?:[.,]\d+)?)?)?$"


def timestamp_from_step(step: Column) -> Column:
    """2024-01-01 00:00 + step hours (naive timestamp)."""
    return F.timestamp_add("HOUR", step.cast("long"), F.lit(STEP_BASE).cast("timestamp_ntz"))


def normalize_txn_type(t: Column) -> Column:
    """'_' -> '-'."""
    return F.replace(t, F.lit("_"), F.lit("-"))


def iso_valid(ts: Column) -> Column:
    """True when the text is an ISO date/date-time with real calendar and clock values."""
    date_ok = F.try_to_date(F.substring(ts, 1, 10), "yyyy-MM-dd").isNotNull()
    has_time = F.length(ts) >= 13
    hh = F.substring(ts, 12, 2).try_cast("int")
    mm = F.nullif(F.regexp_extract(ts, TIME_MM, 1), F.lit("")).try_cast("int")
    ss = F.nullif(F.regexp_extract(ts, TIME_SS, 1), F.lit("")).try_cast("int")
    tail = F.substring(ts, F.lit(14), F.length(ts))
    def off(i: int) -> Column:
        return F.coalesce(F.nullif(F.regexp_extract(tail, OFFSET_HH, i), F.lit("")).try_cast("int"), F.lit(0))

    off_s = off(1) * 3600 + off(2) * 60 + off(3)  # strictly less than a day
    clock_ok = ~has_time | (
        (hh <= 23)
        & F.coalesce(mm <= 59, F.lit(True))
        & F.coalesce(ss <= 59, F.lit(True))
        & (off_s < 86400)
    )
    return F.coalesce(ts.rlike(ISO_DATETIME) & date_ok & clock_ok, F.lit(False))


def hour_from_text(ts: Column) -> Column:
    """hour as written (local to the written offset), 0 for a date-only text."""
    return F.when(F.length(ts) >= 13, F.substring(ts, 12, 2).try_cast("int")).otherwise(F.lit(0))


def iso_error(ts: Column) -> Column:
    return F.concat(F.lit("Invalid isoformat string: '"), ts, F.lit("'"))


def feature_columns(
    amount: Column,
    old_balance: Column,
    new_balance: Column,
    txn_type: Column,
    hour: Column,
    velocity: Column,
) -> list[Column]:
    """the seven contract features, in contract order, as named columns."""
    t = txn_type.cast("string")
    cols = {
        "amount": amount.cast("double"),
        "amount_ratio": amount.cast("double") / (old_balance.cast("double") + F.lit(1.0)),
        "balance_diff_orig": old_balance.cast("double") - new_balance.cast("double") - amount.cast("double"),
        "is_transfer": F.when(t == "TRANSFER", 1).otherwise(0),
        "is_cashout": F.when(t.isin(*CASHOUT_SPELLINGS), 1).otherwise(0),
        "hour_of_day": hour,
        "txn_velocity_1h": velocity,
    }
    return [cols[n].cast(FEATURE_TYPES[n]).alias(n) for n in FEATURES_V1]


def features_struct(*cols: Column) -> Column:
    """nested ``features`` struct (fields in contract order)."""
    return F.struct(*cols)


def feature_vector(prefix: str = "") -> Column:
    """ordered array<double> from the feature columns."""
    return F.array(*[F.col(f"{prefix}{n}").cast("double") for n in FEATURES_V1])


def sigmoid(x: Column) -> Column:
    """F8."""
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def clip(x: Column, lo: float, hi: float) -> Column:
    """F10 (NaN passes through as in NumPy min/max on NaN-free inputs)."""
    return F.least(F.greatest(x, F.lit(lo)), F.lit(hi))


def label_to_int(label: Column) -> Column:
    """F12."""
    return F.when(label == "true_positive", 1).when(label == "false_positive", 0)


def normalize_weights(weights) -> tuple[float, ...]:
    """driver-side constant folding; non-positive sum is an error."""
    total = float(sum(weights))
    if total <= 0:
        raise ValueError("Ensemble weights must have positive sum.")
    return tuple(float(w / total) for w in weights)
