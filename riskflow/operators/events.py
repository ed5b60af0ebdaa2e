"""Event parse/validate (V1-V8), stream features (F4-F7) and the routed flow.

One lazy transformation used by batch ``read`` and by ``readStream`` alike:
every step is a column expression, so the whole flow is a single Project
inside whole-stage codegen; no shuffle unless keyed velocity is requested.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskflow.contract import (
    DEFAULT_THRESHOLD,
    DEFAULT_WEIGHTS,
    EVENT_SCHEMA_V1,
    FEATURES_V1,
    LEAKAGE_FIELDS,
    TOPIC_ANOMALY,
    TOPIC_DLQ,
    TOPIC_FEATURES,
    TOPIC_NORMAL,
    TOPIC_PARSED,
)
from riskflow.functions import features as FX
from riskflow.functions.jsonrules import field_facts, parse_strict_sql, schema_error
from riskflow.functions.plan import fence
from riskflow.models.base import ModelSet
from riskflow.operators.scoring import route_topic, score

EVENT_FIELDS = ["event_id", "timestamp", "user_id", "type", "amount", "old_balance_orig", "new_balance_orig"]


def parse_events(df: DataFrame, raw_col: str = "raw", schema: dict = EVENT_SCHEMA_V1) -> DataFrame:
    """V8: adds ``error`` (first failure or NULL) and ``event``, the sanitised event.

    ``event`` is a struct of the typed schema fields plus ``extras`` (the
    undeclared members minus the leakage fields with their JSON types, V6); it
    is NULL on failed rows.  ``raw_col`` is text or bytes (UTF-8).
    """
    v, decode_error = parse_strict_sql(f"CAST(`{raw_col}` AS STRING)")
    staged = fence(df.selectExpr("*", f"{v} AS _v", f"{decode_error} AS _decode_error"))
    staged = fence(staged.selectExpr("*", *field_facts("_v", schema)))
    props = [n for n, sp in schema.get("properties", {}).items() if isinstance(sp, dict)]
    known = ", ".join(f"'{k}'" for k in sorted(set(props) | set(LEAKAGE_FIELDS)))
    base = [f"`{c}`" for c in df.columns]
    error = f"coalesce(_decode_error, {schema_error(schema)})"
    event = (f"CASE WHEN error IS NULL THEN named_struct("
             + ", ".join(f"'{n}', `_t_{n}`" for n in props)
             + f", 'extras', map_filter(try_variant_get(_v, '$', 'map<string,variant>'), (k, x) -> NOT k IN ({known}))) END")
    out = staged.selectExpr(*base, f"{error} AS error", "_v", *[f"`_t_{n}`" for n in props])
    return fence(out.selectExpr(*base, "error", f"{event} AS event"))


def parse_route(df: DataFrame, raw_col: str = "raw", valid_topic: str = TOPIC_PARSED,
                dlq_topic: str = TOPIC_DLQ) -> DataFrame:
    """V8 routing: valid -> ``valid_topic`` else ``dlq_topic`` (one column)."""
    p = parse_events(df, raw_col)
    return p.withColumn("topic", F.when(F.col("error").isNull(), F.lit(valid_topic)).otherwise(F.lit(dlq_topic)))


def dead_letter(error: Column, raw: Column) -> Column:
    """V7: {error, raw_event, received_at}; bytes become text, invalid ones replaced."""
    text = F.make_valid_utf8(raw.cast("string"))
    return F.struct(error.alias("error"), text.alias("raw_event"), F.current_timestamp().alias("received_at"))


def _merged(a: Column, b: Column) -> Column:
    """JSON text of an object with the members of the objects ``a`` and ``b``."""
    return F.when(b == "{}", a).when(a == "{}", b).otherwise(
        F.concat(F.substr(a, F.lit(1), F.length(a) - 1), F.lit(","), F.substr(b, F.lit(2))))


def stream_feature_columns(velocity: Column | int = 1) -> list[Column]:
    """the contract features over the parsed event columns."""
    v = velocity if isinstance(velocity, Column) else F.lit(int(velocity))
    return FX.feature_columns(
        F.col("event.amount"),
        F.col("event.old_balance_orig"),
        F.col("event.new_balance_orig"),
        F.col("event.type"),
        FX.hour_from_text(F.col("event.timestamp")),
        v,
    )


def route_events(
    df: DataFrame,
    models: ModelSet | None = None,
    *,
    raw_col: str = "raw",
    velocity: Column | int = 1,
    weights=DEFAULT_WEIGHTS,
    threshold: float = DEFAULT_THRESHOLD,
    valid_topic: str = TOPIC_FEATURES,
    dlq_topic: str = TOPIC_DLQ,
    anomaly_topic: str = TOPIC_ANOMALY,
    normal_topic: str = TOPIC_NORMAL,
) -> DataFrame:
    """Parse -> features -> (score) -> topic.

    Parser failures and feature-stage failures (unparsable timestamp) both
    go to ``dlq_topic``; without models every valid event goes to
    ``valid_topic``.  Output: input columns, parsed fields, the 7 features,
    scores (when models are given), ``error`` and ``topic``.
    """
    p = parse_events(df, raw_col)
    ts_ok = FX.iso_valid(F.col("event.timestamp"))
    stage_error = F.when(F.col("error").isNull() & ~ts_ok, FX.iso_error(F.col("event.timestamp")))
    p = p.withColumn("error", F.coalesce(F.col("error"), stage_error))
    feats = [F.when(F.col("error").isNull(), c).alias(n) for c, n in zip(stream_feature_columns(velocity), FEATURES_V1)]
    p = fence(p.select("*", *feats))
    if models is None:
        topic = F.when(F.col("error").isNull(), F.lit(valid_topic)).otherwise(F.lit(dlq_topic))
        return p.withColumn("topic", topic)
    s = score(p, models, weights)
    scored_cols = ["if_score", "ae_score", "sgd_score", "ensemble_score"]
    s = s.select(*[c for c in s.columns if c not in scored_cols],
                 *[F.when(F.col("error").isNull(), F.col(c)).alias(c) for c in scored_cols])
    topic = F.when(F.col("error").isNotNull(), F.lit(dlq_topic)).otherwise(
        route_topic(F.col("ensemble_score"), threshold, anomaly_topic, normal_topic)
    )
    return s.withColumn("topic", topic)


def sink_records(routed: DataFrame, raw_col: str = "raw", key_col: str = "event_id") -> DataFrame:
    """One (topic, key, value) record per event, value as JSON text.

    Parser failures carry {error, raw_event, received_at} with the raw text;
    feature-stage failures {error, raw_event} with the sanitised event.  The
    others carry the sanitised event, undeclared members beside the declared
    ones and with their types, and the nested ``features`` (and ``scores``
    when scored), which replace members of those names.
    """
    has_scores = "ensemble_score" in routed.columns
    features = FX.features_struct(*[F.col(n) for n in FEATURES_V1])
    scores = F.struct(*[F.col(c) for c in ("if_score", "ae_score", "sgd_score", "ensemble_score")]) if has_scores else None
    event_fields = [F.col(f"event.{n}").alias(n) for n in EVENT_FIELDS]
    added = F.struct(features.alias("features"), *([scores.alias("scores")] if has_scores else []))
    names = ["features", "scores"] if has_scores else ["features"]
    declared = F.to_json(F.struct(*event_fields))
    event = _merged(declared, F.to_json("event.extras"))
    kept = _merged(declared, F.to_json(F.map_filter("event.extras", lambda k, v: ~k.isin(*names))))
    parse_failure = F.to_json(dead_letter(F.col("error"), F.col(raw_col)), {"ignoreNullFields": "false"})
    stage_failure = _merged(F.to_json(F.struct("error")), F.concat(F.lit('{"raw_event":'), event, F.lit("}")))
    value = (F.when(F.col("error").isNull(), _merged(kept, F.to_json(added)))
             .when(F.col("event").isNull(), parse_failure).otherwise(stage_failure))
    return routed.select("topic", F.col(key_col).cast("string").alias("key"), value.alias("value"),
                         F.col(key_col), "error")
