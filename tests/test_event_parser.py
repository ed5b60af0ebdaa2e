import json

import pytest
from pyspark.sql import functions as F

from conftest import EVENT as BASE
from riskflow.operators.events import parse_events, parse_route

def _parse(spark, payloads):
    df = spark.createDataFrame([(i, p) for i, p in enumerate(payloads)], "i long, raw string")
    return {r["i"]: r for r in parse_events(df).collect()}


def _err(spark, payload):
    return _parse(spark, [payload])[0]["error"]


def test_valid_event(spark):
    r = _parse(spark, [json.dumps(BASE)])[0]
    assert r["error"] is None
    assert r["event"]["amount"] == 61.5 and r["event"]["type"] == "TRANSFER"


def test_missing_fields_in_schema_order(spark):
    ev = {k: v for k, v in BASE.items() if k not in ("new_balance_orig", "timestamp")}
    assert _err(spark, json.dumps(ev)) == "Missing required fields: ['timestamp', 'new_balance_orig']"


def test_bad_enum(spark):
    assert _err(spark, json.dumps({**BASE, "type": "WIRE"})) == "Invalid value for 'type': WIRE"


def test_underscore_spelling_rejected_on_stream(spark):
    assert _err(spark, json.dumps({**BASE, "type": "CASH_OUT"})) == "Invalid value for 'type': CASH_OUT"


def test_invalid_json_and_trailing_text(spark):
    assert _err(spark, "{bad json}") == "Invalid JSON payload"
    assert _err(spark, json.dumps(BASE) + " x") == "Invalid JSON payload"
    assert _err(spark, '{"a":1}],[') == "Invalid JSON payload"


def test_non_object(spark):
    assert _err(spark, "[1, 2]") == "Payload JSON must decode to an object."


def test_null_is_not_missing(spark):
    assert _err(spark, json.dumps({**BASE, "user_id": None})) == "Field 'user_id' must be a string."


def test_bool_is_not_a_number(spark):
    assert _err(spark, json.dumps({**BASE, "amount": True})) == "Field 'amount' must be numeric."
    assert _err(spark, json.dumps({**BASE, "amount": "12.5"})) == "Field 'amount' must be numeric."


def test_minimum_and_length(spark):
    assert _err(spark, json.dumps({**BASE, "amount": -1})) == "Field 'amount' must be >= 0.0."
    assert _err(spark, json.dumps({**BASE, "user_id": ""})) == "Field 'user_id' must have length >= 1."


def test_first_failure_wins(spark):
    ev = {**BASE, "user_id": 5, "type": "WIRE", "amount": -1}
    assert _err(spark, json.dumps(ev)) == "Field 'user_id' must be a string."


def test_duplicate_keys_last_wins(spark):
    raw = json.dumps(BASE)[:-1] + ', "amount": 7.5}'
    r = _parse(spark, [raw])[0]
    assert r["error"] is None and r["event"]["amount"] == 7.5


def test_leakage_fields_stripped_extras_kept(spark):
    r = _parse(spark, [json.dumps({**BASE, "isFraud": 1, "label": "x", "is_fraud": 1, "channel": "web"})])[0]
    assert r["error"] is None
    assert {k: v.toPython() for k, v in r["event"]["extras"].items()} == {"channel": "web"}


def test_route_topics(spark):
    df = spark.createDataFrame([(0, json.dumps(BASE)), (1, "{bad json}")], "i long, raw string")
    topics = {r["i"]: r["topic"] for r in parse_route(df).collect()}
    assert topics == {0: "parsed-events", 1: "dead-letter"}


def test_bytes_payloads_must_be_utf8(spark):
    good = json.dumps({**BASE, "user_id": "Zoë"}, ensure_ascii=False).encode()
    df = spark.createDataFrame([(0, bytearray(good)), (1, bytearray(good.replace("ë".encode(), b"\xff")))], "i long, raw binary")
    r = {x["i"]: x for x in parse_events(df).collect()}
    assert r[0]["error"] is None and r[0]["event"]["user_id"] == "Zoë"
    assert r[1]["error"] == "Invalid JSON payload"


def test_enum_of_numbers_booleans_and_null(spark):
    schema = {"properties": {"level": {"enum": [1, 2.5, True, None, "x"]}}}
    texts = ['{"level":1}', '{"level":2.5}', '{"level":true}', '{"level":null}', '{"level":"x"}', "{}", '{"level":3}', '{"level":"1"}']
    df = spark.createDataFrame(list(enumerate(texts)), "i long, raw string")
    got = {r["i"]: r["error"] for r in parse_events(df, schema=schema).select("i", "error").collect()}
    assert [got[i] for i in range(6)] == [None] * 6
    assert got[6] == "Invalid value for 'level': 3" and got[7] == "Invalid value for 'level': 1"
