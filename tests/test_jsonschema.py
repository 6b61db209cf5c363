"""Violations by written cases for every keyword, and for every rule of the event schema."""

import json

import pytest
from pyspark.sql import functions as F

from tessella.functions import jsonschema
from tessella.sources import event_schema

CASES = [
    ({"type": "integer"}, [("1", []), ("1.0", []), ("1.5", ["$ type"]), ('"1"', ["$ type"]), ("null", ["$ type"]), ("{", ["$ json"]), (None, ["$ json"])]),
    ({"type": ["string", "null"], "minLength": 2, "maxLength": 3}, [("null", []), ('"é"', ["$ minLength"]), ('"abcd"', ["$ maxLength"]), ('"abc"', [])]),
    ({"type": "number", "minimum": 0, "maximum": 2.5}, [("0", []), ("2.5", []), ("-1", ["$ minimum"]), ("3", ["$ maximum"]), ("true", ["$ type"])]),
    ({"enum": [None, "a", 3]}, [("null", []), ('"a"', []), ("3", []), ('"b"', ["$ enum"])]),
    ({"const": True}, [("true", []), ("false", ["$ const"])]),
    ({"pattern": "^a+$"}, [('"aa"', []), ('"ab"', ["$ pattern"]), ("7", [])]),
    ({"format": "date-time"}, [('"2026-01-02T03:04:05.678Z"', []), ('"2026-13-02T03:04:05Z"', ["$ format"]), ('"2026-01-02"', ["$ format"])]),
    ({"type": "array", "minItems": 1, "maxItems": 2, "uniqueItems": True, "items": {"type": "string"}}, [('["a"]', []), ("[]", ["$ minItems"]), ('["a","a"]', ["$ uniqueItems"]), ('["a",1,2]', ["$ maxItems", "$[] type"])]),
    ({"type": "object", "required": ["a"], "additionalProperties": False, "properties": {"a": {"type": "object", "properties": {"b": {"const": 1}}}}}, [('{"a":{}}', []), ('{"a":{"b":2}}', ["$.a.b const"]), ('{"c":1}', ["$ additionalProperties", "$.a required"]), ("[]", ["$ type"])]),
    ({"propertyNames": {"pattern": "^x"}, "additionalProperties": {"type": "integer"}}, [('{"x":1}', []), ('{"y":"s"}', ["$ propertyNames", "$.* type"])]),
    ({"allOf": [{"if": {"properties": {"k": {"const": "a"}}, "required": ["k"]}, "then": {"required": ["p"]}, "else": {"required": ["q"]}}]}, [('{"k":"a","p":1}', []), ('{"k":"a"}', ["$.p required"]), ('{"k":"b"}', ["$.q required"])]),
    ({"$ref": "#/$defs/n", "$defs": {"n": {"type": "null"}}}, [("null", []), ("0", ["$ type"])]),
]


@pytest.mark.parametrize("at", range(len(CASES)))
def test_keywords(spark, at):
    schema, rows = CASES[at]
    df = spark.createDataFrame(list(enumerate(r[0] for r in rows)), "i int, t string").select("i", jsonschema.violations(F.col("t"), schema).alias("v"))
    assert [r.v for r in df.orderBy("i").collect()] == [r[1] for r in rows]


def test_unknown_keywords_are_refused(spark):
    with pytest.raises(ValueError, match="oneOf"):
        jsonschema.violations(F.col("t"), {"oneOf": []})


def test_every_rule_of_the_seven_payloads_has_a_failing_line(spark):
    """Each payload as it should be; then without each required key, with one more key, and with each value replaced by one
    of another type."""
    rows = []
    for event, payload in event_schema.SAMPLES.items():
        line = {"schema": "events/v1", "event": event, "recorded_at": "2026-01-02T03:04:05.678Z", "trace_id": "01234567-89ab-4def-8123-456789abcdef", "snapshot_id": None, "process": {"runtime": "node", "runtime_version": "22", "component": "cli", "component_version": "1"}, "payload": payload}
        rows.append((f"{event} fits", json.dumps(line), []))
        rows.append((f"{event} extra", json.dumps(line | {"payload": payload | {"zz": 1}}), ["$.payload additionalProperties"]))
        for key in payload:
            wrong = json.dumps(line | {"payload": payload | {key: [{"a": 1}] if not isinstance(payload[key], list) else "s"}})
            rows.append((f"{event} {key} wrong", wrong, f"$.payload.{key} "))
            if key in event_schema.payload(event)["required"]:
                rows.append((f"{event} without {key}", json.dumps(line | {"payload": {k: v for k, v in payload.items() if k != key}}), [f"$.payload.{key} required"]))
    df = spark.createDataFrame([(n, t) for n, t, _ in rows], "n string, t string").repartition(4)
    found = {r.n: r.v for r in df.select("n", jsonschema.violations(F.col("t"), event_schema.schema("events/v1")).alias("v")).collect()}
    for name, _, want in rows:
        got = found[name]
        assert got == want if isinstance(want, list) else got and all(g.startswith(want) for g in got), (name, got, want)
    assert len(rows) > 90
