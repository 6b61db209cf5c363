"""The schema of event lines: an envelope and one closed payload per event."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions import jsonschema
from tessella.sources.logs import EVENTS, UUID4


def _closed(required: dict, optional: dict | None = None) -> dict:
    return {"type": "object", "additionalProperties": False, "required": list(required), "properties": required | (optional or {})}


# The rules of every field.
COUNT, AMOUNT, FLAG, MAYBE = {"type": "integer", "minimum": 0}, {"type": "number", "minimum": 0}, {"type": "boolean"}, {"type": ["boolean", "null"]}
SURFACE = {"enum": ["claude-hook", "cli"]}
TOPICS = {"type": "array", "maxItems": 20, "uniqueItems": True, "items": {"type": "string", "pattern": "^[a-z0-9]+(?:_[a-z0-9]+)*$", "maxLength": 160}}
CLASSES = {"type": "array", "minItems": 1, "uniqueItems": True, "items": {"enum": ["identifier", "path", "error", "natural", "decision", "mixed"]}}
STAGES = {"type": "object", "additionalProperties": False, "properties": dict.fromkeys(("load", "plan", "rank", "context", "emit"), AMOUNT)}
CHANNELS = {"type": "object", "propertyNames": {"pattern": "^[a-z][a-z0-9_-]*$"}, "additionalProperties": COUNT}
REASONS = {"enum": [None, "no-trusted-candidate", "below-threshold", "budget-empty", "all-candidates-excluded"]}
DEGRADED = {"enum": [None, "auth", "quota", "network", "contract", "timeout", "config-invalid", "artifact-missing", "artifact-invalid", "artifact-stale", "snapshot-unavailable"]}
NAMED = {"type": "string", "pattern": "^[a-z0-9.-]+$", "maxLength": 80}
VERSION = {"type": "string", "minLength": 1, "maxLength": 64}
EMBEDDING = _closed({"active": {"const": True}, "latency_ms": AMOUNT, "cache_hit": FLAG, "degraded_reason": DEGRADED}, {"mode": {"enum": ["observe", "weighted"]}, "rrf_weight": {"type": "number", "minimum": 0, "maximum": 100}})
PAYLOADS = {
    "recall.completed": _closed(
        {"query_id": {"type": "string", "pattern": "^[a-f0-9]{64}$"}, "query_class": CLASSES, "execution": {"enum": ["cold", "hot"]}, "total_ms": AMOUNT, "stage_ms": STAGES, "channels": CHANNELS, "rrf_candidates": COUNT, "abstained": FLAG, "returned_topics": TOPICS, "estimated_tokens": COUNT, "cache_hit": MAYBE, "truncated": FLAG},
        {"surface": SURFACE, "consumption_eligible": FLAG, "abstain_reason": REASONS, "dropped_topics": COUNT, "embedding": EMBEDDING},
    ),
    "recall.delivered": _closed({"surface": SURFACE, "topics": TOPICS}),
    "recall.consumed": _closed({"topics": TOPICS, "authority_followed": MAYBE}, {"via": {"enum": ["claude-hook", "cli", "manual"]}, "match": {"enum": ["session", "recent", "declared"]}}),
    "feedback.recorded": _closed({"verdict": {"enum": ["correct", "wrong", "miss"]}, "expected_in_top_k": MAYBE}),
    "index.build": _closed(
        {"mode": {"enum": ["full", "incremental"]}}
        | dict.fromkeys(("changed_files", "compiled_topics", "reused_topics", "deleted_topics", "snapshot_bytes"), COUNT)
        | {"duration_ms": AMOUNT, "success": FLAG, "fallback": FLAG, "previous_snapshot_age_ms": {"type": ["number", "null"], "minimum": 0}, "error_code": {"type": ["string", "null"], "pattern": "^[A-Z0-9_-]+$", "maxLength": 64}}
    ),
    "maintenance.completed": _closed(dict.fromkeys(("generated_updates", "proposals", "conflicts", "orphans", "drift"), COUNT) | {"duration_ms": AMOUNT, "success": FLAG}),
    "gate.completed": _closed({"gate": NAMED, "status": {"enum": ["passed", "failed"]}, "errors": COUNT, "warnings": COUNT, "duration_ms": AMOUNT}),
}
PROCESS = _closed({"runtime": {"const": "node"}, "runtime_version": VERSION, "component": NAMED, "component_version": VERSION})

#: A payload of each event that fits, with every field.
SAMPLES = {
    "recall.completed": {"query_id": "a" * 64, "query_class": ["natural"], "execution": "hot", "total_ms": 1.5, "stage_ms": {"load": 1}, "channels": {"exact": 2}, "rrf_candidates": 3, "abstained": False, "returned_topics": ["a_b"], "estimated_tokens": 10, "cache_hit": None, "truncated": False, "surface": "cli", "consumption_eligible": True, "abstain_reason": None, "dropped_topics": 0, "embedding": {"active": True, "latency_ms": 2, "cache_hit": False, "degraded_reason": None, "mode": "observe", "rrf_weight": 0}},
    "recall.delivered": {"surface": "cli", "topics": ["a"]},
    "recall.consumed": {"topics": [], "authority_followed": None, "via": "manual", "match": "recent"},
    "feedback.recorded": {"verdict": "miss", "expected_in_top_k": False},
    "index.build": {"mode": "full", "changed_files": 1, "compiled_topics": 1, "reused_topics": 0, "deleted_topics": 0, "snapshot_bytes": 9, "duration_ms": 0.5, "success": True, "fallback": False, "previous_snapshot_age_ms": None, "error_code": None},
    "maintenance.completed": {"generated_updates": 0, "proposals": 0, "conflicts": 0, "orphans": 0, "drift": 0, "duration_ms": 1, "success": True},
    "gate.completed": {"gate": "quality", "status": "passed", "errors": 0, "warnings": 0, "duration_ms": 3},
}


def payload(event: str) -> dict:
    return PAYLOADS[event]


def schema(schema_id: str, events: tuple[str, ...] = EVENTS) -> dict:
    """The schema of a line whose own `schema` is schema_id, for logs of some events or of all."""
    envelope = {"schema": {"const": schema_id}, "event": {"enum": list(events)}, "recorded_at": {"type": "string", "format": "date-time"}, "trace_id": {"type": "string", "pattern": UUID4}, "snapshot_id": {"type": ["string", "null"], "minLength": 1, "maxLength": 128}, "process": PROCESS, "payload": {"type": "object"}}
    chosen = [{"if": {"properties": {"event": {"const": e}}, "required": ["event"]}, "then": {"properties": {"payload": p}}} for e, p in PAYLOADS.items() if e in events]
    return _closed(envelope) | {"allOf": chosen}


def upgraded(value: Column, legacy: dict[str, str]) -> Column:
    """A line whose schema id is a legacy one, with the id it has now; other lines as they are."""
    held = F.get_json_object(value, "$.schema")
    out = value
    for old, new in legacy.items():
        out = F.when(held == old, F.regexp_replace(value, f'("schema"\\s*:\\s*)"{old}"', f'$1"{new}"')).otherwise(out)
    return out


def validated(lines: DataFrame, schema_id: str, legacy: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """(events, errors) of (file, line, value): events with recorded_at as a timestamp and the payload as VARIANT, sorted
    by time, trace and event; errors with their violations."""
    rows = lines.withColumn("value", upgraded(F.col("value"), dict.fromkeys(legacy, schema_id)))
    rows = rows.withColumn("violations", jsonschema.violations(F.col("value"), schema(schema_id)))
    v = F.try_parse_json("value")
    get = lambda p, t="string": F.try_variant_get(v, f"$.{p}", t)
    events = rows.filter("size(violations) = 0").select("file", "line", get("event").alias("event"), F.to_timestamp(get("recorded_at")).alias("recorded_at"), get("trace_id").alias("trace_id"), get("snapshot_id").alias("snapshot_id"), get("payload", "variant").alias("payload"))
    return events.orderBy("recorded_at", "trace_id", "event"), rows.filter("size(violations) > 0").select("file", "line", "violations")
