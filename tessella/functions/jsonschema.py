"""A compiler from JSON Schema to a column of violations over VARIANT, so that validation is part of the plan.

Keywords: type, const, enum, pattern, format (date-time), minLength, maxLength, minimum, maximum, required, properties,
additionalProperties, propertyNames (pattern), items, minItems, maxItems, uniqueItems, allOf, if / then / else, $ref into
$defs. Annotations ($schema, $id, title, description, $defs) say nothing about values; any other keyword is refused. As in
the standard a keyword applies to values of its type only, and 1.0 is an integer.
"""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F

SILENT = {"$schema", "$id", "$defs", "title", "description", "$comment"}


def kind_of(v: Column) -> Column:
    """JSON type of a variant: null, boolean, integer, number, string, array, object; null where there is no value."""
    name = F.schema_of_variant(v)
    whole = F.expr("true") & (F.try_variant_get(v, "$", "decimal(38,10)") % 1 == 0)
    number = name.startswith("DECIMAL") | name.isin("DOUBLE", "FLOAT")
    kinds = [(name == "VOID", "null"), (name == "BOOLEAN", "boolean"), (name.isin("BIGINT", "INT", "SMALLINT", "TINYINT"), "integer"), (number & whole, "integer"), (number, "number"), (name.startswith("ARRAY"), "array"), (name.startswith("OBJECT"), "object")]
    out = F.lit("string")
    for test, kind in reversed(kinds):
        out = F.when(test, kind).otherwise(out)
    return F.when(v.isNotNull(), out)


def _text(v: Column) -> Column:
    return F.try_variant_get(v, "$", "string")


def _number(v: Column) -> Column:
    return F.try_variant_get(v, "$", "double")


def _elements(v: Column) -> Column:
    return F.try_variant_get(v, "$", "array<variant>")


def _member(v: Column, name: str) -> Column:
    return F.try_variant_get(v, "$['" + name.replace("'", "\\'") + "']", "variant")


def _same(v: Column, value) -> Column:
    return F.to_json(v) == F.lit(json.dumps(value, ensure_ascii=False, separators=(",", ":")))


def _bound(value: Column, then) -> Column:
    """then(value) with the value computed once, however often it is used."""
    return F.transform(F.array(value), then)[0]


class Compiler:
    def __init__(self, schema: dict):
        self.root = schema

    def _resolved(self, schema: dict) -> dict:
        while "$ref" in schema:
            found = self.root
            for part in schema["$ref"].removeprefix("#/").split("/"):
                found = found[part]
            schema = found
        return schema

    def faults(self, v: Column, schema: dict, path: str) -> Column:
        """Array of `path keyword` strings for what a present value violates."""
        schema = self._resolved(schema)
        return _bound(F.struct(v.alias("v"), kind_of(v).alias("kind")), lambda x: self._faults(x["v"], x["kind"], schema, path))

    def _faults(self, v: Column, kind: Column, schema: dict, path: str) -> Column:
        out: list[Column] = []  # of arrays
        is_ = lambda k: kind == k

        def fault(test: Column, keyword: str, where: str = path) -> None:
            """A violation where the test is false (null counts as false)."""
            out.append(F.when(~F.coalesce(test, F.lit(False)), F.array(F.lit(f"{where} {keyword}"))).otherwise(F.array().cast("array<string>")))

        for keyword, value in schema.items():
            if keyword in SILENT or keyword in ("then", "else"):
                continue
            if keyword == "type":
                allowed = [value] if isinstance(value, str) else list(value)
                allowed += ["integer"] * ("number" in allowed)
                fault(kind.isin(allowed), keyword)
            elif keyword == "const":
                fault(_same(v, value), keyword)
            elif keyword == "enum":
                test = F.lit(False)
                for x in value:
                    test = test | _same(v, x)
                fault(test, keyword)
            elif keyword == "pattern":
                fault(~is_("string") | _text(v).rlike(value), keyword)
            elif keyword == "format":
                if value != "date-time":
                    raise ValueError(f"format {value}")
                fault(~is_("string") | (_text(v).rlike(r"^\d{4}-\d\d-\d\d[Tt]\d\d:\d\d:\d\d(\.\d+)?([Zz]|[+-]\d\d:\d\d)$") & F.try_to_timestamp(F.upper(_text(v))).isNotNull()), keyword)
            elif keyword in ("minLength", "maxLength"):
                n = F.length(_text(v))
                fault(~is_("string") | (n >= value if keyword == "minLength" else n <= value), keyword)
            elif keyword in ("minimum", "maximum"):
                fault(~kind.isin("integer", "number") | (_number(v) >= value if keyword == "minimum" else _number(v) <= value), keyword)
            elif keyword in ("minItems", "maxItems"):
                n = F.size(_elements(v))
                fault(~is_("array") | (n >= value if keyword == "minItems" else n <= value), keyword)
            elif keyword == "uniqueItems":
                if value:
                    texts = F.transform(_elements(v), lambda x: F.to_json(x))
                    fault(~is_("array") | (F.size(F.array_distinct(texts)) == F.size(texts)), keyword)
            elif keyword == "items":
                each = F.flatten(F.transform(_elements(v), lambda x: self.faults(x, value, f"{path}[]")))  # noqa: B023
                out.append(F.when(is_("array"), F.array_distinct(each)).otherwise(F.array().cast("array<string>")))
            elif keyword == "required":
                for name in value:
                    fault(~is_("object") | _member(v, name).isNotNull(), keyword, f"{path}.{name}")
            elif keyword == "properties":
                for name, inner in value.items():
                    found = lambda m: F.when(m.isNotNull(), self.faults(m, inner, f"{path}.{name}")).otherwise(F.array().cast("array<string>"))  # noqa: B023, E731
                    out.append(_bound(F.when(is_("object"), _member(v, name)), found))
            elif keyword == "propertyNames":
                keys = F.json_object_keys(F.to_json(v))
                fault(~is_("object") | F.forall(keys, lambda k: k.rlike(value["pattern"])), keyword)  # noqa: B023
            elif keyword == "additionalProperties":
                known = list(schema.get("properties", {}))
                more = F.filter(F.json_object_keys(F.to_json(v)), lambda k: ~k.isin(known) if known else F.lit(True))  # noqa: B023
                if value is False:
                    fault(~is_("object") | (F.size(more) == 0), keyword)
                elif value is not True:
                    held = F.map_filter(F.try_variant_get(v, "$", "map<string,variant>"), lambda k, _: ~k.isin(known) if known else F.lit(True))  # noqa: B023
                    each = F.flatten(F.transform(F.map_values(held), lambda x: self.faults(x, value, f"{path}.*")))  # noqa: B023
                    out.append(F.when(is_("object"), F.array_distinct(each)).otherwise(F.array().cast("array<string>")))
            elif keyword == "allOf":
                out += [self.faults(v, s, path) for s in value]
            elif keyword == "if":
                holds = F.size(self.faults(v, value, path)) == 0
                for branch, test in (("then", holds), ("else", ~holds)):
                    if branch in schema:
                        out.append(F.when(test, self.faults(v, schema[branch], path)).otherwise(F.array().cast("array<string>")))
            else:
                raise ValueError(f"keyword {keyword}")
        return F.concat(*out) if out else F.array().cast("array<string>")


def violations(value: Column, schema: dict) -> Column:
    """Sorted distinct violations of a JSON text: `$.path keyword`; `$ json` where it is none (null included), empty where
    it fits the schema."""
    found = lambda v: F.when(v.isNull(), F.array(F.lit("$ json"))).otherwise(F.array_sort(F.array_distinct(Compiler(schema).faults(v, schema, "$"))))
    return _bound(F.try_parse_json(value), found)
