"""Schemas that act (U02-U04): a JSON Schema compiled to a Spark type, and to predicates over VARIANT arguments.

The schema is read once, in the driver; what comes out are Columns, so that arguments are cast and checked in the JVM and a
plan can filter on the result. Keywords that aren't known are left alone, as the format asks.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators.calls import fields, is_object, items, kind

SIMPLE = {"string": T.StringType(), "integer": T.LongType(), "number": T.DoubleType(), "boolean": T.BooleanType()}
#: Variant kinds of each JSON type.
KINDS = {"string": ("STRING",), "integer": ("BIGINT",), "number": ("BIGINT", "DECIMAL", "DOUBLE", "FLOAT"), "boolean": ("BOOLEAN",), "null": ("VOID",), "array": ("ARRAY",), "object": ("OBJECT",)}
NONE = "array<string>"


def types_of(schema: dict) -> list[str]:
    t = schema.get("type")
    return [t] if isinstance(t, str) else [x for x in t or [] if isinstance(x, str)]


def spark_type(schema: dict) -> T.DataType:
    """The type that a schema's values have in a table; what has no single type stays VARIANT."""
    known = [t for t in types_of(schema) if t != "null"]
    if len(known) != 1:
        members = {type(v) for v in schema.get("enum") or ()} - {type(None)}
        alone = {str: "string", int: "integer", float: "number", bool: "boolean"}.get(members.pop()) if len(members) == 1 else None
        return SIMPLE[alone] if alone else T.VariantType()
    if known[0] in SIMPLE:
        return SIMPLE[known[0]]
    if known[0] == "array":
        return T.ArrayType(spark_type(schema["items"])) if isinstance(schema.get("items"), dict) else T.ArrayType(T.VariantType())
    if known[0] == "object" and schema.get("properties"):
        return struct_type(schema)
    if known[0] == "object":
        return T.MapType(T.StringType(), spark_type(schema["additionalProperties"]) if isinstance(schema.get("additionalProperties"), dict) else T.VariantType())
    return T.VariantType()


def struct_type(schema: dict) -> T.StructType:
    """A tool's parameters as a StructType; what isn't required may be null, and descriptions go to the metadata."""
    required = set(schema.get("required") or ())
    note = lambda s: {"comment": s["description"]} if s.get("description") else {}
    return T.StructType([T.StructField(k, spark_type(s), k not in required, note(s)) for k, s in (schema.get("properties") or {}).items() if isinstance(s, dict)])


def member(v: Column, key: str) -> Column:
    """A member of a VARIANT object, whatever its name; null if there is none."""
    return F.try_element_at(fields(v), F.lit(key))


def _ddl(t: T.DataType) -> str:
    """A type as text, with quoted names."""
    if isinstance(t, T.StructType):
        return "struct<" + ",".join(f"`{f.name.replace('`', '``')}`:{_ddl(f.dataType)}" for f in t.fields) + ">"
    return f"array<{_ddl(t.elementType)}>" if isinstance(t, T.ArrayType) else f"map<string,{_ddl(t.valueType)}>" if isinstance(t, T.MapType) else t.simpleString()


def typed(arguments: Column, schema: dict) -> Column:
    """The arguments as a struct of ``struct_type``; what can't be cast is null, and defaults stand in for what is absent."""
    out = []
    for f in struct_type(schema).fields:
        v = F.try_variant_get(member(arguments, f.name), "$", _ddl(f.dataType))
        default = schema["properties"][f.name].get("default")
        if default is not None:
            given = F.lit(json.dumps(default))
            v = F.coalesce(v, F.try_variant_get(F.parse_json(given), "$", _ddl(f.dataType)))
        out.append(v.alias(f.name))
    return F.struct(*out) if out else F.struct(F.lit(None).alias("_none"))


def _all(parts: list[Column]) -> Column:
    return reduce(lambda a, b: F.concat(a, b), parts) if parts else F.array().cast(NONE)


def _unless(ok: Column, path: Column, what: str) -> Column:
    return F.when(F.coalesce(ok, F.lit(False)), F.array().cast(NONE)).otherwise(F.array(F.concat(path, F.lit(f": {what}"))))


def _problems(v: Column, schema: dict, path: Column) -> Column:
    """What is wrong with a value that is there, by place, in the order of the schema."""
    k, checks = kind(v), []
    if types := types_of(schema):
        known = [n for t in types for n in KINDS.get(t, ())]
        whole = F.lit(False)
        if "integer" in types:  # 2.0 is an integer
            x = F.try_variant_get(v, "$", "double")
            whole = k.isin("DECIMAL", "DOUBLE") & (x == F.floor(x))
        checks.append(_unless(k.isin(*known) | whole, path, f"is not {' or '.join(types)}"))
    if "enum" in schema:
        checks.append(_unless(F.to_json(v).isin(*[json.dumps(e, ensure_ascii=False, separators=(",", ":")) for e in schema["enum"]]), path, "is not one of the choices"))
    x, number = F.try_variant_get(v, "$", "double"), k.isin(*KINDS["number"])
    bounds = {"minimum": lambda b: x >= b, "maximum": lambda b: x <= b, "exclusiveMinimum": lambda b: x > b, "exclusiveMaximum": lambda b: x < b, "multipleOf": lambda b: F.abs(x / b - F.round(x / b)) < 1e-9}
    n, text = F.length(F.try_variant_get(v, "$", "string")), k == "STRING"
    lengths = {"minLength": lambda b: n >= b, "maxLength": lambda b: n <= b, "pattern": lambda b: F.rlike(F.try_variant_get(v, "$", "string"), b)}
    m, list_ = F.size(items(v)), k == "ARRAY"
    sizes = {"minItems": lambda b: m >= b, "maxItems": lambda b: m <= b}
    for applies, rules in ((number, bounds), (text, lengths), (list_, sizes)):
        for key, holds in rules.items():
            if schema.get(key) is not None:
                bound = F.lit(schema[key] if key == "pattern" else float(schema[key]))
                checks.append(_unless(~applies | holds(bound), path, f"{key} {schema[key]}"))
    if isinstance(schema.get("items"), dict):
        inner = lambda e, i: _problems(e, schema["items"], F.concat(path, F.lit("["), i.cast("string"), F.lit("]")))
        checks.append(F.when(list_, F.flatten(F.transform(items(v), inner))).otherwise(F.array().cast(NONE)))
    if schema.get("anyOf"):
        checks.append(_unless(reduce(lambda a, b: a | b, [F.size(_problems(v, s, path)) == 0 for s in schema["anyOf"]]), path, "fits none of the alternatives"))
    if isinstance(schema.get("properties"), dict):
        checks.append(F.when(k == "OBJECT", _members(v, schema, path)).otherwise(F.array().cast(NONE)))
    return _all(checks)


def _members(v: Column, schema: dict, path: Column) -> Column:
    at = lambda key: F.concat(path, F.when(path == "", F.lit("")).otherwise(F.lit(".")), F.lit(key))
    props, required = schema.get("properties") or {}, set(schema.get("required") or ())
    has = lambda key: F.map_contains_key(fields(v), F.lit(key))
    checks = []
    for key, s in props.items():
        absent = F.array(F.concat(at(key), F.lit(": is missing"))) if key in required else F.array().cast(NONE)
        inner = F.when(member(v, key).isNull(), _null(s, at(key))).otherwise(_problems(member(v, key), s if isinstance(s, dict) else {}, at(key)))
        checks.append(F.when(has(key), inner).otherwise(absent))
    extra = F.array_except(F.map_keys(fields(v)), F.array(*[F.lit(k) for k in props]).cast(NONE))
    if schema.get("additionalProperties", False) is not True and props:
        checks.append(F.transform(F.array_sort(extra), lambda e: F.concat(path, F.when(path == "", F.lit("")).otherwise(F.lit(".")), e, F.lit(": is not declared"))))
    return _all(checks)


def _null(schema, path: Column) -> Column:
    types = types_of(schema) if isinstance(schema, dict) else []
    fine = not types or "null" in types
    return F.array().cast(NONE) if fine else F.array(F.concat(path, F.lit(f": is not {' or '.join(types)}")))


def violations(arguments: Column, schema: dict) -> Column:
    """The list of what is wrong with VARIANT arguments under a tool's parameters; empty if they fit.

    Arguments that aren't an object, or that can't be read, are one violation."""
    whole = F.array(F.lit("the arguments are not an object"))
    return F.when(is_object(arguments), _members(arguments, schema, F.lit(""))).otherwise(whole)


def checked(name: Column, arguments: Column, tools: list[dict]) -> Column:
    """Violations of a call to one of several tools (``build_schema`` gives them); an unknown tool is one."""
    out = F.array(F.concat(F.lit("no tool "), F.coalesce(name, F.lit("null"))))
    for t in reversed(tools):
        out = F.when(name == t["name"], violations(arguments, t["parameters"])).otherwise(out)
    return out

