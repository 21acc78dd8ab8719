"""Types: catalog kinds and JSON Schema to Spark types and back, and schema constraints as predicates."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Catalog type kinds. Unsigned 64-bit numbers need a decimal; JSON is a variant.
KINDS = {
    "BOOL": T.BooleanType(), "BYTES": T.BinaryType(), "DOUBLE": T.DoubleType(), "ENUM": T.StringType(), "FLOAT": T.FloatType(), "INT32": T.IntegerType(), "INT64": T.LongType(), "STRING": T.StringType(),
    "UINT32": T.LongType(), "UINT64": T.DecimalType(20, 0), "JSON": T.VariantType(), "DURATION": T.DayTimeIntervalType(), "TIMESTAMP": T.TimestampType(),
}
NATIVE = {"boolean": "BOOL", "binary": "BYTES", "double": "DOUBLE", "float": "FLOAT", "int": "INT32", "bigint": "INT64", "string": "STRING", "decimal(20,0)": "UINT64", "variant": "JSON", "timestamp": "TIMESTAMP", "timestamp_ntz": "TIMESTAMP", "interval day to second": "DURATION"}
UINT32_MAX = (1 << 32) - 1


def field_of(f: T.StructField) -> dict:
    """A field's description: name, type, nullable, repeated and nested fields."""
    t, repeated = f.dataType, isinstance(f.dataType, T.ArrayType)
    t = t.elementType if repeated else t
    nested = [field_of(x) for x in t.fields] if isinstance(t, T.StructType) else []
    return {"name": f.name, "type": "OBJECT" if nested else NATIVE.get(t.simpleString(), "STRING"), "native": t.simpleString(), "nullable": f.nullable, "repeated": repeated, "fields": nested, "description": f.metadata.get("comment", "")}


def find_native(name: str) -> str | None:
    """A kind by its native name, without case."""
    return next((k for n, k in NATIVE.items() if n.lower() == name.lower()), None)


def declared_format(s: dict, extension: str | None = None) -> str | None:
    """The value of the extension key, if one is named and there, comes before the standard one."""
    return s.get(extension, s.get("format")) if extension else s.get("format")


def integer_type(s: dict, extension: str | None = None) -> T.DataType:
    kind = declared_format(s, extension)
    if kind in ("int32", "int64", "uint32", "uint64"):
        return KINDS[kind.upper()]
    if s.get("minimum", -1) >= 0:
        return KINDS["UINT64"] if s.get("maximum", 0) > UINT32_MAX else KINDS["UINT32"]
    return T.IntegerType()


def from_json_schema(s: dict, root: dict | None = None, extension: str | None = None) -> T.DataType:
    """The Spark type of a JSON Schema; $ref is looked up in $defs or definitions of the root. extension: a key that names formats."""
    root = s if root is None else root
    if "$ref" in s:
        at = root
        for part in s["$ref"].removeprefix("#/").split("/"):
            at = at[part]
        return from_json_schema(at, root, extension)
    for key in ("anyOf", "oneOf"):
        if len(s.get(key, [])) == 2 and any(x.get("type") == "null" for x in s[key]):
            return from_json_schema(next(x for x in s[key] if x.get("type") != "null"), root, extension)
    kind = s.get("type", "object" if "properties" in s else "string")
    if kind == "boolean":
        return T.BooleanType()
    if kind == "integer":
        return integer_type(s, extension)
    if kind == "number":
        return T.FloatType() if declared_format(s, extension) == "float" else T.DoubleType()
    if kind == "array":
        return T.ArrayType(from_json_schema(s.get("items", {}), root, extension))
    if kind == "object":
        if "properties" not in s and isinstance(s.get("additionalProperties"), dict):
            return T.MapType(T.StringType(), from_json_schema(s["additionalProperties"], root, extension))
        need = set(s.get("required", []))
        return T.StructType([T.StructField(sanitize(n), t := from_json_schema(p, root, extension), n not in need and not isinstance(t, (T.ArrayType, T.MapType))) for n, p in s.get("properties", {}).items()])
    return {"byte": T.BinaryType(), "binary": T.BinaryType(), "duration": T.DayTimeIntervalType(), "date-time": T.TimestampType()}.get(s.get("format"), T.StringType())


def sanitize(name: str) -> str:
    name = re.sub(r"[^A-Za-z0-9_]", "_", name)
    return f"_{name}" if name[:1].isdigit() else name


def to_json_schema(t: T.DataType) -> dict:
    """The JSON Schema of a Spark type."""
    if isinstance(t, T.StructType):
        return {"type": "object", "properties": {f.name: to_json_schema(f.dataType) for f in t.fields}, "required": [f.name for f in t.fields if not f.nullable]}
    if isinstance(t, T.ArrayType):
        return {"type": "array", "items": to_json_schema(t.elementType)}
    if isinstance(t, T.MapType):
        return {"type": "object", "additionalProperties": to_json_schema(t.valueType)}
    if isinstance(t, T.DecimalType):
        return {"type": "integer", "format": "uint64"} if (t.precision, t.scale) == (20, 0) else {"type": "number"}
    return {"boolean": {"type": "boolean"}, "int": {"type": "integer", "format": "int32"}, "bigint": {"type": "integer", "format": "int64"}, "double": {"type": "number"}, "float": {"type": "number", "format": "float"}, "binary": {"type": "string", "format": "byte"}, "timestamp": {"type": "string", "format": "date-time"}}.get(t.simpleString(), {"type": "string"})


FORMATS = {
    "email": r"^[^@\s]+@[^@\s]+\.[^@\s]+$", "hostname": r"^(?=.{1,253}$)[A-Za-z0-9]([A-Za-z0-9-]{0,61}[A-Za-z0-9])?(\.[A-Za-z0-9]([A-Za-z0-9-]{0,61}[A-Za-z0-9])?)*$", "ipv4": r"^((25[0-5]|2[0-4]\d|1?\d?\d)(\.|$)){4}(?<!\.)$",
    "uri": r"^[A-Za-z][A-Za-z0-9+.-]*:\S+$", "uuid": r"^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$",
}


def constraint(c: Column, s: dict) -> Column:
    """Whether a value keeps a schema's constraints; null keeps them."""
    tests = [F.lit(True)]
    for key, test in (
        ("minLength", lambda v: F.length(c) >= v), ("maxLength", lambda v: F.length(c) <= v), ("pattern", lambda v: c.rlike(v)), ("minimum", lambda v: c >= v), ("maximum", lambda v: c <= v), ("exclusiveMinimum", lambda v: c > v), ("exclusiveMaximum", lambda v: c < v),
        ("multipleOf", lambda v: c % v == 0), ("enum", lambda v: c.isin(v)), ("minItems", lambda v: F.size(c) >= v), ("maxItems", lambda v: F.size(c) <= v), ("format", lambda v: c.rlike(FORMATS[v]) if v in FORMATS else F.lit(True)),
    ):
        if key in s:
            tests.append(test(s[key]))
    return F.coalesce(reduce(lambda a, b: a & b, tests), F.lit(True))


def valid_row(schema: dict) -> Column:
    """A predicate over the columns of an object schema: constraints, and required fields present."""
    need = set(schema.get("required", []))
    tests = [constraint(F.col(sanitize(n)), p) & (F.col(sanitize(n)).isNotNull() if n in need else F.lit(True)) for n, p in schema.get("properties", {}).items()]
    return reduce(lambda a, b: a & b, tests, F.lit(True))
