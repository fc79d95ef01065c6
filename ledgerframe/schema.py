"""JSON Schema declarations and Spark schemas.

A column is nullable exactly if its declared type admits null; an optional column must be nullable.
Parquet gives every column back as nullable, so the declaration is the authority and is checked on write.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import types as T

from .errors import SchemaRefused
from .limits import OFFSET, TS

INTEGERS = {None: T.LongType(), "int64": T.LongType(), "int32": T.IntegerType()}
NUMBERS = {None: T.DoubleType(), "double": T.DoubleType(), "float": T.FloatType()}
ENCODINGS = ("base16", "base64")
SYSTEM = T.StructType([T.StructField(OFFSET, T.LongType(), False), T.StructField(TS, T.LongType(), False)])


def _kinds(name: str, spec: Any) -> tuple[str, bool]:
    """The one non-null type of a property and whether null is allowed beside it."""
    if not isinstance(spec, dict) or "type" not in spec:
        raise SchemaRefused(f"{name}: a property needs a type")
    kinds = spec["type"] if isinstance(spec["type"], list) else [spec["type"]]
    plain = [k for k in kinds if k != "null"]
    if not plain:
        raise SchemaRefused(f"{name}: a column that is only null holds nothing")
    if len(plain) > 1:
        raise SchemaRefused(f"{name}: a column has one type, not {' or '.join(plain)}")
    return plain[0], "null" in kinds


def _type(name: str, spec: dict, kind: str) -> tuple[T.DataType, dict]:
    fmt = spec.get("format")
    if kind == "boolean":
        if fmt is not None:
            raise SchemaRefused(f"{name}: boolean has no format")
        return T.BooleanType(), {}
    for own, table in (("integer", INTEGERS), ("number", NUMBERS)):
        if kind == own:
            if fmt not in table:
                raise SchemaRefused(f"{name}: {kind} has no format {fmt!r}")
            return table[fmt], {}
    if kind == "string":
        encoding = spec.get("contentEncoding")
        if encoding is None:
            if fmt is not None:
                raise SchemaRefused(f"{name}: string has no format {fmt!r}; times are integers")
            return T.StringType(), {}
        if encoding not in ENCODINGS:
            raise SchemaRefused(f"{name}: contentEncoding is base16 or base64, not {encoding!r}")
        if fmt is None:
            return T.BinaryType(), {"encoding": encoding}
        width = fmt[5:] if fmt.startswith("bytes") else ""
        if not width.isdigit() or int(width) < 1:
            raise SchemaRefused(f"{name}: a binary column's format is bytesN, not {fmt!r}")
        return T.BinaryType(), {"encoding": encoding, "width": int(width)}
    if kind == "array":
        if "items" not in spec:
            raise SchemaRefused(f"{name}: an array needs items")
        inner, nullable, meta = _value(f"{name}[]", spec["items"])
        return T.ArrayType(inner, nullable), {"items": meta} if meta else {}
    if kind == "object":
        extra = spec.get("additionalProperties")
        if "properties" in spec and isinstance(extra, dict):
            raise SchemaRefused(f"{name}: an object has properties or additionalProperties, not both")
        if "properties" in spec:
            return _struct(name, spec), {}
        if isinstance(extra, dict):
            inner, nullable, meta = _value(f"{name}{{}}", extra)
            return T.MapType(T.StringType(), inner, nullable), {"values": meta} if meta else {}
        raise SchemaRefused(f"{name}: an object needs properties or additionalProperties")
    raise SchemaRefused(f"{name}: no column type {kind!r}")


def _value(name: str, spec: Any) -> tuple[T.DataType, bool, dict]:
    kind, nullable = _kinds(name, spec)
    inner, meta = _type(name, spec, kind)
    return inner, nullable, meta


def _struct(name: str, spec: dict) -> T.StructType:
    properties, required = spec.get("properties") or {}, spec.get("required") or []
    unknown = [c for c in required if c not in properties]
    if unknown:
        raise SchemaRefused(f"{name}: required names {', '.join(unknown)}, which isn't declared")
    fields = []
    for column, own in properties.items():
        inner, nullable, meta = _value(f"{name}.{column}" if name else column, own)
        if column not in required and not nullable:
            raise SchemaRefused(f"{column}: an optional column must admit null")
        fields.append(T.StructField(column, inner, nullable, meta))
    return T.StructType(fields)


def to_struct(spec: dict) -> T.StructType:
    """The Spark schema of a declared row; fields keep their order, nullability and binary encodings."""
    if spec.get("type") != "object" or not spec.get("properties"):
        raise SchemaRefused("a row is an object with properties")
    taken = [c for c in spec["properties"] if c in SYSTEM.names]
    if taken:
        raise SchemaRefused(f"{', '.join(taken)} belong to the log")
    return _struct("", spec)


def _spell(kind: T.DataType, nullable: bool, meta: dict) -> dict:
    plain = {T.BooleanType: {"type": "boolean"}, T.LongType: {"type": "integer", "format": "int64"}, T.IntegerType: {"type": "integer", "format": "int32"}, T.DoubleType: {"type": "number", "format": "double"}, T.FloatType: {"type": "number", "format": "float"}, T.StringType: {"type": "string"}}
    if type(kind) in plain:
        out = dict(plain[type(kind)])
    elif isinstance(kind, T.BinaryType):
        out = {"type": "string", "contentEncoding": meta.get("encoding", "base64")} | ({"format": f"bytes{meta['width']}"} if "width" in meta else {})
    elif isinstance(kind, T.ArrayType):
        out = {"type": "array", "items": _spell(kind.elementType, kind.containsNull, meta.get("items", {}))}
    elif isinstance(kind, T.MapType):
        out = {"type": "object", "additionalProperties": _spell(kind.valueType, kind.valueContainsNull, meta.get("values", {}))}
    elif isinstance(kind, T.StructType):
        out = {"type": "object"} | {k: v for k, v in from_struct(kind).items() if k != "type"}
    else:
        raise SchemaRefused(f"no declaration for {kind.simpleString()}")
    return out | ({"type": [out["type"], "null"]} if nullable else {})


def from_struct(struct: T.StructType) -> dict:
    """The declaration of a Spark schema, widths and null written out; ``to_struct`` gives the schema back."""
    return {"type": "object", "properties": {f.name: _spell(f.dataType, f.nullable, f.metadata) for f in struct}, "required": [f.name for f in struct]}


def shape(kind: T.DataType, meta: dict | None = None) -> Any:
    """What must not change for the life of a stream: a type with its inner nullability and encodings."""
    meta = meta or {}
    if isinstance(kind, T.StructType):
        return {f.name: [shape(f.dataType, f.metadata), f.nullable] for f in kind}
    if isinstance(kind, T.ArrayType):
        return ["array", shape(kind.elementType, meta.get("items")), kind.containsNull]
    if isinstance(kind, T.MapType):
        return ["map", shape(kind.valueType, meta.get("values")), kind.valueContainsNull]
    return [kind.simpleString(), meta.get("encoding"), meta.get("width")]


def check_history(history: list[T.StructType], new: T.StructType) -> None:
    """A column's type is fixed for the life of a stream, also after it was dropped and declared again."""
    known: dict[str, Any] = {}
    for struct in [*history, new]:
        for f in struct:
            own = shape(f.dataType, f.metadata)
            if known.setdefault(f.name, own) != own:
                raise SchemaRefused(f"{f.name} is {known[f.name]} in this stream and cannot become {own}")


def check_sort(struct: T.StructType, sort_by: list[str]) -> None:
    if len(set(sort_by)) != len(sort_by) or any(c not in struct.names for c in sort_by):
        raise SchemaRefused(f"sort_by {sort_by} must name declared columns once")
