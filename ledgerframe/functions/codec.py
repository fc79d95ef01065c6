"""Binary text codecs, also inside structs, maps and arrays, and wire frames; all built-in expressions."""

from __future__ import annotations

import base64
import binascii

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import RowsRefused
from ..limits import OFFSET, TS


def decode_text(text: str, encoding: str) -> bytes:
    try:
        return bytes.fromhex(text) if encoding == "base16" and " " not in text else base64.b64decode(text, validate=True) if encoding == "base64" else _bad(text, encoding)
    except (ValueError, binascii.Error) as e:
        raise RowsRefused(f"{text!r} isn't {encoding}") from e


def _bad(text, encoding):
    raise ValueError(f"{text!r} isn't {encoding}")


def to_bytes(text: Column, encoding: str) -> Column:
    """Bytes of a text; a text that isn't in the encoding is an error, not null."""
    raw = F.try_to_binary(text, F.lit("hex" if encoding == "base16" else "base64"))
    # Spark pads hex of odd length, which isn't whole bytes.
    whole = raw.isNotNull() & (F.length(text) % 2 == 0) if encoding == "base16" else raw.isNotNull()
    return F.when(text.isNull(), None).when(whole, raw).otherwise(F.raise_error(F.concat(F.lit(f"not {encoding}: "), text)))


def to_text(raw: Column, encoding: str) -> Column:
    """Lower-case hex, or base64 with padding and without line breaks."""
    return F.lower(F.hex(raw)) if encoding == "base16" else F.regexp_replace(F.base64(raw), "[\\r\\n]", "")


def _walk(value: Column, kind: T.DataType, meta: dict, leaf) -> Column:
    if isinstance(kind, T.BinaryType):
        return leaf(value, meta.get("encoding", "base64"))
    if not _binary(kind):
        return value
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: _walk(x, kind.elementType, meta.get("items", {}), leaf))
    if isinstance(kind, T.MapType):
        return F.transform_values(value, lambda _, x: _walk(x, kind.valueType, meta.get("values", {}), leaf))
    inner = F.struct(*[_walk(value[f.name], f.dataType, f.metadata, leaf).alias(f.name) for f in kind])
    return F.when(value.isNull(), None).otherwise(inner)


def _binary(kind: T.DataType) -> bool:
    if isinstance(kind, T.StructType):
        return any(_binary(f.dataType) for f in kind)
    return isinstance(kind, T.BinaryType) or isinstance(kind, T.ArrayType) and _binary(kind.elementType) or isinstance(kind, T.MapType) and _binary(kind.valueType)


def inbound(schema: T.StructType) -> list[Column]:
    """The declared columns from a frame whose binary cells are text; columns without any are untouched."""
    return [_walk(F.col(f"`{f.name}`"), f.dataType, f.metadata, to_bytes).alias(f.name) for f in schema]


def outbound(schema: T.StructType) -> list[Column]:
    return [_walk(F.col(f"`{f.name}`"), f.dataType, f.metadata, to_text).alias(f.name) for f in schema]


def text_schema(kind: T.DataType) -> T.DataType:
    """A schema with text in the place of binary cells."""
    if isinstance(kind, T.StructType):
        return T.StructType([T.StructField(f.name, text_schema(f.dataType), True) for f in kind])
    if isinstance(kind, T.ArrayType):
        return T.ArrayType(text_schema(kind.elementType))
    if isinstance(kind, T.MapType):
        return T.MapType(T.StringType(), text_schema(kind.valueType))
    return T.StringType() if isinstance(kind, T.BinaryType) else kind


def frames(schema: T.StructType) -> Column:
    """``[offset,ts,row]`` as JSON, keys in schema order, absent cells as null."""
    row = F.to_json(F.struct(*outbound(schema)), {"ignoreNullFields": "false"})
    number = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("null"))
    return F.concat(F.lit("["), number(OFFSET), F.lit(","), number(TS), F.lit(","), row, F.lit("]"))


def parse_frames(frame: Column, schema: T.StructType) -> list[Column]:
    """Offset, stamp and the row struct (binary cells still text) of a frame; a broken one is an error."""
    parts = F.from_json(F.concat(F.lit('{"f":'), frame, F.lit("}")), "f array<string>", {"mode": "FAILFAST"})["f"]
    return [parts[0].cast("long").alias(OFFSET), parts[1].try_cast("long").alias(TS), F.from_json(parts[2], text_schema(schema), {"mode": "FAILFAST"}).alias("row")]
