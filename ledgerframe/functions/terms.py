"""Two predicate languages over columns; they share no code, since null means different things in them.

``subscription`` is two-valued: None matches null and missing cells, a value of another type matches nothing.
``filters`` is SQL's three-valued logic: a comparison with None, or membership in nothing, matches nothing.
"""

from __future__ import annotations

import json
import math
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import PredicateRefused
from . import codec

OPERATORS = ("==", "!=", "<", "<=", ">", ">=", "in")
Term = tuple[str, str, Any]


def validate_where(where: Any, schema: T.StructType | None) -> dict:
    """A JSON object of scalars or non-empty lists of scalars; columns must exist where a schema does."""
    if not isinstance(where, dict):
        raise PredicateRefused("where is an object of columns and values")
    for column, want in where.items():
        if schema is not None:
            if column not in schema.names:
                raise PredicateRefused(f"where names {column!r}, which isn't a column")
            if isinstance(schema[column].dataType, (T.StructType, T.ArrayType, T.MapType)):
                raise PredicateRefused(f"{column} isn't a scalar column")
        if isinstance(want, list) and not want:
            raise PredicateRefused(f"{column}: an empty list matches nothing")
        for v in want if isinstance(want, list) else [want]:
            if v is not None and not isinstance(v, (bool, int, float, str)):
                raise PredicateRefused(f"{column}: {type(v).__name__} isn't a scalar")
    return where


def decode_where(text: str) -> dict:
    try:
        return validate_where(json.loads(text), None)
    except ValueError as e:
        raise PredicateRefused(f"where isn't JSON: {e}") from e


def encode_where(where: dict) -> str:
    return json.dumps(where, separators=(",", ":"), ensure_ascii=False)


def _equals(field: T.StructField, value: Any) -> Column:
    """Python's ``==`` between a cell and a value, never null and never an error."""
    cell, kind = F.col(f"`{field.name}`"), field.dataType
    if value is None:
        return cell.isNull()
    nothing = F.lit(False)
    if isinstance(kind, T.BinaryType):
        raw = codec.decode_text(value, field.metadata.get("encoding", "base64")) if isinstance(value, str) else None
        return F.coalesce(cell == F.lit(raw), nothing) if raw is not None else nothing
    if isinstance(kind, T.StringType):
        return F.coalesce(cell == F.lit(value), nothing) if isinstance(value, str) else nothing
    if isinstance(value, str):
        return nothing
    if isinstance(kind, T.BooleanType):
        # True is 1 and False is 0.
        return F.coalesce(cell == F.lit(bool(value)), nothing) if value in (0, 1) else nothing
    if isinstance(kind, (T.LongType, T.IntegerType)):
        if isinstance(value, float) and (not math.isfinite(value) or value != int(value)):
            return nothing
        whole = int(value)
        return F.coalesce(cell.cast("long") == F.lit(whole).cast("long"), nothing) if -(1 << 63) <= whole < 1 << 63 else nothing
    if isinstance(value, float) and math.isnan(value):
        return nothing
    if isinstance(value, int) and (abs(value) >= 1 << 1023 or float(value) != value):
        return nothing  # no double equals it
    return F.coalesce(cell.cast("double") == F.lit(float(value)), nothing)


def subscription(where: dict, schema: T.StructType) -> Column:
    """The conjunction of equality and membership terms."""
    validate_where(where, schema)
    out = F.lit(True)
    for column, want in where.items():
        own = F.lit(False)
        for v in want if isinstance(want, list) else [want]:
            own = own | _equals(schema[column], v)
        out = out & own
    return out


def check_terms(terms: list[Term] | None, schema: T.StructType | None = None) -> list[Term]:
    out = []
    for term in terms or []:
        if len(term) != 3:
            raise PredicateRefused(f"a filter is (column, operator, value), not {term!r}")
        column, op, value = term
        if op not in OPERATORS:
            raise PredicateRefused(f"no operator {op!r}")
        if schema is not None and column not in schema.names:
            raise PredicateRefused(f"filters name {column!r}, which isn't a column")
        if op == "in" and not isinstance(value, (list, tuple, set)):
            raise PredicateRefused(f"{column} in needs a list")
        out.append((column, op, list(value) if op == "in" else value))
    return out


def filters(terms: list[Term] | None, schema: T.StructType | None = None) -> Column:
    """SQL's conjunction of comparisons; keeps no row where one is null."""
    out = F.lit(True)
    for column, op, value in check_terms(terms, schema):
        cell = F.col(f"`{column}`")
        if op == "in":
            known = [v for v in value if v is not None]
            own = cell.isin(known) if known else F.lit(False)
        elif value is None:
            own = F.lit(None).cast("boolean")
        else:
            v = F.lit(value)
            own = {"==": cell == v, "!=": cell != v, "<": cell < v, "<=": cell <= v, ">": cell > v, ">=": cell >= v}[op]
        out = out & own
    return out


def live_terms(where: dict, schema: T.StructType) -> list[Term]:
    """A live view's ``where`` means the same in both languages, so it takes non-null scalars on scalar columns only."""
    validate_where(where, schema)
    for column, want in where.items():
        values = want if isinstance(want, list) else [want]
        if any(v is None for v in values):
            raise PredicateRefused(f"{column}: a live view's where takes no null")
    return [(c, "in" if isinstance(v, list) else "==", v) for c, v in where.items()]


def apply(df: DataFrame, where: str | None = None, terms: list[Term] | None = None, schema: T.StructType | None = None) -> DataFrame:
    if terms:
        df = df.where(filters(terms, schema))
    return df.where(F.expr(where)) if where else df
