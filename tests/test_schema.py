"""Declarations. Random ones come from the rules of the schema module, and each rule is broken in turn."""

import copy

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import types as T

from ledgerframe import schema
from ledgerframe.errors import SchemaRefused
from ledgerframe.schema import check_history, check_sort, from_struct, to_struct

names = st.text("abcdefgh_", min_size=1, max_size=6)
#: (declaration, type) of each scalar that the tables of the module have.
scalars = [({"type": "boolean"}, T.BooleanType()), ({"type": "string"}, T.StringType())]
scalars += [({"type": kind} | ({"format": f} if f else {}), t) for kind, table in (("integer", schema.INTEGERS), ("number", schema.NUMBERS)) for f, t in table.items()]
scalars += [({"type": "string", "contentEncoding": e} | ({"format": f"bytes{w}"} if w else {}), T.BinaryType()) for e in schema.ENCODINGS for w in (0, 1, 32)]


@st.composite
def declared(draw, depth=2):
    """(declaration, type, nullable) of a column."""
    shape = draw(st.sampled_from(["scalar", "array", "map", "struct"] if depth else ["scalar"]))
    nullable = draw(st.booleans())
    if shape == "scalar":
        spec, kind = draw(st.sampled_from(scalars))
        spec = dict(spec)
    elif shape == "struct":
        spec, kind = draw(rows(depth - 1))
    else:
        inner, t, null = draw(declared(depth - 1))
        spec, kind = ({"type": "array", "items": inner}, T.ArrayType(t, null)) if shape == "array" else ({"type": "object", "additionalProperties": inner}, T.MapType(T.StringType(), t, null))
    return (spec | {"type": draw(st.permutations([spec["type"], "null"]))} if nullable else spec), kind, nullable


@st.composite
def rows(draw, depth=2):
    """(declaration, struct) of a row; columns that admit null may be optional."""
    columns = draw(st.dictionaries(names, declared(depth), min_size=1, max_size=4))
    required = [c for c, (_, _, nullable) in columns.items() if not nullable or draw(st.booleans())]
    return {"type": "object", "properties": {c: s for c, (s, _, _) in columns.items()}, "required": required}, T.StructType([T.StructField(c, t, n) for c, (_, t, n) in columns.items()])


def bare(kind):
    """A type without metadata."""
    if isinstance(kind, T.StructType):
        return T.StructType([T.StructField(f.name, bare(f.dataType), f.nullable) for f in kind])
    if isinstance(kind, T.ArrayType):
        return T.ArrayType(bare(kind.elementType), kind.containsNull)
    return T.MapType(kind.keyType, bare(kind.valueType), kind.valueContainsNull) if isinstance(kind, T.MapType) else kind


@settings(max_examples=150, deadline=None)
@given(rows())
def test_a_declaration_has_one_struct_and_comes_back(row):
    spec, want = row
    before = copy.deepcopy(spec)
    struct = to_struct(spec)
    assert bare(struct) == want and spec == before
    spelled = from_struct(struct)
    assert to_struct(spelled) == struct and from_struct(to_struct(spelled)) == spelled
    check_history([struct, struct], struct)
    check_sort(struct, struct.names)
    for bad in (struct.names + struct.names[:1], ["no such column"]):
        with pytest.raises(SchemaRefused):
            check_sort(struct, bad)


def breaking(spec):
    """Declarations of a column that break one rule each, made from one that breaks none."""
    plain = spec["type"] if isinstance(spec["type"], str) else next(k for k in spec["type"] if k != "null")
    other = "boolean" if plain != "boolean" else "integer"
    yield {k: v for k, v in spec.items() if k != "type"}  # no type
    yield spec | {"type": [plain, other]}  # two types
    yield spec | {"type": "null"}  # null alone
    yield spec | {"type": plain + "s"}  # an unknown type
    if plain in ("boolean", "integer", "number"):
        yield spec | {"format": "no such format"}
    if plain == "string":
        yield {"type": "string", "format": "no such format"}
        yield spec | {"contentEncoding": "base" + str(sum(map(int, "".join(c for e in schema.ENCODINGS for c in e if c.isdigit()))))}
        yield {"type": "string", "contentEncoding": schema.ENCODINGS[0], "format": "bytes0"}
    if plain == "array":
        yield {"type": "array"}
    if plain == "object":
        yield {"type": "object"}
        yield {"type": "object", "properties": {"a": {"type": "boolean"}}, "required": ["a"], "additionalProperties": {"type": "boolean"}}
        yield {"type": "object", "properties": {"a": {"type": "boolean"}}}  # optional, but not null
        yield {"type": "object", "properties": {"a": {"type": "boolean"}}, "required": ["a", "b"]}


@settings(max_examples=60, deadline=None)
@given(declared(), st.integers(0, 2))
def test_each_rule_that_is_broken_is_refused(column, depth):
    spec, _, _ = column
    for bad in breaking(spec):
        for _ in range(depth):
            bad = {"type": "array", "items": bad}
        with pytest.raises(SchemaRefused):
            to_struct({"type": "object", "properties": {"c": bad}, "required": ["c"]})
        with pytest.raises(SchemaRefused):
            to_struct({"type": "object", "properties": {"fine": {"type": "string"}, "c": bad}, "required": ["fine", "c"]})


@pytest.mark.parametrize("bad", ["text", None, 3, [], {"type": "array"}, {"type": "object"}, {"type": "object", "properties": {}}])
def test_a_row_is_an_object_with_columns(bad):
    with pytest.raises((SchemaRefused, AttributeError)):
        to_struct(bad)


@pytest.mark.parametrize("name", schema.SYSTEM.names)
def test_the_logs_own_columns_are_taken(name):
    with pytest.raises(SchemaRefused):
        to_struct({"type": "object", "properties": {name: {"type": "integer"}}, "required": [name]})


@settings(max_examples=100, deadline=None)
@given(declared(), declared(), st.booleans())
def test_a_columns_type_is_fixed_also_after_it_was_dropped(one, two, dropped):
    row = lambda c: to_struct({"type": "object", "properties": {"c": c[0]} | {"d": {"type": "string"}}, "required": ["c", "d"]})
    a, b = row(one), row(two)
    history = [a, to_struct({"type": "object", "properties": {"d": {"type": "string"}}, "required": ["d"]})] if dropped else [a]
    if schema.shape(a["c"].dataType, a["c"].metadata) == schema.shape(b["c"].dataType, b["c"].metadata):
        check_history(history, b)  # whether the column itself admits null may change
    else:
        with pytest.raises(SchemaRefused):
            check_history(history, b)
