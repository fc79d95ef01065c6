"""The two predicate languages against plain Python on random rows, and whole-log pruning against the rows it skips."""

import math

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import types as T

from ledgerframe.errors import PredicateRefused
from ledgerframe.functions import terms
from ledgerframe.plans import manifest

S = T.StructType([T.StructField("word", T.StringType()), T.StructField("count", T.LongType()), T.StructField("level", T.DoubleType()), T.StructField("on", T.BooleanType())])
words, counts = st.sampled_from(["", "a", "b", "ab", "1", "true"]), st.one_of(st.integers(-3, 3), st.integers(-(1 << 63), (1 << 63) - 1))
levels = st.one_of(st.sampled_from([-1.0, 0.0, 0.5, 1.0, 2.0, 1e300]), st.floats(allow_nan=False, allow_infinity=False))
row = st.tuples(*[st.one_of(st.none(), kind) for kind in (words, counts, levels, st.booleans())])
scalar = st.one_of(st.none(), words, counts, levels, st.booleans(), st.just(float("inf")), st.integers(1 << 63, 1 << 70))
slow = settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture, HealthCheck.too_slow])


def table(spark, rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], T.StructType([T.StructField("i", T.IntegerType()), *S.fields]))


def kept(df, condition):
    return sorted(r.i for r in df.where(condition).collect())


def python_equal(cell, want):
    """Equality of JSON values: numbers and booleans by value, texts among themselves."""
    if cell is None or want is None:
        return cell is want
    if isinstance(cell, str) != isinstance(want, str):
        return False
    return cell == want


@slow
@given(st.lists(row, min_size=1, max_size=8), st.lists(st.dictionaries(st.sampled_from(S.names), st.one_of(scalar, st.lists(scalar, min_size=1, max_size=3)), max_size=2), min_size=1, max_size=6))
def test_subscriptions_are_two_valued(spark, rows, wheres):
    df = table(spark, rows).cache()
    for where in wheres:
        matches = lambda r: all(any(python_equal(r[S.names.index(c)], w) for w in (want if isinstance(want, list) else [want])) for c, want in where.items())
        want = [i for i, r in enumerate(rows) if matches(r)]
        assert kept(df, terms.subscription(where, S)) == want, where
        assert kept(df, ~terms.subscription(where, S)) == [i for i in range(len(rows)) if i not in want], where
        assert terms.decode_where(terms.encode_where(where)) == where or any(isinstance(x, float) and math.isinf(x) for v in where.values() for x in (v if isinstance(v, list) else [v]))
    df.unpersist()


TESTS = {"==": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b}
typed = {"word": words, "count": st.integers(-(1 << 62), 1 << 62), "level": levels, "on": st.booleans()}
term = st.sampled_from(S.names).flatmap(lambda c: st.one_of(st.tuples(st.just(c), st.sampled_from(sorted(TESTS)), st.one_of(st.none(), typed[c])), st.tuples(st.just(c), st.just("in"), st.lists(st.one_of(st.none(), typed[c]), max_size=3))))


def sql_true(cell, op, value):
    if cell is None or op != "in" and value is None:
        return False
    return any(v is not None and cell == v for v in value) if op == "in" else TESTS[op](cell, value)


@slow
@given(st.lists(row, min_size=1, max_size=8), st.lists(st.lists(term, min_size=1, max_size=2), min_size=1, max_size=6))
def test_filters_keep_what_is_true_in_sql(spark, rows, filters):
    df = table(spark, rows).cache()
    for own in filters:
        want = [i for i, r in enumerate(rows) if all(sql_true(r[S.names.index(c)], op, v) for c, op, v in own)]
        assert kept(df, terms.filters(own, S)) == want, own
    df.unpersist()


def test_what_means_nothing_is_refused():
    deep = T.StructType([*S.fields, T.StructField("many", T.ArrayType(T.LongType()))])
    for where in ({"nowhere": 1}, {"word": []}, {"word": {"a": 1}}, {"many": 1}, ["word"], {"word": [["a"]]}):
        with pytest.raises(PredicateRefused):
            terms.validate_where(where, deep)
    for text in ("", "[]", "7", '{"word": '):
        with pytest.raises(PredicateRefused):
            terms.decode_where(text)
    for bad in (("count", "like", 1), ("nowhere", "==", 1), ("count", "in", 1), ("count", "==")):
        with pytest.raises(PredicateRefused):
            terms.check_terms([bad], S)


def test_a_live_view_takes_what_both_languages_mean_alike():
    assert terms.live_terms({"word": ["a", "b"], "count": 4}, S) == [("word", "in", ["a", "b"]), ("count", "==", 4)]
    for where in ({"word": None}, {"word": ["a", None]}):
        with pytest.raises(PredicateRefused):
            terms.live_terms(where, S)


# -- pruning

any_double = st.one_of(st.none(), st.floats(width=64), st.sampled_from([0.0, -0.0, 0.1, math.nan, math.inf, -math.inf]))
cells = {
    "long": (T.LongType(), st.one_of(st.none(), st.integers(-3, 3), st.integers(-(1 << 63), (1 << 63) - 1))), "double": (T.DoubleType(), any_double),
    "float": (T.FloatType(), st.one_of(st.none(), st.floats(width=32))), "boolean": (T.BooleanType(), st.one_of(st.none(), st.booleans())),
}
literal = st.one_of(st.none(), st.integers(-4, 4), st.integers(-(1 << 63), (1 << 63) - 1), st.floats(), st.booleans(), words)


def might_match(cell, op, value):
    """Whether a cell satisfies a term under some reading of the comparison: as numbers, as doubles, with NaN largest or unequal to all."""
    if op == "in":
        return any(might_match(cell, "==", v) for v in value)
    if cell is None or value is None or isinstance(value, str):
        return False
    if isinstance(cell, float) and math.isnan(cell) or isinstance(value, float) and math.isnan(value):
        return True
    return TESTS[op](cell, value) or TESTS[op](float(cell), float(value))


@pytest.mark.parametrize("kind", sorted(cells))
def test_no_row_of_a_skipped_log_matches(kind):
    spark_type, own = cells[kind]
    struct, skipped = T.StructType([T.StructField("c", spark_type)]), []

    @settings(max_examples=600, deadline=None)
    @given(st.lists(own, max_size=4), st.one_of(st.tuples(st.sampled_from(sorted(TESTS)), literal), st.tuples(st.just("in"), st.lists(literal, max_size=3))))
    def held(rows, test):
        solid = [x for x in rows if x is not None and not (isinstance(x, float) and math.isnan(x))]
        nans = len([x for x in rows if x is not None]) - len(solid)
        row = {"columns": {"c": {"min": min(solid, default=None), "max": max(solid, default=None), "null_count": rows.count(None), "value_count": len(rows) - rows.count(None), "nan_count": nans}}}
        if manifest.can_skip(row, struct, [("c", *test)]):
            skipped.append(test)
            assert not any(might_match(x, *test) for x in rows), (rows, test)

    held()
    assert skipped


def test_statistics_pass_over_nulls_and_nan(spark):
    rows = [(0.5, True, 11, 0), (math.nan, None, 12, 0), (None, False, 19, 0), (-2.0, True, 13, 0)]
    df = spark.createDataFrame(rows, "level double, on boolean, ledger_offset long, ledger_ts long")
    got = manifest.statistics(df, T.StructType([T.StructField("level", T.DoubleType()), T.StructField("on", T.BooleanType())]))
    assert (got["rows"], got["first"], got["last"]) == (4, 11, 19)
    assert got["columns"]["level"] == {"min": -2.0, "max": 0.5, "null_count": 1, "value_count": 3, "nan_count": 1}
    assert got["columns"]["on"] == {"min": False, "max": True, "null_count": 1, "value_count": 3, "nan_count": 0}


def test_without_statistics_nothing_is_skipped():
    struct = T.StructType([T.StructField("count", T.LongType())])
    known = {"columns": {"count": {"min": 5, "max": 6, "null_count": 0, "value_count": 2, "nan_count": 0}}}
    assert manifest.can_skip(known, struct, [("count", "==", 7)]) and not manifest.can_skip(None, struct, [("count", "==", 7)])
    assert not manifest.can_skip({"columns": {}}, struct, [("count", "==", 7)]) and not manifest.can_skip(known, struct, [("count", "!=", 7)])
    assert manifest.can_skip(known, struct, [("count", "!=", 7), ("count", "<", 5)])
