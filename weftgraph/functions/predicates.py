"""Two-valued predicates: a comparison with null is false, and its negation true."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def is_true(c: Column) -> Column:
    """Null counts as false. Use below not_ and xor and in projections; a filter needs it only there,
    and a bare comparison is pushed to the scan."""
    return F.coalesce(c, F.lit(False))


def eq(a: Column, b: Any) -> Column:
    return is_true(a == b)


def ne(a: Column, b: Any) -> Column:
    """True for null, as it negates eq."""
    return ~eq(a, b)


def not_(c: Column) -> Column:
    return ~is_true(c)


def xor(a: Column, b: Column) -> Column:
    return is_true(a) != is_true(b)


def is_in(a: Column, values: Sequence[Any] | Column) -> Column:
    """Null is in no list; nulls in the list match nothing."""
    if isinstance(values, Column):
        return is_true(F.exists(values, lambda x: is_true(x == a)))
    values = [v for v in values if v is not None]
    return is_true(a.isin(*values)) if values else F.lit(False)


def matches(a: Column, pattern: str) -> Column:
    """The pattern occurs somewhere in a."""
    return is_true(a.rlike(pattern))


_CONDITIONS = {
    "=": lambda c, v: c == v,
    "==": lambda c, v: c == v,
    "!=": lambda c, v: c != v,
    ">": lambda c, v: c > v,
    ">=": lambda c, v: c >= v,
    "<": lambda c, v: c < v,
    "<=": lambda c, v: c <= v,
    "in": lambda c, v: is_in(c, v),
    "between": lambda c, v: c.between(v[0], v[1]),
    "contains": lambda c, v: c.contains(v),
    "starts_with": lambda c, v: c.startswith(v),
    "ends_with": lambda c, v: c.endswith(v),
    "regex": lambda c, v: c.rlike(v),
    "=~": lambda c, v: c.rlike(v),
    "is_null": lambda c, v: c.isNull(),
    "is_not_null": lambda c, v: c.isNotNull(),
}


def condition(df: DataFrame, field: str, wanted: Any) -> Column:
    """One condition on a field: a value, None, or {operator: value}, with `not_` before any text operator.

    A field that df lacks, or null, matches only is_null; so negations of absent values are false.
    """
    if field.split(".")[0] not in df.columns:
        nothing = wanted is None or isinstance(wanted, Mapping) and "is_null" in wanted
        return F.lit(bool(nothing))
    c = F.col(field)
    if wanted is None:
        return c.isNull()
    if not isinstance(wanted, Mapping):
        return c.isin(*wanted) if isinstance(wanted, (list, tuple, set)) else c == wanted
    out = F.lit(True)
    for op, v in wanted.items():
        if op.startswith("not_") and op not in _CONDITIONS:
            out = out & ~_CONDITIONS[op[4:]](c, v)
        elif op in _CONDITIONS:
            out = out & _CONDITIONS[op](c, v)
        else:
            raise ValueError(f"unknown condition {op}")
    return out


def conditions(df: DataFrame, wanted: Mapping[str, Any]) -> Column:
    out = F.lit(True)
    for field, value in wanted.items():
        out = out & condition(df, field, value)
    return out


def any_condition(df: DataFrame, wanted: Sequence[Mapping[str, Any]]) -> Column:
    out = F.lit(False)
    for w in wanted:
        out = out | is_true(conditions(df, w))
    return out
