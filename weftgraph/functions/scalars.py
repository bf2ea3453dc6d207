"""Conversion, text, list and number functions, as expressions of built-in functions."""

from __future__ import annotations

import math
import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from weftgraph.functions.predicates import is_true

# ---------------------------------------------------------------- entities


def labels(n: str) -> Column:
    """The one label of a node, as a list."""
    return F.array(F.col(f"{n}.type"))


def keys(n: str, fields: Sequence[str]) -> Column:
    """Names of the fields of a node or relationship that are not null, sorted."""
    return F.array_sort(F.filter(F.array(*[F.when(F.col(f"{n}.{f}").isNotNull(), F.lit(f)) for f in fields]), lambda x: x.isNotNull()))


# ---------------------------------------------------------------- conversion


def to_integer(c: Column, kind: str = "string") -> Column:
    """Fractions are cut off, text that is no integer is null, truth is 0 or 1."""
    if kind == "string":
        return F.when(F.trim(c).rlike(r"^[+-]?\d+$"), F.trim(c).try_cast("bigint"))
    return c.cast("bigint")


def to_float(c: Column) -> Column:
    return c.try_cast("double")


def to_string(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit("null"))


# ---------------------------------------------------------------- text


def concat(a: Column, b: Column) -> Column:
    return F.concat(a.cast("string"), b.cast("string"))


def size_of_text(c: Column) -> Column:
    """Bytes of the text in UTF-8."""
    return F.octet_length(c)


def split(c: Column, by: str) -> Column:
    return F.split(c, re.escape(by).replace(r"\ ", " ") if by else "", -1)


def substring(c: Column, start: int, length: int | None = None) -> Column:
    """From 0; a negative start counts as 0."""
    begin = F.lit(max(start, 0) + 1)
    return F.substring(c, begin, F.char_length(c) if length is None else F.lit(max(length, 0)))


def left(c: Column, n: int) -> Column:
    return F.substring(c, 1, max(n, 0))


def right(c: Column, n: int) -> Column:
    return F.right(c, F.lit(max(n, 0)))


_SPACE = r"[\s\u0085   -     　]+"


def trim(c: Column) -> Column:
    """White space of any kind, at both ends."""
    return ltrim(rtrim(c))


def ltrim(c: Column) -> Column:
    return F.regexp_replace(c, f"^{_SPACE}", "")


def rtrim(c: Column) -> Column:
    return F.regexp_replace(c, f"{_SPACE}$", "")


def edit_distance(a: Column, b: Column) -> Column:
    return F.levenshtein(a, b)


def normalize(c: Column) -> Column:
    """Lower case, letters and digits only, words one blank apart."""
    words = F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}\s]", "")
    return F.trim(F.regexp_replace(words, r"\s+", " "))


def token_jaccard(a: Column, b: Column, by: str = " ") -> Column:
    """Similarity of the sets of tokens; 1 for two empty texts."""
    x, y = (F.array_distinct(F.filter(split(c, by), lambda t: t != "")) for c in (a, b))
    both = F.size(F.array_union(x, y))
    return F.when(a.isNull() | b.isNull(), None).when(both == 0, 1.0).otherwise(F.size(F.array_intersect(x, y)) / both)


def ngrams(c: Column, n: int) -> Column:
    """Character n-grams; none if the text is shorter."""
    last = F.char_length(c) - n + 1
    return F.when(last >= 1, F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.substring(c, i, F.lit(n)))).otherwise(F.when(c.isNotNull(), F.array().cast("array<string>")))


def contains_any(c: Column, parts: Sequence[str]) -> Column:
    out = F.lit(False)
    for p in parts:
        out = out | is_true(c.contains(p))
    return out


def starts_with_any(c: Column, parts: Sequence[str]) -> Column:
    out = F.lit(False)
    for p in parts:
        out = out | is_true(c.startswith(p))
    return out


# ---------------------------------------------------------------- lists


def head(c: Column) -> Column:
    return F.try_element_at(c, F.lit(1))


def last(c: Column) -> Column:
    return F.try_element_at(c, F.lit(-1))


def at(c: Column, i: int) -> Column:
    """From 0; negative from the end; null outside."""
    return F.try_element_at(c, F.lit(i + 1 if i >= 0 else i))


def slice_(c: Column, start: int | None, end: int | None) -> Column:
    """[start, end), negatives counting from the end, limits cut to the list."""
    n = F.size(c)

    def place(x: int | None, default: Column) -> Column:
        return default if x is None else F.greatest(F.least(F.lit(x) if x >= 0 else n + x, n), F.lit(0))

    a, b = place(start, F.lit(0)), place(end, n)
    return F.when(b > a, F.slice(c, a + 1, F.greatest(b - a, F.lit(0)))).otherwise(F.slice(c, 1, 0))


def range_(a: Column, b: Column, step: int = 1) -> Column:
    """Both ends included; empty in the wrong direction."""
    if step == 0:
        raise ValueError("step must not be 0")
    right_way = a <= b if step > 0 else a >= b
    return F.when(right_way, F.sequence(a, F.when(right_way, b).otherwise(a), F.lit(step))).otherwise(F.when(a.isNotNull() & b.isNotNull(), F.array().cast("array<int>")))


def all_of(c: Column, f) -> Column:
    return F.forall(c, lambda x: is_true(f(x)))


def any_of(c: Column, f) -> Column:
    return F.exists(c, lambda x: is_true(f(x)))


def none_of(c: Column, f) -> Column:
    return ~any_of(c, f)


def single(c: Column, f) -> Column:
    return F.size(F.filter(c, lambda x: is_true(f(x)))) == 1


def comprehension(c: Column, where=None, of=None) -> Column:
    if where is not None:
        c = F.filter(c, lambda x: is_true(where(x)))
    return c if of is None else F.transform(c, of)


def reduce(c: Column, start: Column, f) -> Column:
    return F.aggregate(c, start, f)


# ---------------------------------------------------------------- numbers


def divide(a: Column, b: Column, whole: bool = False) -> Column:
    """Null for a zero divisor; whole: both are integers, and the quotient is cut off."""
    safe = F.when(b != 0, b)
    if whole:
        return F.call_function("div", a, safe)
    return a / safe


def modulo(a: Column, b: Column) -> Column:
    return a % F.when(b != 0, b)


def ceil(c: Column) -> Column:
    return F.ceil(c).cast("double")


def floor(c: Column) -> Column:
    return F.floor(c).cast("double")


def round_(c: Column, digits: int = 0) -> Column:
    """Half away from zero."""
    return F.round(c, digits).cast("double")


def sqrt(c: Column) -> Column:
    return F.when(c >= 0, F.sqrt(c))


def ln(c: Column) -> Column:
    return F.when(c > 0, F.log(c))


def log10(c: Column) -> Column:
    return F.when(c > 0, F.log10(c))


def sign(c: Column) -> Column:
    return F.signum(c).cast("int")


def pi() -> Column:
    return F.lit(math.pi)
