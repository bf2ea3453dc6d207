"""Aggregates, ordering, windows and set operations on matched rows, with the graph language's rules for null and ties."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# ---------------------------------------------------------------- aggregates


def total(c: Column) -> Column:
    """Sum; 0 of nothing."""
    return F.coalesce(F.sum(c), F.lit(0))


def collect(c: Column, distinct: bool = False) -> Column:
    """Values but nulls, in ascending order (Spark keeps no row order)."""
    return F.array_sort(F.collect_set(c) if distinct else F.collect_list(c))


def std(c: Column) -> Column:
    return F.stddev_samp(c)


def variance(c: Column) -> Column:
    return F.var_samp(c)


def median(c: Column) -> Column:
    return F.median(c)


def percentile_cont(c: Column, p: float) -> Column:
    if not 0 <= p <= 1:
        raise ValueError("the share must be within 0 and 1")
    return F.percentile(c, F.lit(p))


def percentile_disc(e: str, p: float) -> Column:
    """Nearest rank; e is a SQL expression."""
    if not 0 <= p <= 1:
        raise ValueError("the share must be within 0 and 1")
    return F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY {e})")


def join_texts(c: Column, by: str = ", ", most: int | None = None) -> Column:
    out = F.array_join(F.array_sort(F.collect_list(c.cast("string"))), by)
    return out if most is None else F.when(F.char_length(out) > most, F.concat(F.left(out, F.lit(max(most - 3, 0))), F.lit("..."))).otherwise(out)


def statistics(df: DataFrame, column: str, by: Sequence[str] = ()) -> DataFrame:
    """count, valid_count, sum, avg, min, max and sample std (null for one value) per group."""
    c = F.col(column)
    return df.groupBy(*by).agg(F.count("*").alias("count"), F.count(c).alias("valid_count"), F.sum(c).alias("sum"), F.avg(c).alias("avg"), F.min(c).alias("min"), F.max(c).alias("max"), F.stddev_samp(c).alias("std"))


# ---------------------------------------------------------------- order


def order(*keys: str | Column | tuple[str | Column, str]) -> list[Column]:
    """Sort keys: ascending puts nulls last, descending first, unless the key says otherwise.

    A key is a column, or (column, "asc" | "desc" | "asc nulls first" | "desc nulls last").
    """
    out = []
    for k in keys:
        c, how = k if isinstance(k, tuple) else (k, "asc")
        c = F.col(c) if isinstance(c, str) else c
        make = {"asc": c.asc_nulls_last, "desc": c.desc_nulls_first, "asc nulls first": c.asc_nulls_first, "asc nulls last": c.asc_nulls_last, "desc nulls first": c.desc_nulls_first, "desc nulls last": c.desc_nulls_last}
        out.append(make[how.lower()]())
    return out


def top(df: DataFrame, n: int, *keys, skip: int = 0) -> DataFrame:
    """ORDER BY, SKIP, LIMIT."""
    out = df.orderBy(*order(*keys))
    return (out.offset(skip) if skip else out).limit(n)


def per_group(df: DataFrame, by: Sequence[str], keys: Sequence, limit: int | None = None, offset: int = 0) -> DataFrame:
    """Rows offset .. offset + limit of each group, by rank within the group."""
    n = F.row_number().over(Window.partitionBy(*by).orderBy(*order(*keys)))
    out = df.withColumn("_n", n).where(F.col("_n") > offset)
    return (out if limit is None else out.where(F.col("_n") <= offset + limit)).drop("_n")


def ranked(df: DataFrame, name: str, how: str, by: Sequence[str], *keys: Column) -> DataFrame:
    """row_number, rank or dense_rank; window keys sort null as the smallest."""
    make = {"row_number": F.row_number, "rank": F.rank, "dense_rank": F.dense_rank}
    if how not in make:
        raise ValueError(f"unknown window function {how}")
    if not keys:
        raise ValueError("a window function needs an order")
    return df.withColumn(name, make[how]().over(Window.partitionBy(*by).orderBy(*keys)))


def unwind(df: DataFrame, values: Column, name: str) -> DataFrame:
    """A row for each element; none for null or an empty list."""
    return df.withColumn(name, F.explode(values))


# ---------------------------------------------------------------- sets


def _aligned(a: DataFrame, b: DataFrame) -> DataFrame:
    """b with a's names, by name if they agree, else by position."""
    if set(a.columns) == set(b.columns):
        return b.select(*a.columns)
    if len(a.columns) != len(b.columns):
        raise ValueError("the sides have different numbers of columns")
    return b.toDF(*a.columns)


def union(a: DataFrame, b: DataFrame, all_rows: bool = False) -> DataFrame:
    out = a.union(_aligned(a, b))
    return out if all_rows else out.distinct()


def intersect(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.intersect(_aligned(a, b))


def except_(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.subtract(_aligned(a, b))
