"""Relational operators: declarative filters, ordering, pages, eager joins, M:N collections, aggregates."""

from __future__ import annotations

from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def condition(field: str, wanted: Any) -> Column | None:
    """A predicate: a list is IN, a dict of gte / lte / gt / lt / contains / in applies all its operators, else equality; None restricts nothing."""
    x = F.col(field)
    if wanted is None:
        return None
    if isinstance(wanted, (list, tuple, set)):
        return x.isin(list(wanted))
    if not isinstance(wanted, dict):
        return x == wanted
    forms = {"gte": lambda v: x >= v, "lte": lambda v: x <= v, "gt": lambda v: x > v, "lt": lambda v: x < v, "contains": lambda v: F.lower(x).contains(v.lower()), "in": lambda v: x.isin(list(v))}
    found = [forms[k](v) for k, v in wanted.items() if v is not None]
    return reduce(lambda a, b: a & b, found) if found else None


def where(df: DataFrame, conditions: dict[str, Any]) -> DataFrame:
    """All conditions hold."""
    for found in (condition(k, v) for k, v in conditions.items()):
        if found is not None:
            df = df.filter(found)
    return df


def or_where(df: DataFrame, conditions: dict[str, Any]) -> DataFrame:
    """One condition at least holds; without conditions nothing is restricted."""
    found = [x for x in (condition(k, v) for k, v in conditions.items()) if x is not None]
    return df.filter(reduce(lambda a, b: a | b, found)) if found else df


def ordered(df: DataFrame, *fields: str) -> DataFrame:
    """Order by fields, -field descending; nulls last either way."""
    return df.orderBy(*[F.col(f[1:]).desc_nulls_last() if f.startswith("-") else F.col(f).asc_nulls_last() for f in fields])


def projected(df: DataFrame, *fields: str) -> DataFrame:
    """The fields; those that don't exist are null."""
    return df.select(*[F.col(f) if f.split(".")[0] in df.columns else F.lit(None).cast("string").alias(f) for f in fields])


def page(df: DataFrame, number: int, size: int, *order: str) -> tuple[DataFrame, dict[str, Any]]:
    """The rows of a page (from 1) in a total order, and the totals."""
    total = df.count()
    pages = -(-total // size)
    return ordered(df, *order).offset((number - 1) * size).limit(size), {"total": total, "pages": pages, "has_next": number < pages, "has_previous": number > 1}


def after_cursor(df: DataFrame, last: tuple[Any, Any] | None, size: int, day: str = "judgment_date", key: str = "id") -> DataFrame:
    """The next rows, newest first, below the (day, key) of the last row seen: pages stay right while rows arrive."""
    if last is not None:
        df = df.filter((F.col(day) < F.lit(last[0])) | ((F.col(day) == F.lit(last[0])) & (F.col(key) < F.lit(last[1]))))
    return df.orderBy(F.col(day).desc(), F.col(key).desc()).limit(size)


def aggregated(df: DataFrame, operations: dict[str, tuple[str, str]], missing_as_zero: bool = False) -> DataFrame:
    """One row: name -> (function, field); missing_as_zero makes averages count null as 0."""
    functions = {"count": F.count, "sum": F.sum, "avg": F.avg, "max": F.max, "min": F.min, "count_distinct": F.count_distinct}
    value = lambda f, field: F.lit(1) if field == "*" else F.coalesce(F.col(field), F.lit(0)) if missing_as_zero and f == "avg" else F.col(field)
    return df.agg(*[functions[f](value(f, field)).alias(name) for name, (f, field) in operations.items()])


def collected(df: DataFrame, bridge: DataFrame, related: DataFrame, key: str, bridge_key: str, related_key: str, fields: list[str], name: str) -> DataFrame:
    """df with a sorted array of structs of its related rows through a bridge table; rows without any have an empty array."""
    found = bridge.join(related, related_key).groupBy(bridge_key).agg(F.sort_array(F.collect_list(F.struct(*fields))).alias(name))
    out = df.join(found, df[key] == found[bridge_key], "left").drop(bridge_key)
    return out.withColumn(name, F.coalesce(name, F.array().cast(found.schema[name].dataType)))


def any_of(column: str, values: list[Any]) -> Column:
    """The array shares an element with values; no values: nothing."""
    return F.coalesce(F.arrays_overlap(column, F.array(*map(F.lit, values))), F.lit(False)) if values else F.lit(False)


def all_of(column: str, values: list[Any]) -> Column:
    """The array holds all values; no values: nothing."""
    return F.coalesce(F.size(F.array_except(F.array(*map(F.lit, values)), F.col(column))) == 0, F.lit(False)) if values else F.lit(False)


def years(column: str, start: int | None, end: int | None) -> Column:
    """Years between open-ended bounds; without bounds all rows, undated ones too."""
    y, found = F.year(column), F.lit(True)
    if start is not None:
        found = found & (y >= start)
    if end is not None:
        found = found & (y <= end)
    return F.coalesce(found, F.lit(False))


def boolean(all_: list[Column] = (), any_: list[Column] = (), none: list[Column] = ()) -> Column:
    """A tree of criteria: all of the first, one of the second if there are any, none of the third."""
    sure = lambda p: F.coalesce(p, F.lit(False))
    out = reduce(lambda a, b: a & b, map(sure, all_), F.lit(True))
    if any_:
        out = out & reduce(lambda a, b: a | b, map(sure, any_))
    return reduce(lambda a, b: a & ~b, map(sure, none), out)


def folded(steps: list[tuple[str, Column]]) -> Column:
    """(operator, predicate) evaluated from left to right; the first operator and unknown ones are ignored; no steps: nothing."""
    out = None
    for operator, p in steps:
        p = F.coalesce(p, F.lit(False))
        if out is None:
            out = p
        elif operator.lower() in ("and", "intersect"):
            out = out & p
        elif operator.lower() in ("or", "union"):
            out = out | p
        elif operator.lower() in ("not", "difference"):
            out = out & ~p
    return F.lit(False) if out is None else out


def symmetric_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of either side only."""
    return a.subtract(b).unionByName(b.subtract(a))


def recent(df: DataFrame, as_of: Column, days: int, courts: list[str] | None = None, day: str = "judgment_date") -> DataFrame:
    """Published rows of the last days, newest and most relevant first."""
    out = df.filter(F.col("published") & (F.col(day) >= F.date_sub(as_of, days)))
    return (out.filter(F.col("court").isin(courts)) if courts else out).orderBy(F.col(day).desc(), F.col("relevance_score").desc(), "id")


def holds(wanted: dict[str, str]) -> Column:
    """Whether any of the fields holds its text, in any case; null fields hold none."""
    found = F.lit(False)
    for field, text in wanted.items():
        found = found | F.coalesce(F.lower(F.col(field).cast("string")).contains(text.lower()), F.lit(False))
    return found
