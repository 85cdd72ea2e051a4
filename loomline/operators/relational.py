"""Relational operators: keyset pages, row comparisons, first-seen distinct, grouped limits, constraints."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import like_escape


def equal_row(left: list[Column], right: list) -> Column:
    return reduce(lambda a, b: a & b, [x == y for x, y in zip(left, right)])


def after_row(left: list[Column], right: list, inclusive: bool = False) -> Column:
    """``(a, b, ...) > (x, y, ...)``, expanded, so that a null component reached is unknown."""
    x, y = left[0], F.lit(right[0])
    if len(left) == 1:
        return x >= y if inclusive else x > y
    return (x > y) | ((x == y) & after_row(left[1:], right[1:], inclusive))


def before_row(left: list[Column], right: list, inclusive: bool = False) -> Column:
    x, y = left[0], F.lit(right[0])
    if len(left) == 1:
        return x <= y if inclusive else x < y
    return (x < y) | ((x == y) & before_row(left[1:], right[1:], inclusive))


def like(c: Column, pattern: str, negated: bool = False) -> Column:
    """Anchored LIKE with ``%`` and ``_`` and no escape character; 1 to 256 bytes."""
    if not 1 <= len(pattern.encode()) <= 256:
        raise ValueError("a pattern has 1 to 256 bytes")
    found = F.like(c, F.lit(pattern), F.lit(like_escape(pattern)))
    return ~found if negated else found


def page(df: DataFrame, keys: list[str], after: list | None, limit: int, descending: bool = False) -> DataFrame:
    """Up to ``limit`` rows in key order, strictly after the cursor; planned as a top-k, not a sort."""
    columns = [F.col(k) for k in keys]
    if after is not None:
        df = df.filter(before_row(columns, after) if descending else after_row(columns, after))
    return df.orderBy(*[c.desc() if descending else c.asc() for c in columns]).limit(limit)


def guarded(df: DataFrame, budget: int) -> DataFrame:
    """The rows, unless there are more than the budget: then an error and no partial result."""
    n = df.limit(budget + 1).count()
    if n > budget:
        raise OverflowError(f"more than {budget} candidates")
    return df


def distinct_first_seen(df: DataFrame, columns: list[str], order: list[str], limit: int, offset: int = 0, descending: bool = False) -> DataFrame:
    """Distinct rows of ``columns`` in the order in which the access path, in either direction, first meets them."""
    first = (F.max if descending else F.min)(F.struct(*order)).alias("_first")
    rows = df.groupBy(*columns).agg(first).orderBy(F.desc("_first") if descending else F.asc("_first"))
    return (rows.offset(offset) if offset else rows).limit(limit).select(*columns)


def cursor_page(df: DataFrame, keys: list[str], after: list | None, limit: int, descending: bool = False) -> tuple[DataFrame, list | None]:
    """A page, and the cursor to go on from: the last row's keys, or none if nothing is behind it. One row more than the page is looked at."""
    rows = page(df, keys, after, limit + 1, descending)
    last = rows.select(*keys).collect()[limit - 1 :]
    return rows.limit(limit), list(last[0]) if len(last) > 1 else None


def grouped(df: DataFrame, keys: list[str], aggregates: list[Column], limit: int, having: Column | None = None, order: list[Column] | None = None) -> DataFrame:
    """Grouped aggregates: HAVING keeps what is true, then the given order with ties by key, then LIMIT.

    Without an order the smallest keys are kept, null first.
    """
    out = df.groupBy(*keys).agg(*aggregates)
    if having is not None:
        out = out.filter(having)
    return out.orderBy(*(order or []), *[F.col(k).asc_nulls_first() for k in keys]).limit(limit)


def exact_sum(c: Column) -> Column:
    """A sum that does not overflow where the total passes 64 bits."""
    return F.sum(c.cast("decimal(38,0)"))


def numbered(df: DataFrame, partition: list[str], order: list[str], name: str = "rn", rank: bool = False) -> DataFrame:
    w = Window.partitionBy(*partition).orderBy(*order) if partition else Window.orderBy(*order)
    return df.withColumn(name, (F.rank() if rank else F.row_number()).over(w))


def check_violations(df: DataFrame, condition: Column) -> DataFrame:
    """Rows for which a CHECK is false; unknown passes."""
    return df.filter(~condition)


def not_null_violations(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.filter(reduce(lambda a, b: a | b, [F.col(c).isNull() for c in columns]))


def unique_violations(df: DataFrame, columns: list[str]) -> DataFrame:
    """Keys that occur more than once; a key with a null never conflicts."""
    present = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in columns])
    return df.filter(present).groupBy(*columns).agg(F.count("*").alias("n")).filter("n > 1")


def foreign_key_violations(child: DataFrame, parent: DataFrame, columns: list[str], target: list[str]) -> DataFrame:
    """Child rows without a parent (MATCH SIMPLE: a null in the key passes)."""
    present = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in columns])
    keys = parent.select(*[F.col(t).alias(c) for c, t in zip(columns, target)]).distinct()
    return child.filter(present).join(keys, columns, "left_anti")


def upsert(base: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """Full-image replacement by key."""
    return base.join(changes.select(*keys), keys, "left_anti").unionByName(changes)


def delete(base: DataFrame, removed: DataFrame, keys: list[str]) -> DataFrame:
    return base.join(removed.select(*keys), keys, "left_anti")


def insert(base: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """All rows or none: a key that is there already, or twice in the rows, is an error."""
    if unique_violations(rows, keys).limit(1).count() or rows.join(base.select(*keys), keys, "left_semi").limit(1).count():
        raise ValueError("duplicate primary key")
    return base.unionByName(rows)


def union_sets(*sets: DataFrame) -> DataFrame:
    return reduce(DataFrame.union, sets).distinct()


def intersect_sets(*sets: DataFrame) -> DataFrame:
    return reduce(DataFrame.intersect, sets)


def subtract_sets(first: DataFrame, *rest: DataFrame) -> DataFrame:
    return reduce(DataFrame.subtract, rest, first)
