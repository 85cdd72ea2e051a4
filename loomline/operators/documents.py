"""Typed filters, facets, metrics and document queries over nested values.

Document values are VARIANT columns, which keep a missing path apart from an explicit null.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .relational import like


def false_if_missing(c: Column) -> Column:
    """Two-valued: what is unknown is false, so that a negation matches missing values."""
    return F.coalesce(c, F.lit(False))


def build_filter(node: dict, column=F.col) -> Column:
    """A filter tree: ``{"op": "and", "of": [...]}``, ``not``, ``exists``, ``is_null``, ``in``, ``like``, ``prefix``, ``contains``, ``all``, ``eq ne lt le gt ge``."""
    op = node["op"]
    if op == "all":
        return F.lit(True)
    if op in ("and", "or"):
        parts = [build_filter(n, column) for n in node["of"]]
        return reduce((lambda a, b: a & b) if op == "and" else (lambda a, b: a | b), parts, F.lit(op == "and"))
    if op == "not":
        return ~build_filter(node["of"], column)
    c = column(node["field"])
    if op == "exists":
        return c.isNotNull()
    if op == "is_null":
        return c.isNull()
    v = node["value"]
    if op == "in":
        if not 1 <= len(v) <= 256:
            raise ValueError("1 to 256 members")
        return false_if_missing(c.isin(*v))
    test = {"eq": lambda: c == v, "ne": lambda: c != v, "lt": lambda: c < v, "le": lambda: c <= v, "gt": lambda: c > v, "ge": lambda: c >= v, "like": lambda: like(c, v), "prefix": lambda: c.startswith(v), "contains": lambda: c.contains(v)}[op]
    return false_if_missing(test())


def at_path(document: str, path: str, kind: str) -> Column:
    """The value at a path of a VARIANT column, null where it is missing or of another type."""
    return F.try_variant_get(F.col(document), path, kind)


def path_state(document: str, path: str) -> Column:
    """0 for a missing path, 1 for an explicit null, 2 for a value: three different groups."""
    v = F.variant_get(F.col(document), path, "variant")
    return F.when(v.isNull(), 0).when(F.is_variant_null(v), 1).otherwise(2)


def terms_facet(df: DataFrame, field: str, limit: int | None = None, maximum: int = 10_000) -> DataFrame:
    """``value, n``: most frequent first, ties by value; missing values have no bucket.

    More than ``maximum`` different values are an error, never a cut; ``limit`` is what the request asks to see of them.
    """
    counts = df.filter(F.col(field).isNotNull()).groupBy(F.col(field).alias("value")).agg(F.count("*").alias("n"))
    if counts.limit(maximum + 1).count() > maximum:
        raise ValueError(f"more than {maximum} terms of {field}")
    ordered = counts.orderBy(F.desc("n"), "value")
    return ordered if limit is None else ordered.limit(limit)


def range_facet(df: DataFrame, field: str, ranges: list[tuple[float | None, float | None]]) -> DataFrame:
    """``ordinal, n``: one bucket per half-open range, in order; ranges may overlap, empty ones stay. One pass, no join."""
    def inside(lo, hi) -> Column:
        c = F.col(field).isNotNull()
        c = c & (F.col(field) >= lo) if lo is not None else c
        return c & (F.col(field) < hi) if hi is not None else c

    sums = df.agg(*[F.coalesce(F.sum(inside(*r).cast("bigint")), F.lit(0)).alias(f"r{i}") for i, r in enumerate(ranges)])
    each = ", ".join(f"{i}, r{i}" for i in range(len(ranges)))
    return sums.selectExpr(f"stack({len(ranges)}, {each}) as (ordinal, n)")


def metrics(df: DataFrame, field: str) -> DataFrame:
    """Count, sum, min, max and average over the present values; a value that is not finite is an error, and so is a sum beyond its type."""
    c = F.col(field)
    if df.schema[field].dataType.typeName() in ("double", "float"):
        c = F.when(F.isnan(c) | (F.abs(c) == float("inf")), F.raise_error(F.lit(f"{field} is not finite")).cast("double")).otherwise(c)
    return df.agg(F.count(c).alias("n"), F.sum(c).alias("total"), F.min(c).alias("low"), F.max(c).alias("high"), F.avg(c.cast("double")).alias("mean"))


def kind_at(document: str, path: str) -> Column:
    """The type of the value at a path (NULL, BOOLEAN, INTEGER, STRING, ARRAY, OBJECT), null where there is none. Numbers with a fraction are FLOAT."""
    kind = F.schema_of_variant(F.variant_get(F.col(document), path, "variant"))
    return F.when(kind == "VOID", "NULL").when(kind == "BIGINT", "INTEGER").when(kind.startswith("ARRAY"), "ARRAY").when(kind.startswith("OBJECT"), "OBJECT").when(kind.startswith("DECIMAL") | (kind == "DOUBLE"), "FLOAT").otherwise(kind)


# The order of values of different types.
KINDS = ("NULL", "BOOLEAN", "INTEGER", "FLOAT", "STRING", "ARRAY", "OBJECT")


def ordered_value(document: str, path: str) -> Column:
    """``(place of the type, number, text)``: a total order over values of all types; null where there is none."""
    kind = kind_at(document, path)
    place = F.array_position(F.array(*[F.lit(k) for k in KINDS]), kind).cast("int")
    number = F.coalesce(F.try_variant_get(document, path, "double"), F.try_variant_get(document, path, "boolean").cast("double"))
    value = F.struct(place.alias("kind"), F.when(kind.isin("BOOLEAN", "INTEGER", "FLOAT"), number).alias("number"), F.when(~kind.isin("BOOLEAN", "INTEGER", "FLOAT"), F.to_json(F.variant_get(document, path, "variant"))).alias("text"))
    return F.when(kind.isNotNull(), value)


def document_filter(node: dict, document: str) -> Column:
    """A filter tree over paths of documents: ``all``, ``exists``, ``eq ne lt le gt ge``, ``prefix``, ``contains``, ``and``, ``or``, ``not``.

    An explicit null exists. Equality holds over all types (1 differs from '1'), an order only within one type. What is
    missing matches nothing, so a negation of it matches. ``contains`` is membership of an array or part of a text.
    """
    op = node["op"]
    if op == "all":
        return F.lit(True)
    if op in ("and", "or"):
        return reduce((lambda a, b: a & b) if op == "and" else (lambda a, b: a | b), [document_filter(n, document) for n in node["of"]], F.lit(op == "and"))
    if op == "not":
        return ~document_filter(node["of"], document)
    path = node["path"]
    kind = kind_at(document, path)
    if op == "exists":
        return kind.isNotNull()
    v = node["value"]
    own = "NULL" if v is None else "BOOLEAN" if isinstance(v, bool) else "INTEGER" if isinstance(v, int) else "FLOAT" if isinstance(v, float) else "STRING"
    get = {"NULL": "string", "BOOLEAN": "boolean", "INTEGER": "bigint", "FLOAT": "double", "STRING": "string"}[own]
    here = F.when(kind == own, F.try_variant_get(document, path, get))
    if op == "prefix":
        return false_if_missing(here.startswith(v)) if own == "STRING" else F.lit(False)
    if op == "contains":
        part = here.contains(v) if own == "STRING" else F.lit(False)
        member = F.exists(F.try_variant_get(document, path, "array<variant>"), lambda x: (F.schema_of_variant(x) == {"NULL": "VOID", "INTEGER": "BIGINT"}.get(own, own)) & (F.lit(True) if v is None else F.try_variant_get(x, "$", get) == v))
        return false_if_missing(F.when(kind == "ARRAY", member).otherwise(part))
    same = (kind == own) & (F.lit(True) if v is None else here == F.lit(v))
    if op in ("eq", "ne"):
        return kind.isNotNull() & (false_if_missing(same) if op == "eq" else ~false_if_missing(same))
    test = {"lt": lambda: here < v, "le": lambda: here <= v, "gt": lambda: here > v, "ge": lambda: here >= v}[op]
    return false_if_missing(test()) if v is not None else (false_if_missing(same) if op in ("le", "ge") else F.lit(False))


def group_documents(df: DataFrame, document: str, paths: list[str], sums: dict[str, str] | None = None, extremes: dict[str, str] | None = None, maximum: int = 10_000) -> DataFrame:
    """Counts, sums and extremes per group of the values at ``paths``; a missing value and an explicit null are different groups.

    ``sums`` (name -> path) are of whole numbers, null is passed over and any other type is an error; ``extremes`` (name -> path)
    give ``<name>_min`` and ``<name>_max`` in the order of ``ordered_value``, explicit nulls passed over. More than ``maximum`` groups are
    an error. Without paths there is one group, also of no document.
    """
    keys = [F.when(path_state(document, p) > 0, F.to_json(F.variant_get(F.col(document), p, "variant"))).alias(f"g{i}") for i, p in enumerate(paths)]
    aggregates = [F.count("*").alias("n")]
    for name, p in (sums or {}).items():
        kind = kind_at(document, p)
        value = F.when(kind == "INTEGER", F.try_variant_get(document, p, "bigint").cast("decimal(38,0)")).when(kind.isNull() | (kind == "NULL"), F.lit(None)).otherwise(F.raise_error(F.lit(f"{name} is not of whole numbers")).cast("decimal(38,0)"))
        aggregates.append(F.sum(value).alias(name))
    for name, p in (extremes or {}).items():
        value = F.when(kind_at(document, p) != "NULL", ordered_value(document, p))
        aggregates += [F.min(value).alias(f"{name}_min"), F.max(value).alias(f"{name}_max")]
    grouped = df.groupBy(*keys).agg(*aggregates) if keys else df.agg(*aggregates)
    if keys and grouped.limit(maximum + 1).count() > maximum:
        raise ValueError(f"more than {maximum} groups")
    return grouped


def query_documents(df: DataFrame, key: str, document: str, node: dict, sort: list[tuple[str, bool, bool]], after: list | None, limit: int) -> DataFrame:
    """Filter, sort by paths (descending, nulls first; missing counts as null) and key, strictly after the cursor, at most ``limit`` rows.

    The cursor is ``[(kind, number, text) or None, ..., key]`` of the last row seen. Bad keys fail the whole query.
    """
    rows = reject_bad_keys(df, key).filter(document_filter(node, document))
    for i, (path, _, _) in enumerate(sort):
        rows = rows.withColumn(f"_s{i}", F.when(kind_at(document, path) != "NULL", ordered_value(document, path)))
    if after is not None:
        later = F.col(key) > F.lit(after[-1])
        for i in range(len(sort) - 1, -1, -1):
            c, (_, down, first), v = F.col(f"_s{i}"), sort[i], after[i]
            last = None if v is None else F.struct(F.lit(v[0]).cast("int").alias("kind"), F.lit(v[1]).cast("double").alias("number"), F.lit(v[2]).cast("string").alias("text"))
            if last is None:
                beyond, same = (c.isNotNull() if first else F.lit(False)), c.isNull()
            else:
                beyond = F.coalesce(c < last if down else c > last, F.lit(not first))
                same = c.eqNullSafe(last)
            later = beyond | (same & later)
        rows = rows.filter(later)
    order = document_sort(rows, [(F.col(f"_s{i}"), down, first) for i, (_, down, first) in enumerate(sort)], key)
    return rows.orderBy(*order).limit(limit)


def document_sort(df: DataFrame, terms: list[tuple[Column, bool, bool]], key: str) -> list[Column]:
    """Sort columns of ``(value, descending, nulls first)``, with the key as the last."""
    out = []
    for c, descending, first in terms:
        out.append((c.desc_nulls_first() if first else c.desc_nulls_last()) if descending else (c.asc_nulls_first() if first else c.asc_nulls_last()))
    return [*out, F.col(key).asc()]


def reject_bad_keys(df: DataFrame, key: str) -> DataFrame:
    """The rows, or an error if a key is null, empty or given twice."""
    bad = df.filter(F.col(key).isNull() | (F.length(key) == 0)).limit(1).count()
    if bad or df.groupBy(key).count().filter("count > 1").limit(1).count():
        raise ValueError("empty or duplicate key")
    return df
