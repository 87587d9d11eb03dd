"""Keep-first dedupe.

``groupBy(keys).agg(min(struct(order, row)))`` -- a declarative aggregate, so
Spark combines map-side before the shuffle and a hot key costs one row
per map task, not one task for all its rows.  Never bare
``dropDuplicates``: it keeps an arbitrary row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T


def _orderable(kind: T.DataType) -> bool:
    if isinstance(kind, T.StructType):
        return all(_orderable(f.dataType) for f in kind.fields)
    if isinstance(kind, T.ArrayType):
        return _orderable(kind.elementType)
    return not isinstance(kind, (T.MapType, T.VariantType))


def _first(df: DataFrame, rest: Sequence[str], order: Column) -> Column:
    """The row of ``rest`` with the smallest ``order``, as a struct; rows without an order do not count.

    ``min_by`` carries the order beside the row.  The minimum of (order, row) is the same
    row with the order once, and decides ties by the row; it needs columns that can be ordered."""
    at = df.select(order).schema[0]
    if not all(_orderable(df.schema[c].dataType) for c in rest) or not _orderable(at.dataType):
        return F.min_by(F.struct(*[F.col(f"`{c}`") for c in rest]), order)
    others = [F.col(f"`{c}`") for c in rest if c != at.name]
    lead = order.alias(at.name if at.name in rest else "_order")
    return F.min(F.when(order.isNotNull(), F.struct(lead, *others)))


def keep_first(df: DataFrame, keys: Sequence[str | Column], order: Column) -> DataFrame:
    """First row (by ``order``) of every ``keys`` group; all columns kept.

    Key columns are taken from the grouping, not from the packed row, so a
    later filter on a key is pushed below the aggregation."""
    if all(isinstance(k, str) for k in keys):
        rest = [c for c in df.columns if c not in keys]
        g = df.groupBy(*keys).agg(_first(df, rest, order).alias("_kf"))
        return g.select(*[F.col(f"`{c}`") if c in keys else F.col(f"_kf.`{c}`").alias(c) for c in df.columns])
    key_cols = [F.col(k) if isinstance(k, str) else k for k in keys]
    g = df.groupBy(*key_cols).agg(_first(df, df.columns, order).alias("_kf"))
    return g.select(*[F.col(f"_kf.`{c}`").alias(c) for c in df.columns])
