"""Rows of a batch brought together: lists, stacks and merges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def in_order(order: str, value: str | Column) -> Column:
    """Aggregate: the values of a batch in order of ``order``, which is unique; nulls keep their place."""
    value = F.col(value) if isinstance(value, str) else value
    return F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), value.alias("v")))), lambda x: x["v"])


def collated(df: DataFrame, batch: str, order: str, item: str) -> DataFrame:
    """(batch, one list per field of the struct ``item``, nested structs as structs of lists): items that are null fall out,
    and so do batches without any. A batch is of bounded size, so its lists are."""
    rows = df.filter(F.col(item).isNotNull())
    kind = df.schema[item].dataType

    def lists(kind, at: str) -> list[Column]:
        out = []
        for f in kind.fields:
            path = f"{at}.{f.name}"
            out.append(F.struct(*lists(f.dataType, path)).alias(f.name) if hasattr(f.dataType, "fields") else in_order(order, F.col(path)).alias(f.name))
        return out

    return rows.groupBy(batch).agg(*lists(kind, item))


def stacked(arrays: Column) -> Column:
    """struct(rows, width, values) of equally long arrays as one flat array; null where their lengths differ or one is null,
    so that the caller keeps them as a list."""
    widths = F.array_distinct(F.transform(arrays, lambda a: F.coalesce(F.size(a), F.lit(-1))))
    same = (F.size(widths) == 1) & (F.get(widths, F.lit(0)) >= 0)
    return F.when(same, F.struct(F.size(arrays).alias("rows"), F.get(widths, F.lit(0)).alias("width"), F.flatten(arrays).alias("values")))


def merged(df: DataFrame, batch: str, order: str, scalars: list[str], arrays: list[str], others: list[str]) -> DataFrame:
    """(batch, columns): numbers of a batch stacked, arrays joined end to end, of other values the first row's."""
    numbers = [in_order(order, c).alias(c) for c in scalars]
    joined = [F.flatten(in_order(order, c)).alias(c) for c in arrays]
    first = [F.min_by(F.struct(c), F.col(order)).getField(c).alias(c) for c in others]  # the struct keeps a null of the first row
    return df.groupBy(batch).agg(*numbers, *joined, *first)
