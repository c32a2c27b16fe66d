"""Numbers and running sums over a whole table in some order, without a window that puts all rows into one task.

Rows are sorted by ranges and written; what each range holds is summed up, and the sums of the ranges before it are added.
Tables that, once written, have few rows (counted) can be left to a plain window.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import cut, few, free_name, small

#: Up to so many rows one task numbers (or sums up) a written table at once; beyond, ranges are.
ONE_TASK = 500_000


def _before(rows: DataFrame, part: str, group: Sequence[str], value: Column, name: str) -> DataFrame:
    """Of each range (and group) the sum over all ranges before it: a row a range and group that it holds."""
    sums = rows.groupBy(part, *group).agg(value.alias(name))
    if not group:  # as many rows as the sort had partitions
        return sums.select(part, (F.sum(name).over(Window.orderBy(part)) - F.col(name)).alias(name))
    return sums.select(part, *group, (F.sum(name).over(Window.partitionBy(*group).orderBy(part)) - F.col(name)).alias(name))


def _matched(rows: DataFrame, other: DataFrame, keys: Sequence[str]) -> DataFrame:
    """rows with other's further columns, by keys, which may be null."""
    names = {k: free_name(f"_{k}_", rows, other) for k in keys}
    same = F.lit(True)
    for k, name in names.items():
        same = same & F.col(k).eqNullSafe(F.col(name))
    return rows.join(other.withColumnsRenamed(names), same).drop(*names.values())


def numbered(df: DataFrame, name: str, *order: str | Column, start: int = 0, one_task: int = 0) -> DataFrame:
    """df with its rows' places in `order`, from `start`, as a long column; ties in any order. Up to one_task rows: by one task."""
    mark, part, before = (free_name(x, df) for x in ("_mark", "_part", "_before"))
    if one_task and (df := cut(df, "unplaced")).count() <= one_task:
        return df.withColumn(name, (F.row_number().over(Window.orderBy(*order)) + (start - 1)).cast("long"))
    rows = cut(df.orderBy(*order).withColumn(mark, F.monotonically_increasing_id()), "placed").withColumn(part, F.shiftright(mark, 33))
    counts = _before(rows, part, (), F.count("*"), before)
    place = F.col(mark).bitwiseAND(F.lit((1 << 33) - 1))
    return rows.join(F.broadcast(counts), part).select(*df.columns, (place + F.col(before) + start).cast("long").alias(name))


def running_sum(df: DataFrame, value: str, name: str, order: Sequence[str], group: Sequence[str] = ()) -> DataFrame:
    """df with the sum of `value` over the rows up to each in `order` (of its group), itself included. order has no ties."""
    part, before = (free_name(x, df) for x in ("_part", "_before"))
    rows = cut(df.orderBy(*group, *order).withColumn(part, F.spark_partition_id()), "placed")
    sums = few(_before(rows, part, group, F.sum(value), before))
    own = F.sum(value).over(Window.partitionBy(part, *group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return _matched(rows, sums, [part, *group]).select(*df.columns, (own + F.col(before)).alias(name))


def percentiles(counts: DataFrame, value: str, at: Sequence[float], group: Sequence[str], n: str = "_n", more: Sequence[Column] = ()) -> DataFrame:
    """group, p0, p1, .. and `more`: linear percentiles (0 to 100) of values that stand `n` times each, from a table of counts.

    counts: group (may be null), value (null: counts for nothing, but a group of nulls has its row) and n, each value once a
    group; it is written here unless it was. more: aggregates over its rows, which have _total, the group's number of values,
    and _mean.
    """
    counts = counts if hasattr(counts, "_cut_path") else cut(counts, "counts")
    every = Window.partitionBy(*group)
    weight = F.sum(F.col(value).cast("double") * F.col(n))
    few_rows, counts = counts.count() <= ONE_TASK, counts.withColumn(n, F.when(F.col(value).isNull(), 0).otherwise(F.col(n)))
    if few_rows:
        own = counts.withColumns({"_run": F.sum(n).over(every.orderBy(value)), "_total": F.sum(n).over(every), "_mean": F.try_divide(weight.over(every), F.sum(n).over(every))})
    else:
        totals = small(counts.groupBy(*group).agg(F.sum(n).alias("_total"), F.try_divide(weight, F.sum(n)).alias("_mean")), "totals")
        own = _matched(running_sum(counts, n, "_run", [value], group), totals, group)
    v, cells = F.col(value).cast("double"), []
    for i, p in enumerate(at):
        place = (F.col("_total") - 1) * (p / 100)
        low, high = (F.min(F.when(F.col("_run") > f(place), v)) for f in (F.floor, F.ceil))
        cells.append((low + (high - low) * F.max(place - F.floor(place))).alias(f"p{i}"))
    return own.groupBy(*group).agg(*cells, *more)
