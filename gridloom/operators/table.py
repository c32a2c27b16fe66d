"""The table manager: projection, calculation, filters, joins, pivots, sorting and row edits over DataFrames."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..plans.expressions import Compiler, compile_over
from ..session import collected, cut, few, free_name, small
from .ranks import percentiles

#: Aggregations by name; std is of the sample in pivots (std_pop: of the population).
AGGREGATES = {
    "sum": F.sum, "min": F.min, "max": F.max, "mean": F.avg, "median": F.median, "count": F.count,
    "std": F.stddev_samp, "std_pop": F.stddev_pop, "var": F.var_samp,
}


def aggregate(func: str, column: str, row_id: str | None = None) -> Column:
    """An aggregation by name: AGGREGATES, percentile_<p>, or first and last by row_id."""
    if func in AGGREGATES:
        return AGGREGATES[func](column)
    if func.startswith("percentile_"):
        return F.percentile(column, F.lit(float(func.removeprefix("percentile_")) / 100))
    if func in ("first", "last") and row_id:
        return (F.min_by if func == "first" else F.max_by)(column, row_id)
    raise ValueError(f"unknown aggregation {func}")


def _quantile(func: str) -> float | None:
    """The percentage of a median or percentile, else None."""
    return 50.0 if func == "median" else float(func.removeprefix("percentile_")) if func.startswith("percentile_") else None


def grouped(df: DataFrame, keys: Sequence[str], functions: Sequence[tuple[str, str]], row_id: str | None = None) -> DataFrame:
    """keys and _v0, _v1, .. of the (column, function) pairs by group.

    Medians and percentiles come from counts of different values (ranks.percentiles), so no group is sorted by one task.
    """
    simple = [(i, aggregate(f, c, row_id)) for i, (c, f) in enumerate(functions) if _quantile(f) is None]
    out = df.groupBy(*keys).agg(*(a.alias(f"_v{i}") for i, a in simple)) if simple else df.select(*keys).distinct()
    for column in dict.fromkeys(c for c, f in functions if _quantile(f) is not None):
        own = [(i, _quantile(f)) for i, (c, f) in enumerate(functions) if c == column and _quantile(f) is not None]
        # the column under another name, as it may be a key too
        counts = df.select(*keys, F.col(column).alias("_value")).groupBy(*keys, "_value").agg(F.count("*").alias("_n"))
        got = percentiles(counts, "_value", [p for _, p in own], keys).toDF(*(f"_k{k}" for k in range(len(keys))), *(f"_v{i}" for i, _ in own))
        same = F.lit(True)
        for k, key in enumerate(keys):
            same = same & F.col(key).eqNullSafe(F.col(f"_k{k}"))
        out = out.join(small(got), same, "left").drop(*(f"_k{k}" for k in range(len(keys))))
    return out


def _resolver(df: DataFrame):
    kinds = {c.lower(): c for c in df.columns}

    def resolve(name: str) -> Column:
        if name.lower() not in kinds:
            raise ValueError(f"no column {name}")
        return df[kinds[name.lower()]]

    return resolve


def project(df: DataFrame, fields: Sequence[str], names: Sequence[str] | None = None) -> DataFrame:
    """The listed columns in that order, renamed if names are given; unknown ones are left out."""
    return df.select(*(F.col(f).alias(n) for f, n in zip(fields, names or fields, strict=True) if f in df.columns))


def rename(df: DataFrame, old: str, new: str) -> DataFrame:
    return df.withColumnRenamed(old, new)


def define_fields(df: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """Casts; a value that doesn't fit is null."""
    return df.withColumns({c: F.col(c).try_cast(t) for c, t in kinds.items()})


def calculate(df: DataFrame, expression: str, name: str, kind: str | None = None) -> DataFrame:
    """Appends a column, or overwrites one, which keeps its type."""
    (value,) = compile_over(df, [expression], _resolver(df))
    kind = dict(df.dtypes).get(name) or kind
    return df.withColumn(name, value.cast(kind) if kind else value)


def calculate_multi(df: DataFrame, expressions: Sequence[str], names: Sequence[str], nodata: float | None = None, kind: str | None = None) -> DataFrame:
    """Appends columns that all see the columns as they were; an expression that isn't valid gives nodata."""
    out = {}
    for e, n in zip(expressions, names, strict=True):
        try:
            (value,) = compile_over(df, [e], _resolver(df))
        except (ValueError, SyntaxError):
            value = F.lit(nodata)
        out[n] = value.cast(kind) if kind else value
    return df.withColumns(out)


def filter_rows(df: DataFrame, condition: str) -> DataFrame:
    return df.where(Compiler(_resolver(df)).compile(condition) != 0)


def filter_values(df: DataFrame, field: str, condition: str) -> DataFrame:
    """One column of the rows that meet a condition."""
    return filter_rows(df, condition).select(field)


def in_list(df: DataFrame, field: str, values: Sequence, output: str) -> DataFrame:
    """Another column of the rows whose field is in a list, with the value's place in the list."""
    order = F.coalesce(*(F.when(F.col(field) == v, F.lit(i)) for i, v in enumerate(values)))
    return df.where(F.col(field).isin(list(values))).select(order.alias("place"), field, output)


def date_ranges(df: DataFrame, field: str, ranges: Sequence[str]) -> DataFrame:
    """Rows of any of the ranges: "2020-01-01", or comparisons such as ">=2020-01-01 & <2020-02-01"."""
    day = F.to_date(field)

    def one(part: str) -> Column:
        part = part.strip()
        for op in ("<=", ">=", "<", ">", "="):
            if part.startswith(op):
                return {"<=": day.__le__, ">=": day.__ge__, "<": day.__lt__, ">": day.__gt__, "=": day.__eq__}[op](F.lit(part[len(op) :].strip()).cast("date"))
        return day == F.lit(part).cast("date")

    out = F.lit(False)
    for r in ranges:
        both = F.lit(True)
        for part in r.split("&"):
            both = both & one(part)
        out = out | both
    return df.where(out)


def fill(df: DataFrame, nodata: float | None) -> DataFrame:
    """Nulls as a number: in numeric columns as it is, in strings as text; other columns keep theirs."""
    if nodata is None:
        return df
    numeric = [c for c, t in df.dtypes if t in ("tinyint", "smallint", "int", "bigint", "float", "double") or t.startswith("decimal")]
    text = [c for c, t in df.dtypes if t == "string"]
    return df.na.fill(nodata, numeric).na.fill(str(nodata), text)


def join_tables(left: DataFrame, right: DataFrame, left_key: str, right_key: str, how: str = "left", postfix: str = "2", nodata: float | None = -9999) -> DataFrame:
    """Equi-join, many to many; null keys match each other. Names of the right that the left has too get the postfix.

    Both keys stay if their names differ; else there is one, from whichever side has it.
    """
    how = {"outer": "full_outer"}.get(how, how)
    taken = {c: c + postfix if c in left.columns else c for c in right.columns if c != right_key or right_key != left_key}
    key = free_name("_key", left, right)
    own = right.select(F.col(right_key).alias(key), *(F.col(c).alias(n) for c, n in taken.items()))
    out = left.join(own, left[left_key].eqNullSafe(own[key]), how)
    if right_key == left_key:
        out = out.withColumn(left_key, F.coalesce(left_key, key))
    return fill(out.drop(key), nodata)


def first_rows(df: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """The first row of each key: an aggregation, which combines before it shuffles, not a sort of each key's rows."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(key, *(F.col(f"_r.{c}").alias(c) for c in rest))


def join_first_match(left: DataFrame, right: DataFrame, left_key: str, right_key: str, order: Sequence[str], how: str = "left", nodata: float | None = -9999) -> DataFrame:
    """Many to one: of the right only the first row of each key, whose key column isn't kept (a right join: of the left)."""
    if how == "right":
        return join_first_match(right, left, right_key, left_key, order, "left", nodata)
    return join_tables(left, rename(first_rows(right, right_key, order), right_key, left_key), left_key, left_key, how, nodata=nodata)


def join_unique(left: DataFrame, right: DataFrame, key: str, how: str = "left") -> DataFrame:
    """Join of tables of unique keys; repeated keys are an error. Names on both sides get _m1 and _m2."""
    for t in (left, right):
        if t.groupBy(key).count().where("count > 1").limit(1).count():
            raise ValueError(f"keys of {key} repeat")
    both = [c for c in left.columns if c in right.columns and c != key]
    a, b = left, right
    for c in both:
        a, b = a.withColumnRenamed(c, f"{c}_m1"), b.withColumnRenamed(c, f"{c}_m2")
    return a.join(b, key, how)


def nearest_value(df: DataFrame, field: str, targets: DataFrame, target: str, threshold: float | None = None, order: str | None = None) -> DataFrame:
    """For each target its nearest row of df (ties: the least by `order`), and none if not strictly within the threshold.

    Both sides may be of any size: their different values are sorted by ranges and written, each value takes the last row of
    df before it and the first after it, and what a range lacks comes from the ranges beside it. Rows whose field is null or
    NaN take no part; null targets, and all if df is empty, get none.
    """
    value = lambda x: F.when(~F.isnan(F.col(x).cast("double")), F.col(x).cast("double"))
    whole, place = F.struct(*(F.col(c).alias(f"c{i}") for i, c in enumerate(df.columns))), F.col(order or field)
    rows = df.select(value(field).alias("v"), place.alias("o"), whole.alias("r")).where("v IS NOT NULL")
    rows = rows.groupBy("v").agg(F.min_by(F.struct("v", "o", "r"), F.struct("o", "r")).alias("own"))
    asked = targets.select(value(target).alias("v")).where("v IS NOT NULL").distinct()
    both = rows.withColumn("asks", F.lit(False)).union(asked.select("v", F.lit(None).cast(rows.schema["own"].dataType), F.lit(True)))
    both = cut(both.orderBy("v", "asks").withColumn("part", F.spark_partition_id()), "sorted")
    ends = both.groupBy("part").agg(F.max_by("own", F.when(F.col("own").isNotNull(), F.col("v"))).alias("last"), F.min_by("own", F.when(F.col("own").isNotNull(), F.col("v"))).alias("first"))
    # both ways from the first row on: a frame to the last row is read anew for every row
    parts, back = (Window.orderBy(o).rowsBetween(Window.unboundedPreceding, -1) for o in ("part", F.desc("part")))  # a row a range
    ends = ends.select("part", F.last("last", True).over(parts).alias("before"), F.last("first", True).over(back).alias("after"))
    here, back = (Window.partitionBy("part").orderBy(*o).rowsBetween(Window.unboundedPreceding, 0) for o in (("v", "asks"), (F.desc("v"), F.desc("asks"))))
    near = both.withColumns({"a": F.last("own", True).over(here), "b": F.last("own", True).over(back)}).where("asks")
    near = near.join(F.broadcast(ends), "part").select("v", F.coalesce("a", "before").alias("a"), F.coalesce("b", "after").alias("b"))
    gap = lambda x: F.abs(F.col(f"{x}.v") - F.col("v"))
    nearer = F.col("b").isNull() | (gap("a") < gap("b")) | ((gap("a") == gap("b")) & (F.struct("a.o", "a.r") <= F.struct("b.o", "b.r")))
    best = near.withColumn("x", F.when(F.col("a").isNotNull() & nearer, F.col("a")).otherwise(F.col("b")))
    best = best.where(F.lit(True) if threshold is None else gap("x") < threshold)
    at, found = (free_name(n, df, targets) for n in ("_at", "_found"))
    out = targets.withColumn(at, value(target)).join(small(best.select(F.col("v").alias(at), F.col("x.r").alias(found)), "nearest"), at, "left")
    return out.select(*targets.columns, *(F.col(f"{found}.c{i}").alias(c) for i, c in enumerate(df.columns)))


def pivot(df: DataFrame, row: str, functions: Sequence[tuple[str, str]], secondary: Sequence[str] = (), condition: str | None = None, nodata: float = -999, cross_matrix: bool = False, values: Sequence[tuple] | None = None, row_id: str | None = None) -> DataFrame:
    """Groups by `row`; with secondary fields each of their combinations is a column <column>_<function>_<field><value>...

    cross_matrix: columns are named by the values alone. Missing cells are 0, missing results without secondary fields
    nodata. values: the combinations, if known, which saves a pass; else they are read (more than 10 000 are an error).
    """
    if condition:
        df = filter_rows(df, condition)
    if not secondary:
        got = grouped(df, [row], functions, row_id)
        return fill(got.select(row, *(F.col(f"_v{i}").alias(f"{c}_{f}") for i, (c, f) in enumerate(functions))), nodata)
    if values is None:
        values = sorted(tuple(r) for r in collected(df.select(*secondary).distinct()))
    part = grouped(df, [row, *secondary], functions, row_id)
    cells = []
    for v in values:
        same = F.lit(True)
        for s, x in zip(secondary, v, strict=True):
            same = same & F.col(s).eqNullSafe(F.lit(x))
        for i, (c, f) in enumerate(functions):
            name = "_".join(map(str, v)) if cross_matrix else f"{c}_{f}_" + "_".join(f"{s}{x}" for s, x in zip(secondary, v, strict=True))
            cells.append(F.coalesce(F.max(F.when(same, F.col(f"_v{i}"))), F.lit(0)).alias(name))
    return part.groupBy(row).agg(*cells)


def pivot_fields(df: DataFrame, functions: Sequence[tuple[str, str]], secondary: Sequence[str]) -> DataFrame:
    """Names that pivot would give over all combinations of values, observed together or not. Reads distinct values only."""
    out = None
    for s in secondary:
        one = df.select(F.col(s).cast("string").alias(f"_{s}")).distinct()
        out = one if out is None else out.join(F.broadcast(one) if one.count() <= 10_000 else one)
    names = [F.concat(F.lit(f"{c}_{f}"), *(F.concat(F.lit(f"_{s}"), F.col(f"_{s}")) for s in secondary)) for c, f in functions]
    return out.select(F.explode(F.array(*names)).alias("name"))


def sort_by(df: DataFrame, *fields: str) -> DataFrame:
    return df.orderBy(*fields)


def append_tables(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of both; a column that one lacks is null there."""
    return a.unionByName(b, allowMissingColumns=True)


def append_row(df: DataFrame, values: Sequence) -> DataFrame:
    return df.union(df.sparkSession.createDataFrame([tuple(values)], df.schema))


def upsert(df: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of df whose key isn't in new, and new."""
    return df.join(few(new.select(key).distinct()), key, "left_anti").select(*df.columns).unionByName(new)
