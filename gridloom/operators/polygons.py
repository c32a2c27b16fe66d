"""Polygons burned into grids, exactly, from their edges: no pixel meets a whole ring.

Features are rows of fid, ring (array of x, y; closed by its first point) and attributes; a feature of several rings, holes
among them, has a row for each. Their edges go to the rows of pixels that they cross. What a row of pixels has of a feature
are then the stretches between its crossings (middles), the columns that its edges pass (touched), or sums of what the edges
cover (areas): spans of columns, whose number grows with the length of the outlines, not with their points times the pixels.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import free_name, small

RING = "ring"
Place = tuple[float, float]


def ring_area(ring: Column) -> Column:
    """Signed area of a ring, by the shoelace formula: positive if it runs counterclockwise (y up)."""
    after = F.concat(F.slice(ring, 2, F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 1, 1))
    cross = F.zip_with(ring, after, lambda a, b: a["x"] * b["y"] - b["x"] * a["y"])
    return F.aggregate(cross, F.lit(0.0), lambda s, v: s + v) / 2


def edges(features: DataFrame, *keep: str) -> DataFrame:
    """fid, keep, and ax, ay, bx, by of every edge of every ring."""
    after = F.concat(F.slice(RING, 2, F.greatest(F.size(RING) - 1, F.lit(0))), F.slice(RING, 1, 1))
    each = features.where(F.size(RING) > 0).select("fid", *keep, F.explode(F.arrays_zip(F.col(RING).alias("a"), after.alias("b"))).alias("e"))
    return each.select("fid", *keep, *(F.col(f"e.{p}.{v}").alias(p + v) for p in "ab" for v in "xy"))


def grid_edges(features: DataFrame, *keep: str, origin: Place = (0.0, 0.0), size: Place = (1.0, 1.0)) -> DataFrame:
    """edges in pixels: x columns to the right, y rows down from the origin."""
    x = lambda c: (F.col(c) - origin[0]) / size[0]
    y = lambda c: (F.lit(origin[1]) - F.col(c)) / size[1]
    return edges(features, *keep).select("fid", *keep, x("ax").alias("ax"), y("ay").alias("ay"), x("bx").alias("bx"), y("by").alias("by"))


def bounds(df: DataFrame) -> tuple[int, int, int, int] | None:
    """top, bottom, left and right of a grid's pixels; none of an empty one."""
    got = df.agg(F.min("r"), F.max("r"), F.min("c"), F.max("c")).first()
    return None if got[0] is None else tuple(got)


def _rows(low: Column, high: Column, top: int, bottom: int) -> Column:
    """Numbers from low to high, within top and bottom; an empty array if there are none."""
    a, b = F.greatest(low.cast("long"), F.lit(top).cast("long")), F.least(high.cast("long"), F.lit(bottom).cast("long"))
    return F.when(a <= b, F.sequence(a, b)).otherwise(F.array().cast("array<bigint>"))


def middle_spans(own: DataFrame, top: int, bottom: int) -> DataFrame:
    """fid, r, lo, hi: columns whose middles are inside a feature, by the even-odd rule over all its rings."""
    low, high = F.least("ay", "by"), F.greatest("ay", "by")
    met = own.withColumn("r", F.explode(_rows(F.floor(low + 0.5), F.floor(high - 0.5), top, bottom)))
    cross = met.select("fid", "r", ((F.col("bx") - F.col("ax")) * (F.col("r") + 0.5 - F.col("ay")) / (F.col("by") - F.col("ay")) + F.col("ax")).alias("x"))
    row = Window.partitionBy("fid", "r").orderBy("x")
    pairs = cross.withColumns({"n": F.row_number().over(row), "to": F.lead("x").over(row)}).where("n % 2 = 1")
    return pairs.select("fid", "r", F.ceil(F.col("x") - 0.5).alias("lo"), (F.ceil(F.col("to") - 0.5) - 1).alias("hi")).where("lo <= hi")


def outline_spans(own: DataFrame, top: int, bottom: int) -> DataFrame:
    """fid, r, lo, hi: columns of pixels whose inner part an edge passes; one along a border of pixels passes none."""
    low, high = F.least("ay", "by"), F.greatest("ay", "by")
    flat = low == high
    last = F.when(flat, F.when(low == F.floor(low), F.floor(low) - 1).otherwise(F.floor(low))).otherwise(F.ceil(high) - 1)
    met = own.withColumn("r", F.explode(_rows(F.floor(low), last, top, bottom)))
    at = lambda y: F.when(flat, F.col("ax")).otherwise(F.col("ax") + (F.col("bx") - F.col("ax")) * (y - F.col("ay")) / (F.col("by") - F.col("ay")))
    one = at(F.greatest(low, F.col("r").cast("double")))
    two = F.when(flat, F.col("bx")).otherwise(at(F.least(high, F.col("r") + 1.0)))
    return met.select("fid", "r", F.floor(F.least(one, two)).alias("lo"), (F.ceil(F.greatest(one, two)) - 1).alias("hi")).where("lo <= hi")


def cover_spans(own: DataFrame, top: int, bottom: int, left: int, right: int) -> DataFrame:
    """fid, r, lo, hi, cover: the share of each of these pixels that a feature covers.

    own: grid_edges with _sign, which makes outer rings of one direction and holes of the other. An edge's piece in a pixel
    covers a part of it and all pixels to its right, by its height: running sums along each row of pixels give the shares.
    """
    flat = F.col("ay") == F.col("by")
    low, high = F.least("ay", "by"), F.greatest("ay", "by")
    met = own.where(~flat).withColumn("r", F.explode(_rows(F.floor(low), F.ceil(high) - 1, top, bottom)))
    inside = lambda y: F.least(F.greatest(y, F.col("r").cast("double")), F.col("r") + 1.0)
    at = lambda y: F.col("ax") + (F.col("bx") - F.col("ax")) * (y - F.col("ay")) / (F.col("by") - F.col("ay"))
    part = met.select("fid", "_sign", "r", at(inside(F.col("ay"))).alias("x1"), inside(F.col("ay")).alias("y1"), at(inside(F.col("by"))).alias("x2"), inside(F.col("by")).alias("y2"))
    # what lies left of the grid counts as at its left border, for all pixels; what lies right of it for none
    near = lambda x: F.least(F.greatest(F.col(x), F.lit(float(left))), F.lit(float(right + 1)))
    a, b = F.floor(F.least(near("x1"), near("x2"))), F.greatest(F.floor(F.least(near("x1"), near("x2"))), F.ceil(F.greatest(near("x1"), near("x2"))) - 1)
    beyond = [F.lit(left - 1).cast("long")]
    columns = F.concat(F.when(F.least("x1", "x2") < left, F.array(*beyond)).otherwise(F.array().cast("array<bigint>")), F.when(F.greatest("x1", "x2") >= left, _rows(a, b, left, right)).otherwise(F.array().cast("array<bigint>")))
    cell = part.withColumn("c", F.explode(columns))
    # the stretch of the piece (0 to 1) in this column
    slope = F.col("x2") - F.col("x1")
    where = lambda x: (x - F.col("x1")) / F.nullif(slope, F.lit(0.0))
    share = lambda t: F.least(F.greatest(t, F.lit(0.0)), F.lit(1.0))
    begin, end = where(F.when(F.col("c") < left, F.lit(float("-inf"))).otherwise(F.col("c").cast("double"))), where(F.col("c") + 1.0)
    t1, t2 = F.when(slope == 0, 0.0).otherwise(share(F.least(begin, end))), F.when(slope == 0, 1.0).otherwise(share(F.greatest(begin, end)))
    dy = (F.col("y2") - F.col("y1")) * (t2 - t1) * F.col("_sign")
    middle = F.col("x1") + slope * (t1 + t2) / 2
    sums = cell.select("fid", "r", "c", dy.alias("dy"), (dy * (F.col("c") + 1.0 - middle)).alias("own")).groupBy("fid", "r", "c").agg(F.sum("dy").alias("dy"), F.sum("own").alias("own"))
    row = Window.partitionBy("fid", "r").orderBy("c")
    run = sums.withColumns({"to": F.coalesce(F.lead("c").over(row), F.lit(right + 1)), "after": F.sum("dy").over(row.rowsBetween(Window.unboundedPreceding, 0))})
    parts = F.array(F.struct(F.col("c").alias("lo"), F.col("c").alias("hi"), F.abs(F.col("after") - F.col("dy") + F.col("own")).alias("cover")), F.struct((F.col("c") + 1).alias("lo"), (F.col("to") - 1).alias("hi"), F.abs("after").alias("cover")))
    return run.select("fid", "r", F.explode(parts).alias("s")).select("fid", "r", "s.*").where(f"lo >= {left} AND lo <= hi AND cover > 1e-9")


def signed(features: DataFrame, hole: str | None = None) -> DataFrame:
    """features with _sign: what makes a ring's direction that of an outer one, or, where the column `hole` says so, of a hole."""
    direction = F.signum(ring_area(F.col(RING)))
    return features.withColumn("_sign", F.when(F.col(hole), -direction).otherwise(direction) if hole else direction)


def at_spans(df: DataFrame, spans: DataFrame, left: int, right: int, cell: int = 256) -> DataFrame:
    """Pixels of df with the columns of the spans that hold them, joined by row and stretch of `cell` columns."""
    j, j2, lo, hi, row = (free_name(x, df, spans) for x in ("_j", "_j2", "_lo", "_hi", "_row"))
    held = spans.withColumns({lo: F.greatest(F.col("lo"), F.lit(left)), hi: F.least(F.col("hi"), F.lit(right))}).where(F.col(lo) <= F.col(hi)).drop("lo", "hi")
    dealt = held.withColumnRenamed("r", row).withColumn(j2, F.explode(F.sequence(F.floor(F.col(lo) / cell), F.floor(F.col(hi) / cell))))
    met = df.withColumn(j, F.floor(F.col("c") / cell)).join(small(dealt, "spans"), (F.col("r") == F.col(row)) & (F.col(j) == F.col(j2)) & F.col("c").between(F.col(lo), F.col(hi)))
    return met.drop(j, j2, lo, hi, row)
