"""Unions of polygons: overlapping and touching rings of one value become the rings of what they cover together.

Edges are cut where they meet others, cell by cell. A stretch is an outline of the union if just one side of it is covered:
a cell holds its own stretches and how often its corner is covered (the winding number there, from running sums along the
line through the corners), and from the corner to a stretch only stretches of that cell lie between. Outlines are then
stitched into rings by list ranking. So a polygon of a million points is never in one task, but for the ring that comes out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..session import cut
from .polygons import RING, edges, signed
from .ranks import running_sum
from .rings import stitched, without_straight

#: Edges that a cell has, about.
EDGES = 64
#: Where lines of cells lie, in cells: at no place that data have.
_SHIFT = 0.618033988749895
_POINT = "array<struct<x:double,y:double>>"


def _cells(df: DataFrame, x0: float, y0: float, cell: float) -> DataFrame:
    """df (ax, ay, bx, by) with i and j of every cell that an edge passes."""
    x, y = (lambda c: (c - x0) / cell), (lambda c: (c - y0) / cell)
    low, high = F.least("ay", "by"), F.greatest("ay", "by")
    row = df.withColumn("j", F.explode(F.sequence(F.floor(y(low)), F.floor(y(high)))))
    at = lambda v: F.when(F.col("ay") == F.col("by"), F.col("ax")).otherwise(F.col("ax") + (F.col("bx") - F.col("ax")) * (v - F.col("ay")) / (F.col("by") - F.col("ay")))
    one = at(F.greatest(low, F.col("j") * cell + y0))
    two = F.when(F.col("ay") == F.col("by"), F.col("bx")).otherwise(at(F.least(high, (F.col("j") + 1) * cell + y0)))
    near = 1e-9 * cell
    return row.withColumn("i", F.explode(F.sequence(F.floor(x(F.least(one, two) - near)), F.floor(x(F.greatest(one, two) + near)))))


def _without_overlaps(own: DataFrame) -> DataFrame:
    """own (value, ax, ay, bx, by, n), what lies on one another along the axes once: n more edges that go one way than the other.

    Of edges along one line a running sum over their ends, sorted by ranges, gives how many more go ahead than back; stretches
    where none do vanish, and neighbours of the same number are one. So polygons that cover each other many times have no
    more edges than the lines that they draw.
    """
    upright, level = F.col("ax") == F.col("bx"), F.col("ay") == F.col("by")
    at, a, b = (F.when(upright, F.col(x)).otherwise(F.col(y)) for x, y in (("ax", "ay"), ("ay", "ax"), ("by", "bx")))
    line = own.where(upright | level).select("value", upright.alias("upright"), at.alias("at"), a.alias("a"), b.alias("b"), "n")
    ends = line.select("value", "upright", "at", F.explode(F.array(F.struct(F.col("a").alias("p"), F.col("n").alias("more")), F.struct(F.col("b").alias("p"), (-F.col("n")).alias("more")))).alias("e"))
    ends = ends.groupBy("value", "upright", "at", F.col("e.p").alias("p")).agg(F.sum("e.more").alias("more")).where("more <> 0")
    run = running_sum(ends, "more", "n", ["p"], ["value", "upright", "at"])
    nexts = F.lead("p").over(Window.partitionBy("value", "upright", "at").orderBy("p"))
    run = run.withColumn("q", nexts).where("n <> 0").select("value", "upright", "at", F.when(F.col("n") > 0, F.col("p")).otherwise(F.col("q")).alias("a"), F.when(F.col("n") > 0, F.col("q")).otherwise(F.col("p")).alias("b"), F.abs("n").alias("n"))
    place = lambda c, along: F.when(F.col("upright") == along, F.col(c)).otherwise(F.col("at"))
    lines = run.select("value", place("a", False).alias("ax"), place("a", True).alias("ay"), place("b", False).alias("bx"), place("b", True).alias("by"), "n")
    return own.where(~(upright | level)).union(lines)


def _meetings(digits: int):
    """The function of a cell's edges that gives the points at which each has to be cut."""
    eps = 0.5 * 10.0**-digits

    def run(key, table):
        eid, ax, ay, bx, by = (np.asarray(table.column(c)) for c in ("eid", "ax", "ay", "bx", "by"))
        out = [], [], []
        dx, dy = bx - ax, by - ay
        length = np.hypot(dx, dy)
        for i in range(len(eid)):
            # points of others that lie on this edge, ends left out
            for px, py in ((ax, ay), (bx, by)):
                along = ((px - ax[i]) * dx[i] + (py - ay[i]) * dy[i]) / length[i]
                off = np.abs((px - ax[i]) * dy[i] - (py - ay[i]) * dx[i]) / length[i]
                on = np.flatnonzero((off <= eps) & (along > eps) & (along < length[i] - eps))
                out[0].append(np.full(len(on), eid[i]))
                out[1].append(px[on])
                out[2].append(py[on])
            # crossings with later ones, inside both
            j = np.arange(i + 1, len(eid))
            den = dx[i] * dy[j] - dy[i] * dx[j]
            with np.errstate(divide="ignore", invalid="ignore"):
                t = ((ax[j] - ax[i]) * dy[j] - (ay[j] - ay[i]) * dx[j]) / den
                u = ((ax[j] - ax[i]) * dy[i] - (ay[j] - ay[i]) * dx[i]) / den
            hit = np.flatnonzero((np.abs(den) > 0) & (t * length[i] > eps) & (t < 1 - eps / length[i]) & (u * length[j] > eps) & (u < 1 - eps / length[j]))
            x, y = np.round(ax[i] + t[hit] * dx[i], digits), np.round(ay[i] + t[hit] * dy[i], digits)
            for e in (np.full(len(hit), eid[i]), eid[j[hit]]):
                out[0].append(e)
                out[1].append(x)
                out[2].append(y)
        return pa.table({"eid": pa.array(np.concatenate([*out[0], np.zeros(0, np.int64)]).astype(np.int64)), "x": pa.array(np.concatenate([*out[1], np.zeros(0)])), "y": pa.array(np.concatenate([*out[2], np.zeros(0)]))})

    return run


def _outlines(x0: float, y0: float, cell: float):
    """The function of a cell's stretches that gives those with one side covered, the covered one on their left."""

    def run(key, own, corner):
        i, j = key[-2].as_py(), key[-1].as_py()
        ux, uy, vx, vy, net = (np.asarray(own.column(c)) for c in ("ax", "ay", "bx", "by", "net"))
        mx, my = (ux + vx) / 2, (uy + vy) / 2
        here = np.flatnonzero((np.floor((mx - x0) / cell) == i) & (np.floor((my - y0) / cell) == j))
        at_corner = int(corner.column("w")[0].as_py() or 0) if len(corner) else 0
        right = (i + 1) * cell + x0
        bottom = j * cell + y0
        with np.errstate(divide="ignore", invalid="ignore"):
            cross_y = uy + (vy - uy) * (right - ux) / (vx - ux)  # on the line along the cell's right side
        passes = ((ux <= right) != (vx <= right)) & (cross_y > bottom)
        turn = np.where(vx > ux, net, -net)
        w = np.zeros(len(here), np.int64)
        for at in range(0, len(here), 256):
            part = here[at : at + 256]
            x, y = mx[part, None], my[part, None]
            up = np.where(passes & (cross_y <= y), turn, 0).sum(1)
            with np.errstate(divide="ignore", invalid="ignore"):
                cross_x = ux + (vx - ux) * (y - uy) / (vy - uy)
            between = (uy <= y) & (y < vy) & (cross_x > x) & (cross_x <= right)
            between[np.arange(len(part)), part] = False
            w[at : at + 256] = at_corner + up + np.where(between, net, 0).sum(1)
        flat = uy[here] == vy[here]
        left_w = np.where(flat, w, w + net[here])
        right_w = np.where(flat, w - net[here], w)
        edge = (left_w > 0) != (right_w > 0)
        here, ahead = here[edge], (left_w > 0)[edge]
        pick = lambda a, b: pa.array(np.where(ahead, a[here], b[here]))
        value = own.column("value").combine_chunks() if isinstance(own.column("value"), pa.ChunkedArray) else own.column("value")
        return pa.table({"value": value.take(pa.array(here)), "ax": pick(ux, vx), "ay": pick(uy, vy), "bx": pick(vx, ux), "by": pick(vy, uy)})

    return run


def dissolved(features: DataFrame, field: str, hole: str | None = None, digits: int = 6) -> DataFrame:
    """field, ring, hole, area and border: the rings of the union of all features of each value of the field.

    Outer rings run counterclockwise (y up) and have positive areas, holes the other way and negative ones; parts that meet in
    a point are rings of their own. Points are rounded to `digits` decimals, crossings too. hole: a boolean column that tells
    rings of the input which are holes. Null values are one value; rings of no area vanish; no features: no rows.
    """
    kind = dict(features.dtypes)[field]
    kept = signed(features.where(F.col(RING).isNotNull()), hole).where("_sign <> 0")
    flip = F.col("_sign") < 0
    ends = {f"{p}{v}": F.round(F.when(flip, F.col(f"{q}{v}")).otherwise(F.col(f"{p}{v}")), digits) + 0.0 for p, q in ("ab", "ba") for v in "xy"}
    own = edges(kept.withColumn("value", F.col(field)), "value", "_sign").select("value", *(c.alias(n) for n, c in ends.items())).where("ax <> bx OR ay <> by")
    own = _without_overlaps(own.groupBy("value", "ax", "ay", "bx", "by").agg(F.count("*").alias("n")))
    own = cut(own.withColumn("eid", F.xxhash64("value", "ax", "ay", "bx", "by")), "edges")
    left, right, low, high = own.agg(F.least(F.min("ax"), F.min("bx")), F.greatest(F.max("ax"), F.max("bx")), F.least(F.min("ay"), F.min("by")), F.greatest(F.max("ay"), F.max("by"))).first()
    if left is None:
        return features.sparkSession.createDataFrame([], f"{field} {kind}, ring {_POINT}, hole boolean, area double, border double")
    # cells are by value, so the value of the most edges says how many
    cells = max(1, own.groupBy("value").count().agg(F.max("count")).first()[0] // EDGES)
    wide, tall = right - left, high - low
    cell = max((wide * tall / cells) ** 0.5, max(wide, tall) / cells) * 1.0000001234567
    x0, y0 = left - _SHIFT * cell, low - _SHIFT * cell
    met = _cells(own.select("value", "eid", "ax", "ay", "bx", "by"), x0, y0, cell).groupBy("value", "i", "j").applyInArrow(_meetings(digits), "eid long, x double, y double")
    cuts = met.groupBy("eid").agg(F.collect_set(F.struct("x", "y")).alias("cuts"))
    ends = lambda p: F.struct(F.col(f"{p}x").alias("x"), F.col(f"{p}y").alias("y"))
    far = lambda p: F.abs(p["x"] - F.col("ax")) + F.abs(p["y"] - F.col("ay"))
    line = F.array_sort(F.transform(F.array_distinct(F.concat(F.array(ends("a"), ends("b")), F.coalesce("cuts", F.array().cast(_POINT)))), lambda p: F.struct(far(p).alias("d"), p.alias("p"))))
    parts = own.join(cuts, "eid", "left").withColumn("line", F.transform(line, lambda p: p["p"]))
    parts = parts.select("value", "n", F.explode(F.zip_with(F.slice("line", 1, F.size("line") - 1), F.slice("line", 2, F.size("line") - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))).alias("s"))
    # each stretch once, upward (or to the right); net: how many more of its edges go that way than back
    ahead = F.expr("struct(s.a.y, s.a.x) < struct(s.b.y, s.b.x)")
    side = lambda p, q, v: F.when(ahead, F.col(f"s.{p}.{v}")).otherwise(F.col(f"s.{q}.{v}")).alias(p + v)
    parts = parts.select("value", *(side(p, q, v) for p, q in ("ab", "ba") for v in "xy"), F.when(ahead, F.col("n")).otherwise(-F.col("n")).alias("net"))
    parts = cut(parts.groupBy("value", "ax", "ay", "bx", "by").agg(F.sum("net").alias("net")).where("net <> 0"), "stretches")
    dealt = cut(_cells(parts, x0, y0, cell), "dealt")
    # how often each cell's lower right corner is covered: crossings of the line through it that lie to its right
    line = F.col("j") * cell + y0
    low, high = (F.floor((F.col(c) - y0) / cell) for c in ("ay", "by"))
    cross = parts.withColumn("j", F.explode(F.when(high > low, F.sequence(low + 1, high)).otherwise(F.array().cast("array<bigint>"))))
    cross = cross.select("value", "j", (F.col("ax") + (F.col("bx") - F.col("ax")) * (line - F.col("ay")) / (F.col("by") - F.col("ay"))).alias("x"), F.lit(None).cast("long").alias("i"), "net")
    corners = dealt.select("value", "i", "j").distinct().select("value", "j", ((F.col("i") + 1) * cell + x0).alias("x"), "i", F.lit(0).cast("long").alias("net"))
    run = Window.partitionBy("value", "j").orderBy(F.desc("x"), F.desc_nulls_last("i")).rowsBetween(Window.unboundedPreceding, 0)
    corners = cross.union(corners).withColumn("w", F.sum("net").over(run)).where("i IS NOT NULL").select("value", "i", "j", "w")
    found = dealt.groupBy("value", "i", "j").cogroup(corners.groupBy("value", "i", "j")).applyInArrow(_outlines(x0, y0, cell), f"value {kind}, ax double, ay double, bx double, by double")
    found = cut(found.withColumn("piece", F.xxhash64("value", "ax", "ay", "bx", "by")), "outlines")
    # at a point where several outlines meet, the next one is that which bounds the same part: the first clockwise
    begins = found.select(F.col("value").alias("_v"), F.col("ax").alias("bx"), F.col("ay").alias("by"), F.atan2(F.col("by") - F.col("ay"), F.col("bx") - F.col("ax")).alias("way"), F.col("piece").alias("follows"))
    back = F.atan2(F.col("ay") - F.col("by"), F.col("ax") - F.col("bx"))
    turn = F.pmod(back - F.col("way") - 1e-12, F.lit(2 * np.pi))
    nexts = found.join(begins, ["bx", "by"]).where(F.col("value").eqNullSafe(F.col("_v"))).groupBy("piece").agg(F.min_by("follows", turn).alias("next"))
    pieces = found.join(nexts, "piece").select("piece", "next", F.col("value").alias("key"), F.array(ends("a")).alias("path"), (F.col("ax") * F.col("by") - F.col("bx") * F.col("ay")).alias("cross"), F.hypot(F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")).alias("length"))
    rings = stitched(pieces)
    return rings.select(F.col("ring_key").alias(field), without_straight(F.col("path")).alias(RING), (F.col("area") < 0).alias("hole"), "area", "border")
