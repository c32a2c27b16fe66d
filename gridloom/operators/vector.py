"""Polygons as rings of points: point-in-polygon joins, rasterization, unions of attributes, GeoJSON.

Features are rows of fid, ring and attributes; one of several rings (parts, holes) has a row for each, with its attributes.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..session import free_name, small
from .overlay import dissolved
from .polygons import RING, at_spans, bounds, cover_spans, grid_edges, middle_spans, outline_spans, ring_area, signed
from .raster import cross_matrix


def boxes(features: DataFrame) -> DataFrame:
    """features with left, top, right and bottom of their rings."""
    x, y = F.transform(RING, lambda p: p["x"]), F.transform(RING, lambda p: p["y"])
    return features.withColumns({"left": F.array_min(x), "right": F.array_max(x), "top": F.array_max(y), "bottom": F.array_min(y)})


def pixel_centers(df: DataFrame, origin: tuple[float, float] = (0.0, 0.0), size: tuple[float, float] = (1.0, 1.0)) -> DataFrame:
    """df with x and y of each pixel's middle; rows go down from the origin."""
    return df.withColumns({"x": F.lit(origin[0]) + (F.col("c") + 0.5) * size[0], "y": F.lit(origin[1]) - (F.col("r") + 0.5) * size[1]})


def pixels_in_polygons(df: DataFrame, features: DataFrame, touched: bool = False, **grid) -> DataFrame:
    """Pixels (with their middles, x and y) joined with the polygons that hold their middles: a row a pixel and feature.

    touched: also with those whose outline passes a pixel. Rings go to the rows of pixels as spans of columns (see polygons);
    holes and several parts count by the even-odd rule. Pixels aren't copied. Attributes of features stay, rings don't.
    """
    box, own, rest = bounds(df), grid_edges(features, **grid), features.drop(RING).dropDuplicates(["fid"])
    if box is None:
        return pixel_centers(df, **grid).join(rest, F.lit(False))
    spans = middle_spans(own, *box[:2])
    if touched:
        spans = spans.union(outline_spans(own, *box[:2]))
    met = at_spans(pixel_centers(df, **grid), spans, *box[2:])
    return (met.dropDuplicates(["r", "c", "fid"]) if touched else met).join(small(rest), "fid")


def training_matrix(df: DataFrame, rois: DataFrame, bands: Sequence[str], label: str, **grid) -> DataFrame:
    """label, r, c and features (array of the bands) of the pixels of regions of interest; pixels with NoData are left out.

    A pixel of several regions of one class counts once, one of several classes for each.
    """
    held = pixels_in_polygons(df.dropna(subset=list(bands)), rois, **grid)
    return held.select(label, "r", "c", F.array(*(F.col(b).cast("double") for b in bands)).alias("features")).dropDuplicates([label, "r", "c"])


def cross_with_features(df: DataFrame, band: str, features: DataFrame, field: str, **grid) -> DataFrame:
    """Pixels of each pair of a raster's class and a reference layer's (burned at pixels' middles), as raster.cross_matrix."""
    burned, name = rasterize(df, features, field, **grid), free_name("_reference", df)
    return cross_matrix(df.join(burned.withColumnRenamed("value", name), ["r", "c"]), band, name)


def clip_polygons(df: DataFrame, features: DataFrame, field: str | None = None, **grid) -> DataFrame:
    """Pixels whose middles are in a polygon; with a field, of each of its values (a column more): a raster a value."""
    keep = [c for c in df.columns] + ([field] if field else [])
    return pixels_in_polygons(df, features, **grid).select(*keep).dropDuplicates(["r", "c"] + ([field] if field else []))


def mask_polygons(df: DataFrame, features: DataFrame, bands: Sequence[str], inverse: bool = False, **grid) -> DataFrame:
    """NoData in the bands inside the polygons (inverse: outside)."""
    flag = free_name("_held", df)
    held = pixels_in_polygons(df.select("r", "c"), features, **grid).select("r", "c", F.lit(True).alias(flag)).distinct()
    out = df.join(held, ["r", "c"], "left")
    stays = F.col(flag).isNotNull() if inverse else F.col(flag).isNull()
    return out.withColumns({b: F.when(stays, F.col(b)) for b in bands}).select(*df.columns)


def rasterize(df: DataFrame, features: DataFrame, field: str, touched: bool = False, **grid) -> DataFrame:
    """r, c and the field of the polygon at each pixel's middle (of several the one of the largest fid), null elsewhere.

    touched: of the polygons that have a part of the pixel, however small.
    """
    burned = pixels_in_polygons(df.select("r", "c"), features, touched, **grid).groupBy("r", "c").agg(F.max_by(field, "fid").alias("value"))
    return df.select("r", "c").join(burned, ["r", "c"], "left")


def rasterize_area(df: DataFrame, features: DataFrame, field: str, hole: str | None = None, **grid) -> DataFrame:
    """r, c, the value that covers most of each pixel (ties, to nine decimals: the smaller value), and the share it covers.

    Shares are exact. hole: a boolean column that tells rings which are holes; the other rings of a feature don't overlap.
    """
    box = bounds(df)
    if box is None:
        return df.select("r", "c").withColumns({"value": F.lit(None).cast(dict(features.dtypes)[field]), "cover": F.lit(None).cast("double")})
    spans = cover_spans(grid_edges(signed(features, hole), "_sign", **grid), *box)
    held = at_spans(df.select("r", "c"), spans, *box[2:]).join(small(features.select("fid", F.col(field).alias("value")).dropDuplicates(["fid"])), "fid")
    shares = held.groupBy("r", "c", "value").agg(F.round(F.sum("cover"), 9).alias("cover"))
    best = shares.groupBy("r", "c").agg(F.min_by("value", F.struct(-F.col("cover"), "value")).alias("value"), F.max("cover").alias("cover"))
    return df.select("r", "c").join(best, ["r", "c"], "left")


def rectangles(spark, rows: Sequence[tuple]) -> DataFrame:
    """Polygons of (fid, left, top, right, bottom, value)."""
    ring = [(f, [(a, t), (b, t), (b, d), (a, d)], v) for f, a, t, b, d, v in rows]
    return spark.createDataFrame(ring, "fid int, ring array<struct<x:double,y:double>>, value int")


def distinct_values(features: DataFrame, field: str) -> DataFrame:
    """Distinct values of a field; fids if there is no such field."""
    return features.select(field if field in features.columns else "fid").distinct()


def layer_extent(features: DataFrame) -> DataFrame:
    return boxes(features).agg(F.min("left").alias("left"), F.max("top").alias("top"), F.max("right").alias("right"), F.min("bottom").alias("bottom"))


def area(ring: Column) -> Column:
    """Area of a ring."""
    return F.abs(ring_area(ring))


def to_geojson(features: DataFrame) -> DataFrame:
    """fid and a GeoJSON feature with the other columns as properties."""
    points = F.transform(RING, lambda p: F.array(p["x"], p["y"]))
    closed = F.concat(points, F.slice(points, 1, 1))
    rest = [c for c in features.columns if c != RING]
    return features.select("fid", F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(*rest).alias("properties"), F.struct(F.lit("Polygon").alias("type"), F.array(closed).alias("coordinates")).alias("geometry"))).alias("json"))


def random_points(spark, number: int, left: float, top: float, right: float, bottom: float, seed: int = 0) -> DataFrame:
    return spark.range(number).select("id", (F.lit(left) + F.rand(seed) * (right - left)).alias("x"), (F.lit(bottom) + F.rand(seed + 1) * (top - bottom)).alias("y"))


def union_features(features: DataFrame, field: str, hole: str | None = None) -> DataFrame:
    """One row a value of the field: the rings of the union of its features (a multipolygon; holes run clockwise), their
    number, the area that they cover and the length of their outlines. Features may overlap and touch; see overlay."""
    rings = dissolved(features, field, hole)
    return rings.groupBy(field).agg(F.collect_list(RING).alias("rings"), F.count("*").alias("parts"), F.sum("area").alias("area"), F.sum("border").alias("border"))


def explode_features(merged: DataFrame, field: str) -> DataFrame:
    """A row a ring of what union_features merged."""
    return merged.select(field, F.posexplode("rings").alias("part", RING))
