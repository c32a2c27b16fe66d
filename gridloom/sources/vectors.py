"""Polygons from files and back: GeoJSON by Spark's own readers, shapefiles by a data source with ranges of records.

All give rows of fid, part, hole, ring (see operators.polygons) and attributes: a row a ring. Rings are closed by their first
point, which is not repeated.
"""

from __future__ import annotations

import struct
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.projection import from_degrees, to_degrees
from ..operators.polygons import RING, ring_area
from . import ranges

POINTS = "array<struct<x:double,y:double>>"


def read_geojson(spark: SparkSession, path: str, properties: Sequence[str] = (), whole: bool = False) -> DataFrame:
    """fid, part, hole, ring, properties (strings) of polygons and multipolygons; other geometries give no rows.

    Files with a feature a line (GeoJSON text sequences, and collections so written) are read by lines, so large ones are
    split; whole: each file is one document. fid is the feature's id if it is a whole number, else a hash of the feature.
    """
    feature = "struct<type:string,id:string,properties:map<string,string>,geometry:struct<type:string,coordinates:string>>"
    lines = spark.read.text(path, wholetext=whole)
    if whole:
        each = F.from_json("value", f"struct<features:array<{feature}>>")["features"]
        rows = lines.select(F.explode(each).alias("f")).withColumn("text", F.to_json("f"))
    else:
        text = F.regexp_replace(F.translate("value", "\x1e", ""), r",\s*$", "")
        rows = lines.select(text.alias("text")).where(F.col("text").rlike(r'^\s*\{.*"geometry"')).withColumn("f", F.from_json("text", feature))
    rows = rows.where("f.type = 'Feature' AND f.geometry IS NOT NULL")
    one = F.from_json("f.geometry.coordinates", "array<array<array<double>>>")
    many = F.from_json("f.geometry.coordinates", "array<array<array<array<double>>>>")
    parts = F.when(F.col("f.geometry.type") == "Polygon", F.array(one)).when(F.col("f.geometry.type") == "MultiPolygon", many)
    fid = F.coalesce(F.col("f.id").try_cast("long"), F.xxhash64("text"))
    named = [F.col("f.properties").getItem(p).alias(p) for p in properties]
    rings = rows.select(fid.alias("fid"), *named, F.posexplode(parts).alias("part", "rings")).select("fid", *properties, "part", F.posexplode("rings").alias("_at", "_points"))
    points = F.transform("_points", lambda p: F.struct(p[0].alias("x"), p[1].alias("y")))
    closed = (F.size("_points") > 1) & (F.element_at("_points", 1) == F.element_at("_points", -1))
    return rings.select("fid", "part", (F.col("_at") > 0).alias("hole"), F.when(closed, F.slice(points, 1, F.size("_points") - 1)).otherwise(points).alias(RING), *properties)


def geojson(features: DataFrame, properties: Sequence[str] = ()) -> DataFrame:
    """fid and json: a Feature for each fid, of all its rings; of features without `part` each outer ring is a part.

    The first ring of a part is its outline; holes without a part of their own belong to the first one.
    """
    hole = F.col("hole") if "hole" in features.columns else F.lit(False)
    part = F.col("part") if "part" in features.columns else F.lit(0)
    points = F.transform(RING, lambda p: F.array(p["x"], p["y"]))
    rows = features.select("fid", part.alias("_part"), hole.alias("_hole"), F.concat(points, F.slice(points, 1, 1)).alias("_points"), *properties)
    polygons = rows.groupBy("fid", "_part").agg(*(F.first(p).alias(p) for p in properties), F.transform(F.array_sort(F.collect_list(F.struct("_hole", "_points"))), lambda r: r["_points"]).alias("_rings"))
    whole = polygons.groupBy("fid").agg(*(F.first(p).alias(p) for p in properties), F.transform(F.array_sort(F.collect_list(F.struct("_part", "_rings"))), lambda p: p["_rings"]).alias("_parts"))
    geometry = F.when(F.size("_parts") == 1, F.to_json(F.struct(F.lit("Polygon").alias("type"), F.element_at("_parts", 1).alias("coordinates")))).otherwise(F.to_json(F.struct(F.lit("MultiPolygon").alias("type"), F.col("_parts").alias("coordinates"))))
    values = F.to_json(F.struct(*properties)) if properties else F.lit("{}")
    return whole.select("fid", F.concat(F.lit('{"type":"Feature","id":'), F.col("fid").cast("string"), F.lit(',"properties":'), values, F.lit(',"geometry":'), geometry, F.lit("}")).alias("json"))


def write_geojson(features: DataFrame, path: str, properties: Sequence[str] = ()) -> None:
    """A feature a line."""
    geojson(features, properties).select("json").write.mode("overwrite").text(path)


@dataclass
class Records(InputPartition):
    """Records of a shapefile from `first`, `count` of them."""

    first: int
    count: int


class Shapefile(DataSource):
    """Polygons of .shp, .shx and .dbf files beside each other (options: path, records: how many a partition has).

    Reading needs the index for offsets only; filters on left, bottom, right and top, a record's box, are met before its points
    are decoded. Outer rings run clockwise, as the format has it; what runs the other way is a hole.
    """

    @classmethod
    def name(cls) -> str:
        return "gridloom_shapefile"

    def fields(self) -> list[tuple[str, str, int, int]]:
        """Name, kind, place in the record and width of each attribute."""
        head = ranges.part(self.base() + ".dbf", 0, struct.unpack("<H", ranges.part(self.base() + ".dbf", 8, 2))[0])
        out, at, place = [], 32, 1
        while at < len(head) and head[at] != 0x0D:
            kind, width, decimals = chr(head[at + 11]), head[at + 16], head[at + 17]
            out.append((head[at : at + 11].split(b"\0")[0].decode("latin-1"), "string" if kind not in "NF" else "bigint" if kind == "N" and not decimals else "double", place, width))
            place += width
            at += 32
        return out

    def base(self) -> str:
        return self.options["path"].removesuffix(".shp")

    def schema(self) -> str:
        return f"fid long, part int, hole boolean, left double, bottom double, right double, top double, {RING} {POINTS}" + "".join(f", `{name}` {kind}" for name, kind, _, _ in self.fields())

    def reader(self, schema) -> DataSourceReader:
        return ShapefileReader(self.base(), self.fields(), int(self.options.get("records", "50000")))


class ShapefileReader(DataSourceReader):
    def __init__(self, base: str, fields: list, records: int):
        self.base, self.fields, self.records, self.box = base, fields, records, {}

    def pushFilters(self, filters):
        self.box, _ = ranges.limits(filters, {"left", "bottom", "right", "top"})
        yield from filters  # limits may be wider

    def partitions(self):
        n = (ranges.length(self.base + ".shx") - 100) // 8
        return [Records(i, min(self.records, n - i)) for i in range(0, n, self.records)] or [Records(0, 0)]

    def _passes(self, box: tuple[float, ...]) -> bool:
        return all(low <= v <= high for v, (low, high) in ((box[i], self.box.get(n, (float("-inf"), float("inf")))) for i, n in enumerate(("left", "bottom", "right", "top"))))

    def read(self, partition: Records):
        if not partition.count:
            return
        index = struct.unpack(f">{2 * partition.count}i", ranges.part(self.base + ".shx", 100 + 8 * partition.first, 8 * partition.count))
        first, last = 2 * index[0], 2 * index[-2] + 8 + 2 * index[-1]
        shapes = ranges.part(self.base + ".shp", first, last - first)
        head, size = struct.unpack("<HH", ranges.part(self.base + ".dbf", 8, 4))
        table = ranges.part(self.base + ".dbf", head + partition.first * size, partition.count * size)
        for i in range(partition.count):
            at = 2 * index[2 * i] + 8 - first
            if struct.unpack_from("<i", shapes, at)[0] not in (5, 15, 25):  # polygons, with or without heights and measures
                continue
            box = struct.unpack_from("<4d", shapes, at + 4)
            if table[i * size : i * size + 1] == b"*" or not self._passes(box):
                continue
            parts, points = struct.unpack_from("<2i", shapes, at + 36)
            begins = [*struct.unpack_from(f"<{parts}i", shapes, at + 44), points]
            xy = np.frombuffer(shapes, "<f8", 2 * points, at + 44 + 4 * parts).reshape(-1, 2)
            cells = [_cell(table[i * size + place : i * size + place + width], kind) for _, kind, place, width in self.fields]
            outer = -1
            for a, b in zip(begins, begins[1:], strict=False):
                p = xy[a : b - 1] if b - a > 1 and (xy[a] == xy[b - 1]).all() else xy[a:b]
                q = np.roll(p, -1, 0)
                hole = bool((p[:, 0] * q[:, 1] - q[:, 0] * p[:, 1]).sum() > 0) and outer >= 0
                outer += not hole
                yield (partition.first + i, outer, hole, *box, [(float(x), float(y)) for x, y in p], *cells)


def _cell(raw: bytes, kind: str):
    text = raw.decode("latin-1").strip()
    if kind == "string":
        return text
    return None if not text or set(text) <= {"*"} else int(text) if kind == "bigint" else float(text)


def read_shapefile(spark: SparkSession, path: str, records: int = 50_000) -> DataFrame:
    """A shapefile's polygons; filters on boxes reach the records. Sets spark.sql.python.filterPushdown.enabled in the session."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Shapefile)
    return spark.read.format("gridloom_shapefile").option("path", path).option("records", str(records)).load()


def layer_fields(features: DataFrame) -> list[tuple[str, str]]:
    """Names and types of a layer's attributes."""
    return [(n, t) for n, t in features.dtypes if n not in ("fid", "part", "hole", RING, "left", "bottom", "right", "top")]


def in_system(features: DataFrame, epsg: int, to: int) -> DataFrame:
    """features with their rings in another system (4326, or UTM: 326zz and 327zz)."""

    def moved(p: Column) -> Column:
        x, y = from_degrees(*to_degrees(p["x"], p["y"], epsg), to)
        return F.struct(x.alias("x"), y.alias("y"))

    return features.withColumn(RING, F.transform(RING, moved))


def import_rois(features: DataFrame, macroclass: Column, class_id: Column, macroclass_name: Column | None = None, class_name: Column | None = None, epsg: int | None = None, to: int | None = None) -> DataFrame:
    """Regions of interest: fid, part, hole, ring, macroclass_id, class_id and their names; values are columns or literals.

    Rings without an area are left out; with epsg and to, rings are moved from one system to the other.
    """
    moved = in_system(features, epsg, to) if epsg and to and epsg != to else features
    part = F.col("part") if "part" in features.columns else F.lit(0)
    hole = F.col("hole") if "hole" in features.columns else F.lit(False)
    named = lambda name, number, text: F.coalesce(name if name is not None else F.lit(None).cast("string"), F.concat(F.lit(text), number.cast("string")))
    rows = moved.where((F.size(RING) > 2) & (ring_area(F.col(RING)) != 0))
    return rows.select("fid", part.alias("part"), hole.alias("hole"), RING, macroclass.cast("int").alias("macroclass_id"), class_id.cast("int").alias("class_id"), named(macroclass_name, macroclass, "macroclass_").alias("macroclass_name"), named(class_name, class_id, "class_").alias("class_name"))
