"""Vector files and GeoTIFF: round trips, ranges of records, and windows that read only their tiles."""

import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.operators import polygons as pg, spectral as sp, vector as ve
from gridloom.sources import geotiff as gt, vectors as vs

SQUARE, HOLE, FAR = [(0.0, 0.0), (4.0, 0.0), (4.0, -4.0), (0.0, -4.0)], [(1.0, -1.0), (1.0, -2.0), (2.0, -2.0)], [(10.0, -10.0), (12.0, -10.0), (11.0, -12.0)]
KIND = "fid long, part int, hole boolean, ring array<struct<x:double,y:double>>, name string, k int"


@pytest.fixture(scope="module")
def layer(spark):
    return spark.createDataFrame([(1, 0, False, SQUARE, 'a "b"', 3), (1, 0, True, HOLE, 'a "b"', 3), (1, 1, False, FAR, 'a "b"', 3), (2, 0, False, FAR, None, 5)], KIND)


def shape(rows):
    return sorted((r.fid, r.part, r.hole, tuple((p.x, p.y) for p in r.ring), r["name"], r.k if r.k is None else int(r.k)) for r in rows)


def test_geojson_round_trip(spark, layer, tmp_path):
    path = str(tmp_path / "g")
    vs.write_geojson(layer, path, ["name", "k"])
    assert shape(vs.read_geojson(spark, path, ["name", "k"]).collect()) == shape(layer.collect())
    one = tmp_path / "one.json"
    lines = [r.json for r in vs.geojson(layer, ["name", "k"]).collect()]
    one.write_text('{"type": "FeatureCollection", "features": [\n' + ",\n".join(lines) + "\n]}")
    for whole in (False, True):
        assert shape(vs.read_geojson(spark, str(one), ["name", "k"], whole).collect()) == shape(layer.collect())
    one.write_text('{"type":"Feature","properties":null,"geometry":{"type":"Point","coordinates":[1,2]}}\n{"type":"Feature","properties":{},"geometry":null}\nrubbish\n')
    assert vs.read_geojson(spark, str(one)).count() == 0


def write_shapefile(base, shapes, rows):
    """shapes: lists of rings (outer ones clockwise); rows: (name, number)."""
    shp, shx, at = b"", b"", 100
    for rings in shapes:
        closed = [r + r[:1] for r in rings]
        points = [p for r in closed for p in r]
        x, y = zip(*points, strict=True)
        parts = np.cumsum([0, *(len(r) for r in closed[:-1])])
        body = struct.pack("<i4d2i", 5, min(x), min(y), max(x), max(y), len(rings), len(points)) + struct.pack(f"<{len(rings)}i", *parts) + b"".join(struct.pack("<2d", *p) for p in points)
        number = len(shx) // 8 + 1
        shp += struct.pack(">2i", number, len(body) // 2) + body
        shx += struct.pack(">2i", at // 2, len(body) // 2)
        at += 8 + len(body)
    head = lambda n: struct.pack(">7i", 9994, 0, 0, 0, 0, 0, (100 + n) // 2) + struct.pack("<2i8d", 1000, 5, *[0.0] * 8)
    for ext, data in ((".shp", shp), (".shx", shx)):
        base.with_suffix(ext).write_bytes(head(len(data)) + data)
    fields = [(b"name", b"C", 10, 0), (b"k", b"N", 6, 0)]
    dbf = struct.pack("<B3BIHH20x", 3, 1, 1, 1, len(rows), 32 + 32 * len(fields) + 1, 17)
    dbf += b"".join(n.ljust(11, b"\0") + t + b"\0" * 4 + bytes([w, d]) + b"\0" * 14 for n, t, w, d in fields) + b"\r"
    dbf += b"".join(b" " + (n or "").encode().ljust(10) + ("" if k is None else str(k)).rjust(6).encode() for n, k in rows)
    base.with_suffix(".dbf").write_bytes(dbf)


def test_shapefile(spark, tmp_path):
    base = tmp_path / "layer.shp"
    moved = lambda ring, i: [(x + 20 * i, y) for x, y in ring]
    shapes = [[moved(SQUARE, i), moved(HOLE, i), moved(FAR, i)] for i in range(25)]
    write_shapefile(base, shapes, [(f"n{i}", None if i == 3 else i) for i in range(25)])
    df = vs.read_shapefile(spark, str(base), records=4)
    assert df.rdd.getNumPartitions() == 7 and df.count() == 75
    got = df.where("fid = 2").collect()
    assert [(r.part, r.hole, r["name"], r.k) for r in got] == [(0, False, "n2", 2), (0, True, "n2", 2), (1, False, "n2", 2)]
    assert [(p.x, p.y) for p in got[1].ring] == moved(HOLE, 2) and (got[0].left, got[0].top) == (40.0, 0.0)
    assert {r.fid for r in df.where("left >= 100 AND right <= 160").collect()} == {5, 6, 7}
    assert vs.layer_fields(df) == [("name", "string"), ("k", "bigint")]
    assert {r.fid: r.k for r in df.collect()}[3] is None
    reader = vs.Shapefile({"path": str(base)}).reader(None)
    from pyspark.sql.datasource import GreaterThanOrEqual

    list(reader.pushFilters([GreaterThanOrEqual(("left",), 440.0)]))
    assert len(list(reader.read(vs.Records(0, 25)))) == 9  # the other records' points aren't decoded


def test_classify_from_imported_rois(spark, tmp_path):
    px = spark.range(400).selectExpr("CAST(id div 20 AS INT) AS r", "CAST(id % 20 AS INT) AS c").withColumns({"a": F.col("r") * 1.0, "b": F.col("c") * 1.0})
    base = tmp_path / "rois.shp"
    box = lambda l, t, r, b: [(l, t), (r, t), (r, b), (l, b)]  # noqa: E731, E741
    write_shapefile(base, [[box(0.0, 0.0, 5.0, -5.0)], [box(15.0, -15.0, 20.0, -20.0)]], [("low", 1), ("high", 2)])
    rois = vs.import_rois(vs.read_shapefile(spark, str(base)), F.lit(7), F.col("k"), class_name=F.col("name"))
    assert {(r.macroclass_id, r.class_id, r.class_name, r.macroclass_name) for r in rois.collect()} == {(7, 1, "low", "macroclass_7"), (7, 2, "high", "macroclass_7")}
    sig = sp.signatures(ve.pixels_in_polygons(px, rois), "class_id", ["a", "b"])
    assert {r.class_id: (r.pixels, r.mean_a) for r in sig.collect()} == {1: (25, 2.0), 2: (25, 17.0)}
    out = sp.classify(px, sig.selectExpr("class_id", "mean_a AS a", "mean_b AS b"), "class_id", ["a", "b"], "md")
    assert {(r.r, r.c): r["class"] for r in out.where("r = c").collect()} == {(i, i): 1 if i < 10 else 2 for i in range(20)}
    utm = vs.in_system(spark.createDataFrame([(1, [(9.0, 47.0), (9.1, 47.0), (9.1, 47.1)])], "fid int, ring array<struct<x:double,y:double>>"), 4326, 32632)
    assert 4.1e7 < abs(utm.select(pg.ring_area(F.col("ring"))).first()[0]) < 4.4e7


def write_tiff(path, x, tile=16, deflate=True, nodata=None, strips=None):
    """x: rows, columns, bands (float32)."""
    h, w, n = x.shape
    pieces = []
    if strips:
        blocks = [x[i : i + strips] for i in range(0, h, strips)]
    else:
        pad = np.zeros((-(-h // tile) * tile, -(-w // tile) * tile, n), x.dtype)
        pad[:h, :w] = x
        blocks = [pad[i : i + tile, j : j + tile] for i in range(0, len(pad), tile) for j in range(0, pad.shape[1], tile)]
    for b in blocks:
        raw = np.ascontiguousarray(b).tobytes()
        pieces.append(zlib.compress(raw) if deflate else raw)
    at, offsets = 8, []
    for p in pieces:
        offsets.append(at)
        at += len(p)
    tags = {256: ("I", [w]), 257: ("I", [h]), 258: ("H", [x.dtype.itemsize * 8] * n), 259: ("H", [8 if deflate else 1]), 262: ("H", [1]), 277: ("H", [n]), 284: ("H", [1]), 339: ("H", [3 if x.dtype.kind == "f" else 1] * n), 33550: ("d", [30.0, 30.0, 0.0]), 33922: ("d", [0.0, 0.0, 0.0, 500000.0, 5200000.0, 0.0]), 34735: ("H", [1, 1, 0, 1, 3072, 0, 1, 32632])}
    tags |= {278: ("I", [strips]), 273: ("I", offsets), 279: ("I", [len(p) for p in pieces])} if strips else {322: ("I", [tile]), 323: ("I", [tile]), 324: ("I", offsets), 325: ("I", [len(p) for p in pieces])}
    if nodata is not None:
        tags[42113] = ("c", [bytes([b]) for b in f"{nodata}\0".encode()])
    codes = {"I": 4, "H": 3, "d": 12, "c": 2}
    entries, extra, place = b"", b"", at + 2 + 12 * len(tags) + 4
    for tag in sorted(tags):
        form, values = tags[tag]
        data = struct.pack(f"<{len(values)}{form}", *values)
        inline = data.ljust(4, b"\0") if len(data) <= 4 else struct.pack("<I", place + len(extra))
        entries += struct.pack("<HHI", tag, codes[form], len(values)) + inline
        extra += data if len(data) > 4 else b""
    path.write_bytes(b"II" + struct.pack("<HI", 42, at) + b"".join(pieces) + struct.pack("<H", len(tags)) + entries + b"\0" * 4 + extra)


@pytest.mark.parametrize("options", [{}, {"deflate": False}, {"strips": 7}])
def test_geotiff(spark, tmp_path, options):
    rng = np.random.default_rng(1)
    x = rng.integers(0, 50, (70, 90, 2)).astype(np.float32)
    path = tmp_path / "x.tif"
    write_tiff(path, x, nodata=7, **options)
    df = gt.read_geotiff(spark, str(path), tiles=2)
    got = np.full(x.shape, -1.0)
    for r in df.collect():
        got[r.r, r.c] = [7 if v is None else v for v in (r.b1, r.b2)]
    assert (got == x).all() and df.where("b1 IS NULL").count() == (x[:, :, 0] == 7).sum()
    assert gt.header(str(path)).grid() == gt.Grid(32632, (500000.0, 5200000.0), (30.0, 30.0))


def test_geotiff_window_reads_its_tiles(spark, tmp_path):
    x = np.arange(128 * 160, dtype=np.float32).reshape(128, 160, 1)
    path = tmp_path / "x.tif"
    write_tiff(path, x)
    df = gt.read_geotiff(spark, f"file://{path}", (20, 33, 40, 50), tiles=1)
    assert df.count() == 21 * 18 and df.agg(F.min("b1")).first()[0] == 20 * 160 + 33
    assert df.rdd.getNumPartitions() == 2 * 2 and gt.read_geotiff(spark, str(path), tiles=1).rdd.getNumPartitions() == 80
    assert gt.read_geotiff(spark, str(path), (500, 0, 600, 10)).count() == 0
    path.write_bytes(b"no such file")
    with pytest.raises(ValueError, match="no plain TIFF"):
        gt.header(str(path))
