"""Reprojection: tiles of any size, kernels on planes, grids made for another system."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.operators import warp

DEG = warp.Grid(4326, (8.5, 47.3), (0.002, 0.002))


@pytest.fixture(scope="module")
def px(spark):
    """A plane over degrees, and a band with holes; rows 40 to 45 missing."""
    df = spark.range(80 * 60).selectExpr("CAST(id div 60 AS INT) AS r", "CAST(id % 60 AS INT) AS c").where("r NOT BETWEEN 40 AND 45")
    return df.withColumns({"v": F.col("r") * 2.0 - F.col("c") * 3.0, "w": F.when(F.pmod(F.col("r") * 7 + F.col("c"), F.lit(11)) != 0, F.col("r") * 100.0 + F.col("c"))})


def as_map(df):
    return {(r.r, r.c): tuple(r)[2:] for r in df.collect()}


@pytest.mark.parametrize("method", ["nearest_neighbour", "bilinear", "cubic"])
def test_tiles_make_no_difference(px, method):
    to, rows, columns = warp.grid_for((0, 79, 0, 59), DEG, 32632, (300.0, 300.0))
    one = as_map(warp.reproject(px, ["v", "w"], DEG, to, rows, columns, method, tile=256))
    many = as_map(warp.reproject(px.repartition(5), ["v", "w"], DEG, to, rows, columns, method, tile=16))
    assert one.keys() == many.keys() and len(one) > 1000
    for k, (v, w) in one.items():
        assert abs(v - many[k][0]) < 1e-9 and (w is None) == (many[k][1] is None) and (w is None or abs(w - many[k][1]) < 1e-9)
    y, x = warp.moved(to, DEG, np.array([k[0] + 0.5 for k in one]), np.array([k[1] + 0.5 for k in one]))
    for (k, (v, w)), a, b in zip(one.items(), y, x, strict=True):
        r, c = int(np.floor(a)), int(np.floor(b))
        if method == "nearest_neighbour":
            assert v == r * 2.0 - c * 3.0 and w == (None if (r * 7 + c) % 11 == 0 else r * 100.0 + c)
        elif all(3 < q < n for q, n in ((a, 36), (b, 56))):  # inside, a plane stays one
            assert abs(v - ((a - 0.5) * 2 - (b - 0.5) * 3)) < 1e-6


def test_same_grid_is_the_same(px):
    for method in ("nearest_neighbour", "bilinear", "average"):
        got, want = as_map(warp.reproject(px, ["v", "w"], DEG, DEG, 80, 60, method)), as_map(px)
        assert got.keys() == want.keys()
        assert all((w is None) == (want[k][1] is None) and abs(v - want[k][0]) < 1e-9 and (w is None or abs(w - want[k][1]) < 1e-9) for k, (v, w) in got.items())


def test_back_and_forth(px):
    utm, rows, columns = warp.grid_for((0, 79, 0, 59), DEG, 32732, (60.0, 60.0))
    there = warp.reproject(px, ["v"], DEG, utm, rows, columns)
    back = as_map(warp.reproject(there, ["v"], utm, DEG, 80, 60, "average"))
    want = as_map(px)
    assert back.keys() <= want.keys() and len(back) > 0.97 * len(want) and all(abs(v[0] - want[k][0]) < 1e-9 for k, v in back.items())
    assert utm.origin[1] > 10_000_000  # the north has its false northing there
    with pytest.raises(ValueError):
        warp.Grid(3857, (0, 0), (1, 1)) and warp.moved(DEG, warp.Grid(3857, (0, 0), (1, 1)), 1.0, 1.0)


def test_nothing(px):
    assert warp.reproject(px.limit(0), ["v"], DEG, DEG, 8, 6).count() == 0
    assert warp.reproject(px, ["v"], DEG, warp.Grid(32632, (0.0, 0.0), (10.0, 10.0)), 20, 20).count() == 0  # elsewhere
