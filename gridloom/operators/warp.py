"""Rasters in another coordinate system: tiles of the new grid ask for the old tiles that lie under them.

A tile of the new grid works out where its pixels' middles lie in the old one, and names the old tiles that its kernel reads
there. Old pixels are packed into tiles once and go to the new tiles that asked, where the kernel samples them: no pixel is
joined with a pixel. Averages go the other way, as each old pixel adds to the new one that its middle lies in.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..functions.projection import from_degrees, to_degrees
from .polygons import bounds
from .raster import block_values
from .tiles import TILE

#: Old pixels around a place that each kernel reads, from its floor: first and last.
REACH = {"nearest_neighbour": (0, 0), "bilinear": (0, 1), "cubic": (-1, 2)}


@dataclass(frozen=True)
class Grid:
    """Where a raster lies: an EPSG code (4326, or UTM: 326zz and 327zz), the upper left corner, and a pixel's size."""

    epsg: int
    origin: tuple[float, float]
    pixel: tuple[float, float]

    def place(self, r, c):
        """x and y of (fractional) rows and columns."""
        return self.origin[0] + c * self.pixel[0], self.origin[1] - r * self.pixel[1]

    def cell(self, x, y):
        """Fractional row and column of x and y."""
        return (self.origin[1] - y) / self.pixel[1], (x - self.origin[0]) / self.pixel[0]


def moved(source: Grid, target: Grid, r, c, m=np):
    """Fractional row and column in target of those in source; m: numpy, or Spark's functions."""
    return target.cell(*from_degrees(*to_degrees(*source.place(r, c), source.epsg, m), target.epsg, m))


def grid_for(box: tuple[int, int, int, int], source: Grid, epsg: int, pixel: tuple[float, float] | None = None) -> tuple[Grid, int, int]:
    """A grid of another system over the pixels of `box` (top, bottom, left, right), its rows and columns.

    Its corner and size come from the box's border; pixels keep about the size of the middle one if none is given.
    """
    top, bottom, left, right = box
    rows, columns = np.linspace(top, bottom + 1, 65), np.linspace(left, right + 1, 65)
    r = np.concatenate([rows, rows, np.full(65, top), np.full(65, bottom + 1)])
    c = np.concatenate([np.full(65, left), np.full(65, right + 1), columns, columns])
    unit = Grid(epsg, (0.0, 0.0), (1.0, 1.0))
    y, x = moved(source, unit, r, c)
    if pixel is None:
        my, mx = np.array([(top + bottom) / 2, (top + bottom) / 2 + 1, (top + bottom) / 2]), np.array([(left + right) / 2, (left + right) / 2, (left + right) / 2 + 1])
        v, u = moved(source, unit, my, mx)
        pixel = (math.hypot(u[2] - u[0], v[2] - v[0]), math.hypot(u[1] - u[0], v[1] - v[0]))
    out = Grid(epsg, (float(x.min()), float(-y.min())), pixel)
    return out, math.ceil((y.max() - y.min()) / pixel[1]), math.ceil((x.max() - x.min()) / pixel[0])


def _weights(method: str, t: np.ndarray) -> list[np.ndarray]:
    """Weights of the pixels that a kernel reads, t (0 to 1) beyond the floor. cubic: Catmull and Rom's."""
    if method == "nearest_neighbour":
        return [np.ones_like(t)]
    if method == "bilinear":
        return [1 - t, t]
    return [((-t + 2) * t - 1) * t / 2, ((3 * t - 5) * t * t + 2) / 2, ((-3 * t + 4) * t + 1) * t / 2, (t - 1) * t * t / 2]


def reproject(df: DataFrame, bands: Sequence[str], source: Grid, target: Grid, rows: int, columns: int, method: str = "nearest_neighbour", tile: int = TILE) -> DataFrame:
    """r, c and the bands (double) of the pixels of target (rows by columns) that lie on one of df's.

    nearest_neighbour takes the old pixel that holds a new one's middle; bilinear and cubic weigh the pixels around it, NoData
    and what lies beyond the raster left out (a pixel that is NoData itself stays so). average, sum, maximum, minimum, mode,
    median and the quartiles are over the old pixels whose middles lie in the new one. A position stands once in df.
    """
    spark = df.sparkSession
    if method not in REACH:
        r, c = moved(source, target, F.col("r") + 0.5, F.col("c") + 0.5, F)
        at = df.select(F.floor(r).cast("int").alias("r"), F.floor(c).cast("int").alias("c"), *(F.col(b).cast("double").alias(b) for b in bands))
        return block_values(at.where(F.col("r").between(0, rows - 1) & F.col("c").between(0, columns - 1)), method, list(bands))
    box = bounds(df)
    if box is None:
        return df.select("r", "c", *(F.col(b).cast("double").alias(b) for b in bands))
    shift = 0.0 if method == "nearest_neighbour" else 0.5  # kernels weigh pixels' middles
    low, high = REACH[method]
    # so many old pixels lie under a new one; a new tile is to lie on a few old ones
    y, x = moved(target, source, np.array([rows / 2, rows / 2 + 1, rows / 2]), np.array([columns / 2, columns / 2, columns / 2 + 1]))
    wide = max(math.hypot(y[1] - y[0], x[1] - x[0]), math.hypot(y[2] - y[0], x[2] - x[0]), 1.0)
    side = max(8, int(tile / wide)) if math.isfinite(wide) else tile
    down, across = -(-rows // side), -(-columns // side)

    def places(i: int, j: int):
        """Rows and columns of a new tile, and where their middles lie in the old grid."""
        r, c = np.mgrid[i * side : min(rows, (i + 1) * side), j * side : min(columns, (j + 1) * side)].reshape(2, -1)
        y, x = moved(target, source, r + 0.5, c + 0.5)
        known = np.isfinite(y) & np.isfinite(x)
        known[known] = (y[known] >= box[0]) & (y[known] < box[1] + 1) & (x[known] >= box[2]) & (x[known] < box[3] + 1)
        return r[known], c[known], y[known], x[known]

    def ask(batches):
        for batch in batches:
            for number in batch.column("id").to_pylist():
                i, j = divmod(number, across)
                _, _, y, x = places(i, j)
                wanted = {(a, b) for u in (low, high) for v in (low, high) for a, b in set(zip((np.floor(y - shift + u) // tile).astype(int).tolist(), (np.floor(x - shift + v) // tile).astype(int).tolist(), strict=True))}
                rows = list(zip(*sorted(wanted), strict=True)) or [(), ()]
                yield pa.RecordBatch.from_arrays([pa.array([i] * len(wanted), pa.int32()), pa.array([j] * len(wanted), pa.int32()), *(pa.array(v, pa.int32()) for v in rows)], names=["i", "j", "si", "sj"])

    def pack(key, table):
        i, j = (k.as_py() * tile for k in key)
        r, c = (np.asarray(table.column(n)).astype(np.int64) for n in "rc")
        out = np.full((len(bands) + 1, tile, tile), np.nan)
        for k, b in enumerate(bands):
            out[k, r - i, c - j] = table.column(b).to_numpy()
        out[-1, r - i, c - j] = 1.0
        return pa.table({"si": pa.array([key[0].as_py()], pa.int32()), "sj": pa.array([key[1].as_py()], pa.int32()), "data": pa.array([out.tobytes()], pa.binary())})

    def sample(key, table):
        r, c, y, x = places(*(k.as_py() for k in key))
        si, sj = (np.asarray(table.column(n)).astype(np.int64) for n in ("si", "sj"))
        top, left = si.min(), sj.min()
        held = np.full((len(bands) + 1, (si.max() - top + 1) * tile, (sj.max() - left + 1) * tile), np.nan)
        for a, b, data in zip(si - top, sj - left, table.column("data"), strict=True):
            held[:, a * tile : (a + 1) * tile, b * tile : (b + 1) * tile] = np.frombuffer(data.as_py()).reshape(-1, tile, tile)

        def at(row, column):
            row, column = row - top * tile, column - left * tile
            ok = (row >= 0) & (row < held.shape[1]) & (column >= 0) & (column < held.shape[2])
            return np.where(ok, held[:, np.where(ok, row, 0), np.where(ok, column, 0)], np.nan)

        own = at(np.floor(y).astype(np.int64), np.floor(x).astype(np.int64))
        y0, x0 = np.floor(y - shift).astype(np.int64), np.floor(x - shift).astype(np.int64)
        wy, wx = _weights(method, y - shift - y0), _weights(method, x - shift - x0)
        total, weight = np.zeros((len(bands), len(r))), np.zeros((len(bands), len(r)))
        for u, p in zip(range(low, high + 1), wy, strict=True):
            for v, q in zip(range(low, high + 1), wx, strict=True):
                value = at(y0 + u, x0 + v)[:-1]
                some = ~np.isnan(value)
                total += np.where(some, value * p * q, 0)
                weight += np.where(some, p * q, 0)
        with np.errstate(invalid="ignore", divide="ignore"):
            value = np.where(np.isnan(own[:-1]), np.nan, total / weight)
        there = np.flatnonzero(own[-1] == 1)
        return pa.table({"r": pa.array(r[there].astype(np.int32)), "c": pa.array(c[there].astype(np.int32)), **{b: pa.array(value[k, there], mask=np.isnan(value[k, there])) for k, b in enumerate(bands)}})

    asked = spark.range(down * across).mapInArrow(ask, "i int, j int, si int, sj int")
    tiles = df.select("r", "c", *(F.col(b).cast("double").alias(b) for b in bands), F.floor(F.col("r") / tile).cast("int").alias("si"), F.floor(F.col("c") / tile).cast("int").alias("sj"))
    tiles = tiles.groupBy("si", "sj").applyInArrow(pack, "si int, sj int, data binary")
    return asked.join(tiles, ["si", "sj"]).groupBy("i", "j").applyInArrow(sample, "r int, c int, " + ", ".join(f"`{b}` double" for b in bands))
