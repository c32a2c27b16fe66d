"""Kernels over square tiles of a grid with a halo: every pixel moves about once, whatever the window's size.

A pixel goes to its tile and, near a border, to the neighbors whose halo holds it. A tile is a dense array in one task, so
its memory is bounded by the tile's side and the halo.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import cut

#: Side of a tile.
TILE = 256
#: Cells that a ranking kernel sorts at once.
_SORTED = 1 << 22
Offset = tuple[int, int, float]


def offsets(size: int, circular: bool = False) -> list[tuple[int, int, float]]:
    """(dr, dc, weight) of a square of 2 size + 1, or of a disk of radius size."""
    return [(i, j, 1.0) for i in range(-size, size + 1) for j in range(-size, size + 1) if not circular or i * i + j * j <= size * size]


def tiled(df: DataFrame, band: str, halo: int, kernel: Callable[[np.ndarray, np.ndarray], np.ndarray], tile: int = TILE) -> DataFrame:
    """r, c, value (double): kernel(values, present) of each tile with its halo. NaN: NoData or not there; present tells which.

    kernel gives an array of the same shape, NaN for NoData; only the tile's own cells are read from it.
    """

    def of(x: str):
        return F.sequence(F.floor((F.col(x) - halo) / tile).cast("int"), F.floor((F.col(x) + halo) / tile).cast("int"))

    sent = df.select("r", "c", F.col(band).cast("double").alias("v"), F.explode(of("r")).alias("i"), F.col("c").alias("_c")).select("r", "c", "v", "i", F.explode(of("c")).alias("j"))

    def run(key, table):
        i, j = (k.as_py() for k in key)
        r, c = (np.asarray(table.column(n).combine_chunks()).astype(np.int64) for n in "rc")
        v = table.column("v").to_numpy()
        side = tile + 2 * halo
        values, present = np.full((side, side), np.nan), np.zeros((side, side), bool)
        y, x = r - i * tile + halo, c - j * tile + halo
        values[y, x], present[y, x] = v, True
        if present.sum() < len(r):
            raise ValueError("a pixel's position stands twice")
        out = kernel(values, present)
        own = (y >= halo) & (y < halo + tile) & (x >= halo) & (x < halo + tile)
        got = out[y[own], x[own]]
        return pa.table({"r": pa.array(r[own].astype(np.int32)), "c": pa.array(c[own].astype(np.int32)), "value": pa.array(got, mask=np.isnan(got))})

    return sent.groupBy("i", "j").applyInArrow(run, "r int, c int, value double")


def pyramid(df: DataFrame, band: str, levels: int, tile: int = TILE) -> DataFrame:
    """level, r, c, average, maximum, minimum, nearest and valid (pixels) of the blocks of 2^level pixels, for levels 1 to `levels`.

    A pixel moves once for every eight levels: a tile has whole blocks of its levels, each summed up from the level before,
    and the last level is the next pass's grid. nearest is the pixel below and right of the block's middle. Blocks without
    valid pixels are left out; NoData is skipped; positions stand once.
    """
    per, done, out = tile.bit_length() - 1, 0, None
    at = lambda x: F.floor(F.col(x) / tile)
    value = F.col(band).cast("double")
    now = df.select("r", "c", *(value.alias(n) for n in ("s", "hi", "lo", "corner")), value.isNotNull().cast("long").alias("n"))
    while done < levels:
        take = min(per, levels - done)
        own = now.withColumns({"i": at("r"), "j": at("c")}).groupBy("i", "j").applyInArrow(_levels(done + 1, take, tile), "level int, r int, c int, s double, hi double, lo double, corner double, near double, n long")
        if done + take < levels:
            own = cut(own, "levels")
            now = own.where(F.col("level") == done + take).select("r", "c", "s", "hi", "lo", "corner", "n")
        out = own if out is None else out.unionByName(own)
        done += take
    return out.where("n > 0").select("level", "r", "c", (F.col("s") / F.col("n")).alias("average"), F.col("hi").alias("maximum"), F.col("lo").alias("minimum"), F.col("near").alias("nearest"), F.col("n").alias("valid"))


def _levels(first: int, levels: int, tile: int) -> Callable:
    """The function of a tile's pixels (or blocks) that gives its blocks of `levels` more levels; corner: a block's first pixel."""

    def run(key, table):
        i, j = (k.as_py() for k in key)
        r, c = (np.asarray(table.column(n)).astype(np.int64) for n in "rc")
        grids = {n: np.full((tile, tile), 0.0 if n == "n" else np.nan) for n in ("s", "hi", "lo", "corner", "n")}
        for n, g in grids.items():
            g[r - i * tile, c - j * tile] = table.column(n).to_numpy()
        parts = []
        for level in range(1, levels + 1):
            four = {n: np.stack([g[a::2, b::2] for a in (0, 1) for b in (0, 1)]) for n, g in grids.items()}
            grids = {"s": np.nansum(four["s"], 0), "hi": np.fmax.reduce(four["hi"]), "lo": np.fmin.reduce(four["lo"]), "corner": four["corner"][0], "n": four["n"].sum(0)}
            y, x = np.indices(grids["n"].shape).reshape(2, -1) if level == levels else np.nonzero(grids["n"])  # the last one's corners go on
            cells = {"level": np.full(len(y), first + level - 1, np.int32), "r": (y + i * (tile >> level)).astype(np.int32), "c": (x + j * (tile >> level)).astype(np.int32)}
            values = {n: g[y, x] for n, g in (*list(grids.items())[:4], ("near", four["corner"][3]))}
            parts.append(pa.table({**{n: pa.array(v) for n, v in cells.items()}, **{n: pa.array(v, mask=np.isnan(v)) for n, v in values.items()}, "n": pa.array(grids["n"][y, x].astype(np.int64))}))
        return pa.concat_tables(parts)

    return run


def shifted(x: np.ndarray, i: int, j: int, fill) -> np.ndarray:
    """x at (row + i, column + j) of each cell; fill beyond the border."""
    out = np.full_like(x, fill)
    h, w = x.shape
    out[max(0, -i) : h - max(0, i), max(0, -j) : w - max(0, j)] = x[max(0, i) : h - max(0, -i), max(0, j) : w - max(0, -j)]
    return out


def ranked(x: np.ndarray, where: Sequence[Offset], share: float) -> np.ndarray:
    """Linear percentile (share: 0 to 1) of the weighted values in each cell's window."""
    out, rows = np.full_like(x, np.nan), max(1, _SORTED // (len(where) * x.shape[1]))
    for a in range(0, len(x), rows):
        b = min(len(x), a + rows)
        reach = max(abs(i) for i, _, _ in where)
        part = x[max(0, a - reach) : b + reach]
        held = np.stack([(shifted(part, i, j, np.nan) * w)[a - max(0, a - reach) :][: b - a] for i, j, w in where])
        held.sort(axis=0)  # NaN stands last
        n = (~np.isnan(held)).sum(0)
        at = np.maximum(n - 1, 0) * share
        low = np.floor(at).astype(np.int64)
        p, q = (np.take_along_axis(held, k[None], 0)[0] for k in (low, np.minimum(low + 1, np.maximum(n - 1, 0))))
        out[a:b] = p + (q - p) * (at - low)
    return out


def window_stat(stat: str, where: Sequence[Offset], share: float = 0.5) -> Callable:
    """The kernel of a statistic over a window of (row, column, weight) offsets; NoData is skipped and stays NoData."""
    own = [o for o in where if o[2]]

    def total(x: np.ndarray, f=lambda v: v) -> np.ndarray:
        return sum((np.nan_to_num(f(shifted(x, i, j, np.nan) * w)) for i, j, w in own), np.zeros_like(x))

    def kernel(x: np.ndarray, present: np.ndarray) -> np.ndarray:
        n = sum(((~np.isnan(shifted(x, i, j, np.nan))).astype(np.float64) for i, j, _ in own), np.zeros_like(x))
        if stat == "count":
            out = n
        elif stat == "sum":
            out = total(x)
        elif stat in ("max", "min"):
            pick = np.fmax if stat == "max" else np.fmin
            out = np.full_like(x, np.nan)
            for i, j, w in own:
                out = pick(out, shifted(x, i, j, np.nan) * w)
        elif stat in ("median", "percentile"):
            out = ranked(x, own, 0.5 if stat == "median" else share)
        else:
            with np.errstate(invalid="ignore", divide="ignore"):
                mean = total(x) / n
                out = mean if stat == "mean" else np.sqrt(total(x, lambda v: (v - mean) ** 2) / n)
        return np.where(np.isnan(x), np.nan, out)

    return kernel


def dilated(values: Sequence[float], where: Sequence[Offset]) -> Callable:
    """The kernel of a dilation: cells of other values take the listed value in their window, of several the later one."""

    def kernel(x: np.ndarray, present: np.ndarray) -> np.ndarray:
        out, listed = x.copy(), np.isin(x, values)
        for v in values:
            near = np.zeros(x.shape, bool)
            for i, j, _ in where:
                near |= shifted(x == v, i, j, False)
            out[near & ~listed] = v
        return out

    return kernel


def eroded(values: Sequence[float], where: Sequence[Offset], passes: int) -> Callable:
    """The kernel of an erosion in so many passes: listed cells beside another value take the commonest unlisted neighbor."""

    def kernel(x: np.ndarray, present: np.ndarray) -> np.ndarray:
        for _ in range(passes):
            near = [(shifted(x, i, j, np.nan), shifted(present, i, j, False)) for i, j, _ in where]
            odd = sum((p & ~(v == x) for v, p in near), np.zeros(x.shape, int)) > 0
            free = [np.where(np.isin(v, values), np.nan, v) for v, _ in near]
            best, times = np.full_like(x, np.nan), np.zeros(x.shape, int)
            for v in free:
                n = sum((v == u).astype(int) for u in free)
                better = (n > times) | ((n == times) & (v < best))
                best, times = np.where(better, v, best), np.where(better, n, times)
            x = np.where(np.isin(x, values) & odd, best, x)
        return x

    return kernel
