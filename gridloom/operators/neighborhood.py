"""Focal operators: statistics over a moving window, dilation, erosion, patches, sieve and region growing.

Windows are worked out tile by tile (tiles.py), so every pixel is shuffled about once however large the window is. Cells
beyond the grid don't count (partial windows at borders).
"""

from __future__ import annotations

import heapq
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import cut, small
from .components import components
from .rings import stitched
from .tiles import TILE, dilated, eroded, offsets, tiled, window_stat


def structure_offsets(matrix: Sequence[Sequence[float | None]]) -> list[tuple[int, int, float]]:
    """Offsets of a custom structuring element around its middle; None and NaN are not part of it."""
    h, w = len(matrix) // 2, len(matrix[0]) // 2
    return [(i - h, j - w, float(v)) for i, row in enumerate(matrix) for j, v in enumerate(row) if v is not None and v == v]


def _reach(where: Sequence[tuple[int, int, float]]) -> int:
    return max(max(abs(i), abs(j)) for i, j, _ in where)


def neighbor_stat(df: DataFrame, band: str, stat: str, size: int = 1, circular: bool = False, structure: Sequence | None = None, percentile: float = 50) -> DataFrame:
    """r, c and value: Count, Max, Mean, Median, Min, Percentile, StdDev (population) or Sum over each pixel's window.

    NoData is skipped; a pixel that is NoData itself has none. Mean, Sum and Count are rounded to 6 decimals.
    """
    where, stat = structure_offsets(structure) if structure else offsets(size, circular), stat.lower()
    if stat not in ("count", "max", "mean", "median", "min", "percentile", "stddev", "sum"):
        raise ValueError(f"unknown statistic {stat}")
    out = tiled(df, band, _reach(where), window_stat(stat, where, percentile / 100))
    return out.withColumn("value", F.round("value", 6)) if stat in ("mean", "sum", "count") else out


def neighbor_apply(df: DataFrame, band: str, kernel, size: int = 1) -> DataFrame:
    """r, c and value of a kernel of one's own, kernel(values, present), over tiles with a halo of `size` (see tiles.tiled)."""
    return tiled(df, band, size, kernel)


def dilation(df: DataFrame, band: str, values: Sequence, size: int = 1, circular: bool = False) -> DataFrame:
    """Pixels not of the listed values take the one that their window has; of several the later in the list."""
    where = offsets(size, circular)
    return tiled(df, band, _reach(where), dilated(list(values), where)).withColumn("value", F.col("value").cast(dict(df.dtypes)[band]))


def erosion(df: DataFrame, band: str, values: Sequence, size: int = 1, circular: bool = False) -> DataFrame:
    """`size` passes: a listed pixel with a neighbor of another value takes the commonest unlisted neighbor value.

    Neighbors: 8, or 4 if circular. Ties go to the smaller value; no unlisted valid neighbor: NoData. All passes are done
    within a tile, whose halo is as wide as there are passes.
    """
    where = [(i, j, 1.0) for i, j, _ in offsets(1) if not circular or i == 0 or j == 0]
    return tiled(df, band, size, eroded(list(values), where, size)).withColumn("value", F.col("value").cast(dict(df.dtypes)[band]))


def _runs(code: np.ndarray, eight: bool) -> tuple[np.ndarray, np.ndarray]:
    """Of a tile (numbers of values, -1: none) each cell's run of equal cells in its row, and of each run the first one joined with it."""
    new = code >= 0
    new[:, 1:] &= code[:, 1:] != code[:, :-1]
    run = np.cumsum(new.ravel()).reshape(code.shape) - 1
    pairs = []
    for step in (0, 1, -1) if eight else (0,):
        up, down = (slice(max(0, -step), code.shape[1] - max(0, step)), slice(max(0, step), code.shape[1] - max(0, -step)))
        same = (code[:-1, up] == code[1:, down]) & (code[:-1, up] >= 0)
        pairs.append(np.stack([run[:-1, up][same], run[1:, down][same]]))
    a, b = np.unique(np.concatenate(pairs, 1), axis=1)
    root = np.arange(run[-1, -1] + 1)
    while True:
        low = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, before[a], low)
        np.minimum.at(root, before[b], low)
        while (root != root[root]).any():
            root = root[root]
        if (root == before).all():
            return run, root


def _labelled(df: DataFrame, band: str, width: int, eight: bool) -> tuple[DataFrame, DataFrame]:
    """r, c, value, run of the pixels (written), and run, patch: of each run of a tile that others continue, the patch.

    A tile's pixels are joined up within it; only pixels at borders of tiles are compared with others, so links are few: what
    meets at a patch's key is its parts in tiles, not its pixels. A run, and a patch, is named by its first pixel.
    """
    kind = dict(df.dtypes)[band]
    sent = df.where(F.col(band).isNotNull()).select("r", "c", F.col(band).alias("value"), F.floor(F.col("r") / TILE).alias("i"), F.floor(F.col("c") / TILE).alias("j"))

    def join_up(key, table):
        i, j = (k.as_py() * TILE for k in key)
        r, c = (np.asarray(table.column(n)).astype(np.int64) for n in "rc")
        value = table.column("value").combine_chunks()
        code = np.full((TILE, TILE), -1)
        code[r - i, c - j] = np.asarray(value.dictionary_encode().indices)
        run, root = _runs(code, eight)
        first = np.full(len(root), -1)
        own = run[r - i, c - j]
        order = np.lexsort((c, r))[::-1]
        first[own[order]] = (r * width + c)[order]
        return pa.table({"r": pa.array(r.astype(np.int32)), "c": pa.array(c.astype(np.int32)), "value": value, "run": pa.array(first[root[own]])})

    own = cut(sent.groupBy("i", "j").applyInArrow(join_up, f"r int, c int, value {kind}, run long"), "runs")
    tile = lambda r, c: (F.floor(r / TILE), F.floor(c / TILE))
    steps = [(1, 0), (0, 1), *([(1, 1), (1, -1)] if eight else [])]
    moved = own.select("value", F.col("run").alias("a"), *(x.alias(n) for x, n in zip(tile(F.col("r"), F.col("c")), "ij", strict=True)), F.explode(F.array(*(F.struct((F.col("r") + i).alias("r"), (F.col("c") + j).alias("c")) for i, j in steps))).alias("p")).select("value", "a", "i", "j", "p.*")
    ti, tj = tile(F.col("r"), F.col("c"))
    moved = moved.where((ti != F.col("i")) | (tj != F.col("j"))).drop("i", "j")
    edge = (F.pmod("r", F.lit(TILE)) == 0) | F.pmod("c", F.lit(TILE)).isin(0, TILE - 1)
    links = moved.join(own.where(edge).select("r", "c", "value", F.col("run").alias("b")), ["r", "c", "value"]).select("a", "b").distinct()
    return own, cut(components(links).toDF("run", "patch"), "patches")


def patches(df: DataFrame, band: str, width: int, eight: bool = False) -> DataFrame:
    """r, c, value, patch: connected pixels of equal value share a patch id, r * width + c of their first pixel.

    width: a number above every column, for ids; a position stands once. See _labelled.
    """
    own, named = _labelled(df, band, width, eight)
    return own.join(small(named), "run", "left").select("r", "c", "value", F.coalesce("patch", "run").alias("patch"))


def label(df: DataFrame, band: str, width: int) -> DataFrame:
    """r, c, value: the number of pixels of each foreground pixel's 4-connected patch (foreground: not 0, not NoData)."""
    own, named = _labelled(df.where(F.col(band) != 0).select("r", "c", F.lit(1).alias("f")), "f", width, False)
    parts = own.groupBy("run").agg(F.count("*").alias("n")).join(small(named), "run", "left").withColumn("patch", F.coalesce("patch", "run"))
    parts = cut(parts, "parts")
    sizes = parts.groupBy("patch").agg(F.sum("n").alias("value"))
    return own.select("r", "c", "run").join(small(parts.join(small(sizes), "patch").select("run", "value")), "run").select("r", "c", "value")


def sieve(df: DataFrame, band: str, size: int, width: int, eight: bool = False) -> DataFrame:
    """Pixels of patches smaller than `size` take the value of the largest patch beside theirs (ties: the smaller value)."""
    own = cut(patches(df, band, width, eight), "patches")
    sizes = cut(own.groupBy("patch").agg(F.count("*").alias("n"), F.first("value").alias("v")), "sizes")
    sides = [(0, 1), (1, 0), *([(1, 1), (1, -1)] if eight else [])]
    moved = own.select("patch", F.explode(F.array(*(F.struct((F.col("r") + i).alias("r"), (F.col("c") + j).alias("c")) for i, j in sides))).alias("p")).select(F.col("p.r").alias("r"), F.col("p.c").alias("c"), F.col("patch").alias("a"))
    beside = moved.join(own.select("r", "c", F.col("patch").alias("b")), ["r", "c"]).where("a <> b").select("a", "b").distinct()
    beside = beside.union(beside.select("b", "a")).distinct()
    small = sizes.where(F.col("n") < size).select(F.col("patch").alias("a"))
    best = beside.join(small, "a").join(sizes.toDF("b", "n", "v"), "b").groupBy("a").agg(F.max_by("v", F.struct("n", -F.col("v"))).alias("to"))
    return own.join(best.withColumnRenamed("a", "patch"), "patch", "left").select("r", "c", F.coalesce("to", "value").alias("value"))


def region_stats(df: DataFrame, band: str, width: int) -> DataFrame:
    """Regions of equal value (4-connected): id, value, pixels and their box; what a polygonisation has by feature."""
    own = patches(df, band, width)
    return own.groupBy(F.col("patch").alias("region")).agg(F.first("value").alias("value"), F.count("*").alias("pixels"), F.min("r").alias("top"), F.max("r").alias("bottom"), F.min("c").alias("left"), F.max("c").alias("right"))


def region_edges(df: DataFrame, band: str, width: int) -> DataFrame:
    """Unit edges of the regions' borders: region, value, r, c, side (N, E, S, W). Their rings are the regions' polygons."""
    own = patches(df, band, width)
    steps = {"N": (-1, 0), "E": (0, 1), "S": (1, 0), "W": (0, -1)}
    each = own.select("r", "c", "value", "patch", F.explode(F.array(*(F.struct(F.lit(s).alias("side"), (F.col("r") + i).alias("nr"), (F.col("c") + j).alias("nc")) for s, (i, j) in steps.items()))).alias("e")).select("r", "c", "value", "patch", "e.*")
    other = own.select(F.col("r").alias("nr"), F.col("c").alias("nc"), F.col("patch").alias("beside"))
    return each.join(other, ["nr", "nc"], "left").where("beside IS NULL OR beside <> patch").select(F.col("patch").alias("region"), "value", "r", "c", "side")


def _least_steps(gap: np.ndarray, start: tuple[int, int]) -> np.ndarray:
    """For each cell the least value that every path to it from the start has to bear (4-connected); NaN cells bar the way."""
    out = np.full(gap.shape, np.inf)
    todo = [(gap[start], *start)]
    while todo:
        d, i, j = heapq.heappop(todo)
        if d >= out[i, j]:
            continue
        out[i, j] = d
        for y, x in ((i + 1, j), (i - 1, j), (i, j + 1), (i, j - 1)):
            if 0 <= y < gap.shape[0] and 0 <= x < gap.shape[1] and gap[y, x] == gap[y, x] and out[y, x] == np.inf:
                heapq.heappush(todo, (max(d, gap[y, x]), y, x))
    return out


def grow_regions(df: DataFrame, bands: Sequence[str], seeds: DataFrame, distance: float, minimum: int, max_width: int = 100) -> DataFrame:
    """id, r, c: the region of every seed (id, r, c), of which there may be any number.

    In each band the pixels connected to the seed whose values differ from its by no more than d: `distance`, or the least
    difference beyond it with which they are `minimum` pixels (all that connect, if they never are). What is left of a seed's
    region is connected to it and in those of all bands. A region lies within max_width pixels; each box is a task's group.
    NoData belongs to no region; a seed that has NoData in a band, or lies beyond the raster, has none.
    """
    half, kind = max_width // 2, dict(seeds.dtypes)["id"]
    near = lambda x: F.sequence(F.floor((F.col(x) - half) / max_width), F.floor((F.col(x) + half) / max_width))
    at = seeds.select("id", F.col("r").alias("sr"), F.col("c").alias("sc"), F.explode(near("r")).alias("i")).join(seeds.select("id", F.explode(near("c")).alias("j")), "id")
    own = df.select("r", "c", *(F.col(b).cast("double").alias(f"v{k}") for k, b in enumerate(bands)), F.floor(F.col("r") / max_width).alias("i"), F.floor(F.col("c") / max_width).alias("j"))
    boxes = own.join(small(at), ["i", "j"]).where((F.abs(F.col("r") - F.col("sr")) <= half) & (F.abs(F.col("c") - F.col("sc")) <= half))

    def grow(key, table):
        r, c = (np.asarray(table.column(n)).astype(np.int64) for n in "rc")
        sr, sc = (int(table.column(n)[0].as_py()) for n in ("sr", "sc"))
        inside = np.ones((2 * half + 1, 2 * half + 1))
        for k in range(len(bands)):
            gap = np.full(inside.shape, np.nan)
            gap[r - sr + half, c - sc + half] = table.column(f"v{k}").to_numpy()
            gap = np.abs(gap - gap[half, half])
            if np.isnan(gap[half, half]):
                inside[:] = np.nan
                break
            steps = _least_steps(gap, (half, half))
            reached = np.sort(steps[np.isfinite(steps)])
            limit = max(distance, reached[max(min(minimum, len(reached)), 1) - 1])
            inside[~(steps <= limit)] = np.nan
        if np.isnan(inside[half, half]):
            y = x = np.zeros(0, np.int64)
        else:
            y, x = np.nonzero(np.isfinite(_least_steps(inside, (half, half))))
        return pa.table({"id": pa.array([key[0].as_py()] * len(y), key[0].type), "r": pa.array((y + sr - half).astype(np.int32)), "c": pa.array((x + sc - half).astype(np.int32))})

    return boxes.groupBy("id").applyInArrow(grow, f"id {kind}, r int, c int")


def region_rings(edges: DataFrame) -> DataFrame:
    """region, value, ring (array of x, y; x right, y down) and area of each ring that bounds a region: holes are negative.

    edges: region, value, r, c, side (region_edges). A tile's edges are followed within it, the region on their right; what
    leaves a tile goes on as the piece of another one, and pieces are stitched by list ranking (rings.stitched).
    """
    kinds = dict(edges.dtypes)
    number = F.when(F.col("side") == "N", 0).when(F.col("side") == "E", 1).when(F.col("side") == "S", 2).otherwise(3)
    at = lambda n: F.sequence(F.floor((F.col(n) - 1) / TILE), F.floor((F.col(n) + 1) / TILE))
    sent = edges.select("region", "value", "r", "c", number.cast("int").alias("side"), F.explode(at("r")).alias("i")).withColumn("j", F.explode(at("c")))
    point = pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())]))
    ahead = np.array([(0, 1), (1, 0), (0, -1), (-1, 0)])  # the way along a side N, E, S, W of a pixel, as (row, column)
    begin = np.array([(0, 0), (0, 1), (1, 1), (1, 0)])  # and the corner where it begins

    def follow(key, table):
        i, j = (k.as_py() * TILE - 1 for k in key)
        r, c, side = (np.asarray(table.column(n)).astype(np.int64) for n in ("r", "c", "side"))
        wide = TILE + 2
        place = np.full((wide + 2, wide + 2, 4), -1)  # edge by pixel and side, with a border of none
        place[r - i + 1, c - j + 1, side] = np.arange(len(r))
        y, x = r - i + 1, c - j + 1
        step, out = ahead[side], -ahead[(side + 1) % 4]  # out: away from the pixel
        right = place[y, x, (side + 1) % 4]
        on = place[y + step[:, 0], x + step[:, 1], side]
        left = place[y + step[:, 0] + out[:, 0], x + step[:, 1] + out[:, 1], (side + 3) % 4]
        after = np.where(right >= 0, right, np.where(on >= 0, on, left))
        own = (y > 1) & (y <= TILE + 1) & (x > 1) & (x <= TILE + 1)
        ids = (r << 34) + (c << 2) + side
        before = np.full(len(r), -1)
        known = np.flatnonzero((after >= 0) & (own | own[after]))
        before[after[known]] = known
        todo = np.flatnonzero(own)
        starts = [e for e in todo.tolist() if before[e] < 0 or not own[before[e]]]
        seen = np.zeros(len(r), bool)
        rows = {n: [] for n in ("piece", "next", "at", "path", "cross", "length")}
        by = [(rr + begin[s][0], cc + begin[s][1]) for rr, cc, s in zip(r.tolist(), c.tolist(), side.tolist(), strict=True)]
        afters, owns, sides, befores = after.tolist(), own.tolist(), side.tolist(), before.tolist()
        for start in [*starts, *todo.tolist()]:  # what starts nowhere are whole rings
            if seen[start]:
                continue
            e, path, cross, n = start, [], 0, 0
            while True:
                seen[e] = True
                if sides[befores[e]] != sides[e]:
                    path.append({"x": float(by[e][1]), "y": float(by[e][0])})
                y1, x1 = by[e]
                y2, x2 = y1 + int(ahead[sides[e]][0]), x1 + int(ahead[sides[e]][1])
                cross += x1 * y2 - x2 * y1
                n += 1
                e = afters[e]
                if e == start or not owns[e]:
                    break
            for name, v in zip(rows, (int(ids[start]), int(ids[e]), start, path, float(cross), float(n)), strict=True):
                rows[name].append(v)
        pick = pa.array(rows["at"], pa.int64())
        cols = {n: table.column(n).combine_chunks().take(pick) for n in ("region", "value")}
        return pa.table({"piece": pa.array(rows["piece"], pa.int64()), "next": pa.array(rows["next"], pa.int64()), **cols, "path": pa.array(rows["path"], point), "cross": pa.array(rows["cross"], pa.float64()), "length": pa.array(rows["length"], pa.float64())})

    pieces = sent.groupBy("i", "j").applyInArrow(follow, f"piece long, next long, region {kinds['region']}, value {kinds['value']}, path array<struct<x:double,y:double>>, cross double, length double")
    rings = stitched(pieces.select("piece", "next", F.struct("region", "value").alias("key"), "path", "cross", "length"))
    return rings.select("ring_key.region", "ring_key.value", F.col("path").alias("ring"), "area")


def dissolve(edges: DataFrame) -> DataFrame:
    """Border length by value over all its regions."""
    return edges.groupBy("value").agg(F.countDistinct("region").alias("regions"), F.count("*").alias("border"))


def region_growing(df: DataFrame, band: str, seed: tuple[int, int], distance: float, minimum: int, width: int, max_width: int = 100) -> DataFrame:
    """r, c of the pixels connected to the seed whose values differ from its by at most d, for the least d that gives
    `minimum` pixels, tried in tenths of `distance` up to it. Only a box of max_width around the seed is read."""
    half = max_width // 2
    box = cut(df.where(F.col("r").between(seed[0] - half, seed[0] + half) & F.col("c").between(seed[1] - half, seed[1] + half)).select("r", "c", F.col(band).alias("v")), "box")
    at = box.where((F.col("r") == seed[0]) & (F.col("c") == seed[1])).first()
    if at is None or at.v is None:
        return box.where("false").select("r", "c")
    for step in range(1, 11):
        near = box.where(F.abs(F.col("v") - at.v) <= distance * step / 10).select("r", "c", F.lit(1).alias("f"))
        own = cut(patches(near, "f", width), "region")
        mine = own.where((F.col("r") == seed[0]) & (F.col("c") == seed[1])).select("patch")
        region = own.join(F.broadcast(mine), "patch").select("r", "c")
        if step == 10 or region.count() >= minimum:
            return region
