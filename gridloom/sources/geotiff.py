"""Plain tiled (or striped) GeoTIFF files as tables of pixels, by tiles: a window reads only the tiles that it meets."""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..operators.warp import Grid
from . import ranges

# fixed values: tags of the format, sizes of its field types, and what sample formats and bits are in numpy
WIDTH, HEIGHT, BITS, COMPRESSION, OFFSETS, SAMPLES, ROWS, COUNTS, PLANAR, PREDICTOR = 256, 257, 258, 259, 273, 277, 278, 279, 284, 317
TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_COUNTS, FORMAT, SCALE, TIE, KEYS, NODATA = 322, 323, 324, 325, 339, 33550, 33922, 34735, 42113
_TYPES = {1: "B", 2: "c", 3: "H", 4: "I", 5: "II", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d", 16: "Q", 17: "q"}
_KINDS = {1: "u", 2: "i", 3: "f"}
_GEOGRAPHIC, _PROJECTED = 2048, 3072


@dataclass
class Header:
    """What the first directory of a file says."""

    tags: dict[int, tuple]
    order: str

    @property
    def shape(self) -> tuple[int, int]:
        return self.tags[HEIGHT][0], self.tags[WIDTH][0]

    @property
    def tile(self) -> tuple[int, int]:
        if TILE_WIDTH in self.tags:
            return self.tags[TILE_HEIGHT][0], self.tags[TILE_WIDTH][0]
        return self.tags.get(ROWS, self.tags[HEIGHT])[0], self.tags[WIDTH][0]

    @property
    def bands(self) -> int:
        return self.tags.get(SAMPLES, (1,))[0]

    @property
    def kind(self) -> np.dtype:
        return np.dtype(f"{self.order}{_KINDS[self.tags.get(FORMAT, (1,))[0]]}{self.tags[BITS][0] // 8}")

    @property
    def pieces(self) -> list[tuple[int, int]]:
        tiled = TILE_OFFSETS in self.tags
        return list(zip(self.tags[TILE_OFFSETS if tiled else OFFSETS], self.tags[TILE_COUNTS if tiled else COUNTS], strict=True))

    @property
    def nodata(self) -> float | None:
        return float(b"".join(self.tags[NODATA]).rstrip(b"\0 ")) if NODATA in self.tags else None

    def grid(self) -> Grid | None:
        """Where the raster lies, if its file says so by a corner and a pixel's size, in WGS 84 or one of its UTM zones."""
        if SCALE not in self.tags or TIE not in self.tags or KEYS not in self.tags:
            return None
        keys = self.tags[KEYS]
        codes = {keys[i]: keys[i + 3] for i in range(4, len(keys), 4) if keys[i + 1] == 0}
        (w, h), tie = self.tags[SCALE][:2], self.tags[TIE]
        return Grid(codes.get(_PROJECTED) or codes.get(_GEOGRAPHIC, 4326), (tie[3] - tie[0] * w, tie[4] + tie[1] * h), (w, h))


def header(path: str) -> Header:
    with ranges.opened(path) as f:
        order = {b"II": "<", b"MM": ">"}.get(f.read_at(2, 0))
        magic, at = struct.unpack(f"{order or '<'}HI", f.read_at(6, 2))
        if not order or magic != 42:
            raise ValueError(f"{path} is no plain TIFF file")
        (n,) = struct.unpack(f"{order}H", f.read_at(2, at))
        tags = {}
        for i in range(n):
            tag, kind, count = struct.unpack(f"{order}HHI", f.read_at(8, at + 2 + 12 * i))
            if kind not in _TYPES:
                continue
            form = f"{order}{count * len(_TYPES[kind])}{_TYPES[kind][0]}"
            size = struct.calcsize(form)
            place = at + 2 + 12 * i + 8 if size <= 4 else struct.unpack(f"{order}I", f.read_at(4, at + 2 + 12 * i + 8))[0]
            tags[tag] = struct.unpack(form, f.read_at(size, place))
    out = Header(tags, order)
    if tags.get(COMPRESSION, (1,))[0] not in (1, 8, 32946) or tags.get(PREDICTOR, (1,))[0] not in (1, 2):
        raise ValueError(f"{path}: only uncompressed and deflated files are read")
    return out


@dataclass
class Tiles(InputPartition):
    """Tiles of one row of tiles, from `first` to before `last`."""

    row: int
    first: int
    last: int


class GeoTiff(DataSource):
    """Columns r, c and b1, b2, .. (double; NoData is null). Options: path; tiles: how many a partition has at most."""

    @classmethod
    def name(cls) -> str:
        return "gridloom_geotiff"

    def schema(self) -> str:
        return "r int, c int, " + ", ".join(f"b{i + 1} double" for i in range(header(self.options["path"]).bands))

    def reader(self, schema) -> DataSourceReader:
        return GeoTiffReader(self.options["path"], int(self.options.get("tiles", "16")))


class GeoTiffReader(DataSourceReader):
    def __init__(self, path: str, tiles: int):
        self.path, self.tiles, self.window = path, tiles, {}

    def pushFilters(self, filters):
        self.window, _ = ranges.limits(filters, {"r", "c"})
        yield from filters

    def _between(self, name: str, size: int, of: int) -> range:
        """Numbers of the tiles that the window meets, along rows or columns."""
        low, high = self.window.get(name, (float("-inf"), float("inf")))
        low, high = max(0, low), min(of - 1, high)
        return range(int(low) // size, int(high) // size + 1) if low <= high else range(0)

    def partitions(self):
        head = header(self.path)
        (h, w), (height, width) = head.tile, head.shape
        columns = self._between("c", w, width)
        return [Tiles(i, j, min(j + self.tiles, columns.stop)) for i in self._between("r", h, height) for j in range(columns.start, columns.stop, self.tiles)] or [Tiles(0, 0, 0)]

    def read(self, partition: Tiles):
        head = header(self.path)
        (h, w), (height, width), n, kind = head.tile, head.shape, head.bands, head.kind
        across = -(-width // w)
        apart = head.tags.get(PLANAR, (1,))[0] == 2  # bands one after the other
        down = -(-height // h)
        deflated, predicted, pieces = head.tags.get(COMPRESSION, (1,))[0] != 1, head.tags.get(PREDICTOR, (1,))[0] == 2, head.pieces
        with ranges.opened(self.path) as f:

            def piece(number: int, samples: int) -> np.ndarray:
                at, size = pieces[number]
                raw = f.read_at(size, at) if size else b""
                x = np.frombuffer(zlib.decompress(raw) if deflated and raw else raw, kind)
                x = x[: len(x) // (w * samples) * w * samples].reshape(-1, w, samples)
                return np.cumsum(x, axis=1, dtype=x.dtype) if predicted else x

            for j in range(partition.first, partition.last):
                i = partition.row
                at = i * across + j
                x = np.concatenate([piece(k * down * across + at, 1) for k in range(n)], 2) if apart else piece(at, n)
                x = x[: min(h, height - i * h), : min(w, width - j * w)].astype(np.float64)
                if x.size == 0:
                    continue
                r, c = np.mgrid[i * h : i * h + x.shape[0], j * w : j * w + x.shape[1]].reshape(2, -1).astype(np.int32)
                empty = np.isnan(x) if head.nodata is None else np.isnan(x) | (x == head.nodata)
                bands = [pa.array(x[:, :, k].ravel(), mask=empty[:, :, k].ravel()) for k in range(n)]
                yield pa.RecordBatch.from_arrays([pa.array(r), pa.array(c), *bands], names=["r", "c", *(f"b{k + 1}" for k in range(n))])


def read_geotiff(spark: SparkSession, path: str, window: tuple[int, int, int, int] | None = None, tiles: int = 16) -> DataFrame:
    """A GeoTIFF's pixels; window (top, left, bottom, right) is pushed down, so that only its tiles are read.

    Sets spark.sql.python.filterPushdown.enabled in the session.
    """
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(GeoTiff)
    df = spark.read.format("gridloom_geotiff").option("path", path).option("tiles", str(tiles)).load()
    if window:
        top, left, bottom, right = window
        df = df.where(f"r >= {top} AND r <= {bottom} AND c >= {left} AND c <= {right}")
    return df
