"""Band sets and catalogs of them: small tables of metadata, and the wide pixel tables that they name."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from ..operators.preprocess import date_from_path
from .expressions import SPECTRAL_RANGES

BAND_SCHEMA = T.StructType(
    [T.StructField(n, t) for n, t in (
        ("band_number", T.IntegerType()), ("raster_band", T.IntegerType()), ("path", T.StringType()), ("name", T.StringType()), ("wavelength", T.DoubleType()),
        ("wavelength_unit", T.StringType()), ("additive_factor", T.DoubleType()), ("multiplicative_factor", T.DoubleType()), ("date", T.DateType()),
        ("left", T.DoubleType()), ("top", T.DoubleType()), ("right", T.DoubleType()), ("bottom", T.DoubleType()), ("nodata", T.DoubleType()), ("crs", T.StringType()),
    )]
)
# fixed values: endings of band names and centre wavelengths in micrometres, by sensor
SENSORS = {
    "ASTER": [("01", 0.56), ("02", 0.66), ("3N", 0.81), ("04", 1.65), ("05", 2.165), ("06", 2.205), ("07", 2.26), ("08", 2.33), ("09", 2.395), ("10", 8.3), ("11", 8.65), ("12", 9.1), ("13", 10.6), ("14", 11.3)],
    "GeoEye-1": [("01", 0.48), ("02", 0.545), ("03", 0.6725), ("04", 0.85)],
    "GOES": [("01", 0.47), ("02", 0.64), ("03", 0.87), ("04", 1.38), ("05", 1.61), ("06", 2.25)],
    "Landsat 1-3": [("4", 0.55), ("5", 0.65), ("6", 0.75), ("7", 0.95)],
    "Landsat 4-5": [("1", 0.485), ("2", 0.56), ("3", 0.66), ("4", 0.83), ("5", 1.65), ("7", 2.215)],
    "Landsat 7": [("1", 0.485), ("2", 0.56), ("3", 0.66), ("4", 0.835), ("5", 1.65), ("7", 2.22)],
    "Landsat 8-9": [("1", 0.44), ("2", 0.48), ("3", 0.56), ("4", 0.655), ("5", 0.865), ("6", 1.61), ("7", 2.2)],
    "MODIS": [("03", 0.469), ("04", 0.555), ("01", 0.645), ("02", 0.858), ("05", 1.24), ("06", 1.64), ("07", 2.13)],
    "Pleiades": [("01", 0.49), ("02", 0.56), ("03", 0.65), ("04", 0.84)],
    "QuickBird": [("01", 0.4875), ("02", 0.543), ("03", 0.65), ("04", 0.8165)],
    "RapidEye": [("01", 0.475), ("02", 0.555), ("03", 0.6575), ("04", 0.71), ("05", 0.805)],
    "Sentinel-2": [("01", 0.443), ("02", 0.49), ("03", 0.56), ("04", 0.665), ("05", 0.705), ("06", 0.74), ("07", 0.783), ("08", 0.842), ("8A", 0.865), ("09", 0.945), ("10", 1.375), ("11", 1.61), ("12", 2.19)],
    "SPOT 4-5": [("01", 0.545), ("02", 0.645), ("03", 0.835), ("04", 1.665)],
    "SPOT 6": [("01", 0.485), ("02", 0.56), ("03", 0.66), ("04", 0.825)],
    "WorldView-2-3": [("01", 0.425), ("02", 0.48), ("03", 0.545), ("04", 0.605), ("05", 0.66), ("06", 0.725), ("07", 0.8325), ("08", 0.95)],
}
_UNITS = {"micrometre": 1.0, "um": 1.0, "nanometre": 1000.0, "nm": 1000.0}


def renumber(bands: DataFrame, *order: str) -> DataFrame:
    """band_number 1.. in the given order; a band table has a few rows, so its one window is no burden."""
    return bands.withColumn("band_number", F.row_number().over(Window.orderBy(*order)).cast("int"))


def sort_by_wavelength(bands: DataFrame) -> DataFrame:
    return renumber(bands, "wavelength", "band_number")


def sort_by_name(bands: DataFrame) -> DataFrame:
    return renumber(bands, "name", "band_number")


def insert_band(bands: DataFrame, row: DataFrame, number: int) -> DataFrame:
    """row as band `number`; the ones from there on move up."""
    moved = bands.withColumn("band_number", F.col("band_number") + (F.col("band_number") >= number).cast("int"))
    return moved.unionByName(row.withColumn("band_number", F.lit(number)), allowMissingColumns=True)


def remove_band(bands: DataFrame, number: int) -> DataFrame:
    return bands.where(F.col("band_number") != number).withColumn("band_number", F.col("band_number") - (F.col("band_number") > number).cast("int"))


def move_band(bands: DataFrame, number: int, to: int) -> DataFrame:
    row = bands.where(F.col("band_number") == number)
    return insert_band(remove_band(bands, number), row, to)


def nearest_band(bands: DataFrame, wavelength: float, threshold: float | None = None) -> DataFrame:
    """The band of nearest wavelength, if strictly within the threshold; ties: the first."""
    gap = F.abs(F.col("wavelength") - wavelength)
    near = bands.where(F.col("wavelength").isNotNull()).orderBy(gap, "band_number").limit(1)
    return near if threshold is None else near.where(gap < threshold)


def bands_where(bands: DataFrame, **attributes) -> DataFrame:
    """Bands with the given attributes; a list stands for any of its values."""
    out = bands
    for name, value in attributes.items():
        out = out.where(F.col(name).isin(list(value)) if isinstance(value, (list, tuple)) else F.col(name).eqNullSafe(F.lit(value)))
    return out


def set_attribute(bands: DataFrame, name: str, value, number: int | None = None) -> DataFrame:
    """An attribute of all bands, or of one."""
    new = F.lit(value).cast(dict(bands.dtypes)[name])
    return bands.withColumn(name, new if number is None else F.when(F.col("band_number") == number, new).otherwise(F.col(name)))


def spectral_bands(bands: DataFrame, unit: str = "micrometre") -> DataFrame:
    """range, band_number: of each spectral range the nearest band within its reach; none: null."""
    scale = _UNITS.get(unit, 0.0)
    each = F.array(*(F.struct(F.lit(k).alias("range"), F.abs(F.col("wavelength") - c * scale).alias("gap"), F.lit(d * scale).alias("reach")) for k, (c, d) in SPECTRAL_RANGES.items()))
    near = bands.where(F.col("wavelength").isNotNull()).select("band_number", F.explode(each).alias("x")).where("x.gap < x.reach")
    best = near.groupBy("x.range").agg(F.min_by("band_number", F.struct("x.gap", "band_number")).alias("band_number"))
    ranges = bands.sparkSession.createDataFrame([(k,) for k in SPECTRAL_RANGES], "range string")
    return ranges.join(F.broadcast(best), "range", "left")  # a row a range


def sensor_bands(bands: DataFrame, sensor: str) -> DataFrame:
    """Wavelengths by the sensor's band names, where a band's name ends in one."""
    table = bands.sparkSession.createDataFrame([(n, w) for n, w in SENSORS[sensor]], "_n string, _w double")
    return bands.drop("wavelength").join(F.broadcast(table), F.upper(F.col("name")).endswith(F.upper("_n")), "left").withColumnRenamed("_w", "wavelength").drop("_n")


@dataclass
class BandSet:
    """Bands in order and the wide table of their pixels (r, c and a column a band, in the bands' order).

    pixel and origin say where the grid lies: a pixel's size, and x and y of its upper left corner.
    """

    bands: DataFrame
    pixels: DataFrame
    name: str = "bandset"
    date: str | None = None
    pixel: tuple[float, float] = (1.0, 1.0)
    origin: tuple[float, float] = (0.0, 0.0)

    @classmethod
    def create(cls, pixels: DataFrame, wavelengths: Sequence[float] | None = None, unit: str = "micrometre", name: str = "bandset", date: str | None = None, nodata: float | None = None, paths: Sequence[str] | None = None, pixel: tuple[float, float] = (1.0, 1.0), origin: tuple[float, float] = (0.0, 0.0)) -> BandSet:
        """Bands of a pixel table, sorted by wavelength; date "auto": from the first path."""
        spark: SparkSession = pixels.sparkSession
        names = [c for c in pixels.columns if c not in ("r", "c")]
        waves = list(wavelengths or range(1, len(names) + 1))
        rows = [(i + 1, 1, paths[i] if paths else None, n, float(w), unit, 0.0, 1.0, None, None, None, None, None, nodata, None) for i, (n, w) in enumerate(zip(names, waves, strict=True))]
        bands = spark.createDataFrame(rows, BAND_SCHEMA)
        if date == "auto" and paths:
            date = str(spark.range(1).select(date_from_path(F.lit(paths[0]))).first()[0])
        if date:
            bands = bands.withColumn("date", F.lit(date).cast("date"))
        order = sorted(zip(waves, names, strict=True), key=lambda x: x[0])
        out = cls(sort_by_wavelength(bands), pixels.select("r", "c", *(n for _, n in order)), name, date, pixel, origin)
        out._waves, out._nodata = ([float(w) for w, _ in order], unit), nodata  # known here: no need to ask the table
        return out

    @property
    def names(self) -> list[str]:
        return [c for c in self.pixels.columns if c not in ("r", "c")]

    def ranges(self) -> dict[str, int]:
        """Band numbers by spectral range, as spectral_bands has them."""
        if not hasattr(self, "_ranges") and hasattr(self, "_waves"):
            waves, unit = self._waves
            scale = _UNITS.get(unit, 0.0)
            near = {k: min((abs(w - c * scale), i) for i, w in enumerate(waves, 1)) for k, (c, _) in SPECTRAL_RANGES.items()} if waves else {}
            self._ranges = {k: near[k][1] if k in near and near[k][0] < d * scale else None for k, (_, d) in SPECTRAL_RANGES.items()}
        if not hasattr(self, "_ranges"):
            unit = self.bands.select("wavelength_unit").first()
            self._ranges = {r["range"]: r.band_number for r in spectral_bands(self.bands, unit[0] if unit else "micrometre").collect()}  # six rows
        return self._ranges

    def column(self, ref: str) -> str | list[str] | None:
        """Columns of "b2", "b*", a band's name, or a spectral range such as "#RED#"."""
        if m := re.fullmatch(r"b(\d+)", ref, re.I):
            return self.names[int(m[1]) - 1]
        if re.fullmatch(r"b\*", ref, re.I):
            return list(self.names)
        if (m := re.fullmatch(r"#(\w+)#", ref)) and m[1].upper() in SPECTRAL_RANGES:
            number = self.ranges().get(m[1].upper())
            if number is None:
                raise ValueError(f"no band in {ref}")
            return self.names[number - 1]
        return next((n for n in self.names if n.lower() == ref.lower()), None)

    def execute(self, operator, *args, **kwargs):
        """An operator over this set's pixels."""
        return operator(self.pixels, *args, **kwargs)


@dataclass
class Catalog:
    """Numbered band sets; `wide` is the table of all that an expression names, on one grid."""

    sets: list[BandSet] = field(default_factory=list)
    current: int = 1

    def add(self, s: BandSet, number: int | None = None) -> None:
        self.sets.insert(len(self.sets) if number is None else number - 1, s)

    def remove(self, number: int) -> None:
        self.sets.pop(number - 1)

    def move(self, number: int, to: int) -> None:
        self.sets.insert(to - 1, self.sets.pop(number - 1))

    def reset(self) -> None:
        self.sets, self.current = [], 1

    def bbox(self) -> DataFrame:
        """top, bottom, left and right of all sets' pixels."""
        each = [s.pixels.agg(F.min("r").alias("top"), F.max("r").alias("bottom"), F.min("c").alias("left"), F.max("c").alias("right")) for s in self.sets]
        out = each[0]
        for x in each[1:]:
            out = out.union(x)
        return out.agg(F.min("top").alias("top"), F.max("bottom").alias("bottom"), F.min("left").alias("left"), F.max("right").alias("right"))

    def sort_by_date(self) -> None:
        self.sets.sort(key=lambda s: s.date or "")

    def by_name(self, name: str) -> list[int]:
        return [i for i, s in enumerate(self.sets, 1) if s.name == name]

    def named(self, part: str) -> list[int]:
        """Sets whose first band's name has this part, in any case."""
        return [i for i, s in enumerate(self.sets, 1) if part.lower() in s.names[0].lower()]

    def by_dates(self, ranges: Sequence[tuple[str, str]]) -> list[int]:
        return [i for i, s in enumerate(self.sets, 1) if s.date and any(a <= s.date <= b for a, b in ranges)]

    def numbers(self, spec: str) -> list[int]:
        """Sets of "1", "1,3", "1:3", "2021-01-01", "2021-01-01:2021-02-01", "*" and lists of these."""
        out: list[int] = []
        for part in spec.split(","):
            a, _, b = part.strip().partition(":")
            if a == "*":
                out += range(1, len(self.sets) + 1)
            elif re.fullmatch(r"\d{4}-\d\d-\d\d", a):
                out += self.by_dates([(a, b or a)])
            else:
                out += range(int(a), int(b or a) + 1)
        return list(dict.fromkeys(out))

    def columns(self, ref: str, band: str | None = None):
        """Names in `wide` of a reference: bandset1b2, bandset#b*, bandset{1:3}b1, bandset*b1, or one of the current set."""
        if ref == "#BAND#" and band:
            return band
        if m := re.fullmatch(r"bandset(#|\*|\d+|\{[^}]*\})b(\d+|\*)", ref, re.I):
            many = m[1] == "*" or m[1].startswith("{")
            sets = self.numbers(m[1].strip("{}")) if m[1] != "#" else [self.current]
            out = []
            for k in sets:
                got = self.sets[k - 1].column(f"b{m[2]}")
                out += [f"s{k}_{n}" for n in (got if isinstance(got, list) else [got])]
            return out if many or m[2] == "*" else out[0]
        got = self.sets[self.current - 1].column(ref)
        if got is None:
            raise ValueError(f"no band {ref}")
        return [f"s{self.current}_{n}" for n in got] if isinstance(got, list) else f"s{self.current}_{got}"

    def grid(self, sets: Sequence[int], align: int | None = None, resolution: tuple[float, float] | None = None) -> tuple[tuple[float, float], tuple[float, float]]:
        """Pixel size and origin for several sets: those of set `align`, else of the first one; resolution: another pixel size."""
        own = self.sets[(align or sets[0]) - 1]
        return (resolution or own.pixel), own.origin

    def wide(self, sets: Sequence[int] | None = None, union: bool = False, grid: tuple | None = None, method: str = "nearest_neighbour") -> DataFrame:
        """r, c and s<number>_<band> of the sets, of pixels in all of them (union: in any).

        grid: pixel size and origin of the result; sets on other grids are resampled onto it (see raster.resample_to).
        """
        from ..operators.raster import resample_to

        numbers = list(sets or range(1, len(self.sets) + 1))
        pixel, origin = grid or self.grid(numbers)
        down = lambda place: (place[0], -place[1])
        kinds = {f"s{k}_{n}": t for k in numbers for n, t in self.sets[k - 1].pixels.dtypes if n not in ("r", "c")}
        out = None
        for k in numbers:  # one grouping by position, however many sets meet
            s = self.sets[k - 1]
            moved = s.pixels if (s.pixel, s.origin) == (pixel, origin) else resample_to(s.pixels, s.names, method, s.pixel, pixel, down(s.origin), down(origin))
            own = {f"s{k}_{n}": F.col(n) for n in s.names}
            one = moved.select("r", "c", *(own.get(n, F.lit(None).cast(t)).alias(n) for n, t in kinds.items()))
            out = one if out is None else out.unionByName(one)
        if len(numbers) == 1:
            return out
        got = out.groupBy("r", "c").agg(F.count("*").alias("_sets"), *(F.max(n).alias(n) for n in kinds))
        return (got if union else got.where(F.col("_sets") == len(numbers))).drop("_sets")

    def used(self, lines: Sequence[tuple[str, str]]) -> list[int]:
        """Sets that a program's lines name, in their order."""
        made, found = set(), set()
        for text, name in lines:
            for ref in re.findall(r'"([^"]+)"', text):
                if ref.lower() in made:
                    continue
                try:
                    got = ref if re.match(r"s\d+_", ref) else self.columns(ref)
                except ValueError:  # an index, which is of the current set
                    got = f"s{self.current}_"
                found |= {int(re.match(r"s(\d+)_", n)[1]) for n in ([got] if isinstance(got, str) else got)}
            made.add(name.lower())
        return sorted(found) or [self.current]


def program(text: str, catalog: Catalog) -> list[tuple[str, str]]:
    """(expression, output name) of a program's lines; loops are written out, # starts a comment line.

    A line is `expression`, or `expression @name`; lines without a name are output1, output2, .. A line
    `forbandsets[1:3]part` (or dates, or a comma list) repeats the lines up to the next blank one for each of the sets whose
    first band's name has the part, with bandset# as that set; `forbandsinbandset[1]` for each band, as "#BAND#".
    """
    out: list[tuple[str, str]] = []
    loop: list[tuple[int, str | None]] = [(catalog.current, None)]
    for raw in [*text.splitlines(), ""]:
        line = raw.strip()
        if not line:
            loop = [(catalog.current, None)]
        elif re.match(r"#(?!\w+#)", line):
            continue
        elif m := re.match(r"forbandsets\[([^\]]*)\](.*)", line, re.I):
            sets = catalog.numbers(m[1])
            loop = [(k, None) for k in sets if not m[2].strip() or k in catalog.named(m[2].strip())]
        elif m := re.match(r"forbandsinbandset\[([^\]]*)\](.*)", line, re.I):
            loop = [(k, f"s{k}_{n}") for k in catalog.numbers(m[1]) for n in catalog.sets[k - 1].names if m[2].strip().lower() in n.lower()]
        else:
            body, _, name = line.partition("@")
            for k, band in loop:
                many = len(loop) > 1
                own = (name.strip() or f"output{len(out) + 1}") + (f"_{k}" if many and name and not band else f"_{band}" if many and name else "")
                own = own.replace("#BANDSET#", str(k)).replace("#DATE#", catalog.sets[k - 1].date or "")
                text_k = re.sub(r'"bandset#b', f'"bandset{k}b', body.strip(), flags=re.I)
                text_k = text_k.replace('"#BAND#"', f'"{band}"') if band else text_k
                out.append((text_k, own))
    return out


def run_program(text: str, catalog: Catalog, union: bool = False, mask: str = "all", align: int | None = None, resolution: tuple[float, float] | None = None, extent: tuple[float, float, float, float] | None = None, method: str = "nearest_neighbour", prune: bool = False) -> DataFrame:
    """r, c and the outputs of a program over a catalog (see `program`). prune: sets that it doesn't name don't count.

    Sets on other grids than the result's (that of set `align`, else of the first one; `resolution`: another pixel size)
    are resampled by `method`. extent: left, top, right and bottom; pixels whose middles lie beyond are left out.
    """
    from ..operators.raster import band_calc

    lines = program(text, catalog)
    sets = catalog.used(lines) if prune else list(range(1, len(catalog.sets) + 1))
    (w, h), (x0, y0) = grid = catalog.grid(sets, align, resolution)
    wide = catalog.wide(sets, union, grid, method)
    if extent:
        left, top, right, bottom = extent
        x, y = F.lit(x0) + (F.col("c") + 0.5) * w, F.lit(y0) - (F.col("r") + 0.5) * h
        wide = wide.where(x.between(left, right) & y.between(bottom, top))

    def resolve(ref: str):
        return ref if ref in wide.columns else catalog.columns(ref)

    nodata = {}
    for k, s in enumerate(catalog.sets if "nodata" in text.lower() else [], 1):
        for r in s.bands.select("band_number", "nodata").collect():  # a row a band
            nodata[f"bandset{k}b{r.band_number}"] = r.nodata
    return band_calc(wide, lines, resolve, mask, nodata)
