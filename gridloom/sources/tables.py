"""Tables and rasters from files, and back: separated text, dBase, XML metadata, pixel tables."""

from __future__ import annotations

import math
import re
import struct
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.tiles import pyramid
from ..session import collected

# fixed values: bands in the order of the products' metadata
S2_BANDS = ("01", "02", "03", "04", "05", "06", "07", "08", "8A", "09", "10", "11", "12")
INT, FLOAT = r"^\s*[+-]?\d{1,18}\s*$", r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$|^\s*[+-]?(nan|inf)\s*$"


def open_text(spark: SparkSession, path: str, separators: str = "\t,", field_names: Sequence[str] | None = None, header: bool = True) -> DataFrame:
    """Lines split at every one of the separators, without quoting; columns are bigint, else double, else string.

    Without a header fields are field1, ..; field_names replace names by place. Types come from one pass over all lines.
    """
    lines = spark.read.text(path).where(F.trim("value") != "")
    first = lines.first()
    if first is None:
        return spark.createDataFrame([], ", ".join(f"{n} string" for n in field_names or ["field1"]))
    split = re.compile("[" + re.escape(separators) + "]")
    cells = split.split(first.value)
    names = [c.strip() for c in cells] if header else [f"field{i}" for i in range(1, len(cells) + 1)]
    for i, n in enumerate(field_names or []):
        names[i : i + 1] = [n]
    if header:  # a header stands on the first line of each file
        lines = lines.where(F.col("value") != first.value)
    parts = lines.select(F.split("value", split.pattern).alias("p")).select(*(F.get("p", F.lit(i)).alias(n) for i, n in enumerate(names)))
    checks = parts.agg(*(F.min(F.col(n).rlike(p).cast("int")).alias(f"{k}{i}") for i, n in enumerate(names) for k, p in (("i", INT), ("f", FLOAT)))).first()
    kind = ["bigint" if checks[f"i{i}"] == 1 else "double" if checks[f"f{i}"] == 1 else "string" for i in range(len(names))]
    return parts.select(*(F.trim(n).try_cast(k).alias(n) if k != "string" else F.col(n) for n, k in zip(names, kind, strict=True)))


def _dbf_rows(content: bytes) -> tuple[list[tuple[str, str]], list[tuple]]:
    count, head, size = struct.unpack("<IHH", content[4:12])
    fields, at = [], 32
    while content[at] != 0x0D:
        name = content[at : at + 11].split(b"\0")[0].decode("latin-1")
        kind, width, decimals = chr(content[at + 11]), content[at + 16], content[at + 17]
        fields.append((name, kind, width, decimals))
        at += 32
    kinds = [(n, "string" if k not in "NF" else "bigint" if k == "N" and not d else "double") for n, k, w, d in fields]
    rows = []
    for i in range(count):
        record = content[head + i * size : head + (i + 1) * size]
        if record[:1] == b"*":  # deleted
            continue
        row, place = [], 1
        for (_, _, width, _), (_, kind) in zip(fields, kinds, strict=True):
            cell = record[place : place + width].decode("latin-1").strip()
            place += width
            row.append(cell if kind == "string" else None if not cell or set(cell) <= {"*"} else int(cell) if kind == "bigint" else float(cell))
        rows.append(tuple(row))
    return kinds, rows


def open_dbf(spark: SparkSession, path: str) -> DataFrame:
    """dBase III tables: each file is read by one task through Spark's reader, so any store that Spark reads will do."""
    files = spark.read.format("binaryFile").load(path)
    kinds, _ = _dbf_rows(files.select("content").first().content)

    def rows(batches):
        import pyarrow as pa

        types = {"bigint": pa.int64(), "double": pa.float64(), "string": pa.string()}
        for batch in batches:
            for content in batch.column("content"):
                own = _dbf_rows(content.as_py())[1]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in own], types[k]) for i, (_, k) in enumerate(kinds)], names=[n for n, _ in kinds])

    return files.select("content").mapInArrow(rows, ", ".join(f"`{n}` {k}" for n, k in kinds))


def open_table(spark: SparkSession, path: str, **options) -> DataFrame:
    return open_dbf(spark, path) if path.lower().endswith(".dbf") else open_text(spark, path, **options)


def read_metadata(spark: SparkSession, path: str, row_tag: str, fields: dict[str, str]) -> DataFrame:
    """Fields of XML metadata by the names of their elements: one row a file, all as strings (null: not there)."""
    files = spark.read.text(path, wholetext=True)
    find = lambda tag: F.nullif(F.regexp_extract("value", rf"<(?:\w+:)?{re.escape(tag)}(?:\s[^>]*)?>\s*([^<]*?)\s*</", 1), F.lit(""))
    return files.where(F.col("value").contains(f"<{row_tag}") | F.col("value").contains(f":{row_tag}")).select(*(find(t).alias(n) for n, t in fields.items()))


def landsat_products(spark: SparkSession, path: str, bands: Sequence[int]) -> DataFrame:
    """Scale, offset, thermal constants and sun elevation of each band from Landsat metadata."""
    whole = {"spacecraft": "SPACECRAFT_ID", "processing_level": "PROCESSING_LEVEL", "date": "DATE_ACQUIRED", "sun_elevation": "SUN_ELEVATION", "earth_sun_distance": "EARTH_SUN_DISTANCE"}
    each = {f"{n}_{b}": f"{t}_{b}" for b in bands for n, t in (("scale", "REFLECTANCE_MULT_BAND"), ("offset", "REFLECTANCE_ADD_BAND"), ("k1", "K1_CONSTANT_BAND"), ("k2", "K2_CONSTANT_BAND"))}
    row = read_metadata(spark, path, "LANDSAT_METADATA_FILE", whole | each)
    rows = F.array(*(F.struct(F.lit(b).alias("band"), *(F.col(f"{n}_{b}").try_cast("double").alias(n) for n in ("scale", "offset", "k1", "k2"))) for b in bands))
    return row.select("spacecraft", "processing_level", F.col("date").try_cast("date").alias("date"), F.col("sun_elevation").try_cast("double").alias("sun_elevation"), F.col("earth_sun_distance").try_cast("double").alias("earth_sun_distance"), F.explode(rows).alias("b")).select("spacecraft", "processing_level", "date", "sun_elevation", "earth_sun_distance", "b.*")


def sentinel2_products(spark: SparkSession, path: str, bands: Sequence[str] = S2_BANDS) -> DataFrame:
    """product (the file), date, level, band, scale and offset from Sentinel-2 product metadata: a row a product and band.

    scale is one over the quantification value, offset the band's offset (in the metadata's order; none: 0) times scale.
    """
    files = spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_name").alias("product"))
    tag = lambda name: F.nullif(F.regexp_extract("value", rf"<(?:\w+:)?{name}(?:\s[^>]*)?>\s*([^<]*?)\s*</", 1), F.lit(""))
    offsets = lambda name: F.regexp_extract_all("value", F.lit(rf"<(?:\w+:)?{name}(?:\s[^>]*)?>\s*(-?\d+)\s*</"), F.lit(1))
    surface = F.lower(tag("PROCESSING_LEVEL")).contains("2a")
    quantity = F.when(surface, tag("BOA_QUANTIFICATION_VALUE")).otherwise(tag("QUANTIFICATION_VALUE")).try_cast("double")
    own = files.where(tag("PROCESSING_LEVEL").isNotNull()).select("product", F.split(tag("PRODUCT_START_TIME"), "T")[0].try_cast("date").alias("date"), tag("PROCESSING_LEVEL").alias("level"), (1 / quantity).alias("scale"), F.when(surface, offsets("BOA_ADD_OFFSET")).otherwise(offsets("RADIO_ADD_OFFSET")).alias("offsets"))
    each = F.transform(F.array(*map(F.lit, bands)), lambda b, i: F.struct(b.alias("band"), F.coalesce(F.get("offsets", i).try_cast("double"), F.lit(0.0)).alias("o")))
    return own.select("product", "date", "level", "scale", F.explode(each).alias("b")).select("product", "date", "level", F.col("b.band").alias("band"), "scale", (F.col("b.o") * F.col("scale")).alias("offset"))


def structure_of(spark: SparkSession, path: str, separator: str = ",") -> list[list[float | None]]:
    """A structuring element from a text matrix; nan: not part of it."""
    rows = [r.value for r in collected(spark.read.text(path))]
    return [[None if x.strip().lower() == "nan" else float(x) for x in line.split(separator)] for line in rows if line.strip()]


def write_text(df: DataFrame, path: str, fields: Sequence[str] | None = None, decimals: int | dict[str, int] = 2, separator: str = "\t", decimal: str = ".", nodata: float | None = None, nodata_text: str = "nan") -> None:
    """Separated text with fixed decimals for doubles, a decimal mark, and NoData (a number, and nulls) as a text."""
    kinds = dict(df.dtypes)
    out = []
    for f in fields or df.columns:
        if kinds[f] in ("double", "float") or kinds[f].startswith("decimal"):
            n = decimals.get(f, 2) if isinstance(decimals, dict) else decimals
            text = F.translate(F.format_string(f"%.{n}f", F.col(f).cast("double")), ".", decimal)
        else:
            text = F.col(f).cast("string")
        empty = F.col(f).isNull() if nodata is None or kinds[f] == "string" else F.col(f).isNull() | (F.col(f) == nodata)
        out.append(F.when(empty, nodata_text).otherwise(text).alias(f))
    df.select(*out).write.mode("overwrite").option("sep", separator).option("header", True).option("quote", "").csv(path)


def write_raster(df: DataFrame, path: str, nodata: float = -32768, scale: float = 1.0, offset: float = 0.0, kind: str = "float", rows_per_tile: int = 1024) -> None:
    """A pixel table as Parquet by strips of rows: bands unscaled, cast (to whole numbers: the nearest), NoData as its sentinel."""
    bands = [c for c in df.columns if c not in ("r", "c")]
    whole = kind not in ("float", "double")
    stored = {b: F.col(b) / scale - offset / scale for b in bands}
    cells = {b: F.coalesce((F.rint(x) if whole else x).cast(kind), F.lit(nodata).cast(kind)) for b, x in stored.items()}
    df.withColumns(cells).withColumn("tile", F.expr(f"cast(r div {rows_per_tile} as int)")).repartition("tile").sortWithinPartitions("r", "c").write.mode("overwrite").partitionBy("tile").parquet(path)


def read_raster(spark: SparkSession, path: str, nodata: float = -32768, scale: float = 1.0, offset: float = 0.0, window: tuple[int, int, int, int] | None = None, rows_per_tile: int = 1024) -> DataFrame:
    """What write_raster wrote; window (top, left, bottom, right) reads only its strips."""
    df = spark.read.parquet(path)
    if window:
        top, left, bottom, right = window
        df = df.where(F.col("tile").between(top // rows_per_tile, bottom // rows_per_tile) & F.col("r").between(top, bottom) & F.col("c").between(left, right))
    bands = [c for c in df.columns if c not in ("r", "c", "tile")]
    return df.select("r", "c", *(F.when(F.col(b) != nodata, F.col(b).cast("double") * scale + offset).alias(b) for b in bands))


def write_overviews(df: DataFrame, band: str, path: str, levels: int = 5) -> None:
    """A band's pyramid (tiles.pyramid) as Parquet, a folder a level."""
    pyramid(df, band, levels).repartition("level", "r").sortWithinPartitions("r", "c").write.mode("overwrite").partitionBy("level").parquet(path)


def read_overview(spark: SparkSession, path: str, zoom: float, method: str = "average") -> DataFrame:
    """r, c, value of the coarsest level whose blocks are no wider than `zoom` pixels (2 at least); only its folder is read."""
    df = spark.read.parquet(path)
    level = max(1, int(math.log2(max(zoom, 2))))
    return df.where(F.col("level") == level).select("r", "c", F.col(method).alias("value"))
