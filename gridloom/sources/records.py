"""Small tables in and out of files: signatures, band sets and products as XML, HTML rows; copies of rasters; probes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .tables import open_text, read_raster, write_raster, write_text

# fixed values: endings of raster and of vector files
RASTERS, VECTORS = ("tif", "tiff", "vrt", "jp2", "img", "hdf", "nc", "asc", "bil"), ("gpkg", "shp", "geojson", "json", "kml", "gml", "fgb")


def path_parts(path: Column) -> dict[str, Column]:
    """folder, file, name (without ending) and ending of a path."""
    file = F.regexp_extract(path, r"([^/\\]*)$", 1)
    return {"folder": F.regexp_extract(path, r"^(.*)[/\\][^/\\]*$", 1), "file": file, "name": F.regexp_replace(file, r"\.[^.]*$", ""), "ending": F.lower(F.regexp_extract(file, r"\.([^.]*)$", 1))}


def kind_of(path: Column) -> Column:
    """raster, vector, or null: what a path's ending says."""
    ending = path_parts(path)["ending"]
    return F.when(ending.isin(*RASTERS), "raster").when(ending.isin(*VECTORS), "vector")


def hex_colour(red: Column, green: Column, blue: Column) -> Column:
    """#rrggbb of three numbers from 0 to 255."""
    return F.lower(F.concat(F.lit("#"), *(F.lpad(F.hex(x.cast("int")), 2, "0") for x in (red, green, blue))))


def colour_parts(colour: Column) -> list[Column]:
    """Red, green and blue of #rrggbb."""
    return [F.conv(F.substring(colour, i, 2), 16, 10).cast("int") for i in (2, 4, 6)]


def write_xml(df: DataFrame, path: str, root: str, row: str) -> None:
    """Rows as elements `row` within `root`; nulls are left out."""
    df.write.mode("overwrite").format("xml").option("rootTag", root).option("rowTag", row).save(path)


def read_xml(spark: SparkSession, path: str, row: str, schema) -> DataFrame:
    """Elements `row` of XML files by a given schema; what an element lacks is null."""
    return spark.read.format("xml").option("rowTag", row).schema(schema).load(path)


def write_signatures(sig: DataFrame, path: str, label: str = "cls") -> None:
    """Signatures (label, wavelength, value, standard_deviation) as separated text."""
    write_text(sig.select(label, "wavelength", "value", "standard_deviation"), path, decimals=12, separator=",")


def read_signatures(spark: SparkSession, path: str) -> DataFrame:
    """What write_signatures wrote, or separated text with the same columns."""
    return open_text(spark, path, ",")


def spectra(sig: DataFrame, label: str, bands: Sequence[str], wavelengths: Sequence[float]) -> DataFrame:
    """label, wavelength, value, standard_deviation of a table of signatures (mean_<band>, std_<band>): a row a band."""
    each = F.array(*(F.struct(F.lit(float(w)).alias("wavelength"), F.col(f"mean_{b}").alias("value"), F.col(f"std_{b}").alias("standard_deviation")) for b, w in zip(bands, wavelengths, strict=True)))
    return sig.select(label, F.explode(each).alias("x")).select(label, "x.*")


def from_spectra(rows: DataFrame, label: str, bands: Sequence[str], wavelengths: Sequence[float]) -> DataFrame:
    """The table of signatures (label and the bands' means) of rows as spectra gives them."""
    return rows.groupBy(label).agg(*(F.max(F.when(F.abs(F.col("wavelength") - w) < 1e-9, F.col("value"))).alias(b) for b, w in zip(bands, wavelengths, strict=True)))


def html_rows(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """html: a table row of each row; nulls are empty cells, and &, < and > are written as entities."""

    def cell(c: str) -> Column:
        text = F.coalesce(F.col(c).cast("string"), F.lit(""))
        for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
            text = F.replace(text, F.lit(a), F.lit(b))
        return F.concat(F.lit("<td>"), text, F.lit("</td>"))

    return df.select(F.concat(F.lit("<tr>"), *(cell(c) for c in columns or df.columns), F.lit("</tr>")).alias("html"))


def write_html(df: DataFrame, path: str, columns: Sequence[str] | None = None) -> None:
    """A folder of parts, each an HTML table with a header."""
    from pyspark.sql import Window

    head = "<table><tr>" + "".join(f"<th>{c}</th>" for c in columns or df.columns) + "</tr>"
    part = html_rows(df, columns).withColumn("_p", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id())
    own = Window.partitionBy("_p").orderBy("_i")
    part = part.withColumns({"_first": F.lag("html").over(own).isNull(), "_last": F.lead("html").over(own).isNull()})
    part.select(F.concat(F.when(F.col("_first"), head).otherwise(""), "html", F.when(F.col("_last"), "</table>").otherwise("")).alias("value")).write.mode("overwrite").text(path)


def copy_raster(spark: SparkSession, source: str, target: str, nodata: float = -32768, kind: str = "float", compression: str = "zstd") -> None:
    """A raster in another type and compression; NoData stays NoData."""
    before = spark.conf.get("spark.sql.parquet.compression.codec")
    spark.conf.set("spark.sql.parquet.compression.codec", compression)
    try:
        write_raster(read_raster(spark, source, nodata), target, nodata, kind=kind)
    finally:
        spark.conf.set("spark.sql.parquet.compression.codec", before)
