"""Conversion of digital numbers to reflectance and temperature, and dark object subtraction."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from ..session import small


def unit(x: Column) -> Column:
    """Clipped to 0..1; NoData stays."""
    return F.when(x.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)))


def linear(dn: Column, scale: float, offset: float = 0.0) -> Column:
    """Reflectance of products that come with scale and offset."""
    return unit(dn * scale + offset)


def top_of_atmosphere(dn: Column, multiplier: float, addend: float, sun_elevation: float) -> Column:
    return unit((dn * multiplier + addend) / math.sin(math.radians(sun_elevation)))


def dark_object_subtraction(dn: Column, scale: float, dark: float) -> Column:
    """DOS1: the darkest object is taken to reflect 1 %."""
    return unit(dn * scale - (scale * dark - 0.01))


def brightness_temperature(dn: Column, scale: float, offset: float, k1: float, k2: float) -> Column:
    radiance = dn * scale + offset
    return F.when(radiance > 0, F.lit(k2) / F.ln(1 + F.lit(k1) / radiance))


def non_negative(dn: Column) -> Column:
    return F.when(dn.isNotNull(), F.greatest(dn, F.lit(0.0)))


def stored(x: Column, scale: float = 0.0001, nodata: int = 65535) -> Column:
    """As an unsigned 16-bit number (an int here) with a scale; NoData as its sentinel."""
    return F.coalesce(F.rint(x / scale).cast("int"), F.lit(nodata))


def restored(x: Column, scale: float, offset: float = 0.0, nodata: float | None = None) -> Column:
    """The value that a stored number stands for; NoData is compared before scaling."""
    value = x.cast("double") * scale + offset
    return value if nodata is None else F.when(x != nodata, value)


def reflectance(pixels: DataFrame, products: DataFrame, value: str = "value", dark: bool = False) -> DataFrame:
    """pixels (product, band, r, c and digital numbers) with reflectances by their products' metadata (product, band, scale,
    offset), clipped to 0..1. dark: less the reflectance of each product and band's darkest pixel, taken to be 1 %.

    Bands without metadata have no reflectance. Metadata, and dark objects, are a row a product and band.
    """
    own = pixels.join(small(products.select("product", "band", "scale", "offset")), ["product", "band"], "left")
    toa = F.col(value) * F.col("scale") + F.col("offset")
    if dark:
        low = pixels.groupBy("product", "band").agg(F.min(value).alias("_low"))
        own, toa = own.join(small(low), ["product", "band"]), (F.col(value) - F.col("_low")) * F.col("scale") + 0.01
    return own.withColumn(value, unit(toa)).select(*pixels.columns)


def date_from_path(path: Column) -> Column:
    """The date in a path such as .../S2_2020-01-05/..., ..._20200105T..."""
    dashed = F.regexp_extract(path, r"(\d{4}-\d{2}-\d{2})", 1)
    plain = F.regexp_extract(path, r"(?:^|\D)((?:19|20)\d{2})([01]\d)([0-3]\d)(?:\D|$)", 0)
    digits = F.regexp_replace(plain, r"\D", "")
    return F.coalesce(F.try_to_date(F.when(dashed != "", dashed)), F.try_to_date(F.when(digits != "", digits), "yyyyMMdd"))


def search_products(products: DataFrame, date_from: str, date_to: str, max_cloud: float, box: tuple[float, float, float, float] | None = None, name: str | None = None, limit: int | None = None) -> DataFrame:
    """Products by date, cloud cover, box (left, top, right, bottom) and a part of the name, in order of date and id."""
    out = products.where(F.col("acquisition_date").between(F.lit(date_from).cast("date"), F.lit(date_to).cast("date")) & (F.col("cloud_cover") <= max_cloud))
    if box:
        left, top, right, bottom = box
        out = out.where((F.col("min_lon") <= right) & (F.col("max_lon") >= left) & (F.col("min_lat") <= top) & (F.col("max_lat") >= bottom))
    if name:
        out = out.where(F.lower("product_id").contains(name.lower()))
    out = out.orderBy("acquisition_date", "product_id")
    return out.limit(limit) if limit else out


def product_urls(products: DataFrame, base: str, bands, ending: str = "tif") -> DataFrame:
    """product_id, band and url (base/collection/product/band) of each band of each product."""
    each = products.withColumn("band", F.explode(F.array(*map(F.lit, bands))))
    return each.select("product_id", "band", F.concat_ws("/", F.lit(base.rstrip("/")), "collection", "product_id", F.concat("band", F.lit(f".{ending}"))).alias("url"))
