"""Per-pixel and aggregating raster operators over tables of pixels.

A raster is a DataFrame with integer columns r and c (row and column, 0 at the top left) and a column a band; NoData is null.
Operators that look at one pixel at a time are projections and filters, so a grid's partitioning stays as it is.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..plans.expressions import Compiler, compile_over
from ..session import collected, cut, free_name, small
from .polygons import bounds
from .ranks import ONE_TASK, numbered, percentiles as ranked_values, running_sum
from .tiles import dilated, offsets, tiled

POSITION = ("r", "c")


def bands_of(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c not in POSITION]


def masked(df: DataFrame, bands: Sequence[str], mode: str) -> Column:
    """NoData of a pixel: any, all or none of the bands."""
    nulls = [F.col(b).isNull() for b in bands]
    if mode == "none" or not nulls:
        return F.lit(False)
    out = nulls[0]
    for x in nulls[1:]:
        out = out | x if mode == "any" else out & x
    return out


def band_calc(df: DataFrame, expressions: Sequence[tuple[str, str]], resolve: Callable | None = None, mask: str = "all", nodata: dict[str, float] | None = None, keep: bool = False, kind: str | None = None) -> DataFrame:
    """r, c and a column for each (expression, name); later expressions may use earlier names. mask: any, all or none.

    kind: the type in which bands are read and results are given, such as float (default: as they are).
    """
    if kind:
        df = df.withColumns({b: F.col(b).cast(kind) for b in bands_of(df)})
    own = {b.lower(): b for b in bands_of(df)}
    made: dict[str, str] = {}
    out = df
    for text, name in expressions:
        used: list[str] = []

        def look(ref: str, made=made, used=used):
            if ref.lower() in made:
                return F.col(made[ref.lower()])
            if resolve:
                got = resolve(ref)
                names = got if isinstance(got, list) else [got]
                used.extend(names)
                return [F.col(n) for n in names] if isinstance(got, list) else F.col(got)
            if ref == "b*":
                used.extend(own.values())
                return [F.col(b) for b in own.values()]
            if ref.lower() not in own:
                raise ValueError(f"no band {ref}")
            used.append(own[ref.lower()])
            return F.col(own[ref.lower()])

        (value,) = compile_over(out, [text], look, lambda n: (nodata or {}).get(n))
        value = value.cast(kind) if kind else value
        out = out.withColumn(name, F.when(~masked(df, list(dict.fromkeys(used)), mask), value) if used else value)
        made[name.lower()] = name
    return out if keep else out.select(*POSITION, *dict.fromkeys(n for _, n in expressions))


def stack(rasters: Sequence[DataFrame], union: bool = False) -> DataFrame:
    """Bands of several rasters by position, as b1, b2, ..; union: pixels of any of them, else those of all.

    A union is a stack of rows and one grouping by position, so however many rasters meet, there is one shuffle.
    """
    n = [len(bands_of(x)) for x in rasters]
    total, out, at = sum(n), None, 0
    for k, x in enumerate(rasters):
        cells = {at + i + 1: F.col(b).cast("double") for i, b in enumerate(bands_of(x))}
        rows = x.select(*POSITION, F.lit(k).alias("_k"), *(cells.get(i, F.lit(None).cast("double")).alias(f"b{i}") for i in range(1, total + 1)))
        out = rows if out is None else out.unionByName(rows)
        at += n[k]
    got = out.groupBy(*POSITION).agg(*(F.max(f"b{i}").alias(f"b{i}") for i in range(1, total + 1)), F.count("*").alias("_n"))
    return (got if union else got.where(F.col("_n") == len(rasters))).drop("_n")


def split(df: DataFrame, prefix: str = "band") -> DataFrame:
    """One row a pixel and band: r, c, band (prefix and number), value."""
    bands = bands_of(df)
    pairs = F.array(*(F.struct(F.lit(f"{prefix}{i}").alias("band"), F.col(b).cast("double").alias("value")) for i, b in enumerate(bands, 1)))
    return df.select(*POSITION, F.explode(pairs).alias("x")).select(*POSITION, "x.band", "x.value")


def mosaic(rasters: Sequence[DataFrame], last_wins: bool = True) -> DataFrame:
    """Corresponding bands of several rasters in one; where several have a value the last one's (or the first one's) stays."""
    bands, out = bands_of(rasters[0]), None
    for k, x in enumerate(rasters):
        rows = x.select(*POSITION, F.lit(k).alias("_k"), *(F.col(b).alias(n) for b, n in zip(bands_of(x), bands, strict=True)))
        out = rows if out is None else out.unionByName(rows)
    pick = F.max_by if last_wins else F.min_by
    return out.groupBy(*POSITION).agg(*(pick(b, F.when(F.col(b).isNotNull(), F.col("_k"))).alias(b) for b in bands))


def clip_extent(df: DataFrame, left: int, top: int, right: int, bottom: int) -> DataFrame:
    """Pixels from left..right and top..bottom, ends included."""
    return df.where(F.col("c").between(left, right) & F.col("r").between(top, bottom))


def mask_values(df: DataFrame, mask: str, values: Sequence, bands: Sequence[str] | None = None, buffer: int = 0, circular: bool = True) -> DataFrame:
    """NoData in the bands where the mask column has one of the values, or a pixel within `buffer` of one has."""
    if buffer:
        flag, near = free_name("_flag", df), free_name("_near", df)
        where = offsets(buffer, circular)
        grown = tiled(df.withColumn(flag, F.when(F.col(mask).isin(list(values)), 1)), flag, buffer, dilated([1], where)).withColumnRenamed("value", near)
        out = df.join(grown, list(POSITION), "left")
        return out.withColumns({b: F.when(F.col(near).isNull(), F.col(b)) for b in bands or [x for x in bands_of(df) if x != mask]}).select(*df.columns)
    return df.withColumns({b: F.when(~F.coalesce(F.col(mask).isin(list(values)), F.lit(False)), F.col(b)) for b in bands or [x for x in bands_of(df) if x != mask]})


def reclassify(df: DataFrame, band: str, rules: Sequence[tuple[str, str]], name: str = "value", integral: bool = False) -> DataFrame:
    """Rules (old, new): old a number, "nan" (NoData) or a condition over `raster`; new a number or nan/Null.

    Values that no rule meets stay; of several the last rule counts.
    """
    value = F.col(band).cast("double")
    out = None
    for old, new in reversed(list(rules)):
        to = F.lit(None).cast("double") if str(new).lower() in ("nan", "null") else F.lit(float(new))
        if str(old).lower() in ("nan", "null"):
            is_old = value.isNull()
        elif "raster" in str(old):
            is_old = Compiler(lambda _: value).compile(str(old).replace('"raster"', "raster").replace("raster", '"raster"')) != 0
        else:
            is_old = value == float(old)
        out = F.when(is_old, to) if out is None else out.when(is_old, to)
    out = value if out is None else out.otherwise(value)
    return df.withColumn(name, F.floor(out).cast("double") if integral else out)


def resample(df: DataFrame, factor: int, method: str, band: str) -> DataFrame:
    """Blocks of factor x factor pixels as one: nearest, average, sum, maximum, minimum, mode, median or a quartile.

    The quartiles and the median are values of the block (not interpolated); ties of mode go to the smaller value.
    """
    block = df.withColumns({"_r": F.col("r"), "_c": F.col("c"), "r": F.expr(f"cast(r div {factor} as int)"), "c": F.expr(f"cast(c div {factor} as int)")})
    if method == "nearest_neighbour":
        half = factor // 2
        return block.where((F.col("_r") % factor == half) & (F.col("_c") % factor == half)).select(*POSITION, band)
    return block_values(block, method, [band])


def block_values(block: DataFrame, method: str, bands: Sequence[str]) -> DataFrame:
    """r, c and a value of each band for rows that share r and c; mode: of one band."""
    if method == "mode":
        (band,) = bands
        counts = block.where(F.col(band).isNotNull()).groupBy(*POSITION, band).agg(F.count("*").alias("n"))
        return counts.groupBy(*POSITION).agg(F.max_by(band, F.struct("n", -F.col(band))).alias(band))
    simple = {"average": F.avg, "sum": F.sum, "maximum": F.max, "minimum": F.min}
    at = {"median": 0.5, "first_quartile": 0.25, "third_quartile": 0.75}
    agg = simple.get(method) or (lambda b: F.expr(f"percentile_disc({at[method]}) WITHIN GROUP (ORDER BY `{b}`)"))
    return block.groupBy(*POSITION).agg(*(agg(b).alias(b) for b in bands))


def resample_to(df: DataFrame, band: str | Sequence[str], method: str, pixel: tuple[float, float], new_pixel: tuple[float, float], origin: tuple[float, float] = (0.0, 0.0), new_origin: tuple[float, float] = (0.0, 0.0)) -> DataFrame:
    """A band, or several, on another grid (pixel width and height, and the corner where it begins: an explicit resolution or an aligned raster).

    nearest_neighbour: each new pixel whose middle lies in an old one takes its value, so finer grids are filled. The other
    methods (see resample) sum up the old pixels whose middles lie in a new one.
    """
    (w, h), (v, u), (x0, y0), (x1, y1) = pixel, new_pixel, origin, new_origin
    bands, i, j = [band] if isinstance(band, str) else list(band), free_name("_i", df), free_name("_j", df)
    if method == "nearest_neighbour":

        def span(place: str, size: float, start: float, new: float, begin: float) -> Column:
            """New places whose middles are in [low, high) of an old one."""
            low = (F.col(place) * size + (start - begin)) / new - 0.5
            return F.sequence(F.ceil(low).cast("int"), (F.ceil(low + size / new) - 1).cast("int"))

        rows, columns = span("r", h, y0, u, y1), span("c", w, x0, v, x1)
        held = df.withColumns({i: rows, j: columns}).where(f"{i}[0] <= {i}[size({i}) - 1] AND {j}[0] <= {j}[size({j}) - 1]")
        return held.select(F.explode(i).alias("r"), j, *bands).select("r", F.explode(j).alias("c"), *bands)
    middle = lambda place, size, start, new, begin: F.floor(((F.col(place) + 0.5) * size + (start - begin)) / new).cast("int")
    return block_values(df.select(middle("r", h, y0, u, y1).alias("r"), middle("c", w, x0, v, x1).alias("c"), *bands), method, bands)


def constant_grid(spark, rows: int, columns: int, value: float) -> DataFrame:
    return spark.range(rows * columns).select(F.expr(f"cast(id div {columns} as int)").alias("r"), F.expr(f"cast(id % {columns} as int)").alias("c"), F.lit(float(value)).alias("value"))


def constant_like(df: DataFrame, value: float | None, name: str = "value") -> DataFrame:
    """A raster over the extent of df, all of one value (None: NoData)."""
    box = bounds(df)
    if box is None:
        return df.select(*POSITION, F.lit(value).cast("double").alias(name))
    top, bottom, left, right = box
    wide = right - left + 1
    pixels = df.sparkSession.range((bottom - top + 1) * wide)
    return pixels.select(F.expr(f"cast(id div {wide} + {top} as int)").alias("r"), F.expr(f"cast(id % {wide} + {left} as int)").alias("c"), F.lit(value).cast("double").alias(name))


def raster_info(df: DataFrame) -> DataFrame:
    """Extent, counts and NoData of each band: one row a band."""
    bands = bands_of(df)
    whole = df.agg(F.min("r").alias("top"), F.max("r").alias("bottom"), F.min("c").alias("left"), F.max("c").alias("right"), F.count("*").alias("pixels"), *(F.count(b).alias(f"_n{i}") for i, b in enumerate(bands)))
    each = F.array(*(F.struct(F.lit(b).alias("band"), F.col(f"_n{i}").alias("valid")) for i, b in enumerate(bands)))
    return whole.select("top", "bottom", "left", "right", "pixels", F.explode(each).alias("x")).select("x.band", "top", "bottom", "left", "right", "pixels", "x.valid")


def point_values(df: DataFrame, points: DataFrame, origin: tuple[float, float] = (0.0, 0.0), pixel: tuple[float, float] = (1.0, 1.0)) -> DataFrame:
    """Values at points (id, x, y): the pixel at round((x - x0) / width), round((y0 - y) / height). Points are the small side."""
    at = small(points.withColumns({"r": F.rint((F.lit(origin[1]) - F.col("y")) / pixel[1]).cast("int"), "c": F.rint((F.col("x") - origin[0]) / pixel[0]).cast("int")}))
    return df.join(at, list(POSITION)).select("id", *bands_of(df))


def edit(df: DataFrame, band: str, inside: Column, expression: str | None = None, constant: float | None = None) -> DataFrame:
    """Pixels inside take a constant or an expression over "raster"; the value before stays as <band>_old, for undo."""
    value = F.lit(constant) if expression is None else Compiler(lambda _: F.col(band)).compile(expression)
    return df.withColumns({f"{band}_old": F.col(band), band: F.when(inside, value.cast("double")).otherwise(F.col(band))})


def undo(df: DataFrame, band: str) -> DataFrame:
    return df.withColumn(band, F.col(f"{band}_old")).drop(f"{band}_old")


# ---- aggregating operators


def report(df: DataFrame, band: str, pixel_area: float | None = 1.0) -> DataFrame:
    """Of each value: pixels, percent of all valid ones, and area (null for geographic coordinates, pixel_area None)."""
    counts = df.where(F.col(band).isNotNull()).groupBy(F.col(band).alias("value")).agg(F.count("*").alias("pixels"))
    total = counts.agg(F.sum("pixels").alias("_t"))
    area = F.lit(None).cast("double") if pixel_area is None else F.col("pixels") * F.lit(pixel_area)
    return counts.join(F.broadcast(total)).select("value", "pixels", (100 * F.col("pixels") / F.col("_t")).alias("percent"), area.alias("area"))


def combination(df: DataFrame, bands: Sequence[str], pixel_area: float = 1.0) -> DataFrame:
    """Distinct tuples of the bands with ids 1.. in their order, pixels and area; pixels with any NoData don't count."""
    counts = df.dropna(subset=list(bands)).groupBy(*bands).agg(F.count("*").alias("pixels"))
    return numbered(counts, "combination", *bands, start=1, one_task=ONE_TASK).select(F.col("combination").cast("int").alias("combination"), *bands, "pixels", (F.col("pixels") * pixel_area).alias("area"))


def combination_raster(df: DataFrame, bands: Sequence[str]) -> DataFrame:
    """r, c and the combination of each pixel."""
    return df.join(small(combination(df, bands).drop("pixels", "area")), list(bands)).select(*POSITION, "combination")


def zonal_stats(df: DataFrame, zone: str, band: str, percentiles: Sequence[float] = ()) -> DataFrame:
    """Count, max, mean, median, min, std (population), sum and linear percentiles of a band by zone; NoData is skipped.

    The median and the percentiles are exact: they are read off running counts of different values (see ranks), so a zone
    with very many pixels is not one task's. The pixels are read once; all comes from the counts.
    """
    own = df.where(F.col(zone).isNotNull())
    counts = cut(own.groupBy(zone, band).agg(F.count("*").alias("_n")), "counts")
    v, n = F.col(band).cast("double"), F.col("_n")
    more = [F.sum("_n").alias("count"), F.max(band).alias("max"), F.max("_mean").alias("mean"), F.min(band).alias("min"), F.sqrt(F.try_divide(F.sum(n * (v - F.col("_mean")) * (v - F.col("_mean"))), F.sum("_n"))).alias("std"), F.sum(F.col(band) * n).alias("sum")]
    got = ranked_values(counts, band, [50, *percentiles], [zone], more=more)
    names = ["median", *(f"p{p:g}" for p in percentiles)]
    return got.select(zone, "count", "max", "mean", F.col("p0").alias("median"), "min", "std", "sum", *(F.col(f"p{i}").alias(x) for i, x in enumerate(names) if i))


def distinct_tuples(df: DataFrame, bands: Sequence[str], valid: Sequence[str] = ()) -> DataFrame:
    """Distinct tuples of the bands over pixels that have a value in all of them, and in `valid`."""
    return df.dropna(subset=[*bands, *valid]).select(*bands).distinct()


def band_stats(df: DataFrame, bands: Sequence[str]) -> DataFrame:
    """band, n, low, high, total, mean, variance (population) of each band's values, in one pass."""
    stats = {"n": F.count, "low": F.min, "high": F.max, "total": F.sum, "mean": F.avg, "variance": F.var_pop}
    row = df.agg(*(F.struct(*(f(F.col(b).cast("double") if n != "n" else F.col(b)).alias(n) for n, f in stats.items())).alias(f"_{i}") for i, b in enumerate(bands)))
    each = F.array(*(F.struct(F.lit(b).alias("band"), *(F.col(f"_{i}.{n}").alias(n) for n in stats)) for i, b in enumerate(bands)))
    return row.select(F.explode(each).alias("x")).select("x.*")


def cross_matrix(df: DataFrame, row: str, column: str) -> DataFrame:
    """Pixels of each pair of classes (long form), with row and column totals."""
    counts = df.dropna(subset=[row, column]).groupBy(F.col(row).alias("row_class"), F.col(column).alias("column_class")).agg(F.count("*").alias("pixels"))
    total = lambda k: F.sum("pixels").over(Window.partitionBy(k))
    return counts.withColumns({"row_total": total("row_class"), "column_total": total("column_class")})


def error_matrix(df: DataFrame, classified: str, reference: str) -> DataFrame:
    """Area-based error matrix: of each pair of classes the sampled pixels and p = W n / n_row, W a class's share of all."""
    m = cross_matrix(df, classified, reference)
    return m.withColumn("p", F.col("row_total") / F.sum("pixels").over(Window.partitionBy()) * F.col("pixels") / F.col("row_total"))


def accuracy(df: DataFrame, classified: str, reference: str, pixel_area: float = 1.0) -> DataFrame:
    """Of each class its area, standard error, 95 % interval, producer's and user's accuracy and kappa; and overall ones.

    From the area-based matrix p_ij (rows: classified). The matrix is small: one row a pair of classes.
    """
    m = error_matrix(df, classified, reference)
    by_row = m.groupBy(F.col("row_class").alias("class")).agg(F.sum("p").alias("p_row"), F.first("row_total").alias("n_row"), F.sum(F.when(F.col("row_class") == F.col("column_class"), F.col("p"))).alias("p_same"))
    weight = F.col("row_total") / F.sum("pixels").over(Window.partitionBy())
    spread = m.withColumn("w", weight).withColumn("v", F.try_divide(F.col("w") * F.col("p") - F.col("p") * F.col("p"), F.col("row_total") - 1))
    by_column = spread.groupBy(F.col("column_class").alias("class")).agg(F.sum("p").alias("p_column"), F.sqrt(F.sum("v")).alias("se"))
    total = m.agg(F.sum("pixels").alias("n"), F.sum(F.when(F.col("row_class") == F.col("column_class"), F.col("p"))).alias("overall"))
    out = by_row.join(by_column, "class", "full_outer").join(F.broadcast(total))
    same, p_row, p_column = (F.coalesce(x, F.lit(0.0)) for x in ("p_same", "p_row", "p_column"))
    chance = F.sum(p_row * p_column).over(Window.partitionBy())
    area = F.col("n") * pixel_area
    return out.select(
        "class", (p_column * area).alias("area"), (F.coalesce("se", F.lit(0.0)) * area).alias("standard_error"), (1.96 * F.coalesce("se", F.lit(0.0)) * area).alias("interval"),
        F.try_divide(same, p_column).alias("producer"), F.try_divide(same, p_row).alias("user"),
        F.try_divide(same - p_row * p_column, p_row - p_row * p_column).alias("kappa"), F.coalesce("overall", F.lit(0.0)).alias("overall"),
        F.try_divide(F.coalesce("overall", F.lit(0.0)) - chance, 1 - chance).alias("kappa_overall"),
    )


def regression(df: DataFrame, x: str, y: str) -> DataFrame:
    """Linear regression of y on x over pixels: slope, intercept, r2, n and the variance about the line with its interval."""
    s = df.dropna(subset=[x, y]).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2"), F.count("*").alias("n"), F.regr_syy(y, x).alias("_yy"), F.regr_sxy(y, x).alias("_xy"))
    var = F.try_divide(F.col("_yy") - F.col("slope") * F.col("_xy"), F.col("n") - 2)
    return s.select("slope", "intercept", "r2", "n", var.alias("variance"), (2 * F.sqrt(var)).alias("interval"))


def histogram2d(df: DataFrame, x: str, y: str, decimals: int) -> DataFrame:
    """Pixels in square bins of width 10^-decimals, counted from one width below the least values."""
    w = 10.0**-decimals
    own = df.dropna(subset=[x, y])
    low = own.agg(F.min(x).alias("_x"), F.min(y).alias("_y"))
    place = lambda v, m: F.floor((F.col(v) - (F.col(m) - w)) / w)
    return own.join(F.broadcast(low)).groupBy(place(x, "_x").alias("bin_x"), place(y, "_y").alias("bin_y")).agg(F.count("*").alias("pixels"))


def dark_object(df: DataFrame, band: str, share: float = 0.0001) -> DataFrame:
    """The least value at which the running count of pixels reaches a share of all."""
    counts = df.where(F.col(band).isNotNull()).groupBy(band).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("t"))
    return running_sum(counts, "n", "run", [band]).join(F.broadcast(total)).where(F.col("run") >= F.col("t") * share).agg(F.min(band).alias("dark_object"))


def unique_table(df: DataFrame, band: str, incremental: bool = True) -> DataFrame:
    """Distinct values and the numbers 1.. in their order (or the values themselves), for a reclassification."""
    values = df.where(F.col(band).isNotNull()).select(F.col(band).alias("old_value")).distinct()
    return numbered(values, "new_value", "old_value", start=1, one_task=ONE_TASK).withColumn("new_value", F.col("new_value").cast("int")) if incremental else values.withColumn("new_value", F.col("old_value"))


def reclassify_by_table(df: DataFrame, band: str, table: DataFrame, name: str = "value") -> DataFrame:
    """Values by a table (old_value, new_value); values that it lacks stay."""
    return df.join(small(table), F.col(band) == F.col("old_value"), "left").withColumn(name, F.coalesce("new_value", band)).drop("old_value", "new_value")


def rules_of(table: DataFrame) -> list[tuple[str, str]]:
    """Reclassification rules of a small table (old_value, new_value), in its order."""
    return [(r.old_value, r.new_value) for r in collected(table)]
