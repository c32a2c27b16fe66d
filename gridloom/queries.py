"""Registered queries of the pixel and table operators, each with the SQL that gives the same rows."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from .fixtures import BANDS, BANDS_SQL, COLUMNS, EMBED_SQL, GRID_SQL, HOLE, OUTLINE, PARCEL_SQL, PLOT_SQL, WAVELENGTHS, bands, embed, estates, grid, parcels, plots, table
from .functions import projection as pj
from .functions.projection import from_utm, to_utm
from .operators import neighborhood as nb, preprocess as pp, raster as ra, spectral as sp, table as tb, vector as ve, warp
from .operators.tiles import offsets, pyramid, window_stat
from .plans import catalog as cat
from .session import shared_path
from .sources import records as re, tables as so, vectors as vs

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
G, E = f"WITH {GRID_SQL} ", f"WITH {EMBED_SQL} "


def query(sql: str | None = None):
    """Registers a function, and the SQL for its rows."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame, *columns: str, places: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, places) for c in columns})


def doubles(df: DataFrame, places: int = 6) -> DataFrame:
    """Every double rounded, so that the order of summation doesn't show."""
    return rounded(df, *(c for c, t in df.dtypes if t == "double"), places=places)


# ---- scans, projections, filters


@query("SELECT event_id, value, event_type FROM events")
def scan_table(spark, sf):
    path = shared_path(spark, "events")
    so.write_text(table(spark, sf, "events").select("event_id", "value", "event_type"), path, decimals=17, separator=",")
    return so.open_table(spark, path).select("event_id", "value", "event_type")


@query(G + "SELECT r, c, vh * 2 + 1 AS v FROM px")
def scan_raster(spark, sf):
    return grid(spark, sf, holes=True).select("r", "c", pp.restored(F.col("v"), 2, 1).alias("v"))


@query(G + "SELECT r, c, v FROM px WHERE r BETWEEN 2 AND 6 AND c BETWEEN 10 AND 30")
def window_read(spark, sf):
    path = shared_path(spark, "raster")
    so.write_raster(grid(spark, sf).select("r", "c", "v"), path, kind="double")
    return so.read_raster(spark, path, window=(2, 10, 6, 30))


@query(G + "SELECT 'v' AS band, min(r) AS top, max(r) AS bottom, min(c) AS \"left\", max(c) AS \"right\", count(*) AS pixels, count(vh) AS valid FROM px")
def raster_info(spark, sf):
    return ra.raster_info(grid(spark, sf, holes=True).select("r", "c", "v"))


@query("SELECT o_orderkey AS id, o_totalprice AS price FROM orders")
def project(spark, sf):
    return tb.project(table(spark, sf, "orders"), ["o_orderkey", "unknown", "o_totalprice"], ["id", "none", "price"])


@query("SELECT c_custkey, c_acctbal AS balance FROM customer")
def rename(spark, sf):
    return tb.rename(table(spark, sf, "customer").select("c_custkey", "c_acctbal"), "c_acctbal", "balance")


@query("SELECT p_partkey, CAST(p_size AS DOUBLE) AS p_size, CAST(p_partkey AS VARCHAR) AS text FROM part")
def cast_cols(spark, sf):
    df = table(spark, sf, "part").select("p_partkey", "p_size", F.col("p_partkey").alias("text"))
    return tb.define_fields(df, {"p_size": "double", "text": "string"})


@query("SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount), 6) AS net FROM lineitem")
def calculate(spark, sf):
    df = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", "l_discount")
    return rounded(tb.calculate(df, '"l_extendedprice" * (1 - "l_discount")', "net").drop("l_extendedprice", "l_discount"), "net")


@query("SELECT l_orderkey, l_linenumber, round(l_quantity * 2, 6) AS a, round(ln(l_extendedprice), 6) AS b, CAST(-999 AS DOUBLE) AS bad FROM lineitem")
def calculate_multi(spark, sf):
    df = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")
    out = tb.calculate_multi(df, ['"l_quantity" * 2', 'log("l_extendedprice")', '"missing" + 1'], ["a", "b", "bad"], -999, "double")
    return doubles(out.select("l_orderkey", "l_linenumber", "a", "b", "bad"))


@query("SELECT o_orderkey FROM orders WHERE o_totalprice > 100000 AND o_orderkey % 3 = 0")
def filter_values(spark, sf):
    return tb.filter_values(table(spark, sf, "orders"), "o_orderkey", '("o_totalprice" > 100000) & ("o_orderkey" % 3 == 0)')


@query("SELECT CASE n_name_key WHEN 3 THEN 0 WHEN 1 THEN 1 ELSE 2 END AS place, n_name_key AS n_nationkey, n_name FROM (SELECT n_nationkey AS n_name_key, n_name FROM nation WHERE n_nationkey IN (3, 1, 7))")
def in_list(spark, sf):
    return tb.in_list(table(spark, sf, "nation"), "n_nationkey", [3, 1, 7], "n_name")


@query("SELECT o_orderkey FROM orders WHERE CAST(o_orderdate AS DATE) = DATE '1995-03-15' OR (CAST(o_orderdate AS DATE) >= DATE '1996-01-01' AND CAST(o_orderdate AS DATE) < DATE '1996-02-01')")
def date_ranges(spark, sf):
    return tb.date_ranges(table(spark, sf, "orders"), "o_orderdate", ["1995-03-15", ">=1996-01-01 & <1996-02-01"]).select("o_orderkey")


# ---- joins

_JOIN = "SELECT coalesce(o_orderkey, -9999) AS o_orderkey, coalesce(o_custkey, -9999) AS o_custkey, coalesce(c_custkey, -9999) AS c_custkey, coalesce(c_acctbal, -9999) AS c_acctbal FROM (SELECT o_orderkey, o_custkey + 100 AS o_custkey FROM orders) {} JOIN (SELECT c_custkey, c_acctbal FROM customer) ON o_custkey = c_custkey"


def _join(spark, sf, how):
    """Orders with every key moved on, so that some find no customer and some customers no order."""
    left = table(spark, sf, "orders").select("o_orderkey", (F.col("o_custkey") + 100).alias("o_custkey"))
    right = table(spark, sf, "customer").select("c_custkey", "c_acctbal")
    return tb.join_tables(left, right, "o_custkey", "c_custkey", how)


@query(_JOIN.format("LEFT"))
def join_left(spark, sf):
    return _join(spark, sf, "left")


@query(_JOIN.format("INNER"))
def join_inner(spark, sf):
    return _join(spark, sf, "inner")


@query(_JOIN.format("RIGHT"))
def join_right(spark, sf):
    return _join(spark, sf, "right")


@query(_JOIN.format("FULL"))
def join_outer(spark, sf):
    return _join(spark, sf, "outer")


@query("WITH f AS (SELECT l_orderkey, min(struct_pack(a := l_linenumber, b := l_partkey, c := l_suppkey, d := l_extendedprice)) AS s FROM lineitem GROUP BY 1) SELECT o_orderkey, coalesce(s.b, -9999) AS l_partkey, coalesce(s.d, -9999) AS l_extendedprice FROM orders LEFT JOIN f ON o_orderkey = l_orderkey")
def join_first_match(spark, sf):
    right = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    out = tb.join_first_match(table(spark, sf, "orders").select("o_orderkey"), right, "o_orderkey", "l_orderkey", ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"])
    return out.select("o_orderkey", "l_partkey", "l_extendedprice")


@query("SELECT n_nationkey, n_name, n_regionkey, r_name FROM (SELECT n_nationkey, n_name, n_regionkey FROM nation) JOIN (SELECT r_regionkey AS n_nationkey, r_name FROM region) USING (n_nationkey)")
def join_unique(spark, sf):
    left = table(spark, sf, "nation").select("n_nationkey", "n_name", "n_regionkey")
    return tb.join_unique(left, table(spark, sf, "region").select(F.col("r_regionkey").alias("n_nationkey"), "r_name"), "n_nationkey", "inner")


@query("WITH p AS (SELECT p_partkey, p_retailprice, s.n_nationkey, row_number() OVER (PARTITION BY p_partkey ORDER BY abs(s.n_nationkey * 50 + 900 - p_retailprice), s.n_nationkey) AS rn, abs(s.n_nationkey * 50 + 900 - p_retailprice) AS d FROM part, nation s) SELECT p_partkey, CASE WHEN d < 20 THEN n_nationkey END AS n_nationkey FROM p WHERE rn = 1")
def nearest_value(spark, sf):
    bands = table(spark, sf, "nation").selectExpr("n_nationkey", "n_nationkey * 50 + 900 AS w")
    return tb.nearest_value(bands, "w", table(spark, sf, "part").select("p_partkey", "p_retailprice"), "p_retailprice", 20, "n_nationkey").select("p_partkey", "n_nationkey")


@query("SELECT c_custkey, s_suppkey FROM (SELECT c_custkey, CASE WHEN abs(s_acctbal - c_acctbal) < 50 THEN s_suppkey END AS s_suppkey, row_number() OVER (PARTITION BY c_custkey ORDER BY abs(s_acctbal - c_acctbal), s_suppkey) AS rn FROM customer, supplier) WHERE rn = 1")
def nearest_join(spark, sf):
    return tb.nearest_value(table(spark, sf, "supplier"), "s_acctbal", table(spark, sf, "customer"), "c_acctbal", 50, "s_suppkey").select("c_custkey", "s_suppkey")


def _bandset(spark, sf) -> cat.BandSet:
    return cat.BandSet.create(embed(spark, sf).drop("cls"), WAVELENGTHS)


_BANDS_SQL = "(VALUES " + ", ".join(f"({i}, {w})" for i, w in enumerate(WAVELENGTHS, 1)) + ") t(band_number, wavelength)"


@query(f"WITH {BANDS_SQL} SELECT band_number, wavelength FROM bt WHERE abs(wavelength - 0.85) < 0.1 ORDER BY abs(wavelength - 0.85), band_number LIMIT 1")
def nearest_wavelength(spark, sf):
    return cat.nearest_band(bands(spark, sf), 0.85, 0.1).select("band_number", "wavelength")


@query(f"WITH {BANDS_SQL}, s AS (SELECT * FROM (VALUES ('BLUE', 0.475, 0.2), ('GREEN', 0.56, 0.03), ('RED', 0.65, 0.04), ('NIR', 0.85, 0.15), ('SWIR1', 1.61, 0.2), ('SWIR2', 2.2, 0.2)) v(\"range\", m, d)) SELECT \"range\", arg_min(band_number, (abs(wavelength - m), band_number)) AS band_number FROM s LEFT JOIN bt ON abs(wavelength - m) < d GROUP BY 1")
def spectral_bands(spark, sf):
    return cat.spectral_bands(bands(spark, sf))


@query(G + "SELECT r, c, a.v AS b1, b.v AS b2 FROM (SELECT r, c, v FROM px WHERE c < 60) a JOIN (SELECT r, c, v FROM px WHERE c >= 40) b USING (r, c)")
def stack_bands(spark, sf):
    px = grid(spark, sf).select("r", "c", "v")
    return ra.stack([px.where("c < 60"), px.where("c >= 40")])


# ---- aggregations


@query("SELECT l_returnflag, round(sum(l_quantity), 6) AS l_quantity_sum, round(avg(l_extendedprice), 6) AS l_extendedprice_mean FROM lineitem GROUP BY 1")
def pivot_group(spark, sf):
    return doubles(tb.pivot(table(spark, sf, "lineitem"), "l_returnflag", [("l_quantity", "sum"), ("l_extendedprice", "mean")]))


def _cells(columns: list[tuple[str, str]]) -> str:
    return ", ".join(f"round(coalesce({sql}, 0), 6) AS \"{name}\"" for sql, name in columns)


@query("SELECT l_returnflag, " + _cells([(f"sum(l_quantity) FILTER (l_linestatus = '{s}')", f"l_quantity_sum_l_linestatus{s}") for s in "FO"]) + " FROM lineitem GROUP BY 1")
def pivot_cross(spark, sf):
    return doubles(tb.pivot(table(spark, sf, "lineitem"), "l_returnflag", [("l_quantity", "sum")], ["l_linestatus"], values=[("F",), ("O",)]))


@query("SELECT l_linenumber, " + _cells([(f"avg(l_discount) FILTER (l_returnflag = '{a}' AND l_linestatus = '{b}')", f"l_discount_mean_l_returnflag{a}_l_linestatus{b}") for a in "ANR" for b in "FO"]) + " FROM lineitem GROUP BY 1")
def pivot_two(spark, sf):
    return doubles(tb.pivot(table(spark, sf, "lineitem"), "l_linenumber", [("l_discount", "mean")], ["l_returnflag", "l_linestatus"], values=[(a, b) for a in "ANR" for b in "FO"]))


@query("SELECT l_returnflag, " + _cells([(f"max(l_tax) FILTER (l_linestatus = '{s}')", s) for s in "FO"]) + " FROM lineitem WHERE l_quantity > 25 GROUP BY 1")
def pivot_filtered(spark, sf):
    return doubles(tb.pivot(table(spark, sf, "lineitem"), "l_returnflag", [("l_tax", "max")], ["l_linestatus"], condition='"l_quantity" > 25', cross_matrix=True, values=[("F",), ("O",)]))


@query("SELECT 'l_tax_sum_l_returnflag' || a.f || '_l_linestatus' || b.s AS name FROM (SELECT DISTINCT l_returnflag AS f FROM lineitem) a, (SELECT DISTINCT l_linestatus AS s FROM lineitem) b")
def pivot_fields(spark, sf):
    return tb.pivot_fields(table(spark, sf, "lineitem"), [("l_tax", "sum")], ["l_returnflag", "l_linestatus"])


@query("SELECT l_returnflag, round(median(l_quantity), 6) AS l_quantity_median, round(quantile_cont(l_extendedprice, 0.9), 6) AS \"l_extendedprice_percentile_90\", count(l_tax) AS l_tax_count FROM lineitem GROUP BY 1")
def pivot_median(spark, sf):
    return doubles(tb.pivot(table(spark, sf, "lineitem"), "l_returnflag", [("l_quantity", "median"), ("l_extendedprice", "percentile_90"), ("l_tax", "count")]))


@query("SELECT l_returnflag, round(sum(x), 6) AS x_sum, min(x) AS x_min, max(x) AS x_max, round(avg(x), 6) AS x_mean, round(median(x), 6) AS x_median, round(stddev_samp(x), 6) AS x_std, round(stddev_pop(x), 6) AS x_std_pop, round(quantile_cont(x, 0.9), 6) AS x_percentile_90, arg_min(x, k) AS x_first, arg_max(x, k) AS x_last FROM (SELECT l_returnflag, l_extendedprice AS x, struct_pack(a := l_orderkey, b := l_linenumber, c := l_partkey, d := l_suppkey, e := l_extendedprice) AS k FROM lineitem) GROUP BY 1")
def agg_functions(spark, sf):
    df = table(spark, sf, "lineitem").select("l_returnflag", F.col("l_extendedprice").alias("x"), F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").alias("_row"))
    names = ["sum", "min", "max", "mean", "median", "std", "std_pop", "percentile_90", "first", "last"]
    got = tb.grouped(df, ["l_returnflag"], [("x", n) for n in names], "_row")
    return doubles(got.select("l_returnflag", *(F.col(f"_v{i}").alias(f"x_{n}") for i, n in enumerate(names))))


@query(G + "SELECT k AS value, count(*) AS pixels FROM px GROUP BY 1")
def unique_count(spark, sf):
    return ra.report(grid(spark, sf), "k").select("value", "pixels")


@query(G + "SELECT DISTINCT k, m FROM px WHERE vh IS NOT NULL")
def distinct_combos(spark, sf):
    return ra.distinct_tuples(grid(spark, sf, holes=True), ["k", "m"], ["v"])


@query(G + " UNION ALL ".join(f"SELECT '{b}' AS band, count({x}) AS n, min({x})::DOUBLE AS low, max({x})::DOUBLE AS high, round(sum({x}), 6)::DOUBLE AS total, round(avg({x}), 6) AS mean, round(var_pop({x}), 6) AS variance FROM px" for b, x in (("v", "vh"), ("k", "k"))))
def band_stats(spark, sf):
    return doubles(ra.band_stats(grid(spark, sf, holes=True), ["v", "k"]))


_PAIRS = [(a, b) for i, a in enumerate(BANDS[:3]) for b in BANDS[i:3]]


@query(E + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(covar_samp({a}, {b}), 8) AS covariance, round(corr({a}, {b}), 8) AS correlation FROM pe" for a, b in _PAIRS))
def covariance(spark, sf):
    return doubles(sp.covariance(embed(spark, sf), BANDS[:3]), 8)


@query(E + " UNION ALL ".join(f"SELECT '{b}' AS band, min({b}) AS low, max({b}) AS high FROM pe" for b in BANDS))
def band_minmax(spark, sf):
    return ra.band_stats(embed(spark, sf), BANDS).select("band", "low", "high")


@query(E + "SELECT cls, count(*) AS pixels, round(avg(b1), 6) AS mean_b1, round(avg(b2), 6) AS mean_b2 FROM pe GROUP BY 1")
def class_means(spark, sf):
    return doubles(sp.signatures(embed(spark, sf), "cls", BANDS[:2]).select("cls", "pixels", "mean_b1", "mean_b2"))


@query(E + "SELECT cls, round(covar_samp(b1, b1), 8) AS cov_1_1, round(covar_samp(b1, b2), 8) AS cov_1_2, round(covar_samp(b2, b2), 8) AS cov_2_2 FROM pe GROUP BY 1")
def class_covariance(spark, sf):
    return doubles(sp.class_covariances(embed(spark, sf), "cls", BANDS[:2]), 8)


@query(G + f", {PARCEL_SQL} SELECT DISTINCT CAST(val AS INT) AS class_id, r, c, v AS f1, m::DOUBLE AS f2 FROM inside JOIN (SELECT r, c, m FROM px) USING (r, c)")
def train_matrix(spark, sf):
    rois = vs.import_rois(parcels(spark, sf), F.lit(1), F.col("value"))
    return ve.training_matrix(grid(spark, sf), rois, ["v", "m"], "class_id").select("class_id", "r", "c", F.col("features")[0].alias("f1"), F.col("features")[1].alias("f2"))


@query(G + f", {PARCEL_SQL}, s AS (SELECT val, avg(v) AS a, avg(m) AS b FROM inside JOIN (SELECT r, c, m FROM px) USING (r, c) GROUP BY 1) SELECT px.r, px.c, CAST(arg_min(val, (round(sqrt((px.v - a) * (px.v - a) + (px.m - b) * (px.m - b)), 9), val)) AS INT) AS class FROM px, s GROUP BY 1, 2")
def classify_rois(spark, sf):
    px = grid(spark, sf).select("r", "c", "v", "m")
    rois = vs.import_rois(_parcel_file(spark, sf), F.lit(1), F.col("value"))
    sig = sp.signatures(ve.pixels_in_polygons(px, rois), "class_id", ["v", "m"]).orderBy("class_id")
    return sp.classify(px, sig.selectExpr("class_id", "mean_v AS v", "mean_m AS m"), "class_id", ["v", "m"], "md").select("r", "c", F.col("class").cast("int").alias("class"))


@query(E + ", lo AS (SELECT min(b1) AS x, min(b2) AS y FROM pe) SELECT CAST(floor((b1 - (x - 0.1)) / 0.1) AS BIGINT) AS bin_x, CAST(floor((b2 - (y - 0.1)) / 0.1) AS BIGINT) AS bin_y, count(*) AS pixels FROM pe, lo GROUP BY 1, 2")
def histogram2d(spark, sf):
    return ra.histogram2d(embed(spark, sf), "b1", "b2", 1)


@query(G + ", n AS (SELECT k, count(*) AS n FROM px GROUP BY 1), q AS (SELECT k, sum(n) OVER (ORDER BY k ROWS UNBOUNDED PRECEDING) AS run, sum(n) OVER () AS t FROM n) SELECT min(k) AS dark_object FROM q WHERE run >= t * 0.0001")
def dark_object(spark, sf):
    return ra.dark_object(grid(spark, sf), "k")


@query(E + "SELECT cls, count(*) AS pixels, round(avg(b1), 6) AS mean_b1, round(stddev_pop(b1), 6) AS std_b1 FROM pe GROUP BY 1")
def roi_signature(spark, sf):
    return doubles(sp.signatures(embed(spark, sf), "cls", ["b1"]))


@query(E + ", s AS (SELECT cls, avg(b1) AS v, stddev_pop(b1) AS d FROM pe GROUP BY 1) SELECT CAST(0.49 AS DOUBLE) AS wavelength, round(avg(v), 6) AS value, round(sqrt(avg(d * d)), 6) AS standard_deviation FROM s")
def sig_merge(spark, sf):
    s = sp.signatures(embed(spark, sf), "cls", ["b1"])
    return doubles(sp.merge_signatures(s.select(F.lit(0.49).cast("double").alias("wavelength"), F.col("mean_b1").alias("value"), F.col("std_b1").alias("standard_deviation"))))


# ---- sorts and sets


@query("SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal, c_custkey")
def sort(spark, sf):
    return tb.sort_by(table(spark, sf, "customer").select("c_custkey", "c_acctbal"), "c_acctbal", "c_custkey")


@query("SELECT n_nationkey AS id, n_name AS name, NULL::INT AS region FROM nation UNION ALL SELECT r_regionkey, r_name, r_regionkey FROM region")
def union_all(spark, sf):
    a = table(spark, sf, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"))
    return tb.append_tables(a, table(spark, sf, "region").select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("name"), F.col("r_regionkey").alias("region")))


@query("SELECT r_regionkey, r_name FROM region UNION ALL SELECT 99::INT, 'new'")
def append_row(spark, sf):
    return tb.append_row(table(spark, sf, "region"), (99, "new"))


@query("SELECT n_nationkey, n_name FROM nation WHERE n_nationkey >= 5 UNION ALL SELECT r_regionkey, r_name FROM region")
def upsert(spark, sf):
    return tb.upsert(table(spark, sf, "nation").select("n_nationkey", "n_name"), table(spark, sf, "region").select(F.col("r_regionkey").alias("n_nationkey"), F.col("r_name").alias("n_name")), "n_nationkey")


@query(f"WITH {BANDS_SQL} SELECT CAST(row_number() OVER (ORDER BY wavelength, band_number) AS INT) AS band_number, wavelength, path FROM bt")
def band_sort(spark, sf):
    return cat.sort_by_wavelength(bands(spark, sf)).select("band_number", "wavelength", "path")


@query("SELECT d AS \"date\", CAST(row_number() OVER (ORDER BY d) AS INT) AS number FROM (SELECT DISTINCT CAST(o_orderdate AS DATE) AS d FROM orders)")
def bandset_sort(spark, sf):
    days = table(spark, sf, "orders").select(F.to_date("o_orderdate").alias("date")).distinct()
    return cat.renumber(days, "date").withColumnRenamed("band_number", "number")


@query(f"WITH {BANDS_SQL} SELECT CAST(CASE WHEN band_number >= 3 THEN band_number + 1 ELSE band_number END AS INT) AS band_number, wavelength FROM bt UNION ALL SELECT 3::INT, max(wavelength) FROM bt")
def band_insert(spark, sf):
    own = bands(spark, sf).select("band_number", "wavelength")
    return cat.insert_band(own, own.agg(F.max("wavelength").alias("wavelength")), 3).select("band_number", "wavelength")


@query(f"WITH {BANDS_SQL} SELECT CAST(CASE WHEN band_number > 2 THEN band_number - 1 ELSE band_number END AS INT) AS band_number, wavelength FROM bt WHERE band_number <> 2")
def band_remove(spark, sf):
    return cat.remove_band(bands(spark, sf).select("band_number", "wavelength"), 2)


@query(f"WITH {BANDS_SQL} SELECT CAST(CASE WHEN band_number = 2 THEN 7 WHEN band_number BETWEEN 3 AND 7 THEN band_number - 1 ELSE band_number END AS INT) AS band_number, wavelength FROM bt")
def band_move(spark, sf):
    return cat.move_band(bands(spark, sf).select("band_number", "wavelength"), 2, 7).select("band_number", "wavelength")


@query(f"WITH {BANDS_SQL} SELECT band_number, wavelength FROM bt WHERE name IN ('scene_B05', 'scene_B11')")
def band_by_attr(spark, sf):
    return cat.bands_where(bands(spark, sf), name=["scene_B05", "scene_B11"]).select("band_number", "wavelength")


@query(G + "SELECT k AS old_value, CAST(row_number() OVER (ORDER BY k) AS INT) AS new_value FROM (SELECT DISTINCT k FROM px)")
def unique_table(spark, sf):
    return ra.unique_table(grid(spark, sf), "k")


# ---- band expressions


def _calc(spark, sf, program: str, union: bool = False, mask: str = "all"):
    """A program over two sets: the bands of the left and of the right part of the embedding grid."""
    px = embed(spark, sf).drop("cls")
    names = [f"left_{b}" for b in BANDS], [f"right_{b}" for b in BANDS]
    sets = [px.where(w).select("r", "c", *(F.col(b).alias(n) for b, n in zip(BANDS, own, strict=True))) for own, w in zip(names, ("c < 20", "c >= 5"), strict=True)]
    catalog = cat.Catalog([cat.BandSet.create(x, WAVELENGTHS, date=d) for x, d in zip(sets, ("2021-01-01", "2021-02-01"), strict=True)])
    return doubles(cat.run_program(program, catalog, union, mask))


_BOTH = E + ", q AS (SELECT *, b4 AS n, b3 AS d FROM pe WHERE c >= 5 AND c < 20) "


@query(_BOTH + "SELECT r, c, round(b1 + b2 * 2, 6) AS total FROM q")
def calc_sum(spark, sf):
    return _calc(spark, sf, '"bandset1b1" + "bandset#b2" * 2 @total')


@query(_BOTH + "SELECT r, c, round((b4 - b3) / nullif(b4 + b3, 0), 6) AS ndvi FROM q")
def calc_ndvi(spark, sf):
    return _calc(spark, sf, '"#NDVI#" @ndvi')


@query(_BOTH + "SELECT r, c, round(2.5 * (b4 - b3) / nullif(b4 + 6 * b3 - 7.5 * b1 + 1, 0), 6) AS evi FROM q")
def calc_evi(spark, sf):
    return _calc(spark, sf, '"#EVI#" @evi')


@query(_BOTH + "SELECT r, c, CAST(b1 > b2 AND NOT b3 < 0 AS INT) AS flag FROM q")
def calc_bool(spark, sf):
    return _calc(spark, sf, '("b1" > "b2") & ~("b3" < 0) @flag')


@query(_BOTH + "SELECT r, c, round(b1 * b2, 6) AS p, round(b1 * b2 + 1, 6) AS q FROM q")
def calc_chain(spark, sf):
    return _calc(spark, sf, '# product first\n"b1" * "b2" @p\n"p" + 1 @q')


@query(_BOTH + "SELECT r, c, round(b1 - b2, 6) AS output1, round(b2 - b1, 6) AS other FROM q")
def calc_multi(spark, sf):
    return _calc(spark, sf, '"b1" - "b2"\n"b2" - "b1" @other')


@query(_BOTH + "SELECT r, c, round((b1 + b2 + b3 + b4 + b5 + b6) / 6, 6) AS mean FROM q")
def calc_mean_bands(spark, sf):
    return _calc(spark, sf, 'mean("bandset#b*") @mean')


@query(_BOTH + "SELECT r, c, round(list_sort([b1, b2, b3, b4, b5, b6])[CAST(round_even(5 * 30 / 100.0, 0) AS INT) + 1], 6) AS p FROM q")
def calc_percentile(spark, sf):
    return _calc(spark, sf, 'percentile("bandset#b*", 30) @p')


@query(_BOTH + "SELECT r, c, round(b1 + b1, 6) AS s, round(b2, 6) AS low FROM q")
def calc_across_sets(spark, sf):
    return _calc(spark, sf, 'sum("bandset*b1") @s\nmin("bandset{1:2}b2") @low')


@query(_BOTH + "SELECT r, c, round(sin(b1) + cos(b2) + exp(b3) - sqrt(abs(b4)) + atan(b5), 6) AS f, round(CASE WHEN b1 > 0 THEN ln(b1) END, 6) AS g, round(CASE WHEN b1 > b2 THEN b3 ELSE b4 END, 6) AS h, round(least(greatest(b1, -0.1), 0.1), 6) AS k FROM q")
def calc_funcs(spark, sf):
    return _calc(spark, sf, 'sin("b1") + np.cos("b2") + exp("b3") - sqrt(abs("b4")) + arctan("b5") @f\nlog("b1") @g\nwhere("b1" > "b2", "b3", "b4") @h\nnp.clip("b1", -0.1, 0.1) @k')


@query(G + "SELECT r, c, round(vh - -9999.0, 6) AS v FROM px")
def calc_nodata(spark, sf):
    return doubles(ra.band_calc(grid(spark, sf, holes=True).select("r", "c", "v"), [('"v" - nodata("v")', "v")], nodata={"v": -9999.0}))


@query(_BOTH + "SELECT r, c, round(b1 * 2, 6) AS twice_1, round(b1 * 2, 6) AS twice_2 FROM q")
def calc_loop(spark, sf):
    return _calc(spark, sf, 'forbandsets[1:2]\n"bandset#b1" * 2 @twice')


@query(E + "SELECT r, c, round(CASE WHEN c < 20 THEN b1 END, 6) AS a, round(CASE WHEN c >= 5 THEN b1 END, 6) AS b FROM pe")
def calc_union_extent(spark, sf):
    return _calc(spark, sf, '"bandset1b1" @a\n"bandset2b1" @b', union=True)


@query(E + "SELECT round(b1 + b2, 6) AS v FROM pe WHERE r = 3 AND c = 7")
def calc_point(spark, sf):
    point = spark.createDataFrame([(1, 7.2, -2.9)], "id int, x double, y double")
    values = ra.band_calc(embed(spark, sf).select("r", "c", "b1", "b2"), [('"b1" + "b2"', "v")])
    return doubles(ra.point_values(values, point).select("v"))


@query(E + "SELECT r, c, round(list_max([b1, b2, b3, b4, b5, b6]) - b1, 6) AS v FROM pe")
def calc_direct(spark, sf):
    return doubles(ra.band_calc(embed(spark, sf).drop("cls"), [('max("b*") - "b1"', "v")]))


@query(_BOTH + "SELECT r, c, round(b1 + b2 + b3 + b4 + b5 + b6, 6) AS v FROM q")
def calc_alias(spark, sf):
    return _calc(spark, sf, '"#BLUE#" + "#GREEN#" + "#RED#" + "#NIR#" + "#SWIR1#" + "#SWIR2#" @v')


@query(E + ", a AS (SELECT avg(b1) AS m, stddev_pop(b1) AS s FROM pe) SELECT r, c, round((b1 - m) / s, 6) AS z FROM pe, a")
def calc_whole_table(spark, sf):
    return doubles(ra.band_calc(embed(spark, sf).select("r", "c", "b1"), [('("b1" - mean("b1")) / std("b1")', "z")]))


# ---- rasters, pixel by pixel


@query(G + "SELECT r, c, CASE WHEN k IN (1, 3) THEN NULL ELSE v END AS v FROM px")
def mask_values(spark, sf):
    return ra.mask_values(grid(spark, sf), "k", [1, 3], ["v"]).select("r", "c", "v")


@query(G + "SELECT r, c, CASE WHEN vh IS NOT NULL THEN 1 END AS any_valid FROM px")
def mask_nodata(spark, sf):
    px = grid(spark, sf, holes=True)
    return px.select("r", "c", F.when(~ra.masked(px, ["v", "k"], "any"), F.lit(1)).alias("any_valid"))


@query(G + "SELECT r, c, v FROM px WHERE c BETWEEN 20 AND 40 AND r BETWEEN 1 AND 8")
def clip_extent(spark, sf):
    return ra.clip_extent(grid(spark, sf).select("r", "c", "v"), 20, 1, 40, 8)


@query(G + "SELECT r, c, CAST(CASE WHEN k = 2 THEN NULL WHEN k = 1 THEN 10 WHEN k = 0 THEN 7 ELSE k END AS DOUBLE) AS value FROM px")
def reclass(spark, sf):
    return ra.reclassify(grid(spark, sf), "k", [("0", "7"), ("1", "10"), ("2", "Null")]).select("r", "c", "value")


@query(G + "SELECT r, c, CAST(CASE WHEN vh IS NULL THEN -1 WHEN vh > 100 AND vh < 200 THEN 2 WHEN vh > 50 THEN 1 ELSE vh END AS DOUBLE) AS value FROM px")
def reclass_cond(spark, sf):
    rules = [("raster > 50", "1"), ("(raster > 100) & (raster < 200)", "2"), ("nan", "-1")]
    return ra.reclassify(grid(spark, sf, holes=True), "v", rules).select("r", "c", "value")


@query(G + "SELECT r, c, CASE WHEN c >= 40 THEN coalesce(vh, CASE WHEN c < 60 THEN v END) ELSE v END AS v FROM px")
def mosaic(spark, sf):
    return ra.mosaic([grid(spark, sf).where("c < 60").select("r", "c", "v"), grid(spark, sf, holes=True).where("c >= 40").select("r", "c", "v")])


@query(E + "SELECT r, c, 'band1' AS band, b1 AS value FROM pe UNION ALL SELECT r, c, 'band2', b2 FROM pe")
def split_bands(spark, sf):
    return ra.split(embed(spark, sf).select("r", "c", "b1", "b2"))


def _resample(method: str, sql: str, column: str = "v"):
    def run(spark, sf):
        return doubles(ra.resample(grid(spark, sf).select("r", "c", column), 4, method, column))

    short = {"average": "avg", "maximum": "max", "minimum": "min", "first_quartile": "q1", "third_quartile": "q3", "nearest_neighbour": "nearest"}.get(method, method)
    run.__name__ = f"resample_{short}"
    query(G + sql)(run)


_BLOCK = "SELECT CAST(r // 4 AS INT) AS r, CAST(c // 4 AS INT) AS c, round({}, 6) AS v FROM px GROUP BY 1, 2"
for _m, _s in {"average": "avg(v)", "sum": "sum(v)", "maximum": "max(v)", "minimum": "min(v)", "median": "quantile_disc(v, 0.5)", "first_quartile": "quantile_disc(v, 0.25)", "third_quartile": "quantile_disc(v, 0.75)"}.items():
    _resample(_m, _BLOCK.format(_s))
_resample("mode", "SELECT r, c, k FROM (SELECT CAST(r // 4 AS INT) AS r, CAST(c // 4 AS INT) AS c, k, row_number() OVER (PARTITION BY r // 4, c // 4 ORDER BY count(*) DESC, k) AS i FROM px GROUP BY r // 4, c // 4, k) WHERE i = 1", "k")
_resample("nearest_neighbour", "SELECT CAST(r // 4 AS INT) AS r, CAST(c // 4 AS INT) AS c, round(v, 6) AS v FROM px WHERE r % 4 = 2 AND c % 4 = 2")


@query(G + "SELECT r, c, round(CASE WHEN r BETWEEN 2 AND 4 THEN v * 2 ELSE v END, 6) AS v, round(v, 6) AS v_old FROM px")
def raster_edit(spark, sf):
    return doubles(ra.edit(grid(spark, sf).select("r", "c", "v"), "v", F.col("r").between(2, 4), '"raster" * 2'))


@query(G + "SELECT CAST(i AS INT) AS r, CAST(j AS INT) AS c, CAST(7 AS DOUBLE) AS value FROM range((SELECT max(r) + 1 FROM px)) a(i), range((SELECT max(c) + 1 FROM px)) b(j)")
def constant_grid(spark, sf):
    return ra.constant_like(grid(spark, sf), 7)


@query(G + "SELECT CAST(1 AS INT) AS id, v FROM px WHERE r = 3 AND c = 12 UNION ALL SELECT 2, v FROM px WHERE r = 5 AND c = 40")
def point_value(spark, sf):
    points = spark.createDataFrame([(1, 12.4, -3.3), (2, 39.7, -5.1)], "id int, x double, y double")
    return ra.point_values(grid(spark, sf).select("r", "c", "v"), points)


# ---- rasters, aggregated


@query(G + "SELECT k AS value, count(*) AS pixels, round(100.0 * count(*) / sum(count(*)) OVER (), 6) AS percent, count(*) * 100.0::DOUBLE AS area FROM px GROUP BY 1")
def raster_report(spark, sf):
    return doubles(ra.report(grid(spark, sf), "k", 100.0))


@query(G + "SELECT CAST(dense_rank() OVER (ORDER BY k, m) AS INT) AS combination, k, m, count(*) AS pixels, count(*) * 100.0::DOUBLE AS area FROM px GROUP BY k, m")
def combination(spark, sf):
    return ra.combination(grid(spark, sf), ["k", "m"], 100.0)


@query(G + "SELECT r, c, CAST(dense_rank() OVER (ORDER BY k, m) AS INT) AS combination FROM px")
def combination_ids(spark, sf):
    return ra.combination_raster(grid(spark, sf), ["k", "m"])


@query(G + "SELECT k AS row_class, m AS column_class, count(*) AS pixels, CAST(sum(count(*)) OVER (PARTITION BY k) AS BIGINT) AS row_total, CAST(sum(count(*)) OVER (PARTITION BY m) AS BIGINT) AS column_total FROM px GROUP BY k, m")
def cross_class(spark, sf):
    return ra.cross_matrix(grid(spark, sf), "k", "m")


@query(G + "SELECT k, " + ", ".join(f"CAST(count(*) FILTER (m = {i}) AS BIGINT) AS \"{i}\"" for i in range(5)) + " FROM px GROUP BY k")
def cross_matrix(spark, sf):
    return tb.pivot(grid(spark, sf), "k", [("v", "count")], ["m"], cross_matrix=True, values=[(i,) for i in range(5)])


_CLASSES = E + ", x AS (SELECT cls AS ref, CAST((cls + CASE WHEN b1 > 0.1 THEN 1 ELSE 0 END) % 10 AS INT) AS got FROM pe), n AS (SELECT got, ref, count(*) AS n FROM x GROUP BY 1, 2), t AS (SELECT *, sum(n) OVER (PARTITION BY got) AS nr, sum(n) OVER (PARTITION BY ref) AS nc, sum(n) OVER () AS nn FROM n), e AS (SELECT *, nr / nn * n / nr AS p, nr / nn AS w FROM t) "


def _classified(spark, sf):
    return embed(spark, sf).selectExpr("cls AS ref", "CAST((cls + CASE WHEN b1 > 0.1 THEN 1 ELSE 0 END) % 10 AS INT) AS got")


@query(_CLASSES + "SELECT got AS row_class, ref AS column_class, n AS pixels, CAST(nr AS BIGINT) AS row_total, CAST(nc AS BIGINT) AS column_total, round(p, 8) AS p FROM e")
def error_matrix(spark, sf):
    return doubles(ra.error_matrix(_classified(spark, sf), "got", "ref"), 8)


@query(_CLASSES + ", a AS (SELECT got AS cls, sum(p) AS pr, coalesce(sum(p) FILTER (got = ref), 0) AS ps FROM e GROUP BY 1), b AS (SELECT ref AS cls, sum(p) AS pc, sqrt(sum(CASE WHEN nr > 1 THEN (w * p - p * p) / (nr - 1) END)) AS se FROM e GROUP BY 1), s AS (SELECT max(nn) AS nn, coalesce(sum(p) FILTER (got = ref), 0) AS o FROM e), u AS (SELECT cls, coalesce(pr, 0) AS pr, coalesce(ps, 0) AS ps, coalesce(pc, 0) AS pc, coalesce(se, 0) AS se, nn, o FROM a FULL JOIN b USING (cls), s) SELECT cls AS class, round(pc * nn * 100, 6) AS area, round(se * nn * 100, 6) AS standard_error, round(1.96 * se * nn * 100, 6) AS \"interval\", round(ps / nullif(pc, 0), 6) AS producer, round(ps / nullif(pr, 0), 6) AS \"user\", round((ps - pr * pc) / nullif(pr - pr * pc, 0), 6) AS kappa, round(o, 6) AS overall, round((o - sum(pr * pc) OVER ()) / (1 - sum(pr * pc) OVER ()), 6) AS kappa_overall FROM u")
def accuracy(spark, sf):
    return doubles(ra.accuracy(_classified(spark, sf), "got", "ref", 100.0))


@query(G + ", s AS (SELECT regr_slope(k, m) AS b, regr_intercept(k, m) AS a, regr_r2(k, m) AS r, count(*) AS n, regr_syy(k, m) AS yy, regr_sxy(k, m) AS xy FROM px) SELECT round(b, 6) AS slope, round(a, 6) AS intercept, round(r, 6) AS r2, n, round((yy - b * xy) / (n - 2), 6) AS variance, round(2 * sqrt((yy - b * xy) / (n - 2)), 6) AS \"interval\" FROM s")
def regression(spark, sf):
    return doubles(ra.regression(grid(spark, sf), "m", "k"))


@query(G + "SELECT z, count(vh) AS count, max(vh) AS max, round(avg(vh), 6) AS mean, round(median(vh), 6) AS median, min(vh) AS min, round(stddev_pop(vh), 6) AS std, round(sum(vh), 6) AS sum FROM px GROUP BY z")
def zonal_stats(spark, sf):
    return rounded(ra.zonal_stats(grid(spark, sf, holes=True), "z", "v"), "mean", "median", "std", "sum")


@query(G + "SELECT z, round(quantile_cont(vh, 0.1), 6) AS p10, round(quantile_cont(vh, 0.75), 6) AS p75 FROM px GROUP BY z")
def zonal_percentile(spark, sf):
    return doubles(ra.zonal_stats(grid(spark, sf, holes=True), "z", "v", [10, 75]).select("z", "p10", "p75"))


_BOXES = [(1, 2.0, -1.0, 12.0, -6.0, 5), (2, 10.0, -3.0, 30.0, -9.0, 8)]
_IN_BOX = " UNION ALL ".join(f"SELECT {f} AS fid, r, c, v, {v} AS value FROM px WHERE c + 0.5 > {a} AND c + 0.5 < {b} AND -(r + 0.5) < {t} AND -(r + 0.5) > {d}" for f, a, t, b, d, v in _BOXES)


@query(G + f"SELECT CAST(fid AS INT) AS fid, count(*) AS pixels, round(avg(v), 6) AS mean FROM ({_IN_BOX}) GROUP BY 1")
def zonal_box(spark, sf):
    return doubles(ve.pixels_in_polygons(grid(spark, sf).select("r", "c", "v"), ve.rectangles(spark, _BOXES)).groupBy("fid").agg(F.count("*").alias("pixels"), F.avg("v").alias("mean")))


@query(G + f"SELECT px.r, px.c, CAST(b.value AS INT) AS value FROM px LEFT JOIN (SELECT r, c, arg_max(value, fid) AS value FROM ({_IN_BOX}) GROUP BY 1, 2) b USING (r, c)")
def rasterize_box(spark, sf):
    return ve.rasterize(grid(spark, sf), ve.rectangles(spark, _BOXES), "value")


def _parcel_file(spark, sf) -> DataFrame:
    """The parcels, written as GeoJSON and read again."""
    path = shared_path(spark, "layer")
    vs.write_geojson(parcels(spark, sf), path, ["value"])
    return vs.read_geojson(spark, path, ["value"])


@query(f"SELECT min(s_suppkey * 37 % 100) + {min(x for x, _ in OUTLINE)} AS \"left\", max(s_suppkey * 37 % 100) + {max(x for x, _ in OUTLINE)} AS \"right\", -min(s_suppkey) - {min(y for _, y in OUTLINE)} AS top, -max(s_suppkey) - {max(y for _, y in OUTLINE)} AS bottom FROM supplier".replace(" AS ", "::DOUBLE AS "))
def layer_extent(spark, sf):
    return ve.layer_extent(_parcel_file(spark, sf))


@query("SELECT DISTINCT CAST(s_nationkey AS VARCHAR) AS value FROM supplier")
def vector_values(spark, sf):
    return ve.distinct_values(_parcel_file(spark, sf), "value")


@query(f"SELECT s_suppkey AS fid, CAST(i AS INT) AS part, h AS hole, CAST(n AS INT) AS points, CAST(s_nationkey AS VARCHAR) AS value, s_suppkey * 37 % 100 + x::DOUBLE AS x FROM supplier, (VALUES (0, false, {len(OUTLINE)}, {OUTLINE[0][0]}), (0, true, {len(HOLE)}, {HOLE[0][0]})) v(i, h, n, x)")
def geojson_layer(spark, sf):
    return _parcel_file(spark, sf).select("fid", "part", "hole", F.size("ring").alias("points"), "value", F.col("ring")[0]["x"].alias("x"))


_LEVEL = "SELECT CAST({k} AS INT) AS level, CAST(r // {b} AS INT) AS r, CAST(c // {b} AS INT) AS c, round(avg(vh), 6) AS average, max(vh) AS maximum, min(vh) AS minimum, max(CASE WHEN r % {b} = {h} AND c % {b} = {h} THEN vh END) AS nearest, count(vh) AS valid FROM px GROUP BY r // {b}, c // {b} HAVING count(vh) > 0"


@query(G + " UNION ALL ".join(_LEVEL.format(k=k, b=2**k, h=2 ** (k - 1)) for k in range(1, 6)))
def overviews(spark, sf):
    return rounded(pyramid(grid(spark, sf, holes=True), "v", 5), "average")


@query(G + "SELECT CAST(r // 8 AS INT) AS r, CAST(c // 8 AS INT) AS c, round(max(vh), 6) AS value FROM px GROUP BY ALL HAVING count(vh) > 0")
def overview_read(spark, sf):
    path = shared_path(spark, "overviews")
    so.write_overviews(grid(spark, sf, holes=True), "v", path, 4)
    return doubles(so.read_overview(spark, path, 12.0, "maximum"))


# ---- reprojection: the event grid in degrees, by thousandths from 8 E 47 N, and a UTM grid over it

_DEGREES, _UTM = warp.Grid(4326, (8.0, 47.0), (0.001, 0.001)), warp.Grid(32632, (423800.0, 5206300.0), (90.0, 90.0))
_SERIES = lambda f, g, terms, a="xi", b="eta": " + ".join(f"{f}({2 * j} * {a}) * {g}({2 * j} * {b}) * {v!r}::DOUBLE" for j, v in enumerate(terms, 1))
#: Of each UTM pixel the fractional row and column in the grid of degrees, by the inverse series.
_INVERSE = (
    f", t AS (SELECT CAST(i AS INT) AS r, CAST(j AS INT) AS c, (5206300.0 - (i + 0.5) * 90) / {pj.SCALE * pj._RADIUS!r}::DOUBLE AS xi, (423800.0 + (j + 0.5) * 90 - 500000) / {pj.SCALE * pj._RADIUS!r}::DOUBLE AS eta FROM range((SELECT CAST(max(r) * 1.3 + 20 AS INT) FROM px)) a(i), range(110) b(j)), "
    f"u AS (SELECT r, c, xi - ({_SERIES('sin', 'cosh', pj._BACK)}) AS up, eta - ({_SERIES('cos', 'sinh', pj._BACK)}) AS across FROM t), "
    f"d AS (SELECT r, c, asin(sin(up) / cosh(across)) AS chi, degrees(atan2(sinh(across), cos(up))) + 9 AS lon FROM u), "
    f"g AS (SELECT r, c, (47.0 - degrees(chi + {' + '.join(f'sin({2 * j} * chi) * {v!r}::DOUBLE' for j, v in enumerate(pj._LATITUDE, 1))})) / 0.001 AS y, (lon - 8.0) / 0.001 AS x FROM d)"
)


def _warped(spark, sf, method: str):
    px = grid(spark, sf, holes=True).select("r", "c", "v")
    rows = int(px.agg(F.max("r") * F.lit(1.3) + 20).first()[0] + 0.5)
    return warp.reproject(px, ["v"], _DEGREES, _UTM, rows, 110, method)


@query(G + _INVERSE + " SELECT g.r, g.c, px.vh AS v FROM g JOIN px ON px.r = floor(g.y) AND px.c = floor(g.x)")
def reproject_utm(spark, sf):
    return _warped(spark, sf, "nearest_neighbour")


@query(G + _INVERSE + ", n AS (SELECT g.r, g.c, sum(p.vh * (1 - abs(g.y - 0.5 - p.r)) * (1 - abs(g.x - 0.5 - p.c))) / sum((1 - abs(g.y - 0.5 - p.r)) * (1 - abs(g.x - 0.5 - p.c))) FILTER (p.vh IS NOT NULL) AS v FROM g JOIN px p ON p.r IN (floor(g.y - 0.5), floor(g.y - 0.5) + 1) AND p.c IN (floor(g.x - 0.5), floor(g.x - 0.5) + 1) GROUP BY 1, 2) SELECT g.r, g.c, CASE WHEN px.vh IS NOT NULL THEN round(n.v, 5) END AS v FROM g JOIN px ON px.r = floor(g.y) AND px.c = floor(g.x) JOIN n ON n.r = g.r AND n.c = g.c")
def reproject_bilinear(spark, sf):
    return doubles(_warped(spark, sf, "bilinear"), 5)


_FORWARD = (
    f", q AS (SELECT vh, radians(47.0 - (r + 0.5) * 0.001) AS phi, radians(8.0 + (c + 0.5) * 0.001 - 9) AS away FROM px), h AS (SELECT vh, away, sinh(atanh(sin(phi)) - {pj._E!r}::DOUBLE * atanh(sin(phi) * {pj._E!r}::DOUBLE)) AS t FROM q), "
    f"k AS (SELECT vh, atan2(t, cos(away)) AS xi, atanh(sin(away) / sqrt(1 + t * t)) AS eta FROM h), "
    f"m AS (SELECT vh, (eta + {_SERIES('cos', 'sinh', pj._FORWARD)}) * {pj.SCALE * pj._RADIUS!r}::DOUBLE + 500000 AS x, (xi + {_SERIES('sin', 'cosh', pj._FORWARD)}) * {pj.SCALE * pj._RADIUS!r}::DOUBLE AS y FROM k)"
)


@query(G + _FORWARD + " SELECT CAST(floor((5206300 - y) / 90) AS INT) AS r, CAST(floor((x - 423800) / 90) AS INT) AS c, round(avg(vh), 6) AS v FROM m WHERE floor((x - 423800) / 90) BETWEEN 0 AND 109 AND floor((5206300 - y) / 90) BETWEEN 0 AND (SELECT CAST(max(r) * 1.3 + 20 AS INT) - 1 FROM px) GROUP BY ALL")
def reproject_average(spark, sf):
    return doubles(_warped(spark, sf, "average"))


# ---- polygons with holes, from table rows

P = G + ", " + PARCEL_SQL + " "


@query(P + "SELECT fid, count(*) AS pixels, round(avg(v), 9) AS mean FROM inside GROUP BY 1")
def zonal_polygons(spark, sf):
    return doubles(ve.pixels_in_polygons(grid(spark, sf).select("r", "c", "v"), parcels(spark, sf)).groupBy("fid").agg(F.count("*").alias("pixels"), F.avg("v").alias("mean")), 9)


@query(P + "SELECT px.r, px.c, i.value FROM px LEFT JOIN (SELECT r, c, arg_max(val, fid) AS value FROM inside GROUP BY 1, 2) i USING (r, c)")
def rasterize_polygons(spark, sf):
    return ve.rasterize(grid(spark, sf), parcels(spark, sf), "value")


@query(P + ", b AS (SELECT r, c, arg_max(val, fid) AS ref FROM inside GROUP BY 1, 2) SELECT k AS row_class, ref AS column_class, count(*) AS pixels, CAST(sum(count(*)) OVER (PARTITION BY k) AS BIGINT) AS row_total, CAST(sum(count(*)) OVER (PARTITION BY ref) AS BIGINT) AS column_total FROM px JOIN b USING (r, c) GROUP BY k, ref")
def cross_polygons(spark, sf):
    return ve.cross_with_features(grid(spark, sf).select("r", "c", "k"), "k", parcels(spark, sf), "value")


#: The part (0 to 1) of an edge that lies within a pixel.
_PART = "greatest(0, least((c - ax) / (zx - ax), (c + 1 - ax) / (zx - ax)), least((r - ay) / (zy - ay), (r + 1 - ay) / (zy - ay))) AS t0, least(1, greatest((c - ax) / (zx - ax), (c + 1 - ax) / (zx - ax)), greatest((r - ay) / (zy - ay), (r + 1 - ay) / (zy - ay))) AS t1"


@query(P + f", t AS (SELECT r, c, fid, val FROM (SELECT r, c, fid, val, {_PART} FROM q) WHERE t0 < t1 UNION SELECT r, c, fid, val FROM inside) SELECT px.r, px.c, i.value FROM px LEFT JOIN (SELECT r, c, arg_max(val, fid) AS value FROM t GROUP BY 1, 2) i USING (r, c)")
def rasterize_touched(spark, sf):
    return ve.rasterize(grid(spark, sf), parcels(spark, sf), "value", touched=True)


#: What lies right of an edge in a pixel: the integral of its clamped distance from the pixel's right side, signed by direction.
_COVER = (
    ", b AS (SELECT r, c, fid, val, hole, ax + (zx - ax) * (y1 - ay) / (zy - ay) AS x1, ax + (zx - ax) * (y2 - ay) / (zy - ay) AS x2, y1, y2 FROM (SELECT *, greatest(r, least(r + 1, ay)) AS y1, greatest(r, least(r + 1, zy)) AS y2 FROM q)), "
    "h AS (SELECT *, c + 1 - x1 AS u1, c + 1 - x2 AS u2 FROM b WHERE y1 <> y2), "
    "w AS (SELECT r, c, fid, val, (y2 - y1) * ((CASE WHEN u2 < 0 THEN 0 WHEN u2 < 1 THEN u2 * u2 / 2 ELSE u2 - 0.5 END) - (CASE WHEN u1 < 0 THEN 0 WHEN u1 < 1 THEN u1 * u1 / 2 ELSE u1 - 0.5 END)) / (u2 - u1) AS a, hole FROM h), "
    "g AS (SELECT r, c, val, sum(cover) AS cover FROM (SELECT r, c, fid, val, abs(sum(a) FILTER (NOT hole)) - coalesce(abs(sum(a) FILTER (hole)), 0) AS cover FROM w GROUP BY 1, 2, 3, 4) WHERE cover > 1e-9 GROUP BY 1, 2, 3), "
    "m AS (SELECT r, c, val, round(cover, 9) AS cover, row_number() OVER (PARTITION BY r, c ORDER BY round(cover, 9) DESC, val) AS i FROM g) "
)


@query(P + _COVER + "SELECT px.r, px.c, m.val AS value, round(m.cover, 6) AS cover FROM px LEFT JOIN m ON m.r = px.r AND m.c = px.c AND m.i = 1")
def rasterize_area(spark, sf):
    return doubles(ve.rasterize_area(grid(spark, sf), parcels(spark, sf), "value", "hole"))


@query(f"WITH {PLOT_SQL} SELECT value, count(*)::DOUBLE AS area, sum((SELECT count(*) FROM (VALUES (1, 0), (-1, 0), (0, 1), (0, -1)) d(i, j) WHERE (u.value, u.x + i, u.y + j) NOT IN (SELECT (value, x, y) FROM u)))::DOUBLE AS border FROM u GROUP BY 1")
def dissolve_polygons(spark, sf):
    return doubles(ve.union_features(plots(spark, sf), "value").select("value", "area", "border"))


# ---- neighborhoods

_NEAR = G + "SELECT a.r, a.c, {} AS value FROM px a JOIN px b ON b.r BETWEEN a.r - 1 AND a.r + 1 AND b.c BETWEEN a.c - 1 AND a.c + 1 GROUP BY a.r, a.c, a.vh"


def _near(stat: str, sql: str):
    def run(spark, sf):
        return doubles(nb.neighbor_stat(grid(spark, sf, holes=True), "v", stat, 1))

    run.__name__ = f"neighbor_{stat}" if stat != "stddev" else "neighbor_std"
    query(_NEAR.format(f"CASE WHEN a.vh IS NOT NULL THEN round({sql}, 6) END"))(run)


for _m, _s in {"sum": "sum(b.vh)", "mean": "avg(b.vh)", "max": "max(b.vh)", "min": "min(b.vh)", "count": "CAST(count(b.vh) AS DOUBLE)", "median": "median(b.vh)", "stddev": "stddev_pop(b.vh)", "percentile": "quantile_cont(b.vh, 0.5)"}.items():
    _near(_m, _s)


@query(G + "SELECT a.r, a.c, CASE WHEN a.k IN (3, 4) THEN a.k ELSE coalesce(max(b.k) FILTER (b.k IN (3, 4)), a.k) END AS value FROM px a JOIN px b ON b.r BETWEEN a.r - 1 AND a.r + 1 AND b.c BETWEEN a.c - 1 AND a.c + 1 GROUP BY a.r, a.c, a.k")
def dilation(spark, sf):
    return nb.dilation(grid(spark, sf), "k", [3, 4], 1)


@query(G + ", n AS (SELECT a.r, a.c, a.k, b.k AS nk, count(*) AS n FROM px a JOIN px b ON b.r BETWEEN a.r - 1 AND a.r + 1 AND b.c BETWEEN a.c - 1 AND a.c + 1 GROUP BY 1, 2, 3, 4), s AS (SELECT r, c, k, count(*) AS kinds, first(nk ORDER BY n DESC, nk) FILTER (nk NOT IN (0, 1)) AS best FROM n GROUP BY 1, 2, 3) SELECT r, c, CASE WHEN k IN (0, 1) AND kinds > 1 THEN best ELSE k END AS value FROM s")
def erosion(spark, sf):
    return nb.erosion(grid(spark, sf), "k", [0, 1], 1)


_PATCH = "WITH RECURSIVE " + GRID_SQL + ", f AS (SELECT r, c, r * 100 + c AS id FROM px WHERE k >= 2), w(id, to_id) AS (SELECT id, id FROM f UNION SELECT w.id, n.id FROM w JOIN f p ON p.id = w.to_id JOIN f n ON abs(n.r - p.r) + abs(n.c - p.c) = 1) "


@query(_PATCH + "SELECT CAST(f.r AS INT) AS r, CAST(f.c AS INT) AS c, count(*) AS value FROM w JOIN f USING (id) GROUP BY 1, 2")
def label(spark, sf):
    return nb.label(grid(spark, sf).selectExpr("r", "c", "CAST(k >= 2 AS INT) AS f"), "f", COLUMNS)


@query(_PATCH + ", m AS (SELECT id, min(to_id) AS patch FROM w GROUP BY 1) SELECT CAST(patch AS BIGINT) AS region, CAST(1 AS INT) AS value, count(*) AS pixels, CAST(min(r) AS INT) AS top, CAST(max(r) AS INT) AS bottom, CAST(min(c) AS INT) AS \"left\", CAST(max(c) AS INT) AS \"right\" FROM m JOIN f USING (id) GROUP BY patch")
def region_stats(spark, sf):
    return nb.region_stats(grid(spark, sf).where("k >= 2").selectExpr("r", "c", "1 AS f"), "f", COLUMNS)


_SIEVE = "WITH RECURSIVE " + GRID_SQL + ", f AS (SELECT r, c, k, r * 100 + c AS id FROM px), w(id, to_id, k) AS (SELECT id, id, k FROM f UNION SELECT w.id, n.id, w.k FROM w JOIN f p ON p.id = w.to_id JOIN f n ON abs(n.r - p.r) + abs(n.c - p.c) = 1 AND n.k = w.k), m AS (SELECT id, min(to_id) AS patch, count(*) AS n FROM w GROUP BY 1), g AS (SELECT f.*, m.patch, m.n FROM f JOIN m USING (id)), "


#: Too slow for whole tables of any size: every pair of a patch's pixels; a test runs it on the smallest.
SIEVE_SQL = _SIEVE + "b AS (SELECT DISTINCT x.patch AS a, y.k, y.n FROM g x JOIN g y ON abs(x.r - y.r) + abs(x.c - y.c) = 1 AND x.patch <> y.patch WHERE x.n < 3), t AS (SELECT a, first(k ORDER BY n DESC, k) AS k FROM b GROUP BY 1) SELECT CAST(g.r AS INT) AS r, CAST(g.c AS INT) AS c, coalesce(t.k, g.k) AS value FROM g LEFT JOIN t ON t.a = g.patch"


@query()
def sieve(spark, sf):
    return nb.sieve(grid(spark, sf), "k", 3, COLUMNS)


_GROW = "WITH RECURSIVE " + GRID_SQL + ", s AS (SELECT v FROM px WHERE r = 4 AND c = 50), b AS (SELECT r, c, v FROM px WHERE r BETWEEN -46 AND 54 AND c BETWEEN 0 AND 100), w(step, r, c) AS (SELECT CAST(i AS INT), 4, 50 FROM range(1, 11) t(i) UNION SELECT w.step, b.r, b.c FROM w JOIN b ON abs(b.r - w.r) + abs(b.c - w.c) = 1 JOIN s ON abs(b.v - s.v) <= 60.0::DOUBLE * w.step / 10), n AS (SELECT step, count(*) AS n FROM w GROUP BY 1), p AS (SELECT coalesce(min(step) FILTER (n >= 20), 10) AS step FROM n) "


@query(_GROW + "SELECT CAST(r AS INT) AS r, CAST(c AS INT) AS c FROM w JOIN p USING (step)")
def region_threshold(spark, sf):
    return nb.region_growing(grid(spark, sf), "v", (4, 50), 60.0, 20, COLUMNS)


@query()
def region_growing_bands(spark, sf):
    """A region for each supplier, from its place in the grid, by two bands."""
    seeds = table(spark, sf, "supplier").selectExpr("s_suppkey AS id", "CAST(s_suppkey AS INT) AS r", "CAST(s_suppkey * 37 % 100 AS INT) AS c")
    return nb.grow_regions(grid(spark, sf), ["v", "m"], seeds, 1.0, 12, 21)


@query(_PATCH + ", m AS (SELECT id, min(to_id) AS patch FROM w GROUP BY 1) SELECT CAST(m.patch AS BIGINT) AS region, CAST(1 AS INT) AS value, CAST(f.r AS INT) AS r, CAST(f.c AS INT) AS c, side FROM f JOIN m USING (id), (VALUES ('N', -1, 0), ('E', 0, 1), ('S', 1, 0), ('W', 0, -1)) v(side, i, j) WHERE NOT EXISTS (SELECT 1 FROM f n WHERE n.r = f.r + i AND n.c = f.c + j)")
def raster_to_vector(spark, sf):
    return nb.region_edges(grid(spark, sf).where("k >= 2").selectExpr("r", "c", "1 AS f"), "f", COLUMNS)


# ---- distances and classifiers


def _dist(k: str) -> str:
    return "sqrt(" + " + ".join(f"(p.{b} - s.{b}) * (p.{b} - s.{b})" for b in BANDS) + ")" if k == "md" else "degrees(acos(greatest(-1, least(1, (" + " + ".join(f"p.{b} * s.{b}" for b in BANDS) + ") / nullif(sqrt((" + " + ".join(f"p.{b} * p.{b}" for b in BANDS) + ") * (" + " + ".join(f"s.{b} * s.{b}" for b in BANDS) + ")), 0)))))"


_SIGS = E + ", s AS (SELECT cls, " + ", ".join(f"avg({b}) AS {b}" for b in BANDS) + " FROM pe GROUP BY 1) "


def _signatures(spark, sf):
    s = sp.signatures(embed(spark, sf), "cls", BANDS)
    return s.select("cls", *(F.col(f"mean_{b}").alias(b) for b in BANDS))


@query(E + "SELECT r, c, round(sqrt((b1 - b4) * (b1 - b4) + (b2 - b5) * (b2 - b5) + (b3 - b6) * (b3 - b6)), 6) AS distance FROM pe")
def spectral_dist(spark, sf):
    return doubles(sp.spectral_distance(embed(spark, sf), BANDS[:3], BANDS[3:]))


@query(E + "SELECT r, c, round(degrees(acos(greatest(-1, least(1, (b1 * b4 + b2 * b5 + b3 * b6) / nullif(sqrt((b1 * b1 + b2 * b2 + b3 * b3) * (b4 * b4 + b5 * b5 + b6 * b6)), 0))))), 4) AS distance FROM pe")
def spectral_angle(spark, sf):
    return doubles(sp.spectral_distance(embed(spark, sf), BANDS[:3], BANDS[3:], "sam"), 4)


@query(E + "SELECT r, c, CAST(sqrt((b1 - b4) * (b1 - b4) + (b2 - b5) * (b2 - b5) + (b3 - b6) * (b3 - b6)) > 0.3 AS INT) AS distance FROM pe")
def dist_threshold(spark, sf):
    return sp.spectral_distance(embed(spark, sf), BANDS[:3], BANDS[3:], threshold=0.3)


def _sig(column: str, sql: str):
    def run(spark, sf):
        return doubles(sp.signature_pairs(_signatures(spark, sf), "cls", BANDS).select("a", "b", column), 4)

    run.__name__ = {"euclidean": "sig_euclid", "angle": "sig_angle", "bray_curtis": "sig_braycurtis"}[column]
    query(_SIGS + f"SELECT p.cls AS a, s.cls AS b, round({sql}, 4) AS {column} FROM s p JOIN s ON p.cls < s.cls")(run)


_sig("euclidean", _dist("md"))
_sig("angle", _dist("sam"))
_sig("bray_curtis", "100 - 100 * (" + " + ".join(f"abs(p.{b} - s.{b})" for b in BANDS) + ") / nullif(" + " + ".join(f"p.{b} + s.{b}" for b in BANDS) + ", 0)")


def _classify(name: str, algorithm: str, threshold: float | None = None):
    def run(spark, sf):
        return doubles(sp.classify(embed(spark, sf), _signatures(spark, sf), "cls", BANDS, algorithm, threshold), 4)

    run.__name__ = name
    limit = "" if threshold is None else f" AND d <= {threshold}"
    query(_SIGS + f", q AS (SELECT p.r, p.c, s.cls, {_dist(algorithm)} AS d FROM pe p, s), o AS (SELECT *, row_number() OVER (PARTITION BY r, c ORDER BY d, cls) AS i FROM q) SELECT r, c, CASE WHEN true{limit} THEN cls END AS class, CASE WHEN true{limit} THEN round(d, 4) END AS distance FROM o WHERE i = 1")(run)


_classify("classify_md", "md")
_classify("classify_sam", "sam")
_classify("classify_threshold", "md", 0.28)


_LIKELY = E + ", s AS (SELECT cls, avg(b1) AS x, avg(b2) AS y, covar_samp(b1, b1) AS a, covar_samp(b1, b2) AS b, covar_samp(b2, b2) AS c FROM pe GROUP BY 1), q AS (SELECT r, c, s.cls, -ln(a * s.c - b * b) - (s.c * (b1 - x) * (b1 - x) - 2 * b * (b1 - x) * (b2 - y) + a * (b2 - y) * (b2 - y)) / (a * s.c - b * b) AS l FROM (SELECT r, c, b1, b2 FROM pe) p, (SELECT cls, x, y, a, b, c AS c FROM s) s)".replace("r, c, s.cls", "p.r, p.c, s.cls")


@query(_LIKELY + ", o AS (SELECT *, row_number() OVER (PARTITION BY r, c ORDER BY l DESC, cls) AS i FROM q) SELECT r, c, cls AS class, round(l, 6) AS likelihood FROM o WHERE i = 1")
def classify_ml(spark, sf):
    px = embed(spark, sf)
    return doubles(sp.classify_likelihood(px, px, "cls", BANDS[:2]))


@query(_LIKELY + f", d AS (SELECT q.*, ln(a * s.c - b * b) AS e FROM q JOIN s USING (cls)), o AS (SELECT r, c, arg_max(cls, (l, -cls)) AS class, round(max(l), 6) AS likelihood FROM d WHERE -(l + e) <= {-2 * math.log(0.4)!r} GROUP BY 1, 2) SELECT pe.r, pe.c, o.class, o.likelihood FROM pe LEFT JOIN o ON o.r = pe.r AND o.c = pe.c")
def classify_ml_chi_square(spark, sf):
    px = embed(spark, sf)
    return doubles(sp.classify_likelihood(px, px, "cls", BANDS[:2], percent=40))


@query()
def classify_network(spark, sf):
    px = embed(spark, sf)
    return sp.train_network(px, BANDS, "cls", 10, [32], steps=20, batches=4).predict(px)


@query()
def cross_validated(spark, sf):
    """Share of right classes by the parameters that do best over folds."""
    from pyspark.ml.tuning import ParamGridBuilder

    px = embed(spark, sf)
    pipeline = sp.learner("random_forest", BANDS, "cls", trees=5)
    grid = ParamGridBuilder().addGrid(pipeline.getStages()[-1].maxDepth, [2, 5]).build()
    return sp.predict(sp.cross_validate(pipeline, grid, px, "cls", 3).bestModel, px)


@query()
def classify_random_forest(spark, sf):
    px = embed(spark, sf)
    return sp.predict(sp.learner("random_forest", BANDS, "cls", trees=10).fit(px), px)


@query()
def classify_svm(spark, sf):
    px = embed(spark, sf)
    return sp.predict(sp.learner("svm", BANDS, "cls").fit(px), px)


@query()
def classify_mlp(spark, sf):
    px = embed(spark, sf)
    return sp.predict(sp.learner("mlp", BANDS, "cls", hidden=[16], classes=10, max_iter=30).fit(px), px)


@query(E + ", a AS (SELECT avg(b1) AS m, stddev_pop(b1) AS s FROM pe) SELECT r, c, round((b1 - m) / (s + 1e-6), 6) AS b1 FROM pe, a")
def norm_zscore(spark, sf):
    return doubles(sp.normalize(embed(spark, sf).select("r", "c", "b1"), ["b1"]))


@query(E + ", a AS (SELECT min(b1) AS lo, max(b1) AS hi FROM pe) SELECT r, c, round((b1 - lo) / (hi - lo), 6) AS b1 FROM pe, a")
def norm_linear(spark, sf):
    return doubles(sp.normalize(embed(spark, sf).select("r", "c", "b1"), ["b1"], "linear"))


@query(E + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(covar_samp({a}, {b}), 8) AS covariance FROM pe" for i, a in enumerate(BANDS) for b in BANDS[i:]))
def pca_cov(spark, sf):
    return doubles(sp.covariance(embed(spark, sf), BANDS).drop("correlation"), 8)


_PCA = ", m AS (SELECT avg(b1) AS x, avg(b2) AS y, covar_samp(b1, b1) AS a, covar_samp(b1, b2) AS b, covar_samp(b2, b2) AS d FROM pe), l AS (SELECT *, (a + d) / 2 + sqrt((a - d) * (a - d) / 4 + b * b) AS v FROM m), u AS (SELECT *, b / sqrt(b * b + (v - a) * (v - a)) AS p, (v - a) / sqrt(b * b + (v - a) * (v - a)) AS q FROM l), w AS (SELECT x, y, p * s AS p, q * s AS q, CASE WHEN abs(p) > abs(q) THEN sign(p * s) ELSE sign(-q * s) END AS t FROM (SELECT *, CASE WHEN abs(p) > abs(q) THEN sign(p) ELSE sign(q) END AS s FROM u))"


@query(E + _PCA + " SELECT r, c, round((b1 - x) * p + (b2 - y) * q, 6) AS pc1, round(t * (-(b1 - x) * q + (b2 - y) * p), 6) AS pc2 FROM pe, w")
def pca_scores(spark, sf):
    return doubles(sp.principal_components(embed(spark, sf), BANDS[:2], 2)[0])


_SEEDS = E + ", m AS (SELECT min(b1) AS l1, max(b1) AS h1, min(b2) AS l2, max(b2) AS h2 FROM pe), s AS (SELECT CAST(i + 1 AS INT) AS k, l1 + (i + 0.5) * (h1 - l1) / 3 AS x, l2 + (i + 0.5) * (h2 - l2) / 3 AS y FROM m, range(3) t(i)), q AS (SELECT r, c, b1, b2, k, sqrt((b1 - x) * (b1 - x) + (b2 - y) * (b2 - y)) AS d FROM pe, s), o AS (SELECT *, row_number() OVER (PARTITION BY r, c ORDER BY d, k) AS i FROM q) "


@query(_SEEDS + "SELECT r, c, k AS cluster, round(d, 6) AS distance FROM o WHERE i = 1")
def cluster_assign(spark, sf):
    px = embed(spark, sf)
    return doubles(sp.assign_clusters(px, sp.range_seeds(px, ["b1", "b2"], 3), ["b1", "b2"]))


@query(_SEEDS + "SELECT k AS cluster, count(*) AS pixels, round(avg(b1), 6) AS b1, round(avg(b2), 6) AS b2 FROM o WHERE i = 1 GROUP BY k")
def cluster_update(spark, sf):
    px = embed(spark, sf)
    return doubles(sp.update_clusters(px, sp.range_seeds(px, ["b1", "b2"], 3), ["b1", "b2"]))


@query()
def classify_svm_radial(spark, sf):
    px = embed(spark, sf)
    return sp.radial_machine(px, BANDS, "cls").predict(px).select("r", "c", "class")


@query()
def cluster_parallel_seeds(spark, sf):
    return sp.cluster(embed(spark, sf), BANDS, 4, max_iter=5, seeds="parallel")[0].select("r", "c", "cluster")


@query()
def cluster_kmeans(spark, sf):
    return sp.cluster(embed(spark, sf), ["b1", "b2"], 3)[0].select("r", "c", "cluster")


# ---- preprocessing


def _pre(name: str, f: Callable, sql: str, places: int = 6):
    def run(spark, sf):
        return doubles(grid(spark, sf, holes=True).select("r", "c", f(F.col("v")).alias("v")), places)

    run.__name__ = name
    query(G + f"SELECT r, c, round(CASE WHEN vh IS NOT NULL THEN {sql} END, {places}) AS v FROM px")(run)


_pre("toa_s2", lambda v: pp.linear(v, 1 / 200, -0.1), "greatest(0, least(1, vh / 200 - 0.1))")
_pre("toa_reflectance", lambda v: pp.top_of_atmosphere(v, 0.002, -0.1, 40.0), f"greatest(0, least(1, (vh * 0.002 - 0.1) / {math.sin(math.radians(40.0))!r}))")
_pre("sr_l2", lambda v: pp.linear(v, 0.00275, -0.2), "greatest(0, least(1, vh * 0.00275 - 0.2))", 9)  # values of two decimals: at six places many are ties
_pre("brightness_temp", lambda v: pp.brightness_temperature(v, 0.0003342, 0.1, 774.8853, 1321.0789), "1321.0789 / ln(1 + 774.8853 / (vh * 0.0003342 + 0.1))")
_pre("hls_non_negative", lambda v: pp.non_negative(v - 50), "greatest(vh - 50, 0)")


@query(G + ", n AS (SELECT vh, count(*) AS n FROM px WHERE vh IS NOT NULL GROUP BY 1), q AS (SELECT vh, sum(n) OVER (ORDER BY vh ROWS UNBOUNDED PRECEDING) AS run, sum(n) OVER () AS t FROM n), d AS (SELECT min(vh) AS d FROM q WHERE run >= t * 0.0001) SELECT r, c, round(CASE WHEN vh IS NOT NULL THEN greatest(0, least(1, vh * 0.002 - (0.002 * d - 0.01))) END, 6) AS v FROM px, d")
def dos1(spark, sf):
    px = grid(spark, sf, holes=True)
    dark = ra.dark_object(px, "v").first()[0]
    return doubles(px.select("r", "c", pp.dark_object_subtraction(F.col("v"), 0.002, dark).alias("v")))


def _metadata(spark, sf) -> str:
    """A product's metadata for each event type, made from its events: quantification values and offsets by type."""
    path = shared_path(spark, "metadata")
    rows = table(spark, sf, "events").groupBy("event_type").agg(F.max("user_id").alias("u"), F.length("event_type").alias("n"))
    level = F.when(F.col("n") % 2 == 0, "Level-2A").otherwise("Level-1C")
    tag = F.when(F.col("n") % 2 == 0, "BOA").otherwise("RADIO")
    value = F.when(F.col("n") % 2 == 0, "BOA_QUANTIFICATION_VALUE").otherwise("QUANTIFICATION_VALUE")
    offsets = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(12)), lambda i: F.concat(F.lit("<"), tag, F.lit('_ADD_OFFSET band_id="'), i.cast("string"), F.lit('">'), (-(F.col("n") + i)).cast("string"), F.lit("</"), tag, F.lit("_ADD_OFFSET>"))), "\n")
    xml = F.concat(F.lit("<n1:Product><PRODUCT_START_TIME>2024-0"), (F.col("n") % 9 + 1).cast("string"), F.lit("-05T10:00:00Z</PRODUCT_START_TIME><PROCESSING_LEVEL>"), level, F.lit("</PROCESSING_LEVEL><"), value, F.lit(' unit="none">'), (F.col("n") * 100).cast("string"), F.lit("</"), value, F.lit(">"), offsets, F.lit("</n1:Product>"))
    rows.select(F.col("event_type").alias("product"), xml.alias("value")).repartition("product").write.partitionBy("product").text(path)
    return path


_PRODUCTS = "m AS (SELECT event_type AS product, b, length(event_type) AS n, 1 / (length(event_type) * 100.0::DOUBLE) AS scale, -(length(event_type) + i) * (1 / (length(event_type) * 100.0::DOUBLE)) AS o FROM (SELECT DISTINCT event_type FROM events), (VALUES " + ", ".join(f"('{b}', {i})" for i, b in enumerate(so.S2_BANDS)) + ") v(b, i))"


def _products(spark, sf) -> DataFrame:
    path = _metadata(spark, sf)
    kinds = [r[0] for r in table(spark, sf, "events").select("event_type").distinct().collect()]
    out = None
    for k in sorted(kinds):  # a product a type
        one = so.sentinel2_products(spark, f"{path}/product={k}").withColumn("product", F.lit(k))
        out = one if out is None else out.union(one)
    return out


@query(f"WITH {_PRODUCTS} SELECT product, make_date(2024, n % 9 + 1, 5) AS \"date\", CASE WHEN n % 2 = 0 THEN 'Level-2A' ELSE 'Level-1C' END AS level, b AS band, round(scale, 9) AS scale, round(o, 9) AS \"offset\" FROM m")
def sentinel2_metadata(spark, sf):
    return doubles(_products(spark, sf), 9)


@query(G + f", {_PRODUCTS}, p AS (SELECT z AS product, lpad(CAST(m + 1 AS VARCHAR), 2, '0') AS band, r, c, v FROM px) SELECT p.product, p.band, p.r, p.c, round(greatest(0, least(1, p.v * m.scale + m.o)), 9) AS v FROM p JOIN m ON m.product = p.product AND m.b = p.band")
def preprocess_sentinel2(spark, sf):
    px = grid(spark, sf).select(F.col("z").alias("product"), F.lpad((F.col("m") + 1).cast("string"), 2, "0").alias("band"), "r", "c", "v")
    return doubles(pp.reflectance(px, _products(spark, sf), "v"), 9)


@query(G + f", {_PRODUCTS}, p AS (SELECT z AS product, lpad(CAST(m + 1 AS VARCHAR), 2, '0') AS band, r, c, v, min(v) OVER (PARTITION BY z, m) AS low FROM px) SELECT p.product, p.band, p.r, p.c, round(greatest(0, least(1, (p.v - low) * m.scale + 0.01)), 9) AS v FROM p JOIN m ON m.product = p.product AND m.b = p.band")
def preprocess_dos1(spark, sf):
    px = grid(spark, sf).select(F.col("z").alias("product"), F.lpad((F.col("m") + 1).cast("string"), 2, "0").alias("band"), "r", "c", "v")
    return doubles(pp.reflectance(px, _products(spark, sf), "v", dark=True), 9)


@query("SELECT o_orderkey, CAST(o_orderdate AS DATE) AS \"date\" FROM orders")
def date_from_path(spark, sf):
    path = F.concat(F.lit("/data/S2_"), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("/B02.tif"))
    return table(spark, sf, "orders").select("o_orderkey", pp.date_from_path(path).alias("date"))


@query("SELECT CAST(o_orderkey AS VARCHAR) AS product_id, CAST(o_orderdate AS DATE) AS acquisition_date FROM orders WHERE CAST(o_orderdate AS DATE) BETWEEN DATE '1995-01-01' AND DATE '1995-12-31' AND o_custkey % 100 <= 30 AND contains(CAST(o_orderkey AS VARCHAR), '1') ORDER BY 2, 1 LIMIT 50")
def product_search(spark, sf):
    products = table(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("product_id"), F.to_date("o_orderdate").alias("acquisition_date"), (F.col("o_custkey") % 100).alias("cloud_cover"))
    return pp.search_products(products, "1995-01-01", "1995-12-31", 30, name="1", limit=50).select("product_id", "acquisition_date")


@query("SELECT 'https://example.org/' || o_orderstatus || '/' || o_orderkey || '/B02.tif' AS url FROM orders")
def product_urls(spark, sf):
    products = table(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("product_id"), F.col("o_orderstatus").alias("collection"))
    return pp.product_urls(products, "https://example.org", ["B02"]).select("url")


# ---- files, catalogs and polygons


def _csv(name: str, decimals: int, where: str = ""):
    def run(spark, sf):
        path = shared_path(spark, name)
        so.write_text(table(spark, sf, "part").select("p_partkey", "p_name", "p_retailprice"), path, decimals=decimals, separator=";")
        return so.open_text(spark, path, ";")

    run.__name__ = name
    query(f"SELECT p_partkey, p_name, round(p_retailprice, {decimals}) AS p_retailprice FROM part")(run)


_csv("scan_csv", 6)


@query(G + "SELECT r, c, CASE WHEN vh IS NOT NULL THEN round(vh, 2) END AS v FROM px")
def write_raster(spark, sf):
    path = shared_path(spark, "raster")
    so.write_raster(doubles(grid(spark, sf, holes=True).select("r", "c", "v"), 2), path, nodata=-32768, scale=0.01, kind="int")
    return doubles(so.read_raster(spark, path, nodata=-32768, scale=0.01), 2)


@query(G + "SELECT r, c, vh AS v FROM px")
def copy_raster(spark, sf):
    one, two = shared_path(spark, "raster"), shared_path(spark, "copy")
    so.write_raster(grid(spark, sf, holes=True).select("r", "c", "v"), one, kind="double")
    re.copy_raster(spark, one, two, kind="double")
    return so.read_raster(spark, two)


@query(E + ", s AS (SELECT cls, " + ", ".join(f"avg({b}) AS {b}, stddev_pop({b}) AS d{b}" for b in BANDS[:2]) + f" FROM pe GROUP BY 1) SELECT cls, CAST({WAVELENGTHS[0]} AS DOUBLE) AS wavelength, round(b1, 8) AS value, round(db1, 8) AS standard_deviation FROM s UNION ALL SELECT cls, CAST({WAVELENGTHS[1]} AS DOUBLE), round(b2, 8), round(db2, 8) FROM s")
def signature_files(spark, sf):
    path = shared_path(spark, "signatures")
    re.write_signatures(re.spectra(sp.signatures(embed(spark, sf), "cls", BANDS[:2]), "cls", BANDS[:2], WAVELENGTHS[:2]), path)
    return doubles(re.read_signatures(spark, path).withColumn("cls", F.col("cls").cast("int")), 8)


@query(_SIGS + f", q AS (SELECT p.r, p.c, s.cls, {_dist('md')} AS d FROM pe p, s), o AS (SELECT *, row_number() OVER (PARTITION BY r, c ORDER BY d, cls) AS i FROM q) SELECT r, c, cls AS class, round(d, 4) AS distance FROM o WHERE i = 1")
def classify_from_file(spark, sf):
    """Signatures written to a file, read back and used."""
    path = shared_path(spark, "signatures")
    px = embed(spark, sf)
    re.write_signatures(re.spectra(sp.signatures(px, "cls", BANDS), "cls", BANDS, WAVELENGTHS), path)
    sig = re.from_spectra(re.read_signatures(spark, path).withColumn("cls", F.col("cls").cast("int")), "cls", BANDS, WAVELENGTHS)
    return doubles(sp.classify(px, sig, "cls", BANDS), 4)


@query(G + "SELECT CAST(row_number() OVER (ORDER BY avg(v)) AS INT) AS band_number, z AS name, round(avg(v), 6) AS wavelength FROM px GROUP BY z")
def bandset_create(spark, sf):
    """A band for each event type, in the order of its mean value."""
    waves = sorted((r.z, r.w) for r in grid(spark, sf).groupBy("z").agg(F.avg("v").alias("w")).collect())  # a row a type
    wide = grid(spark, sf).select("r", "c", *(F.when(F.col("z") == z, F.col("v")).alias(z) for z, _ in waves))
    return doubles(cat.BandSet.create(wide, [w for _, w in waves]).bands.select("band_number", "name", "wavelength"))


@query(f"WITH {BANDS_SQL} SELECT band_number, name, wavelength FROM bt")
def bandset_xml(spark, sf):
    path = shared_path(spark, "bandset")
    re.write_xml(bands(spark, sf), path, "bandset", "band")
    return re.read_xml(spark, path, "band", cat.BAND_SCHEMA).select("band_number", "name", "wavelength")


@query("SELECT CAST(o_orderkey AS VARCHAR) AS product_id, CAST(o_orderdate AS DATE) AS acquisition_date, CAST(o_custkey % 100 AS DOUBLE) AS cloud_cover FROM orders")
def product_xml(spark, sf):
    path = shared_path(spark, "products")
    products = table(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("product_id"), F.to_date("o_orderdate").alias("acquisition_date"), (F.col("o_custkey") % 100).cast("double").alias("cloud_cover"))
    re.write_xml(products, path, "products", "product")
    return re.read_xml(spark, path, "product", products.schema)


@query("SELECT '<tr><td>' || n_nationkey || '</td><td>' || n_name || '</td></tr>' AS html FROM nation")
def html_table(spark, sf):
    return re.html_rows(table(spark, sf, "nation"), ["n_nationkey", "n_name"])


@query("SELECT DISTINCT '/data/' || event_type AS folder, event_type || '.TIF' AS file, event_type AS name, 'tif' AS ending, 'raster' AS kind FROM events")
def path_parts(spark, sf):
    path = F.concat(F.lit("/data/"), "event_type", F.lit("/"), "event_type", F.lit(".TIF"))
    return table(spark, sf, "events").select(*(x.alias(n) for n, x in re.path_parts(path).items()), re.kind_of(path).alias("kind")).distinct()


@query("SELECT n_nationkey, printf('#%02x%02x%02x', n_nationkey, n_regionkey * 50, 255 - n_nationkey) AS colour, n_regionkey * 50 AS green FROM nation")
def colours(spark, sf):
    colour = re.hex_colour(F.col("n_nationkey"), F.col("n_regionkey") * 50, 255 - F.col("n_nationkey"))
    return table(spark, sf, "nation").select("n_nationkey", colour.alias("colour"), re.colour_parts(colour)[1].alias("green"))


_S2 = "(VALUES " + ", ".join(f"('{n}', {w})" for n, w in cat.SENSORS["Sentinel-2"]) + ") t(name, wavelength)"


@query(f"WITH {BANDS_SQL}, s AS (SELECT * FROM (VALUES ('01', 0.443), ('02', 0.49), ('03', 0.56), ('04', 0.665), ('05', 0.705), ('06', 0.74), ('07', 0.783), ('08', 0.842), ('09', 0.945), ('10', 1.375), ('11', 1.61), ('12', 2.19)) v(n, w)) SELECT band_number, name, CAST(w AS DOUBLE) AS wavelength FROM bt LEFT JOIN s ON right(name, 2) = n")
def sensor_lookup(spark, sf):
    return cat.sensor_bands(bands(spark, sf), "Sentinel-2").select("band_number", "name", "wavelength")


def _two_sets(spark, sf) -> cat.Catalog:
    px = embed(spark, sf).drop("cls")
    return cat.Catalog([cat.BandSet.create(px.where(w).select("r", "c", F.col("b1").alias(f"{n}_b1")), name=n) for n, w in (("left", "c < 20"), ("right", "c >= 5"))])


@query("SELECT CAST(i AS INT) AS number FROM (SELECT z, row_number() OVER (ORDER BY z) AS i FROM (SELECT DISTINCT event_type AS z FROM events)) WHERE z = 'error'")
def bandset_by_name(spark, sf):
    px = grid(spark, sf)
    kinds = sorted(r.z for r in px.select("z").distinct().collect())
    sets = cat.Catalog([cat.BandSet.create(px.where(F.col("z") == z).select("r", "c", "v"), name=z) for z in kinds])
    return spark.createDataFrame([(n,) for n in sets.by_name("error")], "number int")


def _two_grids(spark, sf) -> cat.Catalog:
    """The event grid by 1 m, what it counts by 2 m a metre off, and a set that no program names."""
    px = grid(spark, sf)
    coarse = ra.resample(px, 2, "maximum", "k")
    return cat.Catalog([cat.BandSet.create(px.select("r", "c", "v"), name="fine"), cat.BandSet.create(coarse, name="coarse", pixel=(2.0, 2.0), origin=(1.0, -1.0)), cat.BandSet.create(px.where("false").select("r", "c", "m"), name="none")])


_COARSE = ", q AS (SELECT r // 2 AS i, c // 2 AS j, max(k) AS k FROM px GROUP BY 1, 2)"


@query(G + _COARSE + " SELECT px.r, px.c, round(px.v - q.k, 6) AS d FROM px JOIN q ON q.i = (px.r - 1) // 2 AND q.j = (px.c - 1) // 2 WHERE px.r >= 1 AND px.c >= 1")
def calc_two_grids(spark, sf):
    return doubles(cat.run_program('"bandset1b1" - "bandset2b1" @d', _two_grids(spark, sf), prune=True))


@query(G + _COARSE + ", f AS (SELECT CAST((r - 1) // 2 AS INT) AS r, CAST((c - 1) // 2 AS INT) AS c, avg(v) AS v FROM px WHERE r >= 1 AND c >= 1 GROUP BY 1, 2) SELECT f.r, f.c, round(f.v - q.k, 6) AS d FROM f JOIN q ON q.i = f.r AND q.j = f.c WHERE 1 + (f.c + 0.5) * 2 BETWEEN 10 AND 61 AND -1 - (f.r + 0.5) * 2 BETWEEN -90 AND -3")
def calc_aligned(spark, sf):
    return doubles(cat.run_program('"bandset1b1" - "bandset2b1" @d', _two_grids(spark, sf), align=2, extent=(10.0, -3.0, 61.0, -90.0), method="average", prune=True))


@query(E + "SELECT CAST(min(r) AS INT) AS top, CAST(max(r) AS INT) AS bottom, CAST(min(c) AS INT) AS \"left\", CAST(max(c) AS INT) AS \"right\" FROM pe")
def catalog_bbox(spark, sf):
    return _two_sets(spark, sf).bbox()


@query(E + "SELECT r, c, round(b1 * 2, 6) AS b1, round(b1 + b2, 6) AS b2 FROM pe")
def calc_bandset(spark, sf):
    """Results of a calculation as a band set of their own, which the next one uses."""
    px = embed(spark, sf).drop("cls")
    first = cat.BandSet.create(ra.band_calc(px, [('"b1"', "x"), ('"b1" + "b2"', "y")]))
    return doubles(cat.run_program('"b1" * 2 @b1\n"b2" @b2', cat.Catalog([first])))


@query(E + "SELECT r, c, CAST(b1 AS FLOAT) * CAST(3 AS FLOAT) AS v FROM (SELECT r, c, CAST(b1 AS FLOAT) AS b1 FROM pe)")
def calc_float32(spark, sf):
    return ra.band_calc(embed(spark, sf).select("r", "c", "b1"), [('"b1" * 3', "v")], kind="float")


@query(G + f"SELECT DISTINCT r, c, v FROM ({_IN_BOX})")
def clip_polygon(spark, sf):
    return ve.clip_polygons(grid(spark, sf).select("r", "c", "v"), ve.rectangles(spark, _BOXES))


@query(G + f"SELECT DISTINCT r, c, v, CAST(value AS INT) AS value FROM ({_IN_BOX})")
def clip_by_field(spark, sf):
    return ve.clip_polygons(grid(spark, sf).select("r", "c", "v"), ve.rectangles(spark, _BOXES), "value")


@query(G + f"SELECT r, c, CASE WHEN b.value IS NULL THEN px.v END AS v FROM px LEFT JOIN (SELECT DISTINCT r, c, 1 AS value FROM ({_IN_BOX})) b USING (r, c)")
def mask_polygon(spark, sf):
    return ve.mask_polygons(grid(spark, sf).select("r", "c", "v"), ve.rectangles(spark, _BOXES), ["v"])


@query(G + "SELECT a.r, a.c, CASE WHEN count(*) FILTER (b.k = 3) = 0 THEN a.v END AS v FROM px a JOIN px b ON b.r BETWEEN a.r - 1 AND a.r + 1 AND b.c BETWEEN a.c - 1 AND a.c + 1 GROUP BY a.r, a.c, a.v")
def mask_buffer(spark, sf):
    return ra.mask_values(grid(spark, sf).select("r", "c", "k", "v"), "k", [3], ["v"], buffer=1, circular=False).select("r", "c", "v")


@query(G + "SELECT CAST(r * 2 + i AS INT) AS r, CAST(c * 2 + j AS INT) AS c, v FROM px, range(2) a(i), range(2) b(j)")
def resample_finer(spark, sf):
    return ra.resample_to(grid(spark, sf).select("r", "c", "v"), "v", "nearest_neighbour", (1.0, 1.0), (0.5, 0.5))


@query(G + "SELECT CAST(floor((r + 0.5 - 1) / 3) AS INT) AS r, CAST(floor((c + 0.5 - 2) / 3) AS INT) AS c, round(avg(v), 6) AS v FROM px GROUP BY 1, 2")
def resample_aligned(spark, sf):
    return doubles(ra.resample_to(grid(spark, sf).select("r", "c", "v"), "v", "average", (1.0, 1.0), (3.0, 3.0), new_origin=(2.0, 1.0)))


@query(_NEAR.format("CASE WHEN a.vh IS NOT NULL THEN round(max(b.vh) - min(b.vh), 6) END"))
def neighbor_custom(spark, sf):
    """A kernel of one's own: the range of values in each window."""
    top, low = (window_stat(n, offsets(1)) for n in ("max", "min"))
    return doubles(nb.neighbor_apply(grid(spark, sf, holes=True), "v", lambda x, present: top(x, present) - low(x, present)))


@query(E + "SELECT r, c, CASE WHEN b1 + 2 * b2 > 0.1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS class FROM pe")
def custom_model(spark, sf):
    return sp.predict_with(embed(spark, sf), BANDS[:2], lambda x: (x[:, 0] + 2 * x[:, 1] > 0.1) + 1.0)


@query(_PATCH + ", m AS (SELECT id, min(to_id) AS patch FROM w GROUP BY 1) SELECT CAST(patch AS BIGINT) AS region, CAST(count(*) AS DOUBLE) AS area FROM m GROUP BY 1")
def raster_polygons(spark, sf):
    """Rings of the regions' polygons; with holes taken off they are as large as the regions have pixels."""
    px = grid(spark, sf).where("k >= 2").selectExpr("r", "c", "1 AS f")
    return nb.region_rings(nb.region_edges(px, "f", COLUMNS)).groupBy("region").agg(F.sum("area").alias("area"))


@query("SELECT n_regionkey AS value, count(*) AS parts, sum((n_nationkey % 4 + 2) * 5)::DOUBLE AS area FROM nation GROUP BY 1")
def polygon_union(spark, sf):
    return doubles(ve.union_features(estates(spark, sf), "value").select("value", "parts", "area"))


@query("SELECT event_id, lon, lat FROM (SELECT event_id, CAST(event_id % 600 / 100.0 + 6 AS DOUBLE) AS lon, CAST(event_id % 8000 / 100.0 AS DOUBLE) AS lat FROM events)")
def utm_round_trip(spark, sf):
    df = table(spark, sf, "events").selectExpr("event_id", "CAST(event_id % 600 / 100.0D + 6 AS DOUBLE) AS lon", "CAST(event_id % 8000 / 100.0D AS DOUBLE) AS lat")
    x, y = to_utm(F.col("lon"), F.col("lat"), 32)
    back = df.select("event_id", x.alias("x"), y.alias("y"))
    lon, lat = from_utm(F.col("x"), F.col("y"), 32)
    return doubles(back.select("event_id", lon.alias("lon"), lat.alias("lat")))


@query()
def classify_saved(spark, sf):
    """A classifier that was saved and loaded again."""
    px, path = embed(spark, sf), shared_path(spark, "classifier")
    sp.save_model(sp.learner("random_forest", BANDS, "cls", trees=5).fit(px), path)
    return sp.predict(sp.load_model(path), px)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bands to an index by the expression compiler, reclassified into five classes, and reported."""
    ndvi = ra.band_calc(_bandset(spark, sf_dir).pixels, [('("b4" - "b3") / ("b4" + "b3")', "ndvi")])
    rules = [("raster < -0.5", "-2"), ("(raster >= -0.5) & (raster < -0.1)", "-3"), ("(raster >= -0.1) & (raster < 0.1)", "-4"), ("(raster >= 0.1) & (raster < 0.5)", "-5"), ("raster >= 0.5", "-6")]
    return ra.report(ra.reclassify(ndvi, "ndvi", rules).select("r", "c", "value"), "value", 100.0)
