"""Pixel views over the driver's tables: a grid of events and a set of bands of embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

#: Columns of the event grid and of the embedding grid; the latter's six bands and their wavelengths.
COLUMNS, EMBED_COLUMNS = 100, 25
BANDS = ["b1", "b2", "b3", "b4", "b5", "b6"]
WAVELENGTHS = [0.49, 0.56, 0.665, 0.842, 1.61, 2.19]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def grid(spark: SparkSession, sf_dir: str, holes: bool = False) -> DataFrame:
    """r, c, v (number), k (class), z (zone), m (0 to 4); holes: v is NoData where m is 0."""
    v = "CASE WHEN user_id % 5 = 0 THEN NULL ELSE value END" if holes else "value"
    return table(spark, sf_dir, "events").selectExpr(f"CAST(event_id div {COLUMNS} AS INT) AS r", f"CAST(event_id % {COLUMNS} AS INT) AS c", f"{v} AS v", "CAST(floor(value / 50) AS INT) AS k", "event_type AS z", "CAST(user_id % 5 AS INT) AS m")


def embed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """r, c, b1 to b6, cls."""
    return table(spark, sf_dir, "embeddings").selectExpr(f"CAST(vec_id div {EMBED_COLUMNS} AS INT) AS r", f"CAST(vec_id % {EMBED_COLUMNS} AS INT) AS c", *(f"CAST(element_at(embedding, {i}) AS DOUBLE) AS b{i}" for i in range(1, 7)), "label AS cls")


#: A parcel of each supplier, on the event grid: corners of its outline and of its hole, beside (column, row) of its place.
OUTLINE, HOLE = [(0.0, 0.0), (7.3, 2.1), (4.2, 9.7), (-3.1, 5.4)], [(2.3, 3.2), (4.1, 3.9), (2.9, 6.1)]


def parcels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """fid, value, hole, ring (x to the right, y up) of the suppliers' parcels: an outline and a hole each."""
    ring = lambda corners: F.array(*(F.struct((F.col("s_suppkey") * 37 % 100 + x).alias("x"), (-(F.col("s_suppkey") + y)).alias("y")) for x, y in corners))
    both = F.array(F.struct(F.lit(False).alias("hole"), ring(OUTLINE).alias("ring")), F.struct(F.lit(True).alias("hole"), ring(HOLE).alias("ring")))
    rows = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("fid"), F.col("s_nationkey").alias("value"), F.explode(both).alias("p"))
    return rows.select("fid", "value", "p.hole", "p.ring")


def bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A band table of a row a part: band_number, name, wavelength, path."""
    return table(spark, sf_dir, "part").selectExpr("CAST(p_partkey + 1 AS INT) AS band_number", "concat('scene_B', lpad(CAST(p_size % 14 AS STRING), 2, '0')) AS name", "(400 + p_partkey * 37 % 2000) / 1000 AS wavelength", "p_name AS path")


BANDS_SQL = "bt AS (SELECT CAST(p_partkey + 1 AS INT) AS band_number, 'scene_B' || lpad(CAST(p_size % 14 AS VARCHAR), 2, '0') AS name, (400 + p_partkey * 37 % 2000)::DOUBLE / 1000 AS wavelength, p_name AS path FROM part)"


def estates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """fid, value, ring of a box for each nation, none of which meet."""
    corner = lambda i, j: F.struct((F.col("n_nationkey") * 10 + i * (F.col("n_nationkey") % 4 + 2)).cast("double").alias("x"), (F.col("n_regionkey") * 10 + F.lit(j * 5)).cast("double").alias("y"))
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("fid"), F.col("n_regionkey").alias("value"), F.array(corner(0, 0), corner(1, 0), corner(1, 1), corner(0, 1)).alias("ring"))


def plots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """fid, value, ring of a box for each part: boxes of one brand overlap and touch."""
    corner = lambda i, j: F.struct((F.col("p_partkey") * 37 % 101 + i * (F.col("p_size") % 9 + 1)).cast("double").alias("x"), (F.col("p_partkey") * 91 % 83 + j * (F.col("p_size") % 5 + 1)).cast("double").alias("y"))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("fid"), F.col("p_brand").alias("value"), F.array(corner(0, 0), corner(0, 1), corner(1, 1), corner(1, 0)).alias("ring"))


#: The unit squares that the plots cover.
PLOT_SQL = "u AS (SELECT DISTINCT p_brand AS value, x + p_partkey * 37 % 101 AS x, y + p_partkey * 91 % 83 AS y FROM part, range(9) a(x), range(5) b(y) WHERE x <= p_size % 9 AND y <= p_size % 5)"
_EDGES = [(a, b) for corners in (OUTLINE, HOLE) for a, b in zip(corners, corners[1:] + corners[:1], strict=True)]
#: Edges of the parcels in columns and rows (down); pixels that could meet one; and which of these are inside, touched, covered.
PARCEL_SQL = (
    "e AS (SELECT s_suppkey AS fid, s_nationkey AS val, s_suppkey * 37 % 100 + ax AS ax, s_suppkey + ay AS ay, s_suppkey * 37 % 100 + zx AS zx, s_suppkey + zy AS zy, hole FROM supplier, (VALUES "
    + ", ".join(f"({a}::DOUBLE, {b}::DOUBLE, {c}::DOUBLE, {d}::DOUBLE, {i >= len(OUTLINE)})" for i, ((a, b), (c, d)) in enumerate(_EDGES))
    + ") v(ax, ay, zx, zy, hole)), "
    "q AS (SELECT px.r, px.c, px.v, e.* FROM px JOIN e ON px.r BETWEEN e.fid - 1 AND e.fid + 10 AND px.c BETWEEN e.fid * 37 % 100 - 5 AND e.fid * 37 % 100 + 8), "
    "inside AS (SELECT r, c, v, fid, val FROM q WHERE (ay < r + 0.5) <> (zy < r + 0.5) AND c + 0.5 < ax + (zx - ax) * (r + 0.5 - ay) / (zy - ay) GROUP BY ALL HAVING count(*) % 2 = 1)"
)
GRID_SQL = f"px AS (SELECT CAST(event_id // {COLUMNS} AS INT) AS r, CAST(event_id % {COLUMNS} AS INT) AS c, value AS v, CAST(floor(value / 50) AS INT) AS k, event_type AS z, CAST(user_id % 5 AS INT) AS m, CASE WHEN user_id % 5 = 0 THEN NULL ELSE value END AS vh FROM events)"
EMBED_SQL = f"pe AS (SELECT CAST(vec_id // {EMBED_COLUMNS} AS INT) AS r, CAST(vec_id % {EMBED_COLUMNS} AS INT) AS c, {', '.join(f'embedding[{i}]::DOUBLE AS b{i}' for i in range(1, 7))}, label AS cls FROM embeddings)"
