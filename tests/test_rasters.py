import numpy as np
import pytest

from gridloom.operators import neighborhood as nb, raster as ra, spectral as sp, vector as ve
from gridloom.plans import catalog as cat

A = np.array([[1, 1, 0, 2, 2], [1, 0, 0, 2, 0], [0, 0, 3, 0, 0], [4, 4, 0, 0, 5], [4, 0, 0, 5, 5]])


@pytest.fixture(scope="module")
def px(spark):
    return spark.createDataFrame([(i, j, int(A[i, j])) for i in range(5) for j in range(5)], "r int, c int, v int")


def as_array(df, name="value"):
    out = np.full(A.shape, -1.0)
    for r in df.collect():
        out[r.r, r.c] = -9 if r[name] is None else r[name]
    return out


def test_label_counts_patch_pixels(px):
    got = as_array(nb.label(px, "v", 5))
    assert got[0, 0] == 3 and got[2, 2] == 1 and got[4, 4] == 3 and got[0, 2] == -1


def test_neighbor_sum_partial_windows(px):
    got = as_array(nb.neighbor_stat(px, "v", "sum"))
    pad = np.pad(A, 1)
    assert (got == sum(pad[i : i + 5, j : j + 5] for i in range(3) for j in range(3))).all()


def test_dilation_later_value_wins(px):
    got = as_array(nb.dilation(px, "v", [2, 3]))
    assert got[1, 2] == 3 and got[0, 2] == 2 and got[0, 0] == 1


def test_erosion(px):
    got = as_array(nb.erosion(px, "v", [3]))
    assert got[2, 2] == 0 and (got[A != 3] == A[A != 3]).all()


def test_sieve(px):
    assert as_array(nb.sieve(px, "v", 2, 5))[2, 2] == 0


def test_region_edges_close(px):
    edges = nb.region_edges(px, "v", 5)
    assert edges.where("value = 3").count() == 4
    assert nb.dissolve(edges).where("value = 3").first().border == 4


def test_region_growing(px):
    assert nb.region_growing(px, "v", (0, 0), 0.5, 3, 5).count() == 3
    assert nb.region_growing(px, "v", (50, 0), 0.5, 3, 5).count() == 0


def test_structure(px):
    got = as_array(nb.neighbor_stat(px, "v", "sum", structure=[[None, 1, None], [1, 1, 1], [None, 1, None]]))
    pad = np.pad(A, 1)
    assert (got == pad[:-2, 1:-1] + pad[2:, 1:-1] + pad[1:-1, :-2] + pad[1:-1, 2:] + A).all()


def test_triangle(spark, px):
    ring = spark.createDataFrame([(1, [(0.0, 0.0), (5.0, 0.0), (0.0, -5.0)], 9)], "fid int, ring array<struct<x:double,y:double>>, value int")
    got = as_array(ve.rasterize(px, ring, "value"))
    want = np.array([[9 if (j + 0.5) + (i + 0.5) < 5 else -9 for j in range(5)] for i in range(5)])
    assert (got == want).all()
    assert ring.select(ve.area(ring.ring)).first()[0] == 12.5
    assert as_array(ve.rasterize_area(px, ring, "value"))[0, 0] == 9
    assert '"Polygon"' in ve.to_geojson(ring).first().json


def test_pca_orders_components(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 1)) @ np.array([[3.0, 1.0]]) + rng.normal(size=(200, 2)) * 0.1
    df = spark.createDataFrame([(i, 0, *map(float, v)) for i, v in enumerate(x)], "r int, c int, a double, b double")
    scores, values, vectors = sp.principal_components(df, ["a", "b"], 2)
    assert values[0] > 50 * values[1] and abs(vectors[0, 0]) > 0.9
    assert np.allclose(np.linalg.eigvalsh(np.cov(x.T))[::-1], values)


def test_clusters_settle(spark):
    pts = [(i, 0, float(i % 2) * 10 + i * 1e-3) for i in range(40)]
    df = spark.createDataFrame(pts, "r int, c int, a double")
    _, centers = sp.cluster(df, ["a"], 2)
    assert abs(centers[0][0]) < 1 and abs(centers[1][0] - 10) < 1


def test_catalog_program(spark):
    one = spark.createDataFrame([(0, 0, 2.0, 6.0)], "r int, c int, red double, nir double")
    two = spark.createDataFrame([(0, 0, 1.0, 3.0)], "r int, c int, red2 double, nir2 double")
    sets = [cat.BandSet.create(one, [0.65, 0.85], date="2021-01-01"), cat.BandSet.create(two, [0.65, 0.85], date="2021-03-01")]
    c = cat.Catalog(sets)
    row = cat.run_program('"#NDVI#" @n\n"n" * 2 @m\nsum("bandset{2021-01-01:2021-02-01}b1") @s\nforbandsinbandset[1]\n"#BAND#" + 1 @p', c).first()
    assert (row.n, row.m, row.s, row.p_s1_red, row.p_s1_nir) == (0.5, 1.0, 2.0, 3.0, 7.0)
    assert c.numbers("1:2") == [1, 2] and c.by_dates([("2021-02-01", "2021-04-01")]) == [2]


def test_reclass_table(px):
    table = ra.unique_table(px, "v")
    assert {r.value for r in ra.reclassify_by_table(px, "v", table).collect()} == {1, 2, 3, 4, 5, 6}


def test_streaming_report(spark, tmp_path):
    from gridloom.streaming.scenes import running_report, scene_stream

    spark.sql("SELECT timestamp'2024-01-01 10:00:00' AS t, 1 AS k UNION ALL SELECT timestamp'2024-01-01 11:00:00', 1").write.parquet(str(tmp_path / "in"))
    q = running_report(scene_stream(spark, str(tmp_path / "in"), "t timestamp, k int"), "k", "t").writeStream.format("memory").queryName("report").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.table("report").first().pixels == 2


def test_clusters_are_of_the_nearest_centers(spark):
    """The last assignment against its centers, and the centers against their pixels' means."""
    rng = np.random.default_rng(0)
    x = np.vstack([rng.normal(m, 0.3, (60, 2)) for m in (0, 3, 6)])
    df = spark.createDataFrame([(0, i, float(a), float(b)) for i, (a, b) in enumerate(x)], "r int, c int, b1 double, b2 double")
    got, centers = sp.cluster(df, ["b1", "b2"], 3, max_iter=50)
    own = np.array([r.cluster for r in got.orderBy("c").collect()]) - 1
    assert (own == np.argmin(((x[:, None] - centers[None]) ** 2).sum(2), 1)).all()
    assert np.allclose(centers, [x[own == k].mean(0) for k in range(3)], atol=1e-3)


def test_saved_classifier(spark, tmp_path):
    df = spark.createDataFrame([(0, i, float(i % 7), float(i % 3), i % 2) for i in range(60)], "r int, c int, b1 double, b2 double, cls int")
    model = sp.learner("random_forest", ["b1", "b2"], "cls", trees=3).fit(df)
    sp.save_model(model, str(tmp_path / "m"))
    one, two = (sorted(map(tuple, sp.predict(m, df).collect())) for m in (model, sp.load_model(str(tmp_path / "m"))))
    assert one == two


def test_rings_with_a_hole(spark):
    ring = [(i, j, 1) for i in range(3) for j in range(3) if (i, j) != (1, 1)]
    edges = nb.region_edges(spark.createDataFrame([*ring, (3, 3, 1)], "r int, c int, f int"), "f", 10)
    got = sorted((r.region, r.area, len(r.ring)) for r in nb.region_rings(edges).collect())
    assert got == [(0, -1.0, 4), (0, 9.0, 4), (33, 1.0, 4)]


def test_window_larger_than_tiles(spark):
    rng = np.random.default_rng(1)
    x = rng.random((30, 30))
    df = spark.createDataFrame([(i, j, float(x[i, j])) for i in range(30) for j in range(30)], "r int, c int, v double")
    from gridloom.operators import tiles

    got = np.zeros_like(x)
    for r in tiles.tiled(df, "v", 5, tiles.window_stat("median", tiles.offsets(5)), tile=4).collect():
        got[r.r, r.c] = r.value
    pad = np.pad(x, 5, constant_values=np.nan)
    assert np.allclose(got, [[np.nanmedian(pad[i : i + 11, j : j + 11]) for j in range(30)] for i in range(30)])
