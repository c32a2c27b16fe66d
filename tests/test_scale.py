"""Operators over two large sides, pyramids, seeds and the radial machine: against brute force, for any partitioning."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.operators import raster as ra, spectral as sp, table as tb, tiles
from gridloom.sources import tables as so


@pytest.mark.parametrize("threshold", [None, 0.5])
def test_nearest_of_two_tables(spark, threshold):
    rng = np.random.default_rng(1)
    rows = [(i, float(v), int(o)) for i, (v, o) in enumerate(zip(np.round(rng.normal(size=300) * 20, 1), rng.integers(0, 5, 300), strict=True))] + [(900, None, 0), (901, float("nan"), 0)]
    asked = [(i, float(v)) for i, v in enumerate(np.round(rng.normal(size=500) * 25, 1))] + [(k, 3.3) for k in range(1000, 1400)] + [(2000, None), (2001, float("nan"))]
    df = spark.createDataFrame(rows, "k int, w double, o int").repartition(7)
    targets = spark.createDataFrame(asked, "t int, w2 double").repartition(5)
    got = {r.t: r.k for r in tb.nearest_value(df, "w", targets, "w2", threshold, "o").collect()}
    assert len(got) == len(asked)
    for t, v in asked:
        if v is None or v != v:
            assert got[t] is None
            continue
        gap, _, k = min((abs(w - v), o, k) for k, w, o in rows if w is not None and w == w)
        best = [k for k, w, o in rows if w is not None and abs(w - v) == gap]
        least = min(o for k, w, o in rows if k in best)
        assert got[t] is None if threshold is not None and gap >= threshold else got[t] in [k for k, w, o in rows if k in best and o == least]
    assert tb.nearest_value(df.limit(0), "w", targets, "w2").where("k IS NOT NULL").count() == 0


def test_pyramid_equals_resampling(spark, tmp_path):
    rng = np.random.default_rng(5)
    rows = [(i, j, None if rng.random() < 0.1 else float(rng.integers(100))) for i in range(70) for j in range(45) if not 20 <= i < 30]
    px = spark.createDataFrame(rows, "r int, c int, v double")
    got = {(r.level, r.r, r.c): r for r in tiles.pyramid(px, "v", 5, tile=8).collect()}  # three levels a pass
    for level in range(1, 6):
        for method in ("average", "maximum", "minimum"):
            want = {(r.r, r.c): r.v for r in ra.resample(px, 2**level, method, "v").collect() if r.v is not None}
            own = {k[1:]: r[method] for k, r in got.items() if k[0] == level}
            assert own.keys() == want.keys() and all(abs(own[k] - want[k]) < 1e-9 for k in own)
        near = {(r.r, r.c): r.v for r in ra.resample(px, 2**level, "nearest_neighbour", "v").collect()}
        assert all(near.get(k[1:]) == r.nearest for k, r in got.items() if k[0] == level)
    so.write_overviews(px, "v", str(tmp_path / "o"), 3)
    read = so.read_overview(spark, str(tmp_path / "o"), 4.0)
    assert read.count() == sum(k[0] == 2 for k in got) and "PartitionFilters: [isnotnull(level" in read._jdf.queryExecution().toString()


@pytest.fixture(scope="module")
def rings(spark):
    """Two classes: a disk and the ring around it."""
    rng = np.random.default_rng(7)
    a, d, k = rng.uniform(0, 2 * np.pi, 600), np.concatenate([rng.uniform(0, 1, 300), rng.uniform(1.6, 2.4, 300)]), np.repeat([0, 1], 300)
    return spark.createDataFrame([(0, i, float(x), float(y), int(c)) for i, (x, y, c) in enumerate(zip(d * np.cos(a), d * np.sin(a), k, strict=True))], "r int, c int, x double, y double, k int")


def test_radial_machine(spark, rings, tmp_path):
    machine = sp.radial_machine(rings, ["x", "y"], "k", features=100)
    right = machine.predict(rings, ["c", "k"]).where(F.col("class") == F.col("k")).count()
    linear = sp.predict(sp.learner("svm", ["x", "y"], "k").fit(rings), rings, ["c", "k"]).where(F.col("class") == F.col("k")).count()
    assert right > 590 and linear < 480
    one = {r.c: r.confidence for r in machine.predict(rings.repartition(1)).collect()}
    many = {r.c: r.confidence for r in machine.predict(rings.repartition(9)).collect()}
    assert one == many
    machine.save(spark, str(tmp_path / "m"))
    again = {r.c: r.confidence for r in sp.RadialMachine.load(spark, str(tmp_path / "m")).predict(rings).collect()}
    assert again == one
    z = np.array([r._f.toArray() for r in sp.radial_machine(rings, ["x", "y"], "k", gamma=0.3, features=4000).features(rings.limit(40), ["c"]).collect()])
    p = np.array([(r.x, r.y) for r in rings.limit(40).collect()])
    row = rings.agg(F.stddev_pop("x"), F.stddev_pop("y")).first()
    d = (((p[:, None] - p[None]) / np.array(row)) ** 2).sum(-1)
    assert np.abs(z @ z.T - np.exp(-0.3 * d)).max() < 0.1  # the kernel that the features stand for


def test_seeds(spark, rings):
    for choose in (sp.random_seeds, sp.parallel_seeds):
        a, b = choose(rings.repartition(1), ["x", "y"], 5), choose(rings.repartition(8), ["x", "y"], 5)
        assert a.shape == (5, 2) and (a == b).all()
    p = np.array([(r.x, r.y) for r in rings.collect()])
    cost = lambda c: ((p[:, None] - c[None]) ** 2).sum(-1).min(1).sum()
    assert cost(sp.parallel_seeds(rings, ["x", "y"], 8)) <= 1.5 * cost(sp.range_seeds(rings, ["x", "y"], 8))
    clusters, centers = sp.cluster(rings, ["x", "y"], 4, seeds="parallel")
    assert clusters.select("cluster").distinct().count() == 4 and len(centers) == 4
    assert len(sp.parallel_seeds(rings.limit(0), ["x", "y"], 3)) == 0
    assert len(sp.parallel_seeds(rings.select("r", "c", F.lit(1.0).alias("x"), F.lit(2.0).alias("y")), ["x", "y"], 3)) == 1  # no more different pixels


def test_chi_square_limits():
    for percent, n, want in ((5, 1, 3.841459), (5, 2, 5.991465), (1, 3, 11.344867), (50, 6, 5.348121), (0.1, 10, 29.588298)):
        assert abs(sp.chi_square_limit(percent, n) - want) < 1e-5


def test_network_learns_rings(spark, rings):
    net = sp.train_network(rings, ["x", "y"], "k", 2, hidden=[32], steps=60, batches=3, rate=0.03)
    assert net.predict(rings, ["c", "k"]).where(F.col("class") == F.col("k")).count() > 580
    again = sp.train_network(rings.repartition(1), ["x", "y"], "k", 2, hidden=[32], steps=5, batches=3)
    other = sp.train_network(rings.repartition(7), ["x", "y"], "k", 2, hidden=[32], steps=5, batches=3)
    assert all(np.allclose(a, b, atol=1e-9) for p, q in zip(again.layers, other.layers, strict=True) for a, b in zip(p, q, strict=True))

    def squares(scores, wanted):  # a loss of one's own
        g = scores - np.eye(2)[wanted]
        return float((g * g).sum() / 2), g

    assert sp.train_network(rings, ["x", "y"], "k", 2, hidden=[32], steps=60, rate=0.03, loss=squares).predict(rings, ["c", "k"]).where(F.col("class") == F.col("k")).count() > 560


def test_slopes_of_the_loss():
    rng = np.random.default_rng(2)
    scores, wanted = rng.normal(size=(5, 4)), np.array([0, 3, 1, 1, 2])
    _, g = sp.cross_entropy(scores, wanted)
    for i, j in ((0, 0), (2, 3), (4, 1)):
        up, down = scores.copy(), scores.copy()
        up[i, j] += 1e-6
        down[i, j] -= 1e-6
        assert abs((sp.cross_entropy(up, wanted)[0] - sp.cross_entropy(down, wanted)[0]) / 2e-6 - g[i, j]) < 1e-6


def test_cross_validation(spark, rings):
    from pyspark.ml.tuning import ParamGridBuilder

    pipeline = sp.learner("random_forest", ["x", "y"], "k", trees=5)
    grid = ParamGridBuilder().addGrid(pipeline.getStages()[-1].maxDepth, [1, 6]).build()
    fitted = sp.cross_validate(pipeline, grid, rings, "k", 3)
    assert fitted.avgMetrics[1] > 0.9 > fitted.avgMetrics[0]
    assert sp.predict(fitted.bestModel, rings, ["c", "k"]).where(F.col("class") == F.col("k")).count() > 570


@pytest.mark.parametrize("minimum", [1, 15, 10_000])
def test_regions_of_many_seeds(spark, minimum):
    from gridloom.operators import neighborhood as nb

    rng = np.random.default_rng(3)
    a = rng.integers(0, 6, (2, 40, 40)).astype(float)
    a[0, rng.integers(0, 40, 60), rng.integers(0, 40, 60)] = np.nan
    rows = [(i, j, *(None if np.isnan(v) else float(v) for v in a[:, i, j])) for i in range(40) for j in range(40)]
    px = spark.createDataFrame(rows, "r int, c int, u double, v double")
    places = [(k, int(i), int(j)) for k, (i, j) in enumerate(rng.integers(0, 42, (25, 2)))]
    got = {}
    for r in nb.grow_regions(px, ["u", "v"], spark.createDataFrame(places, "id int, r int, c int"), 1.0, minimum, 11).collect():
        got.setdefault(r.id, set()).add((r.r, r.c))

    def connected(ok, start):
        out, todo = {start}, [start]
        while todo:
            i, j = todo.pop()
            for n in ((i + 1, j), (i - 1, j), (i, j + 1), (i, j - 1)):
                if n in ok and n not in out:
                    out.add(n)
                    todo.append(n)
        return out

    for k, i, j in places:
        if i > 39 or j > 39 or np.isnan(a[:, i, j]).any():
            assert k not in got
            continue
        box = [(y, x) for y in range(max(0, i - 5), min(40, i + 6)) for x in range(max(0, j - 5), min(40, j + 6))]
        both = None
        for band in a:
            gap = {p: abs(band[p] - band[i, j]) for p in box if not np.isnan(band[p])}
            for d in [1.0, *sorted({g for g in gap.values() if g > 1.0})]:
                region = connected({p for p, g in gap.items() if g <= d}, (i, j))
                if len(region) >= minimum:
                    break
            both = region if both is None else both & region
        assert got[k] == connected(both, (i, j))


@pytest.mark.parametrize("one_task", [500_000, 0])
def test_ranks_with_nulls(spark, monkeypatch, one_task):
    """Groups of NoData alone, and the null group, by one task and by ranges."""
    from gridloom.operators import ranks

    monkeypatch.setattr(ranks, "ONE_TASK", one_task)
    df = spark.createDataFrame([(1, 2.0), (1, 4.0), (1, None), (2, None), (None, 5.0), (None, 6.0), (3, 7.0)], "z int, v double")
    got = {r.z: (r["count"], r["mean"], r["median"], r["std"], r["p25"]) for r in ra.zonal_stats(df, "z", "v", [25]).collect()}
    assert got == {1: (2, 3.0, 3.0, 1.0, 2.5), 2: (0, None, None, None, None), 3: (1, 7.0, 7.0, 0.0, 7.0)}
    pivoted = {r.z: (r.v_median, r.v_count) for r in tb.pivot(df, "z", [("v", "median"), ("v", "count")]).collect()}
    assert pivoted == {1: (3.0, 2), 2: (-999.0, 0), 3: (7.0, 1), -999: (5.5, 2)}
    two = {r.z: (r.v_median_w1, r.v_count_w1) for r in tb.pivot(df.selectExpr("z", "v", "1 AS w"), "z", [("v", "median"), ("v", "count")], ["w"]).collect()}
    assert two[None] == (5.5, 2) and two[1] == (3.0, 2)


def test_nearest_values_read_no_frame_to_the_end(spark, sf, monkeypatch):
    """A frame up to a range's last row is read anew for each row: the work would grow with the square of a range."""
    from gridloom.queries import nearest_join

    monkeypatch.setattr(tb, "small", lambda df, name: df)  # which writes, so that the plan would end there
    plan = nearest_join(spark, sf)._jdf.queryExecution().toString().lower()
    assert "unboundedpreceding" in plan and "unboundedfollowing" not in plan


def test_medians_of_few_groups_are_not_gathered_by_group(spark, sf):
    """A group's median and percentile come from ranks over sorted ranges, not from all its values in one task."""
    from gridloom.queries import agg_functions

    plan = agg_functions(spark, sf)._jdf.queryExecution().toString()
    assert "median(" not in plan and "percentile(" not in plan


def test_linear_machines_are_fitted_side_by_side(spark):
    assert sp.learner("svm", ["b1"], "cls").getStages()[-1].getParallelism() == sp.MACHINES > 1


def test_radial_machines_are_fitted_side_by_side(rings, monkeypatch):
    from pyspark.ml.classification import OneVsRest

    seen, fit = [], OneVsRest.fit
    monkeypatch.setattr(OneVsRest, "fit", lambda self, rows: seen.append(self.getParallelism()) or fit(self, rows))
    sp.radial_machine(rings, ["x", "y"], "k", features=4)
    assert seen == [sp.MACHINES]
