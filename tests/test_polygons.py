"""Polygons against fine sampling and brute force: burning, unions, components and rings of regions."""

from collections import defaultdict

import numpy as np
import pytest

from gridloom.operators import neighborhood as nb, overlay, polygons as pg, vector as ve

KIND = "fid int, value int, hole boolean, ring array<struct<x:double,y:double>>"


@pytest.fixture(scope="module")
def plain(spark):
    return spark.range(30 * 40).selectExpr("CAST(id div 40 AS INT) AS r", "CAST(id % 40 AS INT) AS c", "1 AS v")


def star(rng, x, y, size, n=9):
    a = (np.arange(n) + rng.uniform(0, 0.6, n)) * 2 * np.pi / n  # holes of less than a third of the size stay inside
    d = rng.uniform(0.4, 1.0, n) * size
    return [(float(x + u), float(y + v)) for u, v in zip(d * np.cos(a), d * np.sin(a))]


def inside(x, y, rings):
    odd = np.zeros(np.broadcast(x, y).shape, bool)
    for ring in rings:
        for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1]):
            if ay != by:
                odd ^= ((ay > y) != (by > y)) & (x < (bx - ax) * (y - ay) / (by - ay) + ax)
    return odd


def test_burning_of_stars_with_holes(spark, plain):
    rng = np.random.default_rng(2)
    rows, shapes = [], {}
    for f in range(6):
        x, y = rng.uniform(-3, 40), -rng.uniform(-2, 30)
        outer, hole = star(rng, x, y, 9), star(rng, x, y, 2.5)
        shapes[f] = [outer, hole]
        rows += [(f, f % 4, False, outer if f % 2 else outer[::-1]), (f, f % 4, True, hole)]
    features = spark.createDataFrame(rows, KIND)
    fine = 60
    p = (np.arange(fine) + 0.5) / fine
    X, Y = np.meshgrid((np.arange(40)[:, None] + p).ravel(), -(np.arange(30)[:, None] + p).ravel())
    held = {f: inside(X, Y, s).reshape(30, fine, 40, fine).mean((1, 3)) for f, s in shapes.items()}
    # middles
    got = {(r.fid, r.r, r.c) for r in ve.pixels_in_polygons(plain, features).collect()}
    mx, my = np.meshgrid(np.arange(40) + 0.5, -(np.arange(30) + 0.5))
    assert got == {(f, int(r), int(c)) for f, s in shapes.items() for r, c in zip(*np.nonzero(inside(mx, my, s)))}
    # touched: all that fine sampling sees, and no more than it can overlook
    touched = {(r.fid, r.r, r.c) for r in ve.pixels_in_polygons(plain, features, touched=True).collect()}
    seen = {(f, int(r), int(c)) for f, h in held.items() for r, c in zip(*np.nonzero(h))}
    assert seen <= touched and len(touched - seen) <= 0.02 * len(touched)
    # areas
    own = pg.grid_edges(pg.signed(features, "hole"), "_sign")
    cover = defaultdict(float)
    for s in pg.cover_spans(own, 0, 29, 0, 39).collect():
        for c in range(s.lo, s.hi + 1):
            cover[s.fid, s.r, c] += s.cover
    for f, h in held.items():
        mine = np.array([[cover[f, r, c] for c in range(40)] for r in range(30)])
        assert np.abs(mine - h).max() < 0.02
    by_area = {(r.r, r.c): (r.value, r.cover) for r in ve.rasterize_area(plain, features, "value", "hole").collect()}
    share = np.stack([sum(np.array([[cover[f, r, c] for c in range(40)] for r in range(30)]) for f in shapes if f % 4 == v) for v in range(4)])
    for (r, c), (v, s) in by_area.items():
        assert (v is None and share[:, r, c].max() < 1e-8) or (v == int(np.argmax(np.round(share[:, r, c], 9))) and abs(s - share[v, r, c]) < 1e-6)


def test_a_long_outline_is_not_repeated(spark, plain):
    """A ring of very many points: no plan holds it whole beside pixels, and what goes to the pixels is spans."""
    a = np.linspace(0, 2 * np.pi, 100_000, endpoint=False)
    ring = [(float(20 + 12 * np.cos(t)), float(-15 + 12 * np.sin(t))) for t in a]
    features = spark.createDataFrame([(1, 5, False, ring)], KIND)
    got = ve.pixels_in_polygons(plain, features)
    assert "ring" not in got.columns and got.count() == sum((c + 0.5 - 20) ** 2 + (r + 0.5 - 15) ** 2 < 144 for r in range(30) for c in range(40))
    spans = pg.middle_spans(pg.grid_edges(features), 0, 29)
    assert spans.count() == 24


def test_empty_inputs(spark, plain):
    none = spark.createDataFrame([], KIND)
    assert ve.pixels_in_polygons(plain, none).count() == 0 and ve.union_features(none, "value").count() == 0
    box = ve.rectangles(spark, [(1, 0.0, 0.0, 3.0, -2.0, 7)])
    assert ve.pixels_in_polygons(plain.limit(0), box).count() == 0 and ve.rasterize_area(plain.limit(0), box, "value").count() == 0
    assert ve.rasterize(plain, box, "value", touched=True).where("value = 7").count() == 6  # outlines along pixels' borders touch none


def rings_of(cells):
    """Number of rings of a set of unit cells: parts joined by sides, each with its own holes, joined by corners too."""

    def parts(cells, steps):
        left, out = set(cells), []
        while left:
            todo, part = [left.pop()], set()
            while todo:
                x, y = todo.pop()
                part.add((x, y))
                for i, j in steps:
                    if (x + i, y + j) in left:
                        left.remove((x + i, y + j))
                        todo.append((x + i, y + j))
            out.append(part)
        return out

    four = [(0, 1), (1, 0), (0, -1), (-1, 0)]
    eight = [(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1) if i or j]
    total = 0
    for part in parts(cells, four):
        xs, ys = [x for x, _ in part], [y for _, y in part]
        rest = {(x, y) for x in range(min(xs) - 1, max(xs) + 2) for y in range(min(ys) - 1, max(ys) + 2)} - part
        total += len(parts(rest, eight))  # the outside is one, for the outer ring
    return total


def test_union_of_boxes(spark):
    rng = np.random.default_rng(6)
    rows, cells = [], defaultdict(set)
    for f in range(120):
        x, y, w, h = (int(v) for v in (*rng.integers(0, 30, 2), *rng.integers(1, 7, 2)))
        rows.append((f, float(x), float(y + h), float(x + w), float(y), f % 3))
        cells[f % 3] |= {(x + i, y + j) for i in range(w) for j in range(h)}
    got = {r.value: r for r in ve.union_features(ve.rectangles(spark, rows), "value").collect()}
    for v, own in cells.items():
        assert abs(got[v].area - len(own)) < 1e-6 and got[v].parts == rings_of(own)
    rings = overlay.dissolved(ve.rectangles(spark, rows), "value").collect()
    for r in rings:  # corners only, right direction
        p = np.array([(q.x, q.y) for q in r.ring])
        z = np.roll(p, -1, 0)
        assert abs((p[:, 0] * z[:, 1] - z[:, 0] * p[:, 1]).sum() / 2 - r.area) < 1e-6 and r.hole == (r.area < 0)
        assert ((p == z).sum(1) == 1).all()


def test_union_of_stars(spark):
    """Overlapping outlines in any direction, with holes: areas against sampling; one polygon alone is itself."""
    rng = np.random.default_rng(9)
    rows, shapes = [], defaultdict(list)
    for f in range(14):
        x, y = rng.uniform(0, 20, 2)
        outer, hole = star(rng, x, y, 5), star(rng, x, y, 1.2)
        rows += [(f, f % 2, False, outer), (f, f % 2, True, hole)]
        shapes[f % 2].append([outer, hole])
    got = {r.value: r.area for r in ve.union_features(spark.createDataFrame(rows, KIND), "value", "hole").collect()}
    g = np.arange(-7, 28, 0.02)
    X, Y = np.meshgrid(g, g)
    for v, own in shapes.items():
        want = np.logical_or.reduce([inside(X, Y, s) for s in own]).sum() * 0.0004
        assert abs(got[v] - want) < 0.15
    one = overlay.dissolved(spark.createDataFrame(rows[:2] * 2, KIND), "value", "hole").collect()  # repeated rows count once
    assert sorted(len(r.ring) for r in one) == [9, 9] and [r.hole for r in sorted(one, key=lambda r: r.area)] == [True, False]


@pytest.mark.parametrize("eight", [False, True])
def test_patches_over_tiles(spark, monkeypatch, eight):
    monkeypatch.setattr(nb, "TILE", 8)
    rng = np.random.default_rng(3)
    a = rng.integers(0, 3, (37, 29))
    a[5:30, 4] = 7  # long ones over many tiles
    a[20, 2:28] = 7
    rows = [(i, j, str(a[i, j])) for i in range(37) for j in range(29) if a[i, j] != 0]
    got = {(r.r, r.c): r.patch for r in nb.patches(spark.createDataFrame(rows, "r int, c int, v string"), "v", 100, eight).collect()}
    steps = [(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1) if (i or j) and (eight or not i or not j)]
    want, left = {}, {(i, j) for i, j, _ in rows}
    while left:
        start = min(left)
        left.discard(start)
        todo = [start]
        while todo:
            r, c = todo.pop()
            want[r, c] = start[0] * 100 + start[1]
            for i, j in steps:
                n = (r + i, c + j)
                if n in left and a[n] == a[r, c]:
                    left.remove(n)
                    todo.append(n)
    assert got == want


def test_rings_over_tiles(spark, monkeypatch):
    """Rings put together from tiles are those of one tile: areas, lengths and closed outlines."""
    rng = np.random.default_rng(12)
    a = (rng.random((30, 30)) < 0.6).astype(int)
    a[3:27, 3:27] = 1
    a[10:20, 10:20] = 0
    px = spark.createDataFrame([(i, j, int(a[i, j])) for i in range(30) for j in range(30) if a[i, j]], "r int, c int, v int")
    edges = nb.region_edges(px, "v", 100)
    key = lambda rows: sorted((r.region, r.area, tuple(sorted((p.x, p.y) for p in r.ring))) for r in rows)
    whole = key(nb.region_rings(edges).collect())
    monkeypatch.setattr(nb, "TILE", 4)
    parts = nb.region_rings(edges).collect()
    assert key(parts) == whole
    cells = defaultdict(set)
    for r in nb.patches(px, "v", 100).collect():
        cells[r.patch].add((r.c, r.r))
    assert sum(r.area for r in parts) == a.sum() and len(parts) == sum(rings_of(x) for x in cells.values())


def test_boxes_on_one_another_have_few_edges(spark):
    """Edges along one line are taken together before cells compare them with each other, however many lie there."""
    from gridloom.operators.overlay import _without_overlaps

    boxes = [(0.0, float(x), float(x + w), 1) for x in range(20) for w in range(1, 10)]  # bottoms to the right
    tops = [(3.0, float(x + w), float(x), 1) for x in range(20) for w in range(1, 10)]
    own = spark.createDataFrame([("a", a, y, b, y, n) for y, a, b, n in boxes + tops] + [("a", 0.0, 0.0, 2.0, 3.0, 1), ("b", 5.0, 5.0, 5.0, 7.0, 2), ("b", 5.0, 7.0, 5.0, 6.0, 2)], "value string, ax double, ay double, bx double, by double, n long")
    got = [tuple(r) for r in _without_overlaps(own).select("value", "ax", "ay", "bx", "by", "n").collect()]
    assert ("a", 0.0, 0.0, 2.0, 3.0, 1) in got and [r for r in got if r[0] == "b"] == [("b", 5.0, 5.0, 5.0, 6.0, 2)]
    assert len(got) <= 2 + 2 * 28
    for y, ahead in ((0.0, 1), (3.0, -1)):
        for k in range(28):
            want = sum(min(a, b) <= k < max(a, b) for yy, a, b, _ in boxes + tops if yy == y)
            assert [n * (1 if ax < bx else -1) for v, ax, ay, bx, by, n in got if v == "a" and ay == by == y and min(ax, bx) <= k < max(ax, bx)] == [want * ahead]
