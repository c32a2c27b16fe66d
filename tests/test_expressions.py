import pytest
from pyspark.sql import functions as F

from gridloom.operators.raster import band_calc
from gridloom.plans.expressions import Compiler

ROWS = [(0, 0, 1.0, 2.0, 4.0), (0, 1, None, 3.0, 5.0), (0, 2, 0.0, 0.0, None)]


@pytest.fixture(scope="module")
def px(spark):
    return spark.createDataFrame(ROWS, "r int, c int, a double, b double, d double")


def values(px, text, mask="all"):
    return [r.v for r in band_calc(px, [(text, "v")], mask=mask).orderBy("c").collect()]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ('"a" + "b"', [3.0, None, 0.0]),
        ('"a" / "b"', [0.5, None, None]),
        ('"b" // 2', [1.0, 1.0, 0.0]),
        ('-"b" % 3', [1.0, 0.0, 0.0]),
        ('"b" ** 2', [4.0, 9.0, 0.0]),
        ('("a" > 0) & ("b" == 2)', [1, None, 0]),
        ('where("b" > 1, 7, 8)', [7, 7, 8]),
        ("max(['a', 'b'])".replace("'", '"'), [2.0, 3.0, 0.0]),
        ('sum(["a", "b", "d"], axis=0)', [7.0, 8.0, 0.0]),
        ('mean(["a", "b", "d"])', [7 / 3, 4.0, 0.0]),
        ('percentile(["a", "b", "d"], 50)', [2.0, 3.0, 0.0]),
        ('median(["a", "b", "d"])', [2.0, 4.0, 0.0]),
        ('std(["b", "d"])', [1.0, 1.0, 0.0]),
        ('"b" - mean("b")', [2 - 5 / 3, 3 - 5 / 3, -5 / 3]),
        ('sqrt("b" - 1)', [1.0, pytest.approx(2**0.5), None]),
        ('log("b")', [pytest.approx(0.6931471805599453), pytest.approx(1.0986122886681098), None]),
        ('np.isin("b", [2, 3]) * 2', [2, 2, 0]),
        ('nan_to_num("a")', [1.0, None, 0.0]),
    ],
)
def test_values(px, text, want):
    got = values(px, text)
    for g, w in zip(got, want, strict=True):
        assert (g is None) == (w is None) if w is None or g is None else g == pytest.approx(w) if isinstance(w, float) else g == w


def test_masks(px):
    assert values(px, 'max(["a", "b"])', "any") == [2.0, None, 0.0]
    assert values(px, 'nan_to_num("a")', "none") == [1.0, 0.0, 0.0]


@pytest.mark.parametrize("text", ['__import__("os")', '"a".real', "lambda: 1", 'open("a")', '["a"][0]', '"zz" + 1'])
def test_refuses(px, text):
    with pytest.raises((ValueError, SyntaxError, AttributeError)):
        band_calc(px, [(text, "v")])


def test_ndvi_needs_ranges():
    seen = []
    Compiler(lambda n: seen.append(n) or F.lit(1.0)).compile('"#NDVI#"')
    assert set(seen) == {"#NIR#", "#RED#"}
