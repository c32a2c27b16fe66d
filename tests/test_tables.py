import struct

import pytest

from gridloom.operators import table as tb
from gridloom.sources import tables as src

# fixed values: two small tables
ONE = "id,main,field1,field2,field3,name\n1,101,0,0,1281,a\n2,101,0,1,811,a\n3,101,0,2,181,a\n4,102,1,0,26,c\n5,102,1,1,110,c\n6,102,1,2,170,c\n7,103,2,0,843,b\n9,105,2,0,843,t\n"
TWO = "id,value,field1,field2,field3,name\n1,101,0,0,100,d\n2,101,0,1,400,d\n3,101,0,2,600,e\n4,102,1,0,200,d\n5,102,1,1,100,d\n6,102,1,2,200,e\n7,103,2,0,300,e\n8,105,2,0,300,f\n"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("csv")
    (d / "1.csv").write_text(ONE)
    (d / "2.csv").write_text(TWO)
    return src.open_table(spark, str(d / "1.csv")), src.open_table(spark, str(d / "2.csv"))


def test_types(tables):
    assert dict(tables[0].dtypes) == {"id": "bigint", "main": "bigint", "field1": "bigint", "field2": "bigint", "field3": "bigint", "name": "string"}


def test_join_counts(tables):
    a, b = tables
    assert tb.join_tables(a, b, "main", "value", "inner").count() == 20
    assert tb.join_first_match(a, b, "main", "value", ["id"]).count() == 8
    out = tb.join_tables(a, b, "id", "id", "outer")
    assert out.count() == 9
    assert {r.id: r.field32 for r in out.collect()}[9] == -9999
    assert "name2" in out.columns
    with pytest.raises(ValueError):
        tb.join_unique(a, b.withColumnRenamed("value", "main"), "main")


def test_null_keys_match(spark):
    a = spark.createDataFrame([(None, 1), (2, 2)], "k int, x int")
    b = spark.createDataFrame([(None, 5)], "k int, y int")
    assert sorted((r.x, r.y) for r in tb.join_tables(a, b, "k", "k", "left", nodata=None).collect() if r.y) == [(1, 5)]


def test_pivot(tables):
    a, _ = tables
    rows = {r["main"]: r for r in tb.pivot(a, "main", [("field3", "sum")], ["field2"]).collect()}
    assert rows[101]["field3_sum_field20"] == 1281 and rows[105]["field3_sum_field21"] == 0
    assert tb.pivot(a, "main", [("field3", "max")], condition='"field3" > 1000').collect()[0]["field3_max"] == 1281


def test_edits(tables, spark):
    a, _ = tables
    assert tb.append_row(a, (10, 1, 2, 3, 4, "x")).count() == 9
    assert tb.upsert(a, spark.createDataFrame([(1, 9, 9, 9, 9, "n")], a.schema), "id").where("id = 1").first().main == 9
    assert tb.calculate(a, '"field3" / 2', "half").where("id = 4").first().half == 13
    assert tb.calculate_multi(a, ['"none"'], ["z"], -1).first().z == -1
    assert tb.filter_values(a, "id", '"main" == 103').collect()[0].id == 7


def test_headerless_and_export(spark, tmp_path):
    (tmp_path / "x.txt").write_text("1\t2.5,a\n3\t\tb\n")
    df = src.open_text(spark, str(tmp_path / "x.txt"), header=False, field_names=["n"])
    assert df.columns == ["n", "field2", "field3"] and dict(df.dtypes)["n"] == "bigint"
    src.write_text(df.selectExpr("n", "CAST(n AS double) / 3 AS x"), str(tmp_path / "out"), decimals=3, decimal=",")
    text = "".join(p.read_text() for p in sorted((tmp_path / "out").glob("part-*")))
    assert "0,333" in text


def test_dbf(spark, tmp_path):
    head = struct.pack("<B3BIHH20x", 3, 24, 1, 1, 2, 32 + 32 * 3 + 1, 1 + 5 + 7 + 4)
    fields = b"".join(struct.pack("<11sc4xBB14x", n.encode(), k.encode(), w, d) for n, k, w, d in (("ID", "N", 5, 0), ("VAL", "N", 7, 2), ("NAME", "C", 4, 0)))
    rows = b" " + b"    7" + b"   1.25" + b"ab  " + b" " + b"    8" + b"       " + b"cd  "
    (tmp_path / "t.dbf").write_bytes(head + fields + b"\r" + rows)
    got = [tuple(r) for r in src.open_table(spark, str(tmp_path / "t.dbf")).collect()]
    assert got == [(7, 1.25, "ab"), (8, None, "cd")]


def test_raster_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(0, 0, 1.5), (0, 1, None), (2000, 0, 3.0)], "r int, c int, v double")
    src.write_raster(df, str(tmp_path / "r"), scale=0.5, kind="int")
    got = src.read_raster(spark, str(tmp_path / "r"), scale=0.5)
    assert sorted((r.r, r.c, r.v) for r in got.where("v is not null").collect()) == [(0, 0, 1.5), (2000, 0, 3.0)]
    assert src.read_raster(spark, str(tmp_path / "r"), scale=0.5, window=(1990, 0, 2010, 5)).count() == 1


def test_metadata(spark, tmp_path):
    (tmp_path / "m.xml").write_text("<LANDSAT_METADATA_FILE><A><SPACECRAFT_ID>L8</SPACECRAFT_ID><PROCESSING_LEVEL>L1</PROCESSING_LEVEL><DATE_ACQUIRED>2020-01-02</DATE_ACQUIRED><SUN_ELEVATION>45.5</SUN_ELEVATION><REFLECTANCE_MULT_BAND_1>2.0E-5</REFLECTANCE_MULT_BAND_1></A></LANDSAT_METADATA_FILE>")
    row = src.landsat_products(spark, str(tmp_path / "m.xml"), [1]).first()
    assert row.sun_elevation == 45.5 and row.scale == 2e-5 and row.k1 is None
