import pytest

# ids: unique, null and repeated; texts: null, empty, blank, short, repeated, very long
LONG = " ".join(f"w{i % 997}x{i % 89}" for i in range(30_000))
PASSAGE = " ".join(f"p{i}" for i in range(60))
ROWS = [
    (1, "Alpha beta gamma delta epsilon zeta eta theta", 7), (2, "alpha BETA gamma delta epsilon zeta eta theta", 7), (3, "", None), (4, None, 1), (None, "alpha beta", 2), (None, None, 2), (5, " \t\n ", 3),
    (6, LONG, 4), (7, LONG + " tail", 4), (8, f"own words here {PASSAGE} and the end of eight", 5), (9, f"other start of nine {PASSAGE} closing", 5), (9, f"other start of nine {PASSAGE} closing", 5),
    (10, "é É ñ 中文 字 <|endoftext|> 😀 x y z", 6), (11, "one", 6), (11, "two words", 6), (12, "a\r\nb\tc  d\x1ce", 8),
]
SCHEMA = "doc_id long, text string, k long"
CLASHES = ["d", "key", "label", "_k", "cid", "score", "words", "n", "length"]


@pytest.fixture(scope="session")
def odd(spark):
    """Awkward rows, with columns whose names the operators use inside."""
    from pyspark.sql import functions as F

    return spark.createDataFrame(ROWS, SCHEMA).withColumns({c: F.lit("clash") for c in CLASHES}).cache()


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)


@pytest.fixture(scope="session")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")
