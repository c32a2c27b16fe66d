"""Benchmark decontamination by winnowing, with DataFrame functions only.

Fingerprints of a text: the least 5-word hash of each 4 that follow one another (Schleimer, Wilkerson and Aiken 2003). Every
span of 8 words has one, the same wherever the span stands, so every shared span of 8 words shares a fingerprint. Test and
training fingerprints are joined; documents with a hit are read again and their 8-word windows compared with the items'.
Items of fewer than 8 words are one window each and are compared with all spans of their length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import cut, few, row_key

#: Words of a window, of a hashed gram, and grams that a winnowing window has (8 - 5 + 1).
WINDOW, GRAM, GRAMS = 8, 5, 4
_PART = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def word_array(text: Column) -> Column:
    """Words: runs of 0-9, a-z and all beyond ASCII, A-Z lower-cased first and nothing else; null text: no words."""
    text = F.coalesce(text, F.lit(""))
    ascii_lower = F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    return F.array_remove(F.split(ascii_lower, _PART), "")


def let(value: Column, body) -> Column:
    """body(value) with the value worked out once: Catalyst would put its expression into a lambda, for every element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _each(array: Column, width: int, f) -> Column:
    """f(i) for each i from 1 at which `width` elements of the array begin."""
    return F.when(F.size(array) >= width, F.transform(F.sequence(F.lit(1), F.size(array) - (width - 1)), f))


def grams(words: Column, n: int) -> Column:
    """Hashes of the n-word spans in order; too few words: null."""
    return let(words, lambda w: _each(w, n, lambda i: F.xxhash64(F.slice(w, i, n))))


def fingerprints(words: Column) -> Column:
    """Distinct least hashes of each GRAMS grams that follow one another; under WINDOW words: null."""
    return let(grams(words, GRAM), lambda g: F.array_distinct(_each(g, GRAMS, lambda i: F.array_min(F.slice(g, i, GRAMS)))))


def spans(words: Column, n: int) -> Column:
    """The n-word spans in order; too few words: null."""
    return let(words, lambda w: _each(w, n, lambda i: F.slice(w, i, n)))


def window_hits(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """k, at, words, item: each occurrence of a window of an item in a row of docs, at word `at` from 0, of `words` words.

    k is row_key(id_col, text_col), so repeated rows share theirs and their hits stand once.
    """
    tests = cut(items.select(F.col(item_col).cast("string").alias("item"), word_array(F.col(item_text_col)).alias("words")).where(F.size("words") > 0).distinct(), "items")
    rows = docs.select(row_key(id_col, text_col).alias("k"), word_array(F.col(text_col)).alias("words"))
    test_prints = few(tests.select(F.explode(fingerprints(F.col("words"))).alias("print")).distinct())
    found = rows.select("k", F.explode(fingerprints(F.col("words"))).alias("print")).join(test_prints, "print").select("k").distinct()
    lengths = sorted(r[0] for r in tests.where(F.size("words") < WINDOW).select(F.size("words")).distinct().collect())  # at most 7 numbers
    wide = tests.select("item", F.explode(spans(F.col("words"), WINDOW)).alias("span")).distinct()
    hits = _spans(rows.join(few(cut(found, "found")), "k"), wide, WINDOW)
    if lengths:
        hits = hits.union(_short_spans(rows, tests.where(F.size("words") < WINDOW), lengths))
    return hits.distinct()


def _spans(rows: DataFrame, tests: DataFrame, n: int) -> DataFrame:
    """Spans of n words of rows that are a test's span, word by word: by hash first."""
    hashed = few(tests.withColumn("h", F.xxhash64("span")))
    own = rows.select("k", F.posexplode(spans(F.col("words"), n)).alias("at", "s"))
    return own.withColumn("h", F.xxhash64("s")).join(hashed, "h").where("s = span").select("k", "at", F.lit(n).alias("words"), "item")


def _short_spans(rows: DataFrame, tests: DataFrame, lengths: list[int]) -> DataFrame:
    """Spans of rows that are the words of one of the (short) tests, in one pass over the rows for all lengths: by 128-bit hashes."""
    keys = lambda x: (F.xxhash64(x).alias("h"), F.xxhash64(F.lit(1), x).alias("g"))
    hashed = few(tests.select("item", F.size("words").alias("n"), *keys(F.col("words"))))
    kind = "array<struct<at:int,n:int,h:bigint,g:bigint>>"

    def every(w: Column) -> Column:
        each = lambda n: _each(w, n, lambda i: F.struct((i - 1).alias("at"), F.lit(n).alias("n"), *keys(F.slice(w, i, n))))
        return F.concat(*(F.coalesce(each(n).cast(kind), F.array().cast(kind)) for n in lengths))

    own = rows.select("k", F.explode(let(F.col("words"), every)).alias("s")).select("k", "s.*")
    return own.join(hashed, ["n", "h", "g"]).select("k", "at", F.col("n").alias("words"), "item")


def contamination(docs: DataFrame, items: DataFrame, least_items: int = 2, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """k, doc_id, n_words, n_hit, n_items, items_sha256, contaminated of every row of docs.

    n_hit counts words inside any occurrence of an item's window, n_items the items with one; items_sha256 is over their ids
    as strings, sorted and comma-joined (none: of the empty string). Null and wordless texts have no words; null or wordless
    items match nothing; repeated rows have the same result each; items that share an id are one item. Empty docs: no rows.
    """
    hits = cut(window_hits(docs, items, id_col, text_col, item_col, item_text_col), "hits")
    covered = hits.select("k", F.explode(F.sequence("at", F.col("at") + F.col("words") - 1)).alias("w")).distinct().groupBy("k").agg(F.count("*").alias("n_hit"))
    named = hits.select("k", "item").distinct().groupBy("k").agg(F.count("*").alias("n_items"), F.sha2(F.array_join(F.array_sort(F.collect_list(F.coalesce("item", F.lit("")))), ","), 256).alias("items_sha256"))
    found = few(cut(covered.join(named, "k"), "contaminated"))
    every = docs.select(row_key(id_col, text_col).alias("k"), F.col(id_col).cast("long").alias("doc_id"), F.size(word_array(F.col(text_col))).cast("long").alias("n_words"))
    zero = F.lit(0).cast("long")
    return every.join(found, "k", "left").select("k", "doc_id", "n_words", F.coalesce("n_hit", zero).alias("n_hit"), F.coalesce("n_items", zero).alias("n_items"), F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"), (F.coalesce("n_items", zero) >= least_items).alias("contaminated"))
