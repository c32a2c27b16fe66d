"""Closed rings put together from pieces of outlines that were found apart, by list ranking: no ring is walked by one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..session import cut, release
from .components import components


def stitched(pieces: DataFrame, rounds: int = 60) -> DataFrame:
    """ring (its least piece), ring_key, path, area, border and n_pieces of every ring.

    pieces: piece and next (longs: the piece that begins where this one ends), key, path (its points, the last left out),
    cross (what its stretches give to twice the ring's area) and length. Each piece has one next and is one piece's next.
    Places along a ring come by pointer doubling: in every round a piece learns from the piece that it points at, and points
    as far as that one, so rounds grow with the logarithm of the number of pieces. A ring is a row, put together at the end.
    """
    pieces = pieces if hasattr(pieces, "_cut_path") else cut(pieces, "pieces")
    ends = pieces.where("piece <> next").select(F.col("piece").alias("a"), F.col("next").alias("b"))
    roots = cut(components(ends).toDF("piece", "ring"), "rings")
    # a piece whose next begins the ring is its last
    now = cut(ends.toDF("piece", "to").join(roots, "piece").select("piece", "ring", F.when(F.col("to") != F.col("ring"), F.col("to")).alias("to"), F.when(F.col("to") != F.col("ring"), 1).otherwise(0).cast("long").alias("left")), "places")
    for _ in range(rounds):
        if now.where("to IS NOT NULL").isEmpty():
            break
        other = now.select(F.col("piece").alias("to"), F.col("to").alias("far"), F.col("left").alias("more"))
        new = now.where("to IS NOT NULL").join(other, "to").select("piece", "ring", F.col("far").alias("to"), (F.col("left") + F.col("more")).alias("left"))
        before, now = now, cut(now.where("to IS NULL").select("piece", "ring", "to", "left").union(new), "places")
        release(before)
    else:
        raise RuntimeError("rings did not settle")
    placed = pieces.join(now.select("piece", "ring", "left"), "piece", "left").select(F.coalesce("ring", "piece").alias("ring"), F.coalesce("left", F.lit(0)).alias("left"), "key", "path", "cross", "length")
    parts = F.array_sort(F.collect_list(F.struct((-F.col("left")).alias("at"), "path")))
    return placed.groupBy("ring").agg(F.first("key").alias("ring_key"), F.flatten(F.transform(parts, lambda p: p["path"])).alias("path"), (F.sum("cross") / 2).alias("area"), F.sum("length").alias("border"), F.count("*").alias("n_pieces"))


def without_straight(path):
    """A ring's points without those at which it goes straight on."""
    n = F.size(path)
    before = F.concat(F.slice(path, n, 1), F.slice(path, 1, F.greatest(n - 1, F.lit(0))))
    after = F.concat(F.slice(path, 2, F.greatest(n - 1, F.lit(0))), F.slice(path, 1, 1))
    near = F.arrays_zip(before.alias("p"), path.alias("q"), after.alias("s"))
    turns = F.filter(near, lambda t: F.abs((t["q"]["x"] - t["p"]["x"]) * (t["s"]["y"] - t["q"]["y"]) - (t["q"]["y"] - t["p"]["y"]) * (t["s"]["x"] - t["q"]["x"])) > 1e-12)
    return F.transform(turns, lambda t: t["q"])
