"""Connected components of a table of links, in a number of steps that grows with the logarithm of their size."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..session import cut, release


def components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """(node, root) of every node that `edges` (two long columns) names; root is the least node that links reach.

    Alternates large-star and small-star steps, each a min per node and a join back, until nothing changes. Every step is
    written to the shared folder, so lineage stays short. No edges: no rows.
    """
    now = cut(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct(), "edges")
    state = None
    for _ in range(rounds):
        both = now.union(now.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        links = F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))
        small = large.join(least, "u").select(F.explode(links).alias("e")).select("e.*").where("u <> v").distinct()
        before, now = now, cut(small, "edges")
        release(before)
        got = tuple(now.agg(F.count("*"), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 40)))).first())
        if state == got:
            break
        state = got
    else:
        raise RuntimeError("components did not settle")
    nodes = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return nodes.union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
