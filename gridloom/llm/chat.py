"""Chat formatting: logged snapshots of growing conversations are collapsed to the longest ones, then rendered.

Each turn's prefix hash is a running sum of its conversation's turn hashes, each salted with its place. A conversation whose
whole hash is the prefix hash of a longer one goes (an anti-join on length and hash); of equal conversations the one of the
least id stays. Only hashes are compared; texts are read for the conversations that stay. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from .common import cut

#: Two lanes of this many bits: sums of 2**20 turns fit 64 bits, and different prefixes agree with a chance of 2**-84.
_LANE = 42
TEMPLATE = ("<|im_start|>", "\n", "<|im_end|>\n")


def prefix_hashes(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv, n (place from 1), last, h1, h2: the hash of each conversation's first n turns, in order of turn, role and text hashes."""
    order = Window.partitionBy("conv").orderBy(*(F.col(c).asc_nulls_last() for c in ("turn", "role", "text_key", "text_length")))
    rows = turns.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), F.col(role).alias("role"), F.xxhash64(F.lit(1), text).alias("text_key"), F.xxhash64(F.lit(2), text).alias("text_length"))
    placed = rows.withColumn("n", F.row_number().over(order))
    lanes = [F.sum(F.pmod(F.xxhash64(F.lit(i), "n", "role", F.isnull("role"), "text_key", "text_length"), F.lit(1 << _LANE))).over(order.rowsBetween(Window.unboundedPreceding, 0)).alias(f"h{i}") for i in (1, 2)]
    return placed.select("conv", "n", (F.lead("n").over(order).isNull()).alias("last"), *lanes)


def maximal_conversations(turns: DataFrame, **columns: str) -> DataFrame:
    """conv and n_turns of the conversations that no longer one continues; of equal ones the least conv (null: least)."""
    hashes = cut(prefix_hashes(turns, **columns), "prefixes")
    whole = hashes.where("last").groupBy("n", "h1", "h2").agg(F.min(F.struct(F.col("conv").isNotNull().alias("known"), "conv")).alias("c"))
    longer = hashes.where("not last").select("n", "h1", "h2").distinct()
    return whole.join(longer, ["n", "h1", "h2"], "left_anti").select(F.col("c.conv").alias("conv"), F.col("n").cast("long").alias("n_turns"))


def render(turns: DataFrame, kept: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, n_turns and chat of the conversations in `kept`: each turn as start mark, role, text, end mark."""
    start, between, end = TEMPLATE
    rows = turns.select(F.col(conv).alias("_c"), F.struct(F.col(turn).alias("t"), F.col(role).alias("r"), F.xxhash64(F.lit(1), text).alias("k1"), F.xxhash64(F.lit(2), text).alias("k2"), F.concat(F.lit(start), F.coalesce(role, F.lit("")), F.lit(between), F.coalesce(text, F.lit("")), F.lit(end)).alias("s")).alias("turn"))
    return rows.join(kept, F.col("_c").eqNullSafe(F.col("conv"))).groupBy("conv").agg(F.first("n_turns").alias("n_turns"), F.array_join(F.transform(F.array_sort(F.collect_list("turn")), lambda x: x["s"]), "").alias("chat")).withColumnRenamed("conv", "conv_id")


def format_chats(turns: DataFrame, **columns: str) -> DataFrame:
    """conv_id, n_turns, chat of the maximal conversations.

    Turns stand by turn number, then role (nulls last), then a hash of the text; repeated rows are turns of their own. A null
    role or text differs from an empty one for matching and renders as nothing. Null ids are one conversation. No turns: no
    rows. One conversation's turns meet in one task, as its chat is one value; groups of equal conversations don't.
    """
    return render(turns, cut(maximal_conversations(turns, **columns), "kept"), **columns)


SQL = r"""
WITH t AS (SELECT conv_id, turn, role, text, '<|im_start|>' || coalesce(role, '') || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10) AS s FROM conversations),
p AS (SELECT conv_id, row_number() OVER w AS n, count(*) OVER (PARTITION BY conv_id) AS n_turns, string_agg(s, '') OVER (PARTITION BY conv_id ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING) AS chat FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)),
whole AS (SELECT min(conv_id) AS conv_id, n_turns, chat FROM p WHERE n = n_turns GROUP BY n_turns, chat)
SELECT conv_id, n_turns, chat FROM whole ANTI JOIN (SELECT DISTINCT n AS n_turns, chat FROM p WHERE n < n_turns) USING (n_turns, chat)
"""
