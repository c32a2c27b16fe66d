"""Hard-negative mining: the kth score of every window by distributed radix selection.

Vectors are packed into blocks of GROUP rows, anchors into blocks of ANCHORS; a task works out the integer scores of one by
the other as a matrix product and keeps none of them. A window is what is asked of an anchor: rows of its label or of others,
a range of scores, and how many. Each pass counts, for every window that is open, its rows by the next digit of the score
(how far below the window's top), and adds the histograms up over all blocks: the first digit at which enough rows have been
seen is the kth row's. A window whose rows down to there are few is settled, the others go on to the next digit, and those
that many equal scores leave open to the digits of vec_id. Only then are the rows down to each window's bound gathered and
ranked. All state is in tables written to the shared folder; windows never pass through the driver.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import arrow_rows, cut, slices

#: Rows and anchors of a block, anchors whose scores are held at once, bits of a digit, and how many rows for each one asked
#: for may be gathered.
GROUP, ANCHORS, AT_ONCE, DIGIT, SLACK = 8192, 1024, 64, 8, 4
#: Magnitude from which on a component takes no part: scores of 512 components stay within 64 bits.
LARGEST = 1 << 26
#: Bytes of anchor blocks that are broadcast, at most.
BROADCAST_BYTES = 32 << 20
#: Windows of an anchor block, packed: the anchor's place, id and score of the positive that it is for, whether it asks for
#: the same label, its range of scores, its digits so far (of score, then of id), how many rows are still to be found, and
#: whether it is open.
_KINDS = {"anchor": "<i4", "pid": "<i8", "pscore": "<i8", "same": "?", "lo": "<i8", "hi": "<i8", "d": "<i8", "u": "<u8", "need": "<i8", "open": "?"}
WINDOWS = "h int, id binary, label binary, vec binary, " + ", ".join(f"{k} binary" for k in _KINDS) + ", n_open int"
FOUND = "h int, w int, anchor_id long, pid long, pscore long, id long, score long"


def _packed(rows: DataFrame, group: str, dims: int) -> DataFrame:
    """A row a group: ids and labels as 64-bit integers, vectors as 32-bit ones, `dims` each (shorter ones end in zeros)."""

    def pack(key, table):
        vec = table.column("vec")
        size = np.asarray(pc.list_value_length(vec)).astype(np.int64)
        out = np.zeros((len(vec), dims), "<i4")
        out[np.repeat(np.arange(len(vec)), size), np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)] = np.asarray(pc.list_flatten(vec))
        as_bytes = lambda c: np.asarray(table.column(c)).astype("<i8").tobytes()
        return pa.table({group: pa.array([key[0].as_py()], pa.int32()), **{c: pa.array([x], pa.binary()) for c, x in (("id", as_bytes("id")), ("label", as_bytes("label")), ("vec", out.tobytes()))}})

    return rows.groupBy(group).applyInArrow(pack, f"{group} int, id binary, label binary, vec binary")


def _block(row: dict, dims: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return np.frombuffer(row["id"], "<i8"), np.frombuffer(row["label"], "<i8"), np.frombuffer(row["vec"], "<i4").reshape(-1, dims)


def _windows(row: dict) -> dict[str, np.ndarray]:
    return {k: np.frombuffer(row[k], kind).copy() for k, kind in _KINDS.items()}


def _window_row(row: dict, w: dict[str, np.ndarray]) -> pa.Table:
    own = {"h": pa.array([row["h"]], pa.int32())} | {c: pa.array([row[c]], pa.binary()) for c in ("id", "label", "vec")}
    return pa.table(own | {k: pa.array([w[k].astype(kind).tobytes()], pa.binary()) for k, kind in _KINDS.items()} | {"n_open": pa.array([int(w["open"].sum())], pa.int32())})


def _scores(anchors: np.ndarray, vecs: np.ndarray) -> np.ndarray:
    """Integer inner products, by floating point where that is exact."""
    bound = float(np.abs(anchors).max(initial=0)) * float(np.abs(vecs).max(initial=0)) * anchors.shape[1]
    if bound < 1 << 52:
        return (anchors.astype(np.float64) @ vecs.astype(np.float64).T).astype(np.int64)
    return anchors.astype(np.int64) @ vecs.astype(np.int64).T


def _each_window(a: dict, b: dict, dims: int, chosen):
    """(window, scores, rows) for the windows of a that `chosen` names: scores in range, of rows of b by their places."""
    ids, labels, vecs = _block(a, dims)
    row_ids, row_labels, rows = _block(b, dims)
    w = _windows(a)
    todo = chosen(w)
    todo = todo[np.argsort(w["anchor"][todo], kind="stable")]
    used = np.unique(w["anchor"][todo])
    for at in range(0, len(used), AT_ONCE):
        part = used[at : at + AT_ONCE]
        scores = _scores(vecs[part], rows)
        lo, hi = np.searchsorted(w["anchor"][todo], [part[0], part[-1] + 1])
        place = np.searchsorted(part, w["anchor"][todo[lo:hi]])
        for i, p in zip(todo[lo:hi].tolist(), place.tolist(), strict=True):
            own = scores[p]
            keep = (own >= w["lo"][i]) & (own <= w["hi"][i]) & ((row_labels == labels[part[p]]) == w["same"][i]) & (row_ids != ids[part[p]])
            at_rows = np.flatnonzero(keep)
            yield w, i, own[at_rows], at_rows, row_ids


def _pairs(blocks: DataFrame, windows: DataFrame, n_blocks: int, dims: int) -> DataFrame:
    """a, b: every block of windows beside every block of rows, a stated set of anchors against all rows in blocks."""
    own = windows.select("h", F.struct("*").alias("a"))
    most = ANCHORS * (4 * dims + 500)  # bytes of a block with its windows
    own = F.broadcast(own) if n_blocks * most <= BROADCAST_BYTES else own
    return blocks.select(F.struct("*").alias("b"), F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("h")).join(own, "h").select("a", "b")


def _selected(blocks: DataFrame, windows: DataFrame, n_blocks: int, dims: int, score_bits: int, least_id: int, id_bits: int) -> DataFrame:
    """Rows (FOUND) among which are each window's first `need` ones, by score from the top, then by id."""
    levels = [("d", s) for s in range(max(0, score_bits - DIGIT), -DIGIT, -DIGIT)] + [("u", s) for s in range(max(0, id_bits - DIGIT), -DIGIT, -DIGIT)]

    def steps(digit: str, shift: int, last: bool):
        """The functions of a pass: histograms of a block, and what they make of the windows."""

        def count(batches):
            for batch in batches:
                for x in batch.to_pylist():
                    out = ([], [], [])
                    for w, i, score, rows, ids in _each_window(x["a"], x["b"], dims, lambda w: np.flatnonzero(w["open"])):
                        d = w["hi"][i] - score
                        if digit == "d":
                            value = (d[d >= w["d"][i]] - w["d"][i]) >> shift
                        else:
                            u = (ids[rows[d == w["d"][i]]] - least_id).astype(np.uint64)
                            value = ((u[u >= w["u"][i]] - w["u"][i]) >> np.uint64(shift)).astype(np.int64)
                        n = np.bincount(value[value < 2 << DIGIT], minlength=1) if len(value) else np.zeros(1, np.int64)
                        buckets = np.flatnonzero(n)
                        # the window's last row is no further down than where this block alone has enough
                        buckets = buckets[: int(np.searchsorted(np.cumsum(n[buckets]), w["need"][i])) + 1]
                        out[0].append(np.full(len(buckets), i, np.int32))
                        out[1].append(buckets)
                        out[2].append(n[buckets])
                    own = [np.concatenate([*o, np.zeros(0, np.int64)]) for o in out]
                    yield from slices(pa.RecordBatch.from_arrays([pa.array(np.full(len(own[0]), x["a"]["h"], np.int32)), pa.array(own[0].astype(np.int32)), pa.array(own[1].astype(np.int64)), pa.array(own[2].astype(np.int64))], names=["h", "w", "bucket", "n"]))

        def narrow(state, counts):
            row = state.to_pylist()[0]
            w = _windows(row)
            win, bucket, n = (np.asarray(counts.column(c)) for c in ("w", "bucket", "n"))
            order = np.lexsort((bucket, win))
            win, bucket, n = win[order], bucket[order], n[order]
            seen = np.cumsum(n)
            first = np.searchsorted(win, np.arange(len(w["open"]) + 1))
            for i in np.flatnonzero(w["open"]):
                lo, hi = first[i], first[i + 1]
                before = seen[lo - 1] if lo else 0
                at = lo + int(np.searchsorted(seen[lo:hi] - before, w["need"][i]))
                if at >= hi:  # all the window's rows are wanted
                    w["d"][i], w["u"][i], w["open"][i] = w["hi"][i] - w["lo"][i], np.uint64(0xFFFFFFFFFFFFFFFF), False
                    continue
                passed = int(seen[at - 1] - before) if at > lo else 0
                settled = last or seen[at] - before <= SLACK * w["need"][i]
                step = int(bucket[at]) << shift
                if digit == "d":
                    w["d"][i] += step + ((1 << shift) - 1 if settled else 0)
                    w["u"][i] = np.uint64(0xFFFFFFFFFFFFFFFF) if settled else 0
                else:
                    w["u"][i] = np.uint64(min(int(w["u"][i]) + step + ((1 << shift) - 1 if settled else 0), (1 << 64) - 1))
                if settled:
                    w["open"][i] = False
                else:
                    w["need"][i] -= passed
            return _window_row(row, w)

        return count, narrow

    for digit, shift in levels:
        count, narrow = steps(digit, max(shift, 0), (digit, shift) == levels[-1])
        counts = _pairs(blocks, windows, n_blocks, dims).mapInArrow(count, "h int, w int, bucket long, n long").groupBy("h", "w", "bucket").agg(F.sum("n").alias("n"))
        windows = cut(windows.groupBy("h").cogroup(counts.groupBy("h")).applyInArrow(narrow, WINDOWS), "windows")
        if windows.where("n_open > 0").isEmpty():
            break

    def gather(batches):
        for batch in batches:
            for x in batch.to_pylist():
                out = [[np.zeros(0, np.int64)] for _ in range(6)]
                anchor_ids = np.frombuffer(x["a"]["id"], "<i8")
                for w, i, score, rows, ids in _each_window(x["a"], x["b"], dims, lambda w: np.flatnonzero(w["lo"] <= w["hi"])):
                    d, u = w["hi"][i] - score, (ids[rows] - least_id).astype(np.uint64)
                    keep = np.flatnonzero((d < w["d"][i]) | ((d == w["d"][i]) & (u <= w["u"][i])))
                    full = lambda v: np.full(len(keep), v, np.int64)  # noqa: B023, E731
                    for o, v in zip(out, (full(i), full(anchor_ids[w["anchor"][i]]), full(w["pid"][i]), full(w["pscore"][i]), ids[rows[keep]], score[keep]), strict=True):
                        o.append(v)
                own = [np.concatenate(o) for o in out]
                yield from slices(pa.RecordBatch.from_arrays([pa.array(np.full(len(own[0]), x["a"]["h"], np.int32)), pa.array(own[0].astype(np.int32)), *map(pa.array, own[1:])], names=["h", "w", "anchor_id", "pid", "pscore", "id", "score"]))

    return _pairs(blocks, windows, n_blocks, dims).mapInArrow(gather, FOUND)


def usable(rows: DataFrame, scale: int, vec_col: str) -> Column:
    """Whether the vector and all its components are there, finite, and below LARGEST once scaled."""
    return F.col(vec_col).isNotNull() & F.forall(F.col(vec_col), lambda x: F.coalesce(F.abs(x.cast("double")) < LARGEST / scale, F.lit(False)) & ~F.coalesce(F.isnan(x.cast("double")), F.lit(True)))


def mine_negatives(rows: DataFrame, k: int = 10, positives: int = 5, low: int = 30, high: int = 90, every: int = 100, scale: int = 256, id_col: str = "vec_id", label: Column | None = None, vec_col: str = "embedding") -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    A component x counts as floor(scale * x); a score is the inner product with the anchor, a row whose id is divisible by
    `every`. An anchor's positives are its first `positives` rows of the same label, by score from the top, then by id; for
    each, the first `k` rows of other labels with low * positive_score <= 100 * negative_score <= high * positive_score.
    Rows with a null id, label or vector, or a component that is null, not finite or of 2**26 and more once scaled, take no
    part. Equal rows count once; rows that share an id are neither positives nor negatives of each other; a shorter vector
    ends in zeros. Empty tables, or no anchors: no rows. label: a column for the label, "label" if not given.
    """
    spark = rows.sparkSession
    arrow_rows(spark, 16)
    whole = F.transform(F.col(vec_col), lambda x: F.floor(x.cast("double") * scale).cast("int"))
    rows = rows.where(usable(rows, scale, vec_col) & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), (F.col("label") if label is None else label).cast("long").alias("label"), whole.alias("vec"))
    rows = cut(rows.where("label is not null").distinct(), "vectors")
    norm = F.aggregate("vec", F.lit(0.0), lambda s, x: s + x.cast("double") * x)
    is_anchor = F.col("id") % every == 0
    n, n_anchors, dims, far, lo_id, hi_id = rows.agg(F.count("*"), F.count_if(is_anchor), F.max(F.size("vec")), F.max(norm), F.min("id"), F.max("id")).first()
    kind = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if not n_anchors or not dims:
        return spark.createDataFrame([], kind)
    far, n_blocks = int(far) + 1, -(-n_anchors // ANCHORS)  # no score is beyond the largest square of a norm
    least_id, id_bits, score_bits = lo_id, max(1, (hi_id - lo_id).bit_length()), (2 * far).bit_length()
    deal = lambda count: F.pmod(F.xxhash64("id", "label", "vec"), F.lit(count)).cast("int")
    # the packed rows are megabytes each, so a task that packs has few of them
    blocks = cut(_packed(rows.withColumn("g", deal(-(-n // GROUP))), "g", dims), "blocks")
    anchors = cut(_packed(rows.where(is_anchor).withColumn("h", deal(n_blocks)), "h", dims), "anchors")

    def ask(batches):
        for batch in batches:
            for row in batch.to_pylist():
                full = lambda x: np.full(len(row["id"]) // 8, x)  # noqa: B023, E731
                yield from _window_row(row, {"anchor": np.arange(len(row["id"]) // 8), "pid": full(0), "pscore": full(0), "same": full(True), "lo": full(-far), "hi": full(far), "d": full(0), "u": full(0), "need": full(positives), "open": full(True)}).to_batches()

    def again(state, found):
        row = state.to_pylist()[0]
        anchor, pid, score = (np.asarray(found.column(c)).astype(np.int64) for c in ("w", "id", "score"))
        lo, hi = -((-low * score) // 100), (high * score) // 100
        full = lambda x: np.full(len(score), x)
        return _window_row(row, {"anchor": anchor, "pid": pid, "pscore": score, "same": full(False), "lo": lo, "hi": hi, "d": full(0), "u": full(0), "need": full(k), "open": hi >= lo})

    select = lambda windows: _selected(blocks, cut(windows, "windows"), n_blocks, dims, score_bits, least_id, id_bits)
    place = F.row_number().over(Window.partitionBy("h", "w").orderBy(F.desc("score"), "id"))
    own = select(anchors.mapInArrow(ask, WINDOWS)).withColumn("rank", place).where(F.col("rank") <= positives)
    found = select(anchors.groupBy("h").cogroup(own.groupBy("h")).applyInArrow(again, WINDOWS)).withColumn("rank", place).where(F.col("rank") <= k)
    return found.select("anchor_id", F.col("pid").alias("positive_id"), "rank", F.col("id").alias("negative_id"), F.col("pscore").alias("positive_score"), F.col("score").alias("negative_score"))


#: The same by SQL over embeddings, for small tables (each anchor meets all rows).
SQL = """
WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [floor(256 * x::DOUBLE)::BIGINT FOR x IN embedding] AS q FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_sum([a.q[i] * b.q[i] FOR i IN range(1, len(a.q) + 1)])::BIGINT AS score FROM e a JOIN e b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, row_number() OVER w::INT AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 10
"""
