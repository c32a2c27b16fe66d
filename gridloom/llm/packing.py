"""Best-fit packing of token pieces into sequences by exact complements.

Pieces matter to a plan only by their length, so the plan is made over the counts per length (at most max_len numbers):
for the longest length left, single, pair and triple sums of available lengths that fill its gap exactly are looked up
and used as often as their counts allow; where none fits, the longest available length that fits goes in (best fit).
Each use empties a length, so there are at most about max_len different patterns, whatever the number of pieces.
Triples first is not always best, so plans with sums of up to three, two and one are made, and the shortest is taken.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import arrow_rows, chunks, cut, few, free_name

#: Pieces of one length that are numbered together, about.
SALTED = 200_000


@dataclass
class Plan:
    """Slots sorted by length and first rank: ranks from..to-1 of a length go to sequences first_sequence.. at an offset."""

    length: np.ndarray
    rank: np.ndarray
    sequence: np.ndarray
    offset: np.ndarray
    sequences: int


class Sums:
    """Sums of one, two and three of the lengths that are left, by hash: the combinations of a sum in a list, longest first.

    Counts only fall while a plan is made, so a combination that is used up never comes back, and each list is read once.
    """

    def __init__(self, left: np.ndarray, most: int):
        self.left, self.most = left, most
        self.lengths = np.flatnonzero(left)[::-1].tolist()
        self.pairs: dict[int, list[tuple[int, int]]] = {}
        self.at: dict[int, int] = {}
        for i, a in enumerate(self.lengths if most > 1 else []):
            for b in self.lengths[i:]:
                if a + b < len(left):
                    self.pairs.setdefault(a + b, []).append((a, b))

    def pair(self, total: int, taken: int = 0) -> tuple[int, int] | None:
        """The first pair with this sum that is left once one length is taken."""
        found, left = self.pairs.get(total, ()), self.left
        k = self.at.get(total, 0)
        while k < len(found) and not (left[found[k][0]] > 0 and left[found[k][1]] > (found[k][0] == found[k][1])):
            k += 1
        self.at[total] = k
        for a, b in found[k:]:
            if left[a] > (a == taken) and left[b] > (a == b) + (b == taken):
                return a, b
        return None

    def exact(self, gap: int) -> list[int] | None:
        """One, two or three lengths (at most `most`) that fill the gap exactly."""
        if self.left[gap] > 0:
            return [gap]
        if self.most > 1 and (two := self.pair(gap)):
            return list(two)
        for a in self.lengths if self.most > 2 else ():
            if 3 * a < gap:
                break
            if a < gap and self.left[a] > 0 and (two := self.pair(gap - a, a)):
                return [a, *two]
        return None


def make_plan(counts: np.ndarray, max_len: int) -> Plan:
    """counts[n]: pieces of n tokens, n up to max_len. Of plans with sums of up to three, two and one the shortest."""
    return min((_plan(counts, max_len, most) for most in (3, 2, 1)), key=lambda p: p.sequences)


def _plan(counts: np.ndarray, max_len: int, most: int) -> Plan:
    left = np.zeros(max_len + 1, np.int64)
    left[: len(counts)] = counts
    sums = Sums(left, most)
    runs: list[tuple[list[int], int]] = []
    for top in range(max_len, 0, -1):
        while left[top]:
            first, gap = [top], max_len - top
            left[top] -= 1
            while gap:
                if found := sums.exact(gap):
                    first += found
                    left[found[0]] -= 1
                    for x in found[1:]:
                        left[x] -= 1
                    break
                fits = np.flatnonzero(left[: gap + 1])
                if not len(fits):
                    break
                first.append(int(fits[-1]))
                left[fits[-1]] -= 1
                gap -= int(fits[-1])
            sizes, times = np.unique(first, return_counts=True)
            more = int((left[sizes] // times).min())
            left[sizes] -= more * times
            runs.append((first, more + 1))
    slots, used, sequence = [], np.zeros(max_len + 1, np.int64), 0
    for pattern, many in runs:
        at = 0
        for x in pattern:
            slots.append((x, used[x], sequence, at))
            used[x] += many
            at += x
        sequence += many
    slots.sort()
    t = np.array(slots, np.int64).reshape(-1, 4)
    return Plan(t[:, 0], t[:, 1], t[:, 2], t[:, 3], sequence)


def token_pieces(docs: DataFrame, tokenizer_path: str, end_id: int, max_len: int, id_col: str = "doc_id", text_col: str = "text", ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece of every text with its end id (ids: and the ids).

    Pieces have max_len tokens, but for a text's first, which has what is over.

    A null text is empty: one piece with the end id. Repeated rows and null ids stay rows of their own.
    """
    arrow_rows(docs.sparkSession)

    def pieces(batches):
        from .encoders import encoder

        enc = encoder(tokenizer_path)
        kind = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())] + [("ids", pa.binary())] * ids)
        for whole in batches:
            for batch in chunks(whole, "text"):
                flat, at = enc.ended(batch.column("text"), end_id)
                n = np.diff(at)
                many = -(-n // max_len)
                row = np.repeat(np.arange(len(n)), many)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
                over = n - (many - 1) * max_len  # the first piece's length
                start = np.where(piece > 0, over[row] + (piece - 1) * max_len, 0)
                length = np.where(piece > 0, max_len, over[row])
                own, begin = memoryview(flat.astype("<u4", copy=False)).cast("B"), 4 * (at[row] + start)
                spans = [own[a:b] for a, b in zip(begin.tolist(), (begin + 4 * length).tolist(), strict=True)]
                columns = [batch.column("id").take(pa.array(row)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(map(zlib.crc32, spans), pa.int64())] + [pa.array(map(bytes, spans), pa.binary())] * ids
                yield pa.RecordBatch.from_arrays(columns, schema=kind)

    return docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text")).mapInArrow(pieces, "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * ids)


def pack(pieces: DataFrame, max_len: int) -> DataFrame:
    """Adds sequence_id and offset to rows with a `length` of 1 to max_len; other columns stay. No rows: no rows.

    `pieces` is read three times, so it should be a written table. Pieces of one length are numbered by salt and row, with
    prefix sums over the salts, of which a length has as many as its pieces need: no length's pieces meet in one task. Ties go
    by the rows' own values.
    """
    salt, base, place_of, salts = (free_name(pieces, n) for n in ("_salt", "_base", "_rank", "_salts"))
    keys = [c for c in pieces.columns if dict(pieces.dtypes)[c] != "binary"]
    total = np.zeros(max_len + 1, np.int64)
    for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect():  # at most max_len rows
        total[r.length] = r.n
    many = pieces.sparkSession.createDataFrame([(n, int(-(-c // SALTED))) for n, c in enumerate(total.tolist()) if c], f"length long, {salts} long")
    salted = pieces.join(F.broadcast(many), "length").withColumn(salt, F.pmod(F.xxhash64(*keys), F.col(salts)).cast("int")).select(*pieces.columns, salt)
    counts = salted.groupBy("length", salt).agg(F.count("*").alias(base))  # a row for each SALTED pieces, and for each length
    before = few(cut(counts.withColumn(base, F.sum(base).over(Window.partitionBy("length").orderBy(salt)) - F.col(base)), "lengths"))
    plan = pieces.sparkSession.sparkContext.broadcast(make_plan(total, max_len))
    ranked = salted.join(before, ["length", salt]).withColumn(place_of, F.col(base) + F.row_number().over(Window.partitionBy("length", salt).orderBy(*keys)) - 1).select(*pieces.columns, place_of)

    def place(batches):
        p = plan.value
        key = p.length * (1 << 40) + p.rank  # lengths stay apart: ranks are under 2**40
        for batch in batches:
            n, rank = np.asarray(batch.column("length")).astype(np.int64), np.asarray(batch.column(place_of))
            slot = np.searchsorted(key, n * (1 << 40) + rank, "right") - 1
            own = batch.drop_columns([place_of])
            yield pa.RecordBatch.from_arrays([*own.columns, pa.array(p.sequence[slot] + rank - p.rank[slot]), pa.array(p.offset[slot])], names=[*own.schema.names, "sequence_id", "offset"])

    return ranked.mapInArrow(place, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields) + ", sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer_path: str, end_id: int, max_len: int = 1024, id_col: str = "doc_id", text_col: str = "text", ids: bool = False) -> DataFrame:
    """Every piece of every document with its place in a sequence of at most max_len tokens; see token_pieces and pack."""
    return pack(cut(token_pieces(docs, tokenizer_path, end_id, max_len, id_col, text_col, ids), "pieces"), max_len)
