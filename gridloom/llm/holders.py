"""How many texts hold each shingle, told back to every text: one exchange by hash, in packed blocks.

Texts stand in chunks: a row of a chunk table has the ids of some texts, how many shingles each has, and the shingles (48
bits of each hash). Every chunk sends its shingles by ranges of their hashes, so that a block has about BLOCK of them
whatever the input; the block counts equal ones and sends each chunk the counts in the order in which it sent. The chunk
table is bucketed by chunk, so the counts come to where the chunk lies and the shingles move only once.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import PAGES
from .common import arrow_rows, shared_path

#: Shingles that a block has, about; bits of a shingle that are kept; shingles of a chunk, about.
BLOCK, BITS, CHUNK = 1 << 19, 48, 1 << 18
_BYTES = BITS // 8
KIND = "chunk long, ids binary, sizes binary, h binary"


def kept_bits(h: np.ndarray) -> np.ndarray:
    """The part of 64-bit hashes that is kept."""
    return h >> np.uint64(64 - BITS)


def packed(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :_BYTES]).tobytes()


def unpacked(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // _BYTES, 8), np.uint8)
    out[:, :_BYTES] = np.frombuffer(data, np.uint8).reshape(-1, _BYTES)
    return out.view("<u8").ravel()


class Chunks:
    """Gathers (ids, sizes, kept bits of all shingles in order) and gives rows of a chunk table."""

    def __init__(self):
        self.got: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def add(self, ids: np.ndarray, sizes: np.ndarray, x: np.ndarray):
        if len(ids):
            self.got.append((ids, sizes, x))
        if sum(len(g[2]) for g in self.got) >= CHUNK:
            yield from self.row()

    def row(self):
        if self.got:
            ids, sizes, x = (np.concatenate(c) for c in zip(*self.got, strict=True))
            self.got = []
            yield pa.RecordBatch.from_arrays([pa.array(ids[:1].astype(np.int64)), pa.array([ids.astype("<i8").tobytes()], pa.binary()), pa.array([sizes.astype("<i4").tobytes()], pa.binary()), pa.array([packed(x)], pa.binary())], names=["chunk", "ids", "sizes", "h"])


def bucketed(chunks: DataFrame, name: str) -> DataFrame:
    """A chunk table, written to the shared folder with a bucket for each shuffle partition. Ids must be different."""
    spark = chunks.sparkSession
    path, table = shared_path(spark, name), f"gridloom_{name}_{uuid.uuid4().hex}"
    chunks.write.bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), "chunk").options(path=path, **PAGES).saveAsTable(table)
    out = spark.table(table)
    spark.sql(f"DROP TABLE {table}")  # the catalog's entry; the files stay
    out._cut_path = path
    return out


def _dealt(x: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The order in which a chunk's shingles are sent, block by block, and where each block begins."""
    block = (x >> np.uint64(BITS - bits)).astype(np.uint16)
    order = np.argsort(block, kind="stable")
    return order, np.searchsorted(block[order], np.arange((1 << bits) + 1))


def with_counts(chunks: DataFrame, run, kind: str, flags: bool = False, last=None) -> DataFrame:
    """run(ids, sizes, x, counts) -> record batches of `kind`, for every row of a chunk table; last(): after a task's rows.

    counts: how often each shingle of x stands in all chunks, 255 for that and more; flags: only whether twice or more.
    """
    spark = chunks.sparkSession
    arrow_rows(spark)
    total = (chunks.agg(F.sum(F.octet_length("h"))).first()[0] or 0) // _BYTES
    bits = min(16, max(4, int(total // BLOCK).bit_length()))

    def send(batches):
        for batch in batches:
            for chunk, h in zip(batch.column("chunk").to_pylist(), batch.column("h"), strict=True):
                x = unpacked(h.as_py())
                order, at = _dealt(x, bits)
                low = x[order].astype("<u4")
                full = np.flatnonzero(np.diff(at))
                yield pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), pa.array(np.full(len(full), chunk, np.int64)), pa.array([low[at[b] : at[b + 1]].tobytes() for b in full], pa.binary())], names=["block", "chunk", "low"])

    def count(key, table):
        parts = [np.frombuffer(x.as_py(), "<u4") for x in table.column("low")]
        low = np.concatenate(parts)
        order = np.argsort(low)
        held = low[order]
        start = np.flatnonzero(np.concatenate([[True], held[1:] != held[:-1]]))
        times = np.diff(np.append(start, len(held)))
        counts = np.empty(len(low), np.uint8)
        counts[order] = np.repeat(np.minimum(times, 255), times)
        ends = np.cumsum([len(p) for p in parts])
        back = [np.packbits(c > 1).tobytes() if flags else c.tobytes() for c in np.split(counts, ends[:-1])]
        return pa.table({"chunk": table.column("chunk").combine_chunks(), "block": pa.array([key[0].as_py()] * len(parts), pa.int32()), "counts": pa.array(back, pa.binary())})

    sent = chunks.select("chunk", "h").mapInArrow(send, "block int, chunk long, low binary")
    back = sent.groupBy("block").applyInArrow(count, "chunk long, block int, counts binary").groupBy("chunk").agg(F.collect_list(F.struct("block", "counts")).alias("parts"))

    def meet(batches):
        for batch in batches:
            for ids, sizes, h, parts in zip(*(batch.column(c) for c in ("ids", "sizes", "h", "parts")), strict=True):
                x = unpacked(h.as_py())
                order, at = _dealt(x, bits)
                counts = np.zeros(len(x), np.uint8)
                for p in parts.as_py() or ():
                    own = order[at[p["block"]] : at[p["block"] + 1]]
                    got = np.frombuffer(p["counts"], np.uint8)
                    counts[own] = np.unpackbits(got, count=len(own)) if flags else got
                yield from run(np.frombuffer(ids.as_py(), "<i8"), np.frombuffer(sizes.as_py(), "<i4").astype(np.int64), x, counts)
        if last:
            yield from last()

    return chunks.join(back, "chunk", "left").select("ids", "sizes", "h", "parts").mapInArrow(meet, kind)
