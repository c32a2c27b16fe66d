"""Flat files of token ids with 64-bit document offsets, written by the executors and memory-mapped by readers.

A folder has, for each part k in ascending order of document ids,
  part-k.bin      the ids of its documents one after another, little-endian unsigned 16-bit if all ids fit, else 32-bit
  part-k.offsets  64-bit places in part-k.bin where each document begins, in ids, and the end
  part-k.docs     64-bit document ids
and manifest.json with each part's counts and its base, the ids in all parts before it (prefix sums).
"""

from __future__ import annotations

import json
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import arrow_rows, chunks, shared_path

#: Stands for a null document id in part-k.docs.
NULL_ID = -(1 << 63)


def _put(fs: pafs.FileSystem, path: str, pieces) -> None:
    """Writes a file under a name of its own and then renames it: a task that runs again leaves the same file."""
    own = f"{path}.{uuid.uuid4().hex}"
    with fs.open_output_stream(own) as out:
        for x in pieces:
            out.write(x)
    if fs.get_file_info(path).type != pafs.FileType.NotFound:  # an earlier attempt's, with the same content
        fs.delete_file(path)
    fs.move(own, path)


def write_token_files(docs: DataFrame, tokenizer_path: str, end_id: int, out_dir: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> str:
    """Encodes whole texts, appends end_id to each, and writes the folder out_dir (default: a new shared one); its path.

    Rows are ordered by id, then text; null ids come first and are kept as NULL_ID; a null text is empty, so it has the
    end id alone. Repeated ids stay separate rows. No rows: no parts. Other columns are ignored.
    """
    spark = docs.sparkSession
    arrow_rows(spark)
    out_dir = out_dir or shared_path(spark, "tokens")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).repartitionByRange(n, "id").sortWithinPartitions("id", "text").select("id", F.col("text").cast("binary").alias("text"))

    def write(batches):
        from pyspark import TaskContext

        from .encoders import encoder

        enc = encoder(tokenizer_path)
        part = TaskContext.get().partitionId()
        fs, base = pafs.FileSystem.from_uri(out_dir)
        kind = "<u2" if max(enc.vocabulary, end_id + 1) <= 1 << 16 else "<u4"
        ids, offsets, held = [], [np.zeros(1, np.int64)], [0]

        def stream():
            for whole in batches:
                for batch in chunks(whole, "text"):
                    flat, at = enc.ended(batch.column("text"), end_id)
                    ids.append(np.asarray(batch.column("id").fill_null(NULL_ID)).astype("<i8"))
                    offsets.append(held[0] + at[1:])
                    held[0] += len(flat)
                    yield flat.astype(kind).tobytes()

        first = next(whole := stream(), None)
        if first is None:
            return
        fs.create_dir(base, recursive=True)
        name = f"{base}/part-{part:05d}"

        def all_pieces():
            yield first
            yield from whole

        _put(fs, f"{name}.bin", all_pieces())
        _put(fs, f"{name}.offsets", [np.concatenate(offsets).astype("<u8").tobytes()])
        _put(fs, f"{name}.docs", [x.tobytes() for x in ids])
        yield pa.RecordBatch.from_pydict({"part": [part], "docs": [sum(map(len, ids))], "ids": held, "kind": [kind]})

    parts = sorted(rows.mapInArrow(write, "part long, docs long, ids long, kind string").collect())  # one row a part
    before, listed = 0, []
    for p in parts:
        listed.append({"part": p.part, "docs": p.docs, "ids": p.ids, "kind": p.kind, "base": before})
        before += p.ids
    fs, base = pafs.FileSystem.from_uri(out_dir)
    fs.create_dir(base, recursive=True)
    _put(fs, f"{base}/manifest.json", [json.dumps(listed).encode()])
    return out_dir


def _mapped(fs: pafs.FileSystem, path: str, kind: str) -> np.ndarray:
    if isinstance(fs, pafs.LocalFileSystem):
        return np.memmap(path, kind, "r")
    with fs.open_input_file(path) as f:
        return np.frombuffer(f.read(), kind)


def read_token_files(spark: SparkSession, folder: str, ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document in the files; with ids also the ids as an array.

    Each task maps one part and adds the part's base to the offsets. ids_crc32 is over little-endian unsigned 32-bit ids.
    """
    fs, base = pafs.FileSystem.from_uri(folder)
    with fs.open_input_stream(f"{base}/manifest.json") as f:
        parts = json.loads(f.read())

    def read(batches):
        for batch in batches:
            for k in batch.column(0).to_pylist():
                p, (fs, base) = parts[k], pafs.FileSystem.from_uri(folder)
                name = f"{base}/part-{p['part']:05d}"
                flat, at, docs = _mapped(fs, f"{name}.bin", p["kind"]), _mapped(fs, f"{name}.offsets", "<u8").astype(np.int64), _mapped(fs, f"{name}.docs", "<i8")
                for i in range(0, len(docs), 4096):
                    to = min(i + 4096, len(docs))
                    got = [np.asarray(flat[at[j] : at[j + 1]]).astype("<u4") for j in range(i, to)]
                    own = docs[i:to]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(own, pa.int64(), mask=own == NULL_ID), pa.array(at[i:to] + p["base"]), pa.array(np.diff(at[i : to + 1])), pa.array([zlib.crc32(x) for x in got], pa.int64())] + [pa.array([x.astype(np.int64) for x in got], pa.list_(pa.int64()))] * ids,
                        names=["doc_id", "start", "n_tokens", "ids_crc32"] + ["ids"] * ids,
                    )

    return spark.range(0, len(parts), 1, max(1, len(parts))).mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * ids)
