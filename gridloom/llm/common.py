"""Helpers that the text operators share; lineage cuts, checked broadcasts and components are the library's own."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .. import session
from ..operators.components import components
from ..operators.ranks import numbered
from ..session import cut, few, release, shared_path, tidy

__all__ = ["arrow_rows", "chunks", "components", "cut", "few", "free_name", "give_back", "numbered", "release", "row_key", "shared_path", "slices", "tidy"]

#: Texts are handled in chunks of about so many bytes, whatever Spark's batch size; a longer text is a chunk alone.
CHUNK_BYTES = 1 << 19
#: Workers give freed arrays back to the system, as they stay from one stage to the next.
WORKERS = {"MALLOC_MMAP_THRESHOLD_": str(4 << 20), "MALLOC_TRIM_THRESHOLD_": str(8 << 20), "MALLOC_ARENA_MAX": "2", "ARROW_DEFAULT_MEMORY_POOL": "system"}
#: Bytes of an Arrow batch to Python, about.
BATCH_BYTES = 4 << 20
#: Rows of a few numbers that a task sends on at once.
OUTPUT_ROWS = 50_000


def arrow_rows(spark: SparkSession, rows: int = 1000) -> None:
    """Keeps Arrow batches to Python small, as texts vary from none to many thousand words, and lets workers find this package.

    The package's folder joins the workers' path, for a driver that was started elsewhere; on a cluster without a shared
    installation the package is shipped in the usual ways (--py-files).
    """
    env, root = spark.sparkContext.environment, str(Path(__file__).resolve().parents[2])
    if root not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = ":".join(filter(None, [env.get("PYTHONPATH"), root]))
    env.update(WORKERS)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def _trim() -> None:
    with contextlib.suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL(None).malloc_trim(0)


def give_back() -> None:
    """Gives memory that Python has freed back to the system, after the driver has put a model together."""
    gc.collect()
    _trim()


def slices(batch: pa.RecordBatch, rows: int = OUTPUT_ROWS):
    """A large batch in parts, as each goes to the JVM whole."""
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def chunks(batch: pa.RecordBatch, column: str, size: int = CHUNK_BYTES):
    """Slices of a batch whose `column` has about `size` bytes each."""
    col = batch.column(column)
    wide = 8 if pa.types.is_large_binary(col.type) or pa.types.is_large_string(col.type) else 4
    if not len(col):
        return
    ends = np.frombuffer(col.buffers()[1], f"<i{wide}", len(col) + 1, col.offset * wide).astype(np.int64)
    at = 0
    while at < len(col):
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + size, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to
    _trim()


def free_name(df: DataFrame, name: str) -> str:
    """name, lengthened until df has no such column."""
    return session.free_name(name, df)


def row_key(id_col: str, text_col: str):
    """A 64-bit key of a row's id and text: equal for repeated rows, not null for null ones."""
    return F.xxhash64(F.lit(7), F.col(id_col), F.col(text_col))
