"""Sessions, the cluster's shared folder, lineage cuts and checked broadcasts."""

from __future__ import annotations

import contextlib
import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

#: A side of a join is broadcast only if it has at most this many rows of a few fixed-width columns (about 32 MB).
BROADCAST_ROWS = 1_000_000
#: Bytes of a written table that is broadcast, at most.
BROADCAST_BYTES = 32 << 20
#: The writer looks at a page's size from the first row on, not from the hundredth: pages of rows of megabytes, and the
#: direct buffers that codecs keep for the largest, would be a hundred times as large.
PAGES = {"parquet.page.size.row.check.min": "1"}
#: Whether shuffle files go at the end of the job that wrote them.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def make_spark(app: str = "gridloom", cores: str = "*", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A local session for tests and benchmarks; on a cluster the submitted session is used as it is."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app).config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in conf.items():
        builder = builder.config(k.replace("_", "."), v)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or one of our own where that is unset and all is local (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or getattr(spark, "_gridloom_shared", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="gridloom-")
        spark._gridloom_shared = found
    return found if "://" in found or found.startswith("file:") else "file://" + found


def shared_path(spark: SparkSession, name: str) -> str:
    """A new folder's path under the shared folder; it goes when the session's JVM ends."""
    path = f"{shared_dir(spark)}/gridloom/{name}-{uuid.uuid4().hex}"
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jpath)
    return path


@contextlib.contextmanager
def shuffles_go(spark: SparkSession):
    """What is written here leaves no shuffle files: Spark deletes a job's as it ends, not when the driver collects its garbage."""
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


def cut(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet to the shared folder and reads it again: lost executors don't lose it."""
    path = shared_path(df.sparkSession, name)
    with shuffles_go(df.sparkSession):
        df.write.options(**PAGES).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._cut_path = path
    return out


def release(*cuts: DataFrame) -> None:
    """Deletes the files of tables that cut wrote and nothing reads any more."""
    for df in cuts:
        jpath = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._cut_path)
        jpath.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(jpath, True)


def tidy(spark: SparkSession) -> None:
    """Lets Spark drop what plans that are gone have broadcast: every executor keeps it until the driver collects its garbage."""
    gc.collect()  # Python's handles first
    spark._jvm.System.gc()


def few(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """df marked for broadcast if it has at most `limit` rows (counted), else as it is, for a shuffled join."""
    return F.broadcast(df) if df.count() <= limit else df


def written_bytes(df: DataFrame) -> int:
    """Bytes of the files of a table that cut wrote."""
    jpath = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._cut_path)
    return jpath.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).getContentSummary(jpath).getLength()


def small(df: DataFrame, name: str = "side", limit: int = BROADCAST_ROWS) -> DataFrame:
    """df, worked out once and written, and marked for broadcast if its rows and bytes are few; else for a shuffled join."""
    out = df if hasattr(df, "_cut_path") else cut(df, name)
    return F.broadcast(out) if written_bytes(out) <= BROADCAST_BYTES and out.count() <= limit else out


def collected(df: DataFrame, limit: int = 10_000) -> list:
    """Rows of a table that has to be small, such as signatures or rules; more than `limit` rows is an error."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} rows")
    return rows


def free_name(name: str, *frames: DataFrame) -> str:
    """name, lengthened until none of the frames has such a column (Spark's names have no case)."""
    taken = {c.lower() for df in frames for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
