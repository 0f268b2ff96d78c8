"""Places that the driver and every executor can read, and other helpers of the operators."""

from __future__ import annotations

import math
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A table of at most so many rows of a few numbers or digests may be broadcast.
BROADCAST_ROWS = 200_000
#: Rows of such a table that one task takes.
TASK_ROWS = 50_000


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; in local mode, where one process sees all, a temporary one if none is set."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="barloom-shared-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it again: cuts the lineage, and any executor can be lost after it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def counted(df: DataFrame, name: str, *more: F.Column) -> tuple[DataFrame, dict]:
    """``materialize``, and what the written table holds: rows as ``n``, from the files' footers, and the named aggregates in ``more``, from their columns alone."""
    out = materialize(df, name)
    return out, out.agg(F.count(F.lit(1)).alias("n"), *more).first().asDict()


def lean(of: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The same work on batches, which gives back the memory that Arrow keeps when a partition is done: workers wait beside others that need it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from of(batches)
        pa.default_memory_pool().release_unused()

    return run


def small(df: DataFrame, rows: int) -> DataFrame:
    """``df``, to be broadcast if its known number of rows allows; else it is joined through a shuffle."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def fitted(df: DataFrame, rows: int) -> DataFrame:
    """``df`` in as many tasks as a number of rows asks for, where that is fewer than it has: small tables cost few tasks."""
    return df.coalesce(max(1, math.ceil(rows / TASK_ROWS)))


def discard(*written: DataFrame | None) -> None:
    """Delete what ``materialize`` wrote and nothing reads any more."""
    for df in written:
        if df is not None:
            spark = df.sparkSession
            path = spark._jvm.org.apache.hadoop.fs.Path(df.written_to)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
