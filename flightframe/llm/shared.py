"""Helpers that several operators of this subpackage use: table access, the shared work folder, Arrow slices."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


#: Spark's setting by which a query's shuffle files are deleted when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def work_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a new temporary one if none is set.

    A temporary folder is on one machine, so it will do on a local master only.
    """
    sc = spark.sparkContext
    place = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not place:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and the executors share")
        place = tempfile.mkdtemp(prefix="spark-")
        sc.setCheckpointDir(place)
        place = sc.getCheckpointDir()
    return place.rstrip("/")


def written(spark: SparkSession, df: DataFrame, name: str, *done: DataFrame, codec: str | None = None) -> DataFrame:
    """Cut the lineage: write df as Parquet in the shared folder and read it back.

    A lost executor then costs at most the stage that runs, never the jobs that led to it.  Shuffle files go when the table
    is whole, as nothing reads them again.  done: tables written before
    that nothing else reads from now on; their files go once df is whole.  codec: Parquet's compression, by default the session's.
    """
    path = f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        (df.write.option("compression", codec) if codec else df.write).parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    for old in done:
        forget(spark, old)
    return spark.read.schema(df.schema).parquet(path)


def forget(spark: SparkSession, df: DataFrame) -> None:
    """Delete the files of a table that written() returned."""
    files = df.inputFiles()
    if files:
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def schema_with(df: DataFrame, **added: str) -> StructType:
    """The schema of df and more columns, name=type."""
    schema = StructType(list(df.schema.fields))
    for name, kind in added.items():
        schema = schema.add(name, kind)
    return schema


def text_slices(batch: pa.RecordBatch, column: str, most_bytes: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Cut a batch into runs of whole rows with at most most_bytes of text each (a longer text is a run of its own).

    Yields the rows, their UTF-8 bytes and the n + 1 offsets into them; a null text counts as empty.
    """
    at = 0
    texts = batch.column(column).cast(pa.large_binary()).fill_null(b"")
    while at < batch.num_rows:
        part = texts.slice(at)
        offsets = np.frombuffer(part.buffers()[1], np.int64)[part.offset : part.offset + len(part) + 1]
        n = max(1, int(np.searchsorted(offsets, offsets[0] + most_bytes, side="right")) - 1)
        n = min(n, len(part))
        data = part.buffers()[2]
        data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[n]] if data is not None and data.size else np.zeros(0, np.uint8)
        yield batch.slice(at, n), data, offsets[: n + 1] - offsets[0]
        at += n
