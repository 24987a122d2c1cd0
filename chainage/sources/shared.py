"""The folder that driver and executors share."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session, or a temporary folder where it is unset (tests)."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = f"file://{tempfile.mkdtemp(prefix='chainage-')}"
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def opened(uri: str):
    """A file of any store that pyarrow knows, to be read at any place; for use inside tasks."""
    from pyarrow import fs

    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri.removeprefix("file:")
    store, place = fs.FileSystem.from_uri(uri)
    return store.open_input_file(place)


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> tuple[DataFrame, str]:
    """df written to the shared folder as Parquet, and its folder: for large rows that only a few steps read, to be dropped after them."""
    folder = f"{shared_dir(df.sparkSession)}/rows-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder), folder


def drop(spark: SparkSession, folder: str) -> None:
    """Delete a folder of `stored` once all steps that read it are done."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files of finished steps, which stay until the driver collects its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


#: Rows of a partition, about, where the steps after it sort several columns of them.
ROWS_A_TASK = 200_000


def spread(df: DataFrame, rows: int, *by: str) -> DataFrame:
    """df hashed by columns into partitions of about ROWS_A_TASK of its rows, so that what a task sorts doesn't grow with the table.

    Their number is kept: partitions that are merged by their bytes hold the more rows the
    better these compress.
    """
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // ROWS_A_TASK)), *by)
