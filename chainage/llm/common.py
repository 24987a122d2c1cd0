"""What several operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def short_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Arrow batches of so many rows in this session, for tables of long texts.

    Spark's default of 10,000 rows makes batches of tens of megabytes of text, of which a
    task holds several copies in the JVM and in Python. Batches that are set shorter stay.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= rows:
        spark.conf.set(name, rows)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session, or a temporary one in local mode where it is unset (tests)."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = f"file://{tempfile.mkdtemp(prefix='chainage-')}"
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=True)


def fresh_dir(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def ascii_lower(col):
    """Lower-case A-Z only; lower() would also change other letters."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def groups_of(rows: int, per_group: int) -> int:
    """How many groups of about per_group rows hold all rows; grows with the table, at least 1."""
    return max(1, -(-rows // per_group))


def plain_names(df: DataFrame, keep: tuple[str, ...]) -> tuple[DataFrame, list[str]]:
    """df with all columns but those of `keep` named c0, c1, ..., and the names it had: columns of any name (dots, quotes, clashes) then go through any operator."""
    given = df.columns
    return df.toDF(*[c if c in keep else f"c{i}" for i, c in enumerate(given)]), given
