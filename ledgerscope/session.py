"""Session helpers: the shared folder for cut lineage, and size-checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of at most this many are broadcast after they have been counted; about 32 bytes each.
BROADCAST_ROWS = 1_000_000
#: A row of compressed ids takes a few bytes in a file and many times that in a broadcast.
FILE_FACTOR = 32


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, named by ``spark.checkpoint.dir``.

    Where the setting is absent and Spark runs in one process (tests), a temporary
    folder is made and remembered in the session; elsewhere its absence is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    made = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def honest_sizes(spark: SparkSession) -> None:
    """Let Spark take files for what their rows take in memory, unless the session says otherwise.

    Else it broadcasts a table of millions of rows, which the driver must hold, because its file is small.
    """
    name = "spark.sql.sources.fileCompressionFactor"
    if float(spark.conf.get(name)) == 1.0:
        spark.conf.set(name, str(float(FILE_FACTOR)))


def plain_unions(spark: SparkSession) -> None:
    """Unions don't count as dealt like their parts.

    Spark 4.1 skips the shuffle for a join over a union of frames that are dealt alike, and then may run the union
    with the partitions of all parts one after the other: "Can't zip RDDs with unequal numbers of partitions".
    """
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str = "step") -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it again.

    This cuts the lineage; the files outlive any executor.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast of a materialised frame if a count proves it has few rows.

    Beyond that the frame is returned as it is and Spark shuffles for the join.
    """
    return F.broadcast(df) if df.count() <= rows else df


def left_join(df: DataFrame, other: DataFrame, key: str) -> DataFrame:
    """A left join on one column of a materialised frame; rows without a key meet nothing and are not shuffled.

    In a plain left join all of them would go to the task that null hashes to.
    """
    keyed = df.filter(F.col(key).isNotNull()).join(other, key, "left")
    return keyed.unionByName(df.filter(F.col(key).isNull()), allowMissingColumns=True)
