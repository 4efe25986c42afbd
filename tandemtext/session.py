"""Session helpers: table access and durable intermediate results."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Parallelism hint for stages that must not shrink below the cluster's cores.
MIN_PARTITIONS = 12
#: Folders of intermediate results by application.
_WRITTEN: dict[str, list[str]] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table `name` of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, from spark.checkpoint.dir.

    Where that is unset, a temporary folder is made and set, but only if driver and executors are one process (tests, a local
    session); a cluster without a shared folder is an error, as its executors would write where nobody else reads.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="tandemtext-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder of the shared file system, if it is there."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def release(spark: SparkSession) -> None:
    """Deletes all that durable() wrote in this session; DataFrames made of it can no longer be read."""
    for path in _WRITTEN.pop(spark.sparkContext.applicationId, []):
        remove(spark, path)


def durable(df: DataFrame, name: str) -> DataFrame:
    """Write `df` once to the shared folder and return a DataFrame that reads it: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tandemtext/{name}-{uuid.uuid4().hex}"
    _WRITTEN.setdefault(spark.sparkContext.applicationId, []).append(path)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return max(MIN_PARTITIONS, int(spark.conf.get("spark.sql.shuffle.partitions")))


def sized_join(df: DataFrame, ids: DataFrame, key: str, how: str, most_mb: int = 16) -> DataFrame:
    """A semi or anti join with a one-column table of ids: broadcast if the ids, counted, take at most `most_mb`, else shuffled."""
    small = ids.count() * 16 <= most_mb << 20
    return df.join(F.broadcast(ids) if small else ids.hint("merge"), key, how)
