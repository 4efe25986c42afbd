"""Names and digests of files and projects."""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_UNUSABLE = re.compile(r'[<>:"/\\|?*\x00-\x1f]')


def project_id(name: str) -> str:
    """A name that can be a folder's; anything else is an error."""
    name = name.strip()
    if name in ("", ".", "..") or name.endswith((" ", ".")) or _UNUSABLE.search(name):
        raise ValueError(f"not a project name: {name!r}")
    return name


def free_project_id(name: str, path: str, taken: dict[str, str | None]) -> str:
    """The name, or with as many digits of the path's digest as keep it apart from `taken` names of other paths."""
    digest = hashlib.sha256(path.encode()).hexdigest()
    for candidate in (name, *(f"{name}-{digest[:n]}" for n in (8, 12, 16, 64))):
        if candidate not in taken or taken[candidate] == path:
            return project_id(candidate)
    raise ValueError(f"no free name for {path}")


def file_digests(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """SHA-256, size and time of the files below a path: `path, length, modified, sha256`; whole files, one a row."""
    reader = spark.read.format("binaryFile")
    files = (reader.option("pathGlobFilter", glob) if glob else reader).load(path)
    return files.select("path", "length", F.col("modificationTime").alias("modified"), F.sha2("content", 256).alias("sha256"))


def changed_files(before: DataFrame, after: DataFrame) -> DataFrame:
    """Paths whose size, time or digest differ between two listings, or that stand in one only."""
    same = ["length", "modified", "sha256"]
    a, b = (d.select("path", F.struct(*same).alias(name)) for d, name in ((before, "x"), (after, "y")))
    return a.join(b, "path", "full_outer").where(~F.col("x").eqNullSafe(F.col("y"))).select("path")


def path_key(path: Column) -> Column:
    """A path for comparison: one kind of slash, no empty or `.` steps, no letter case."""
    return F.lower(F.regexp_replace(F.regexp_replace(path, r"\\", "/"), r"/(?:\./|/)+", "/"))


def distinct_paths(df: DataFrame, column: str = "path") -> DataFrame:
    """One row for each path, the least of its spellings."""
    return df.groupBy(path_key(F.col(column)).alias("_key")).agg(F.min(column).alias(column)).drop("_key")
