"""Commits of a sink (S8, S9, M1): what a commit holds is there, what failed or was stopped is not.

A commit is a table in a folder of its own under ``<folder>/commits``, written by Spark's own job commit,
so rows of failed or repeated task attempts don't get in, and it counts only once its ``_SUCCESS``
mark is there.  Commits are read in order of their names; a named commit that is written again
replaces itself.
"""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _root(folder: str) -> str:
    return f"{folder.rstrip('/')}/commits"


def commit(table: DataFrame, folder: str, name: str | None = None) -> str:
    """Write ``table`` as one commit; returns its name (by default one that sorts after all earlier ones)."""
    name = name or f"{time.time_ns():020d}-{uuid.uuid4().hex}"
    table.write.mode("overwrite").parquet(f"{_root(folder)}/{name}")
    return name


def commits(spark: SparkSession, folder: str) -> list[str]:
    """Names of the finished commits, in order."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{_root(folder)}/*/_SUCCESS")
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path)
    return sorted(s.getPath().getParent().getName() for s in found or [])


def committed(spark: SparkSession, folder: str, names: list[str] | None = None) -> DataFrame | None:
    """The rows of the finished commits with the column ``commit``; None without one."""
    names = commits(spark, folder) if names is None else names
    if not names:
        return None
    rows = spark.read.parquet(*[f"{_root(folder)}/{n}" for n in names])
    place = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2)
    return rows.withColumn("commit", place)


def latest(rows: DataFrame, key: list[str]) -> DataFrame:
    """Of each key's rows those of the last commit that has it."""
    last = rows.groupBy(*[F.col(k).alias(f"_{k}") for k in key]).agg(F.max("commit").alias("_commit"))
    on = rows["commit"] == last["_commit"]
    for k in key:
        on = on & rows[k].eqNullSafe(last[f"_{k}"])
    return rows.join(last, on, "left_semi")
