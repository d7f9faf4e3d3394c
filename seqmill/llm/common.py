"""Helpers shared by the training-data operators."""

from __future__ import annotations

import os
import uuid
import zipfile
import tempfile
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqmill.session import checkpoint_dir

#: Java regular expression of a run of the white space that separates words.
SPACES = r"[\x20\x09-\x0D]+"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the given folder, by any path that Spark's readers open."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared checkpoint folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/seqmill/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage of a table of small rows by a reliable checkpoint."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
    """Cut the lineage of a table with large rows: Parquet in the shared folder, read again."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path, compression=codec)
    return spark.read.schema(df.schema).parquet(path)


def ship(spark: SparkSession) -> None:
    """Make this package importable on the workers, wherever the driver was started."""
    sc = spark.sparkContext
    if getattr(sc, "_seqmill_shipped", False):
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    fd, path = tempfile.mkstemp(prefix="seqmill-", suffix=".zip")
    with os.fdopen(fd, "wb") as f, zipfile.ZipFile(f, "w") as z:
        for d, _, names in os.walk(root):
            for n in names:
                if n.endswith(".py"):
                    p = os.path.join(d, n)
                    z.write(p, os.path.relpath(p, os.path.dirname(root)))
    sc.addPyFile(path)
    sc._seqmill_shipped = True


def text_bytes(col: str = "text"):
    """The column's UTF-8 bytes; null counts as empty."""
    return F.coalesce(F.col(col).cast("binary"), F.lit(b""))


def words(data: bytes) -> list[bytes]:
    """Runs of bytes other than 0x20 and 0x09 to 0x0D (``bytes.split`` splits there)."""
    return data.split()


def chunks(batch: pa.RecordBatch, column: str, max_bytes: int = 8 << 20) -> Iterable[pa.RecordBatch]:
    """Slices of a batch whose ``column`` holds about ``max_bytes`` at most (one row at least)."""
    size = pc.binary_length(batch.column(column)).to_numpy(zero_copy_only=False)
    start, held = 0, 0
    for i, n in enumerate(size):
        if held and held + n > max_bytes:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    if start < batch.num_rows:
        yield batch.slice(start)


def small(df: DataFrame, most_rows: int = 100_000) -> DataFrame:
    """A broadcast hint for a checkpointed table of narrow rows if it has at most ``most_rows``.

    Beyond that the table is returned as it is and Spark joins by shuffle.
    """
    return F.broadcast(df) if df.limit(most_rows + 1).count() <= most_rows else df


def filesystem(uri: str):
    """``(filesystem, path)`` of a folder that driver and executors share."""
    from pyarrow import fs
    return fs.FileSystem.from_uri(uri)


def finite(rows: DataFrame, vector: str) -> DataFrame:
    """Rows whose vector is not null and holds neither null nor non-finite entries."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.where(F.col(vector).isNotNull() & ~bad)


def common_width(rows: DataFrame, vector: str) -> int:
    """The length that most vectors have (of equally frequent ones the greatest); 0 without rows."""
    sizes = rows.groupBy(F.size(vector).alias("w")).agg(F.count("*").alias("n"))
    first = sizes.orderBy(F.desc("n"), F.desc("w")).first()
    return first.w if first else 0


def scaled(column: pa.Array, width: int, scale: int, most: int) -> np.ndarray:
    """Whole numbers ``floor(scale * x)`` of an Arrow list column, a row each, held at plus or minus ``most``."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype("<f8")
    return np.clip(np.floor(scale * flat), -most, most).astype(np.int64).reshape(len(column), width)


def total_joined(rows: DataFrame, totals: DataFrame, key: str, total: str, most_rows: int = 1_000_000,
                 most_keys: int = 100_000) -> DataFrame:
    """``rows`` with the column ``total`` of ``totals(key, total, n)``; null keys meet each other.

    Few totals are broadcast (counted first).  Otherwise the totals of keys with more than
    ``most_rows`` rows are: a table has few such keys.  The others' are joined by shuffle.
    """
    k = totals.select(F.col(key).alias("k_"), total, "n")
    same = F.col(key).eqNullSafe(F.col("k_"))
    if k.limit(most_keys + 1).count() <= most_keys:
        return rows.join(F.broadcast(k.drop("n")), same).drop("k_")
    hot, cold = F.broadcast(k.where(F.col("n") > most_rows).drop("n")), k.where(F.col("n") <= most_rows).drop("n")
    often = rows.join(hot, same).drop("k_")
    return often.unionByName(rows.join(hot, same, "left_anti").join(cold, same).drop("k_"))
