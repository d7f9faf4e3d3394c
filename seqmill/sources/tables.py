"""Driver-table access: one parquet file (or folder) per table name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


class Tables:
    """Lazy table handle: ``t('orders')`` returns the parquet scan.

    Scans are plain ``spark.read.parquet`` so Catalyst prunes columns and pushes
    filters into the reader.
    """

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir

    def path(self, name: str) -> str:
        return f"{self.sf_dir.rstrip('/')}/{name}.parquet"

    def __call__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self.path(name))


def write_table(df: DataFrame, path: str) -> None:
    """A table as Parquet."""
    df.write.mode("overwrite").parquet(path)
