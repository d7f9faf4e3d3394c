"""Join helpers: size-checked broadcast and key-first payload attachment."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

DEFAULT_BROADCAST_BYTES = 64 * 1024 * 1024


def estimate_bytes(df: DataFrame) -> tuple[int, int]:
    """(rows, approximate bytes) of a DataFrame from one aggregation pass.

    Array columns count their elements, strings their characters, so the
    estimate follows the actual payload instead of schema guesses.
    """
    aggs = [F.count(F.lit(1)).alias("_rows")]
    fixed = 0
    for f in df.schema.fields:
        dt = f.dataType
        if isinstance(dt, T.ArrayType):
            w = 8 if isinstance(dt.elementType, (T.DoubleType, T.LongType)) else 4
            aggs.append((F.sum(F.size(F.col(f.name))) * w).alias(f"_b_{f.name}"))
        elif isinstance(dt, (T.StringType, T.BinaryType)):
            aggs.append(F.sum(F.length(F.col(f.name))).alias(f"_b_{f.name}"))
        else:
            fixed += 8
    row = df.agg(*aggs).first()
    rows = int(row["_rows"] or 0)
    var = sum(int(v or 0) for k, v in row.asDict().items() if k.startswith("_b_"))
    return rows, var + rows * (fixed + 16)


def broadcast_if_small(df: DataFrame, spark: SparkSession | None = None,
                       max_bytes: int = DEFAULT_BROADCAST_BYTES) -> DataFrame:
    """Broadcast ``df`` only when its measured size is within ``max_bytes``.

    Above the bound the plain DataFrame is returned and Spark picks a shuffle
    join (or AQE converts it at runtime when the filtered side turns out small).
    """
    _, size = estimate_bytes(df)
    return F.broadcast(df) if size <= max_bytes else df


def attach_by_key(rows: DataFrame, table: DataFrame, on, count: str, most_rows: int = 1_000_000,
                  max_bytes: int = DEFAULT_BROADCAST_BYTES) -> DataFrame:
    """Inner join of ``rows`` with ``table``, which has a row for each key and in ``count`` how many rows have it.

    A small table is broadcast.  Otherwise the keys of more than ``most_rows`` rows are (a table
    has few such keys), and the others meet by shuffle, so that no task gets all rows of a frequent key.
    """
    if estimate_bytes(table)[1] <= max_bytes:
        return rows.join(F.broadcast(table), on)
    hot = F.broadcast(table.where(F.col(count) > most_rows))
    cold = rows.join(hot, on, "left_anti").join(table.where(F.col(count) <= most_rows), on)
    return rows.join(hot, on).unionByName(cold)
