"""Query registry: name -> (spark builder, DuckDB oracle SQL or None).

Builders take ``(spark, sf_dir)`` and return a lazy DataFrame over the whole
driver tables.  Oracles are independent DuckDB formulations (often brute
force) of the same result with identical column names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
BENCH: list[str] = []


def query(name: str, oracle: str | None = None, bench: bool = False):
    def deco(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        if bench:
            BENCH.append(name)
        return fn
    return deco


def load_all() -> None:
    # importing the modules registers their queries
    from seqmill.plans import q_vectors, q_dataset, q_stats, q_residues, q_align, q_cluster, q_misc  # noqa: F401
