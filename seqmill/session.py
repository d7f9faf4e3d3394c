"""Session helpers.

Cluster settings come from the session: a default is applied only to a key that
neither the caller nor the submitted configuration sets.  The checkpoint folder is
read from ``spark.checkpoint.dir``; a folder of its own is made only for a local
master, since executors elsewhere would not see it.
"""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import SparkSession

#: For sessions that this package starts itself, on a local master.
_LOCAL_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    # wide float arrays: keep Arrow batches moderate
    "spark.sql.execution.arrow.maxRecordsPerBatch": "4096",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}
_LOCAL_ONLY = {"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "20g"}


def get_spark(master: str | None = None, app: str = "seqmill", **conf) -> SparkSession:
    """The running session, or a new one.

    ``conf`` (dots as given) is set as it is.  Defaults go in only where the
    submitted configuration has no value, those for memory and partitions only if
    a local ``master`` is asked for here.
    """
    from pyspark import SparkConf

    running = SparkSession.getActiveSession()
    submitted = SparkConf()
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = dict(_LOCAL_DEFAULTS)
    if master and master.startswith("local"):
        defaults |= _LOCAL_ONLY
    for k, v in defaults.items():
        if running is None and not submitted.contains(k) and k not in conf:
            builder = builder.config(k, v)
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder; one of its own only where none is set and the master is local."""
    sc = spark.sparkContext
    current = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if current:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(current)
        return current
    existing = sc.getCheckpointDir()
    if existing:
        return existing
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    local = tempfile.mkdtemp(prefix="seqmill-ckpt-", dir=os.environ.get("SEQMILL_SCRATCH", "/tmp"))
    sc.setCheckpointDir(local)
    spark.conf.set("spark.checkpoint.dir", local)
    return local


def cut(df):
    """Cut the lineage by a reliable checkpoint in the shared folder."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def staged(df, name: str):
    """Cut the lineage of a large table: Parquet in the shared folder, read again."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/seqmill/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ship(spark: SparkSession) -> None:
    """Make this package importable on the workers, wherever the driver was started."""
    sc = spark.sparkContext
    if getattr(sc, "_seqmill_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    fd, path = tempfile.mkstemp(prefix="seqmill-", suffix=".zip")
    with os.fdopen(fd, "wb") as f, zipfile.ZipFile(f, "w") as z:
        for d, _, names in os.walk(root):
            for n in names:
                if n.endswith(".py"):
                    p = os.path.join(d, n)
                    z.write(p, os.path.relpath(p, os.path.dirname(root)))
    sc.addPyFile(path)
    sc._seqmill_shipped = True
