"""File sources and sinks (S1-S5, S7-S9): FASTA, membership TSV, splits, ``.npy`` vectors, results."""

from __future__ import annotations

import io
import re
import time
import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqmill.operators.joins import broadcast_if_small
from seqmill.operators.stats import value_ranks
from seqmill.session import cut, ship, staged
from seqmill.sources.commits import commit, commits, committed, latest


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """``file, start, k, last, header, body``: each split's lines, joined by record.

    A split is named by its file and first byte.  ``k`` counts the headers seen in it: lines before its first header
    (k = 0, no header) belong to a record that began in an earlier split, and the last record may go on in later ones.
    """
    ship(spark)
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"),
                                         F.col("_metadata.file_block_start").alias("start"))

    def run(batches):
        name, k, header, body = None, 0, None, []

        def piece(last):
            return pa.RecordBatch.from_arrays(
                [pa.array([name[0]]), pa.array([name[1]]), pa.array([k], pa.int32()), pa.array([last]), pa.array([header], pa.string()),
                 pa.array(["".join(body)])], names=["file", "start", "k", "last", "header", "body"])

        for b in batches:
            starts = b.column("start").to_numpy()
            files = b.column("file").to_pylist()
            for i, line in enumerate(b.column("value").to_pylist()):
                if name != (files[i], starts[i]):
                    if name is not None:
                        yield piece(True)
                    name, k, header, body = (files[i], starts[i]), 0, None, []
                if line.startswith(">"):
                    if k or body:
                        yield piece(False)
                    k, header, body = k + 1, line[1:].rstrip(), []
                else:
                    body.append("".join(line.split()))
        if name is not None:
            yield piece(True)

    return lines.mapInArrow(run, "file string, start long, k int, last boolean, header string, body string")


def _records(spark: SparkSession, path: str) -> DataFrame:
    """``file, ord, h, sequence``: the records of FASTA files, numbered from 0 in order of file name and place.

    Records that lie in one split are whole as they are; only what a split's edges cut, at most two pieces a
    split, is brought together.  A split's first number comes from a running sum of the splits' headers.
    """
    pieces = staged(_pieces(spark, path), "fasta-pieces")
    heads = pieces.groupBy("file", "start").agg(F.max("k").alias("n"))
    place = F.concat("file", F.lit("\u0000"), F.lpad(F.col("start").cast("string"), 20, "0"))
    before = value_ranks(heads.withColumn("place", place).select("place", F.col("n").alias("_w")), "place", "_w").select("place", "before")
    heads = heads.withColumn("place", place).join(before, "place").select("file", "start", F.col("before").cast("long").alias("before"))
    heads = cut(heads)
    first = heads.groupBy("file").agg(F.min("before").alias("first"))  # one row a file
    base = broadcast_if_small(heads.join(first, "file"))
    x = pieces.join(base, ["file", "start"]).withColumn("ord", F.col("before") + F.col("k") - 1)
    x = x.where(F.col("ord") >= F.col("first"))  # lines before a file's first header belong to no record
    inner = x.where((F.col("k") > 0) & ~F.col("last")).select("file", "ord", F.col("header").alias("h"), F.col("body").alias("sequence"))
    edge = x.where((F.col("k") == 0) | F.col("last")).groupBy("file", "ord").agg(
        F.max("header").alias("h"), F.array_sort(F.collect_list(F.struct("start", "body"))).alias("p"))
    edge = edge.select("file", "ord", "h", F.array_join(F.transform("p", lambda v: v["body"]), "").alias("sequence"))
    return inner.unionByName(edge)


def read_fasta(spark: SparkSession, path: str, header: str = "std", mode: str = "PERMISSIVE") -> DataFrame:
    """(ord, id, description, sequence, file, _corrupt) of FASTA files.

    Files are read line by line in splits, so a record may be larger than a split; ``ord`` numbers the records
    of all files in order of file name and place.  Lines of a sequence are joined.  ``std``: id is the first word of
    the header, description the whole header.  ``tagged``: header ``tag id description`` split at single
    spaces into three parts; one with fewer is kept with null id in ``_corrupt``, or
    raises with mode ``FAILFAST``.  Records with an empty id are dropped (their number stays unused).
    """
    if header not in ("std", "tagged") or mode not in ("PERMISSIVE", "FAILFAST"):
        raise ValueError("header is std or tagged, mode PERMISSIVE or FAILFAST")
    x = _records(spark, path)
    if header == "std":
        return x.select("ord", F.split("h", r"\s+")[0].alias("id"), F.col("h").alias("description"), "sequence", "file",
                        F.lit(None).cast("string").alias("_corrupt")).where(F.col("id") != "")
    parts = F.split("h", " ", 3)
    bad = F.size(parts) < 3
    corrupt = F.when(bad, F.raise_error(F.concat(F.lit("bad FASTA header: "), "h")).cast("string") if mode == "FAILFAST" else F.col("h"))
    out = x.select("ord", F.when(~bad, F.get(parts, F.lit(1))).alias("id"), F.when(~bad, F.get(parts, F.lit(2))).alias("description"),
                   "sequence", "file", corrupt.alias("_corrupt"))
    return out.where(F.col("_corrupt").isNotNull() | (F.col("id") != ""))


def write_fasta(df: DataFrame, path: str, header, sequence: str = "sequence", width: int = 60) -> None:
    """Records with ``header`` (a column) and lines of ``width`` letters."""
    wrapped = F.regexp_replace(F.coalesce(F.col(sequence), F.lit("")), f"(.{{{width}}})(?=.)", "$1\n")
    df.select(F.concat(F.lit(">"), header, F.lit("\n"), wrapped).alias("value")).write.text(path)


def write_memberships(df: DataFrame, path: str) -> None:
    """The raw membership table (group_name, protein_ids) as TSV with its header row."""
    (df.select(F.col("group_name").alias("#GroupName"), F.col("protein_ids").alias("ProteinIDs"))
     .write.option("sep", "\t").option("header", True).csv(path))


def read_memberships(spark: SparkSession, path: str) -> DataFrame:
    """S3: (group_name, protein_ids) of membership TSV files, with an explicit schema."""
    x = spark.read.option("sep", "\t").option("header", True).schema("`#GroupName` string, ProteinIDs string").csv(path)
    return x.select(F.col("#GroupName").alias("group_name"), F.col("ProteinIDs").alias("protein_ids"))


def write_splits(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """A dataset with a ``split`` column, one folder a split."""
    df.write.partitionBy("split").format(fmt).option("header", True).save(path)


def read_split(spark: SparkSession, path: str, mode: str, fmt: str = "parquet") -> DataFrame:
    """The rows of one split (``train``, ``val`` or ``test``); other folders are not read."""
    if mode not in ("train", "val", "test"):
        raise ValueError(f"mode must be train, val or test, got {mode!r}")
    return spark.read.format(fmt).option("header", True).load(path).where(F.col("split") == mode)


def write_vectors(df: DataFrame, path: str) -> None:
    """Vectors (model, seq_id, pos, vec) as Parquet, one folder a model; a model that is written
    again replaces what was there."""
    (df.repartition("model", "seq_id").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("model").parquet(path))


def read_vectors(spark: SparkSession, path: str, models=None) -> DataFrame:
    x = spark.read.parquet(path).withColumn("model", F.col("model").cast("string"))
    return x.where(F.col("model").isin(*models)) if models else x


def write_npy(df: DataFrame, folder: str) -> str:
    """One ``.npy`` file for each row of (model, seq_id, rows array<array>) in a shared folder, and one commit
    that lists them; returns the commit's name.

    Every attempt of a task writes files of its own names, and only those of finished tasks are listed, so a
    repeated, killed or half-done task leaves nothing that a reader sees.  A vector that is written again
    replaces the earlier one.
    """
    ship(df.sparkSession)

    def run(frames):
        from urllib.parse import quote

        from pyarrow import fs
        at, root = fs.FileSystem.from_uri(folder)
        for pdf in frames:
            out = []
            for model, seq, rows in zip(pdf["model"], pdf["seq_id"], pdf["rows"]):
                buf = io.BytesIO()
                np.save(buf, np.array([np.asarray(r, np.float32) for r in rows]))
                where = f"data/{quote(model, safe='')}/{quote(seq, safe='')}.{uuid.uuid4().hex}.npy"
                at.create_dir(f"{root}/{where.rpartition('/')[0]}", recursive=True)
                with at.open_output_stream(f"{root}/{where}") as f:
                    f.write(buf.getvalue())
                out.append((model, seq, where, buf.tell()))
            yield pd.DataFrame(out, columns=["model", "seq_id", "path", "bytes"])

    return commit(df.select("model", "seq_id", "rows").mapInPandas(run, "model string, seq_id string, path string, bytes long"), folder)


def read_committed_npy(spark: SparkSession, folder: str) -> DataFrame:
    """(model, seq_id, pos, vec) of the matrices that the commits of ``write_npy`` list."""
    ship(spark)
    listed = committed(spark, folder)
    if listed is None:
        return spark.createDataFrame([], "model string, seq_id string, pos int, vec array<float>")

    def run(frames):
        from pyarrow import fs
        at, root = fs.FileSystem.from_uri(folder)
        for pdf in frames:
            for model, seq, where in zip(pdf["model"], pdf["seq_id"], pdf["path"]):
                with at.open_input_stream(f"{root}/{where}") as f:
                    m = np.load(io.BytesIO(f.read()), allow_pickle=False)
                yield pd.DataFrame({"model": model, "seq_id": seq, "pos": pd.array(range(len(m)), "Int32"),
                                    "vec": [r.astype(np.float32) for r in m]})

    rows = latest(listed, ["model", "seq_id"]).select("model", "seq_id", "path")
    return rows.mapInPandas(run, "model string, seq_id string, pos int, vec array<float>")


def read_npy_vectors(spark: SparkSession, path: str) -> DataFrame:
    """(model, seq_id, pos, vec) of ``.npy`` matrices, model and id from the file's place; a file
    that is no plain array gives null ``pos`` and ``vec``."""
    ship(spark)

    def run(frames):
        for pdf in frames:
            for where, content in zip(pdf["path"], pdf["content"]):
                model, seq = re.search(r"([^/]+)/([^/]+)\.npy$", where).groups()
                try:
                    m = np.load(io.BytesIO(content), allow_pickle=False)
                    pos, vec = list(range(len(m))), [r.astype(np.float32) for r in m]
                except ValueError:
                    pos, vec = [None], [None]
                yield pd.DataFrame({"model": model, "seq_id": seq, "pos": pd.array(pos, "Int32"), "vec": vec})

    files = (spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.npy").load(path))
    return files.select("path", "content").mapInPandas(run, "model string, seq_id string, pos int, vec array<float>")


def append_results(df: DataFrame, path: str, name: str | None = None) -> str:
    """Add rows to a result table as one commit; returns its name.

    The parts are TSV without a header; the header is one file of its own.  An append under a ``name`` that is
    there already replaces it, so a job that is repeated does not add its rows twice; one that was
    stopped adds nothing.
    """
    name = name or f"{time.time_ns():020d}-{uuid.uuid4().hex}"
    spark = df.sparkSession
    df.write.mode("overwrite").option("sep", "\t").csv(f"{path.rstrip('/')}/commits/{name}")
    head = spark.range(1).select(F.lit("\t".join(df.columns)).alias("value")).coalesce(1)
    head.write.mode("overwrite").text(f"{path.rstrip('/')}/header")
    return name


def read_results(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of a result table's finished appends; columns of ``schema`` are found by the header's names."""
    from pyspark.sql.types import StructType

    names = commits(spark, path)
    want = StructType.fromDDL(schema)
    if not names:
        return spark.createDataFrame([], want)
    columns = spark.read.text(f"{path.rstrip('/')}/header").first()["value"].split("\t")
    kinds = {f.name: f.dataType for f in want}
    x = spark.read.option("sep", "\t").schema(", ".join(f"`{c}` string" for c in columns)).csv(
        [f"{path.rstrip('/')}/commits/{n}" for n in names])
    return x.select(*[F.col(c).cast(kinds[c]).alias(c) for c in want.names])
