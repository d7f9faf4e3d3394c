"""Operator 10: token ids in files, as frequency ranks in a byte-aligned variable-length coding.

A folder holds ``ranks.bin`` (the ids from the commonest on, little-endian
unsigned 32-bit) and ``part-*.frv`` files in ascending order of keys.  A file is a
run of blocks: a header of four little-endian unsigned 64-bit numbers (documents,
ids, control bytes, data bytes), then for every document a byte that is 1 if it
has a key, its key as a signed 64-bit number and its count of ids as an unsigned
64-bit number (three columns one after the other), then the control bytes (2 bits
an id, the first id lowest: the id's data bytes less one), then the data bytes
(the rank, little-endian, 1 to 4 bytes).
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seqmill.llm.common import chunks, cut, filesystem, shared_path, ship, text_bytes, written
from seqmill.llm.tokens import encoder

#: Data bytes of the four ids of each control byte.
_LENGTHS = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3).astype(np.uint8) + 1
_BYTE = np.arange(4, dtype=np.uint8)
_SLICE = 1 << 20  # ids that are coded at a time


def encode_ranks(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Ranks (unsigned 32-bit) to ``(control bytes, data bytes)``."""
    control, data = [], []
    for at in range(0, len(ranks), _SLICE):
        r = ranks[at:at + _SLICE].astype("<u4")
        n = 1 + (r > 0xFF).astype(np.uint8) + (r > 0xFFFF) + (r > 0xFFFFFF)
        data.append(r.view(np.uint8).reshape(-1, 4)[_BYTE < n[:, None]].tobytes())
        code = np.zeros((len(r) + 3) // 4 * 4, np.uint8)
        code[:len(r)] = n - 1
        code = code.reshape(-1, 4)
        control.append((code[:, 0] | code[:, 1] << 2 | code[:, 2] << 4 | code[:, 3] << 6).tobytes())
    return b"".join(control), b"".join(data)


def decode_ranks(control: bytes, data: bytes, count: int) -> np.ndarray:
    """The inverse: lengths by a table look-up of the control bytes, ranks by one scatter."""
    lengths = _LENGTHS[np.frombuffer(control, np.uint8)].ravel()[:count]
    raw, out, at = np.frombuffer(data, np.uint8), np.empty(count, np.uint32), 0
    for i in range(0, count, _SLICE):
        n = lengths[i:i + _SLICE]
        size = int(n.sum(dtype=np.int64))
        wide = np.zeros((len(n), 4), np.uint8)
        wide[_BYTE < n[:, None]] = raw[at:at + size]
        out[i:i + len(n)] = wide.view("<u4").ravel()
        at += size
    return out


def tokenised(docs: DataFrame, tokenizer_path: str, end_id: int = 1, key: str = "doc_id",
              text: str = "text") -> DataFrame:
    """``width, k, ids``: a document's ids at two or four bytes each (``width``), or the counts of ids of a task (0)."""
    ship(docs.sparkSession)

    def run(batches):
        enc, counts = encoder(tokenizer_path), np.zeros(1 << 16, np.int64)

        def rows(width, k, ids):
            return pa.RecordBatch.from_arrays([pa.array([width] * len(k), pa.int32()), k, ids], names=["width", "k", "ids"])

        for batch in batches:
            for part in chunks(batch, "t", 4 << 20):
                ids, bounds = enc.texts(part.column("t"), end_id)
                got = np.bincount(ids)
                if len(got) > len(counts):
                    counts = np.concatenate([counts, np.zeros(len(got) - len(counts), np.int64)])
                counts[:len(got)] += got
                width = 2 if len(got) <= 1 << 16 else 4
                column = pa.LargeBinaryArray.from_buffers(
                    pa.large_binary(), part.num_rows,
                    [None, pa.py_buffer((bounds * width).astype("<i8")), pa.py_buffer(ids.astype(f"<u{width}"))])
                yield rows(width, part.column("k"), column.cast(pa.binary()))
        if counts.any():
            yield rows(0, pa.nulls(1, pa.int64()), pa.array([counts.astype("<i8").tobytes()], pa.binary()))

    return docs.select(F.col(key).cast("long").alias("k"), text_bytes(text).alias("t")).mapInArrow(
        run, "width int, k long, ids binary")


def id_counts(tokens: DataFrame) -> np.ndarray:
    """How often each id occurs: task counts, summed by Spark; as many numbers as the vocabulary has ids."""
    def run(batches):
        for b in batches:
            for x in b.column("ids"):
                n = np.frombuffer(x.as_py(), "<i8")
                i = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(n[i])], names=["i", "n"])

    rows = tokens.where("width = 0").select("ids").mapInArrow(run, "i long, n long").groupBy("i").agg(
        F.sum("n").alias("n")).collect()
    out = np.zeros(max((r["i"] for r in rows), default=0) + 1, np.int64)
    for r in rows:
        out[r["i"]] = r["n"]
    return out


def write_files(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int = 1, key: str = "doc_id",
                text: str = "text", block_ids: int = 1 << 20) -> DataFrame:
    """Write the files into ``folder``; returns ``(part, path, documents, ids, bytes)`` for each file.

    Texts are tokenised once; their ids are dealt by key ranges, so a task writes
    one file.  A file has a name of its own for every attempt and only files of
    finished tasks are in the result, so a repeated task does no harm.
    """
    spark = docs.sparkSession
    tokens = written(tokenised(docs, tokenizer_path, end_id, key, text), "tokens")
    counts = id_counts(tokens)
    by_rank = np.argsort(-counts, kind="stable").astype("<u4")  # ties: the smaller id first
    fs, path = filesystem(folder)
    fs.create_dir(path, recursive=True)
    with fs.open_output_stream(f"{path}/ranks.bin") as f:
        f.write(by_rank.tobytes())
    rank_of = np.empty(len(by_rank), np.uint32)
    rank_of[by_rank] = np.arange(len(by_rank), dtype=np.uint32)
    shared = spark.sparkContext.broadcast(rank_of)

    def run(batches):
        rank, out, sums = shared.value, None, np.zeros(3, np.int64)
        keys, parts = [], []

        def flush():
            ids = np.concatenate(parts)
            control, data = encode_ranks(rank[ids])
            k = np.array([x or 0 for x in keys], "<i8")
            has = np.array([x is not None for x in keys], np.uint8)
            size = np.array([len(p) for p in parts], "<u8")
            head = np.array([len(keys), len(ids), len(control), len(data)], "<u8")
            block = b"".join([head.tobytes(), has.tobytes(), k.tobytes(), size.tobytes(), control, data])
            out.write(block)
            sums[:] += len(keys), len(ids), len(block)
            keys.clear()
            parts.clear()

        name, held = None, 0
        for b in batches:
            for k, width, ids in zip(b.column("k").to_pylist(), b.column("width").to_pylist(), b.column("ids")):
                if out is None:
                    at, where = filesystem(folder)
                    no = TaskContext.get().partitionId()
                    name = f"part-{no:06d}-{uuid.uuid4().hex}.frv"
                    out = at.open_output_stream(f"{where}/{name}")
                keys.append(k)
                parts.append(np.frombuffer(ids.as_buffer(), f"<u{width}").astype(np.uint32))
                held += len(parts[-1])
                if held >= block_ids:
                    flush()
                    held = 0
        if out is not None:
            if keys:
                flush()
            out.close()
            yield pa.RecordBatch.from_arrays(
                [pa.array([no], pa.int32()), pa.array([name]), *[pa.array([int(x)], pa.int64()) for x in sums]],
                names=["part", "file", "documents", "ids", "bytes"])

    ordered = tokens.where("width > 0").repartitionByRange("k").sortWithinPartitions("k")
    return cut(ordered.mapInArrow(run, "part int, file string, documents long, ids long, bytes long"))


def read_files(spark: SparkSession, folder: str, files: DataFrame, key: str = "doc_id") -> DataFrame:
    """``key, start, ids`` of every document, from the files alone; one task a file, a block at a time."""
    ship(spark)
    order = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each file
    files = files.withColumn("base", F.coalesce(F.sum("ids").over(order), F.lit(0))).select("file", "base")

    def run(batches):
        at, where = filesystem(folder)
        by_rank = None
        for b in batches:
            for file, base in zip(b.column("file").to_pylist(), b.column("base").to_pylist()):
                if by_rank is None:
                    with at.open_input_stream(f"{where}/ranks.bin") as f:
                        by_rank = np.frombuffer(f.read(), "<u4")
                with at.open_input_stream(f"{where}/{file}") as f:
                    while head := f.read(32):
                        n, count, controls, size = np.frombuffer(head, "<u8").tolist()
                        has = np.frombuffer(f.read(n), np.uint8).astype(bool)
                        k = np.frombuffer(f.read(8 * n), "<i8")
                        length = np.frombuffer(f.read(8 * n), "<u8").astype(np.int64)
                        control = f.read(controls)
                        ids = by_rank[decode_ranks(control, f.read(size), count)].astype("<u4")
                        ends = np.concatenate([[0], np.cumsum(length)])
                        raw = pa.py_buffer(ids.tobytes())
                        column = pa.LargeBinaryArray.from_buffers(
                            pa.large_binary(), n, [None, pa.py_buffer((ends * 4).astype("<i8").tobytes()), raw])
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(k, mask=~has), pa.array(base + ends[:-1]), column.cast(pa.binary())],
                            names=["k", "start", "ids"])
                        base += count

    return files.repartition(max(1, files.count())).mapInArrow(run, "k long, start long, ids binary").withColumnRenamed("k", key)


def round_trip(docs: DataFrame, tokenizer_path: str, end_id: int = 1, key: str = "doc_id", text: str = "text",
               folder: str | None = None) -> DataFrame:
    """Write all documents' ids and read them back: ``key, start, n_tokens, ids_crc32``.

    Null and empty texts hold the end id alone.  Null keys come first, repeated
    keys stay next to each other in any order; keys must be whole numbers.  An
    empty table gives no files and no rows; other columns are left out.
    """
    spark = docs.sparkSession
    folder = folder or shared_path(spark, "token-files")
    files = write_files(docs, folder, tokenizer_path, end_id, key, text)
    back = read_files(spark, folder, files, key)
    # crc32 of Spark reads the same bytes that the file's ids are made of
    return back.select(key, "start", (F.length("ids") / 4).cast("long").alias("n_tokens"),
                       F.crc32("ids").alias("ids_crc32"))
