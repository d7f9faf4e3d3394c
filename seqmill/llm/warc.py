"""Operator 4: WARC archives with a splittable reader."""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqmill.llm.common import chunks, cut, filesystem, shared_path, ship, text_bytes

_MAGIC = b"\x1f\x8b\x08"
_STEP = 1 << 16
_UNSAFE = re.compile(rb"[\x00-\x20\x7f]")
#: Fixed value: the profile of revisits that the public WARC 1.1 standard names.
_PROFILE = b"http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_IDS = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # fixed value: the URL name space of RFC 4122


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _record_id(page: int | None) -> bytes:
    return b"<urn:uuid:%s>" % str(uuid.uuid5(_IDS, f"page:{page}")).encode()


def record(page: int | None, url: str | None, digest: str, size: int, payload: bytes | None,
           refers_to: int | None, date: str) -> bytes:
    """A WARC 1.1 record as one gzip member; without a payload a revisit of ``refers_to``."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size
    block = http + (payload or b"")
    lines = [b"WARC/1.1", b"WARC-Type: " + (b"response" if payload is not None else b"revisit"),
             b"WARC-Record-ID: " + _record_id(page), b"WARC-Date: " + date.encode()]
    if url is not None:
        lines.append(b"WARC-Target-URI: " + _UNSAFE.sub(lambda m: b"%%%02X" % m[0][0], url.encode()))
    if page is not None:
        lines.append(b"X-Page-ID: %d" % page)
    lines.append(b"WARC-Payload-Digest: sha1:" + digest.encode())
    if payload is None:
        lines += [b"WARC-Profile: " + _PROFILE, b"WARC-Refers-To: " + _record_id(refers_to)]
        if refers_to is not None:
            lines.append(b"X-Refers-To-Page-ID: %d" % refers_to)
    lines += [b"Content-Type: application/http;msgtype=response", b"Content-Length: %d" % len(block)]
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(b"\r\n".join(lines) + b"\r\n\r\n" + block + b"\r\n\r\n") + z.flush()


def write_archives(pages: DataFrame, folder: str, min_bytes: int = 0, date: str = "2000-01-01T00:00:00Z",
                   key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """One record a row; returns ``file, bytes, records`` of the archives of finished tasks.

    Of rows with equal payloads of at least ``min_bytes`` the one with the largest
    key holds the payload, the others are revisits that refer to it.  Payloads are
    grouped by their SHA-1 with a map-side combine, so a payload that a third of
    the rows share costs a maximum; only rows that keep their payload carry it
    through the shuffle.
    """
    spark = pages.sparkSession
    ship(spark)
    payload = text_bytes(html)
    rows = cut(pages.select(F.col(key).cast("long").alias("k"), F.col(url).cast("string").alias("url"),
                            F.sha1(payload).alias("sha"), F.octet_length(payload).cast("long").alias("size")))
    best = rows.where(F.col("size") >= min_bytes).groupBy("sha").agg(F.max("k").alias("best")).withColumnRenamed("sha", "sha_")
    ranked = rows.join(best, rows["sha"] == best["sha_"], "left")
    whole = (F.col("size") < min_bytes) | F.col("k").eqNullSafe(F.col("best"))
    keep = ranked.where(whole).select(F.col("k").alias("k_"), F.col("sha").alias("s_")).distinct()
    texts = pages.select(F.col(key).cast("long").alias("k"), F.col(url).cast("string").alias("url"),
                         F.sha1(payload).alias("sha"), payload.alias("payload"))
    full = texts.join(keep, texts["k"].eqNullSafe(keep["k_"]) & (texts["sha"] == keep["s_"]), "left_semi").select(
        "k", "url", "sha", F.octet_length("payload").cast("long").alias("size"), "payload",
        F.lit(None).cast("long").alias("best"))
    again = ranked.where(~whole).select("k", "url", "sha", "size", F.lit(None).cast("binary").alias("payload"), "best")

    def run(batches):
        out, name, size, count = None, None, 0, 0
        for b in batches:
            for r in b.to_pylist():
                if out is None:
                    fs, path = filesystem(folder)
                    fs.create_dir(path, recursive=True)
                    name = f"part-{uuid.uuid4().hex}.warc.gz"
                    out = fs.open_output_stream(f"{path}/{name}", compression=None)  # members are compressed one by one
                digest = base64.b32encode(bytes.fromhex(r["sha"])).decode()
                data = record(r["k"], r["url"], digest, r["size"], r["payload"], r["best"], date)
                out.write(data)
                size, count = size + len(data), count + 1
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([size]), pa.array([count])],
                                             names=["file", "bytes", "records"])

    return cut(full.unionByName(again).mapInArrow(run, "file string, bytes long, records long"))


class _Members:
    """Gzip members with WARC records that start in ``[start, end)`` of an open file."""

    def __init__(self, f, start: int, end: int):
        self.f, self.start, self.end = f, start, end

    def __iter__(self) -> Iterator[bytes]:
        at = self._find(self.start)
        while at is not None:
            data, after = self._member(at)
            if data is None:  # the magic was part of something else
                at = self._find(at + 1)
                continue
            yield data
            # the next member starts where this one ended, or after a damaged place
            at = self._find(after)

    def _find(self, at: int) -> int | None:
        """The first place from ``at`` on, before ``end``, with the bytes that open a member."""
        while at < self.end:
            self.f.seek(at)
            part = self.f.read(min(_STEP, self.end - at) + len(_MAGIC) - 1)
            i = part.find(_MAGIC)
            if i >= 0:
                return at + i
            if len(part) < len(_MAGIC):
                return None
            at += len(part) - len(_MAGIC) + 1
        return None

    def _member(self, at: int) -> tuple[bytes | None, int]:
        """``(content, end)`` of the member at ``at``; ``(None, at)`` unless it opens a WARC record."""
        z, out, have, pos = zlib.decompressobj(31), [], b"", at
        self.f.seek(at)
        try:
            while not z.eof:
                part = self.f.read(_STEP)
                if not part:
                    return None, at
                out.append(z.decompress(part))
                pos += len(part)
                if len(have) < 7:
                    have += out[-1][:7]
                    if not b"WARC/1.".startswith(have[:7]):
                        return None, at
        except zlib.error:
            return None, at
        return (b"".join(out), pos - len(z.unused_data)) if len(have) >= 7 else (None, at)


def _headers(block: bytes) -> tuple[dict[bytes, bytes], bytes]:
    head, _, rest = block.partition(b"\r\n\r\n")
    pairs = (x.partition(b":") for x in head.split(b"\r\n")[1:])
    return {k.strip().lower(): v.strip() for k, _, v in pairs}, rest


def parse(member: bytes) -> dict:
    """A record's fields; the payload is null for a revisit, whose size and digest come from its headers."""
    head, rest = _headers(member)
    http, payload = _headers(rest[:int(head[b"content-length"])])
    kind = head[b"warc-type"].decode()
    page, refers = head.get(b"x-page-id"), head.get(b"x-refers-to-page-id")
    revisit = kind == "revisit"
    return {"k": None if page is None else int(page), "record_type": kind,
            "url": head[b"warc-target-uri"].decode() if b"warc-target-uri" in head else None,
            "payload": None if revisit else payload,
            "payload_bytes": int(http[b"content-length"]) if revisit else len(payload),
            "payload_digest": head[b"warc-payload-digest"].decode().partition(":")[2] if revisit else base32_sha1(payload),
            "refers_to": None if refers is None else int(refers)}


def read_archives(spark: SparkSession, folder: str, files: DataFrame, split_bytes: int = 8 << 20,
                  with_payload: bool = True, key: str = "page_id") -> DataFrame:
    """Records of the archives ``files(file, bytes)``: ``key, url, record_type, payload_bytes, payload_digest,
    refers_to`` and, if asked for, ``payload``.

    An archive is cut into byte ranges, a task each, wherever members begin.  A task
    looks for the bytes that open a gzip member, takes a place for a record only if
    it decodes to a WARC header, and owns the records that start in its range; the
    last one may end beyond it.
    """
    ship(spark)
    ranges = files.where("bytes > 0").select("file", "bytes", F.explode(
        F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(split_bytes).cast("long"))).alias("start"))
    ranges = ranges.withColumn("end", F.least("bytes", F.col("start") + split_bytes))
    schema = pa.schema([("k", pa.int64()), ("url", pa.string()), ("record_type", pa.string()),
                        ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64())]
                       + [("payload", pa.binary())] * with_payload)

    def run(batches):
        fs, path = filesystem(folder)
        for b in batches:
            for r in b.to_pylist():
                with fs.open_input_file(f"{path}/{r['file']}") as f:
                    rows, held = [], 0
                    for member in _Members(f, r["start"], r["end"]):
                        rec = parse(member)
                        if not with_payload:
                            del rec["payload"]
                        rows.append(rec)
                        held += len(member) if with_payload else 256
                        if held > 8 << 20:
                            yield pa.RecordBatch.from_pylist(rows, schema=schema)
                            rows, held = [], 0
                    if rows:
                        yield pa.RecordBatch.from_pylist(rows, schema=schema)

    kinds = "k long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long"
    return ranges.repartition(max(1, ranges.count())).mapInArrow(
        run, kinds + ", payload binary" * with_payload).withColumnRenamed("k", key)


def round_trip(pages: DataFrame, min_bytes: int = 0, split_bytes: int = 8 << 20, folder: str | None = None,
               key: str = "page_id", **columns) -> DataFrame:
    """Write all pages as archives and read them back: a row for each page.

    Null html is an empty payload.  Rows that repeat the key and the payload of a
    response are responses too.  Null keys never win against others; if all rows of
    a payload have null keys they are responses.  An empty table writes nothing
    and gives no rows; other columns are left out.
    """
    spark = pages.sparkSession
    folder = folder or shared_path(spark, "warc")
    files = write_archives(pages, folder, min_bytes, key=key, **columns)
    return read_archives(spark, folder, files, split_bytes, with_payload=False, key=key).select(
        key, "payload_bytes", "payload_digest", "record_type", "refers_to")
