"""WARC archives: a deterministic sharded writer, and a reader.

Records are sorted by page_id and dealt into shards, id ranges of about as many
records each (those without an id by their digest). A shard rolls to its next file at a compressed size. Each record is a gzip member of
its own with headers made anew from the payload: digests, lengths, and record
ids that follow from the page_id and the digest. Files are written under
temporary names and moved into place; the manifest (a table that is written
after all files) names the files that count. The same pages give the same bytes.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import commit_file, even_cuts, frugal, open_folder, ready, saved, scratch

REVISIT_BYTES = 100
ROLL_BYTES = 64 << 20
SHARD_BYTES = 32 << 20  # payload bytes a shard, on average
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "file string, records long, bytes long, sha256 string"


def record_id(page_id: int | None, digest: str) -> str:
    """A version 8 UUID: 48 bits of the digest, and all 64 bits of the page_id (or a mark for none)."""
    n = (page_id or 0) & (2 ** 64 - 1)
    bits = int(digest[:12], 16) << 80 | 8 << 76 | (page_id is None) << 66 | (n >> 62) << 64 | 2 << 62 | n & (2 ** 62 - 1)
    return f"<urn:uuid:{uuid.UUID(int=bits)}>"


def page_of(record: str) -> int | None:
    """The page_id in a record id."""
    bits = uuid.UUID(record.strip("<>").removeprefix("urn:uuid:")).int
    if bits >> 66 & 1:
        return None
    n = (bits >> 64 & 3) << 62 | bits & (2 ** 62 - 1)
    return n - 2 ** 64 if n >> 63 else n


def _member(headers: list[tuple[str, str]], payload: bytes) -> bytes:
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers) + f"Content-Length: {len(payload)}\r\n\r\n"
    gz = zlib.compressobj(6, zlib.DEFLATED, 31)
    return gz.compress(head.encode() + payload + b"\r\n\r\n") + gz.flush()


def _clean(url: str | None) -> str:
    return "".join(c for c in url or "" if c >= " " and c != "\x7f").strip() or "urn:none"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, first: int | None) -> bytes:
    """A page's record; a revisit of page ``first`` has no payload but names its length and digest."""
    sha = "sha256:" + base64.b32encode(bytes.fromhex(digest)).decode().rstrip("=")
    headers = [("WARC-Record-ID", record_id(page_id, digest)), ("WARC-Date", DATE), ("WARC-Target-URI", _clean(url)),
               ("WARC-Payload-Digest", sha), ("X-Payload-Length", str(len(payload)))]
    if first is None:
        return _member([("WARC-Type", "response"), *headers, ("Content-Type", "text/html; charset=utf-8"),
                        ("WARC-Block-Digest", sha)], payload)
    return _member([("WARC-Type", "revisit"), *headers, ("WARC-Profile", PROFILE),
                    ("WARC-Refers-To", record_id(first, digest))], b"")


def read_records(chunks: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each gzip member; raises ValueError for a damaged one."""
    gz, parts = zlib.decompressobj(31), []
    for chunk in chunks:
        while chunk:
            try:
                parts.append(gz.decompress(chunk))
            except zlib.error as e:
                raise ValueError(f"damaged record: {e}") from e
            chunk = gz.unused_data
            if gz.eof:
                head, _, rest = b"".join(parts).partition(b"\r\n\r\n")
                version, *lines = head.decode().split("\r\n")
                headers = dict(line.split(": ", 1) for line in lines)
                block, end = rest[:-4], rest[-4:]
                if not version.startswith("WARC/") or end != b"\r\n\r\n" or int(headers["Content-Length"]) != len(block):
                    raise ValueError("damaged record")
                yield headers, block
                gz, parts = zlib.decompressobj(31), []
    if parts and any(parts):
        raise ValueError("the file ends within a record")


def write_warc(pages: DataFrame, folder: str, shard_bytes: int = SHARD_BYTES, roll_bytes: int = ROLL_BYTES) -> DataFrame:
    """Write ``pages`` (page_id, url, html) as WARC files; returns the manifest.

    The payload is html in UTF-8; null is empty. Of equal payloads of at least
    100 bytes the smallest page_id is a response and the others revisits of it.
    Rows with null page_id are responses, in shards of their own. Repeated
    rows of one page_id are written as often as they come. ``shard_bytes`` is
    the payload of a shard if all pages were of the same size.
    """
    spark = pages.sparkSession
    html = F.coalesce("html", F.lit(""))
    rows = ready(pages).select(F.col("page_id").cast("long"), "url", html.alias("html"), F.sha2(html, 256).alias("digest"))
    big = rows.where((F.octet_length("html") >= REVISIT_BYTES) & F.col("page_id").isNotNull())
    firsts = saved(big.groupBy("digest").agg(F.min("page_id").alias("first"), F.max("page_id").alias("last"))
                   .where("first < last").select("digest", "first"), "first-pages")
    n, unnamed, size = rows.agg(F.count(F.lit(1)), F.count_if(F.col("page_id").isNull()), F.sum(F.octet_length("html"))).first()
    share = max(1, n * shard_bytes // max(size or 0, 1))  # records a shard
    cuts = even_cuts(rows.select("page_id"), share)
    no_id = max(1, -(-unnamed // share))
    small = rows.select("page_id", "digest").where((F.octet_length("html") >= REVISIT_BYTES) & F.col("page_id").isNotNull())
    # a payload that a third of all pages share is one key: both sides are plain tables, which Spark can split
    refers = saved(small.join(firsts, "digest").where("page_id != first").select("page_id", "digest", "first").distinct(),
                   "revisits").select(F.col("page_id").alias("again"), F.col("digest").alias("same"), "first")
    edges = np.array(cuts, np.int64)

    @F.pandas_udf("int")
    def range_of(ids: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(edges, ids.to_numpy(), "right").astype(np.int32))

    shard = F.when(F.col("page_id").isNotNull(), range_of(F.coalesce("page_id", F.lit(0).cast("long")))).otherwise(
        -1 - F.pmod(F.xxhash64("digest"), F.lit(no_id))).cast("int")
    joined = rows.join(refers, (F.col("page_id") == F.col("again")) & (F.col("digest") == F.col("same")), "left").select(
        "page_id", "url", "html", "digest", "first", shard.alias("shard"))

    def write(batches):
        task = TaskContext.get()
        fs, at = open_folder(folder)
        done, name, parts, held = [], None, [], 0

        def close():
            nonlocal parts, held
            sha = hashlib.sha256()
            for p in parts:
                sha.update(p)
            size = commit_file(fs, at, name, str(task.taskAttemptId()), parts)
            done.append((name, len(parts), size, sha.hexdigest()))
            parts, held = [], 0

        shard, roll = None, 0
        for batch in batches:
            for page_id, url, text, digest, first, own in zip(*(c.to_pylist() for c in batch.columns)):
                if parts and (own != shard or held >= roll_bytes):
                    close()
                    roll = roll + 1 if own == shard else 0
                elif own != shard:
                    roll = 0
                shard = own
                name = f"pages-{f'none{-1 - shard:06d}' if shard < 0 else f'{shard:06d}'}-{roll:04d}.warc.gz"
                parts.append(record(page_id, url, text.encode(), digest, first))
                held += len(parts[-1])
        if parts:
            close()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*done)], [f.split()[0] for f in MANIFEST.split(", ")])

    dealt = joined.repartitionByRange(len(cuts) + 1 + no_id, "shard").sortWithinPartitions("shard", "page_id", "url", "html")
    manifest = dealt.select("page_id", "url", "html", "digest", "first", "shard").mapInArrow(frugal(write), MANIFEST)
    manifest.write.parquet(f"{folder}/manifest")
    return spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")


RECORDS = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary"


def read_warc(spark: SparkSession, folder: str) -> DataFrame:
    """Records of the files that the manifest of ``folder`` names.

    Returns page_id, url, record_type, payload_bytes, payload_digest (bare
    hex), refers_to, payload (null for revisits). A response whose payload does
    not match its digest or length raises ValueError.
    """
    def read(batches):
        fs, at = open_folder(folder)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                rows, size = [], 0
                with fs.open_input_stream(f"{at}/{name}", compression=None) as f:
                    for headers, block in read_records(iter(lambda: f.read(1 << 20), b"")):
                        code = headers["WARC-Payload-Digest"].removeprefix("sha256:")
                        digest = base64.b32decode(code + "=" * (-len(code) % 8)).hex()
                        kind, n = headers["WARC-Type"], int(headers["X-Payload-Length"])
                        if kind == "response" and (hashlib.sha256(block).hexdigest() != digest or len(block) != n):
                            raise ValueError(f"{name}: a payload does not match its digest")
                        refers = headers.get("WARC-Refers-To")
                        rows.append((page_of(headers["WARC-Record-ID"]), headers["WARC-Target-URI"], kind, n, digest,
                                     page_of(refers) if refers else None, block if kind == "response" else None))
                        size += len(block)
                        if size > 4 << 20:
                            yield batch_of(rows)
                            rows, size = [], 0
                if rows:
                    yield batch_of(rows)

    kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary())

    def batch_of(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)],
                                          [f.split()[0] for f in RECORDS.split(", ")])

    files = ready(spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")).select("file")
    # a fixed number: the names are few bytes, so Spark would else give all archives to one task
    return files.repartition(max(1, files.count()), "file").mapInArrow(read, RECORDS)


def archive_pages(pages: DataFrame) -> DataFrame:
    """Write the pages to a new archive in the shared folder and read it back: a row a page.

    page_id, payload_bytes, payload_digest, record_type, refers_to.
    """
    spark = pages.sparkSession
    folder = scratch(spark, "warc")
    write_warc(pages, folder)
    return read_warc(spark, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
