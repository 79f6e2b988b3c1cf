"""Tables and files in the folder that the cluster shares.

Every intermediate table is written as Parquet below ``spark.checkpoint.dir``
and read again: lineage ends there, so a lost executor costs a task, not a job.
Files of the operators' own formats go to the same folder through pyarrow's
file systems, under a temporary name first.
"""

from __future__ import annotations

import ctypes
import os
import uuid

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_dir

#: Session settings: rows and bytes of an Arrow batch at most.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": 2000, "spark.sql.execution.arrow.maxBytesPerBatch": 8 << 20}

_ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def ready(df: DataFrame) -> DataFrame:
    """``df``, for a task function: workers get this package's path and Arrow batches of bounded size.

    Rows hold whole texts, so the default of 10,000 rows a batch may be
    hundreds of MB. A smaller setting of the session stays.
    """
    spark = df.sparkSession
    spark.sparkContext.environment.setdefault("PYTHONPATH", _ROOT)
    for key, most in BATCH.items():
        now = int(spark.conf.get(key).rstrip("b"))
        if now <= 0 or now > most:
            spark.conf.set(key, str(most))
    return df


def give_back() -> None:
    """Hand memory that a task has freed back to the system.

    Workers are reused, so what one operator's blocks leave in the allocators
    would otherwise stand beside the next one's.
    """
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # another C library
        pass


def frugal(task):
    """The task function ``task`` (batches -> batches), giving freed memory back when it ends."""
    def run(batches):
        try:
            yield from task(batches)
        finally:
            give_back()

    return run


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder name below the shared folder."""
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def open_folder(uri: str) -> tuple[pafs.FileSystem, str]:
    """pyarrow's file system and path of a folder named as Spark names it."""
    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[len("file:"):]
    if "://" not in uri:
        return pafs.LocalFileSystem(), uri
    return pafs.FileSystem.from_uri(uri)


def commit_file(fs: pafs.FileSystem, folder: str, name: str, attempt: str, parts) -> int:
    """Write ``parts`` under a temporary name, then move it into place; returns the bytes."""
    fs.create_dir(folder, recursive=True)
    temporary = f"{folder}/.{name}.{attempt}.tmp"
    size = 0
    with fs.open_output_stream(temporary, compression=None) as out:
        for part in parts:
            out.write(part)
            size += len(part)
    fs.move(temporary, f"{folder}/{name}")
    return size


def local_path(uri: str) -> str:
    """The mounted path of a shared file, for memory mapping."""
    fs, path = open_folder(uri)
    if not isinstance(fs, pafs.LocalFileSystem):
        raise ValueError(f"memory mapping needs a mounted shared folder, not {uri}")
    return path


def even_ranges(ids: DataFrame, rows: int) -> list[tuple[int, int]]:
    """(smallest id, rows) of consecutive id ranges of about ``rows`` rows each, ascending.

    ``ids`` has one long column, nulls left out. The ranges depend on the rows
    alone, not on their layout: rows are counted by their highest bits, and
    only prefixes that hold more than ``rows`` are counted again by eight bits
    more. So one outlying id does not put all others into one range; an id that
    comes more than ``rows`` times has a range to itself.
    """
    ids = ids.toDF("id").where("id is not null")
    low, high = ids.agg(F.min("id"), F.max("id")).first()
    if low is None:
        return []
    flip = 1 << 63  # ids as unsigned numbers in the same order
    open_, shift, closed = [None], max(0, -(-((low ^ high) & ((1 << 64) - 1)).bit_length() // 8) * 8), []
    while open_ and shift:
        shift -= 8
        prefix = F.shiftright("id", shift)
        found = ids
        if open_ != [None]:
            heavy = ids.sparkSession.createDataFrame([(x,) for x in open_], "p long")  # prefixes of more than `rows` rows
            found = ids.join(F.broadcast(heavy), F.shiftright("id", shift + 8) == F.col("p"), "left_semi")
        counts = found.groupBy(prefix.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()
        open_ = [r["p"] for r in counts if r["n"] > rows and shift]
        closed += [((r["p"] << shift) + flip, r["n"]) for r in counts if r["n"] <= rows or not shift]
    out: list[tuple[int, int]] = []
    for first, n in sorted(closed):
        if out and out[-1][1] + n <= rows:
            out[-1] = out[-1][0], out[-1][1] + n
        else:
            out.append((first - flip, n))
    return out


def even_cuts(ids: DataFrame, rows: int) -> list[int]:
    """The smallest ids of all but the first of :func:`even_ranges`."""
    return [first for first, _ in even_ranges(ids, rows)[1:]]
