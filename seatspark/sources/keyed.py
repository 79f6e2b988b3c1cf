"""Tables stored by hash buckets of their key, changed by rewriting touched buckets only.

A bucket is a partition folder (``bucket=7``), so a change that names some keys
reads the folders that can hold them and no others, and a dynamic partition
overwrite replaces just those folders. Keys of text compare without case, as
everywhere else, so the bucket is taken from their lower case.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.audit import key_expr
from ..schemas import PRIMARY_KEYS, SCHEMAS
from ..session import cut_lineage

BUCKET = "bucket"


def bucket_of(table: str, buckets: int, key: tuple[str, ...] | None = None) -> Column:
    """The bucket of a row of ``table`` (or of a row with its key columns)."""
    cols = [key_expr(table, c).cast(SCHEMAS[table][c].dataType) for c in key or PRIMARY_KEYS[table]]
    return F.pmod(F.xxhash64(*cols), F.lit(buckets)).cast("int")


def write_keyed(df: DataFrame, table: str, path: str, buckets: int, key: tuple[str, ...] | None = None) -> None:
    """Write ``df`` (rows of ``table``) as ``buckets`` partition folders, a file or more each."""
    (df.withColumn(BUCKET, bucket_of(table, buckets, key)).repartition(buckets, BUCKET)
     .write.partitionBy(BUCKET).parquet(path))


def read_keyed(spark: SparkSession, table: str, path: str) -> DataFrame:
    """The whole table, without the bucket column."""
    return spark.read.schema(SCHEMAS[table]).parquet(path).select(*SCHEMAS[table].names)


def change_keyed(spark: SparkSession, table: str, path: str, buckets: int, changed: DataFrame,
                 change: Callable[[DataFrame], DataFrame], key: tuple[str, ...] | None = None) -> list[int]:
    """Replace the stored rows whose key is in ``changed`` and leave all other buckets unread and unwritten.

    ``changed`` has the key columns (of changed, deleted or inserted rows);
    ``change`` takes the stored rows of the touched buckets and returns what
    they become (an update, a delete or an insert of :mod:`..operators`). The
    new rows are written to the checkpoint folder first, so a job that dies
    leaves the table as it was or as it should be, bucket by bucket, and can be
    run again. Returns the touched buckets (``buckets`` of them at most).
    """
    at = bucket_of(table, buckets, key)
    touched = sorted(r[0] for r in changed.select(at.alias(BUCKET)).distinct().collect())
    if not touched:
        return []
    names = SCHEMAS[table].names
    stored = T.StructType([*SCHEMAS[table].fields, T.StructField(BUCKET, T.IntegerType())])
    old = spark.read.schema(stored).parquet(path)
    new = cut_lineage(change(old.where(F.col(BUCKET).isin(touched)).select(*names)).withColumn(BUCKET, at))
    kept = {r[0] for r in new.select(BUCKET).distinct().collect()}
    if stray := kept - set(touched):
        raise ValueError(f"the change made rows of untouched buckets: {sorted(stray)}")
    (new.repartition(len(touched), BUCKET).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(BUCKET).parquet(path))
    drop_folders(spark, [f"{path.rstrip('/')}/{BUCKET}={b}" for b in touched if b not in kept])
    return touched


def drop_folders(spark: SparkSession, folders: list[str]) -> None:
    """Remove partition folders, as of buckets that have lost all rows (an overwrite writes no empty partition)."""
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    for folder in folders:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        where.getFileSystem(hadoop).delete(where, True)
