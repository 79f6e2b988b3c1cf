"""Booking and payment events as a stream: foreachBatch over a change log.

Events change existing rows (a booking's status, a payment's status and
amount) and may add payments. Each micro-batch applies its events (M2) to the
current tables and writes the new state of every booking and payment its
events touched into a change log under ``batch_id=<id>`` (dynamic partition
overwrite, so a re-run batch replaces its own output: exactly-once effect).
Readers merge on read: the stored base tables (and, if an admission stream runs
beside this one, the bookings and held seats that it has added) with, per key,
the row of the latest batch that changed it. :func:`compact` folds the log of
past batches into one, so what a batch reads grows with the keys ever changed
and not with the number of batches.
"""

from __future__ import annotations

import os

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import LongType, StructField, StructType

from ..operators.events import apply_booking_events
from ..schemas import BOOKING_EVENT, SCHEMAS
from ..session import cut_lineage
from ..sources.keyed import drop_folders
from ..sources.tables import Tables, load_tables
from . import admission

MANY = 1 << 62  # a batch number that every batch of another stream comes before
CHANGED = {"booking": "booking_id", "payment": "payment_id"}


def _changes(spark: SparkSession, root: str, name: str, before: int) -> DataFrame | None:
    schema = StructType(SCHEMAS[name].fields + [StructField("batch_id", LongType())])
    try:
        log = spark.read.schema(schema).parquet(os.path.join(root, "changes", name))
    except AnalysisException:      # no change written yet
        return None
    key = CHANGED[name]
    cols = [f.name for f in SCHEMAS[name].fields if f.name != key]
    latest = (log.where(F.col("batch_id") < before).groupBy(key)
              .agg(F.max_by(F.struct(*cols), F.col("batch_id")).alias("r")))
    return latest.select(key, *[F.col(f"r.{c}").alias(c) for c in cols])


def current_tables(spark: SparkSession, base: str, root: str, batch_id: int,
                   admitted: str | None = None) -> Tables:
    """Base tables merged with the latest change per key from batches before ``batch_id``.

    ``admitted``: the folder of an admission stream, whose bookings count as well.
    """
    t = load_tables(spark, base) if admitted is None else admission.current_tables(spark, base, admitted, MANY)
    merged = {}
    for name, key in CHANGED.items():
        latest = _changes(spark, root, name, batch_id)
        if latest is not None:
            merged[name] = (t.get(name).join(latest.select(key), key, "left_anti")
                            .unionByName(latest))
    return t.with_(**merged)


def compact(spark: SparkSession, root: str, before: int) -> None:
    """Fold the changes of batches before ``before`` into the last of them: one row a key.

    Run between batches. The folded rows are written to the checkpoint folder, then over that last
    batch's folder, and only then do the older folders go; a reader that sees both finds the same rows.
    """
    for name, key in CHANGED.items():
        latest = _changes(spark, root, name, before)
        if latest is None:
            continue
        path = os.path.join(root, "changes", name)
        log = spark.read.schema(StructType(SCHEMAS[name].fields + [StructField("batch_id", LongType())])).parquet(path)
        past = sorted(r[0] for r in log.where(F.col("batch_id") < before).select("batch_id").distinct().collect())
        if len(past) < 2:
            continue
        (cut_lineage(latest).withColumn("batch_id", F.lit(past[-1]).cast("long")).write.mode("overwrite")
         .option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(path))
        drop_folders(spark, [f"{path}/batch_id={b}" for b in past[:-1]])


def apply_events_batch(spark: SparkSession, base: str, root: str, batch: DataFrame,
                       batch_id: int, admitted: str | None = None, compact_every: int | None = None) -> None:
    if compact_every and batch_id and batch_id % compact_every == 0:
        compact(spark, root, batch_id)
    t = current_tables(spark, base, root, batch_id, admitted)
    nxt, outcomes = apply_booking_events(t, batch)
    touched = batch.select("booking_id").distinct()
    out = {"booking": nxt.booking.join(touched, "booking_id", "left_semi"),
           "payment": nxt.payment.join(touched, "booking_id", "left_semi")}
    for name, df in out.items():
        (df.withColumn("batch_id", F.lit(batch_id).cast("long"))
           .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id")
           .parquet(os.path.join(root, "changes", name)))
    (outcomes.withColumn("batch_id", F.lit(batch_id).cast("long"))
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(os.path.join(root, "outcomes")))


def start_events_stream(spark: SparkSession, base: str, events_dir: str, root: str,
                        checkpoint: str, files_per_batch: int | None = None,
                        available_now: bool = False,
                        processing_time: str | None = None, admitted: str | None = None,
                        compact_every: int | None = 100) -> StreamingQuery:
    """Start the stream; ``admitted`` is the folder of an admission stream over the same base, if one runs."""
    reader = spark.readStream.schema(BOOKING_EVENT).option("mode", "PERMISSIVE")
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    writer = (reader.json(events_dir).writeStream
              .foreachBatch(lambda df, batch_id: apply_events_batch(spark, base, root, df, batch_id, admitted,
                                                                             compact_every))
              .option("checkpointLocation", checkpoint))
    if available_now:
        writer = writer.trigger(availableNow=True)
    elif processing_time:
        writer = writer.trigger(processingTime=processing_time)
    return writer.start()
