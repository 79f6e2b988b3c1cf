"""Booking requests as a stream: Structured Streaming + foreachBatch admission.

Requests arrive as JSON files (one request per line) in a folder. Each
micro-batch is admitted (M1) against the stored tables plus every row earlier
micro-batches added. Admission only appends (new bookings, new held seats), so
a micro-batch writes its rows under ``batch_id=<id>`` with dynamic partition
overwrite: when Spark re-runs a batch after a failure, it replaces the very
same partition, so the effect is exactly once. Outcomes are written the same
way. The stream's own checkpoint (offsets) lives under ``checkpoint``, which
must be shared storage on a cluster.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.errors import AnalysisException
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import LongType, StructField, StructType

from ..operators.admit import admitted
from ..schemas import BOOKING_REQUEST, SCHEMAS
from ..sources.tables import Tables, load_tables

APPENDED = ("booking", "booking_seat")


def _added(spark: SparkSession, root: str, name: str, before: int) -> DataFrame | None:
    schema = StructType(SCHEMAS[name].fields + [StructField("batch_id", LongType())])
    try:
        added = spark.read.schema(schema).parquet(os.path.join(root, "added", name))
    except AnalysisException:      # nothing appended yet
        return None
    # a re-run batch must not see its own earlier output
    return added.where(F.col("batch_id") < before).drop("batch_id")


def current_tables(spark: SparkSession, base: str, root: str, batch_id: int) -> Tables:
    """Stored tables plus every row appended by micro-batches before ``batch_id``."""
    t = load_tables(spark, base)
    extra = {}
    for name in APPENDED:
        added = _added(spark, root, name, batch_id)
        if added is not None:
            extra[name] = t.get(name).unionByName(added)
    return t.with_(**extra)


def admit_batch(spark: SparkSession, base: str, root: str, batch: DataFrame, batch_id: int) -> None:
    """One micro-batch: admit, then write added rows and outcomes under batch_id."""
    t = current_tables(spark, base, root, batch_id)
    new_booking, new_seats, outcomes = admitted(t, batch)
    for name, df in (("booking", new_booking), ("booking_seat", new_seats),
                     ("outcomes", outcomes)):
        target = os.path.join(root, "added" if name != "outcomes" else "", name)
        (df.withColumn("batch_id", F.lit(batch_id).cast("long"))
           .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(target))


def start_admission_stream(spark: SparkSession, base: str, requests_dir: str, root: str,
                           checkpoint: str, files_per_batch: int | None = None,
                           available_now: bool = False,
                           processing_time: str | None = None) -> StreamingQuery:
    """Start the stream; returns the running query."""
    reader = spark.readStream.schema(BOOKING_REQUEST).option("mode", "PERMISSIVE")
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    stream = reader.json(requests_dir)
    writer = (stream.writeStream
              .foreachBatch(lambda df, batch_id: admit_batch(spark, base, root, df, batch_id))
              .option("checkpointLocation", checkpoint))
    if available_now:
        writer = writer.trigger(availableNow=True)
    elif processing_time:
        writer = writer.trigger(processingTime=processing_time)
    return writer.start()


def read_outcomes(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.parquet(os.path.join(root, "outcomes"))
