"""Line dedup over levelled sorted runs of line keys, in DataFrame operations only.

Documents come in batches of ascending doc_id, of about as many lines each. Each run is a bucketed, sorted
table of the line keys that earlier batches held. A batch's keys are
merge-anti-joined with the runs; keys that are new form the next run of level
0. When a level has ``fan_in`` runs they are merged into one of the next level,
so there are few runs however many batches came, and each key is rewritten
once a level.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import saved, scratch

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
KEY = ["h1", "h2"]


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    """A line without the blanks at its ends, A-Z in lower case."""
    return F.translate(F.btrim(line, F.lit(" \t\n\x0b\f\r")), UPPER, LOWER)


class Runs:
    """The levelled runs of one job, each a bucketed table below the shared folder."""

    def __init__(self, spark: SparkSession, fan_in: int, buckets: int):
        self.spark, self.fan_in, self.buckets = spark, fan_in, buckets
        self.prefix, self.count = f"line_runs_{uuid.uuid4().hex}", 0
        self.levels: list[list[str]] = []

    def _write(self, keys: DataFrame) -> str:
        name = f"{self.prefix}_{self.count}"
        self.count += 1
        (keys.select(*KEY).repartition(self.buckets, *KEY).write.bucketBy(self.buckets, *KEY).sortBy(*KEY)
         .option("path", scratch(self.spark, name)).saveAsTable(name))
        return name

    def add(self, keys: DataFrame) -> None:
        """Add a batch's new keys as a run of level 0; merge full levels."""
        run, level = self._write(keys), 0
        while True:
            if level == len(self.levels):
                self.levels.append([])
            self.levels[level].append(run)
            if len(self.levels[level]) < self.fan_in:
                return
            full, self.levels[level] = self.levels[level], []
            run = self._write(self._union(full))  # the runs are disjoint
            self._drop(full)
            level += 1

    def _union(self, names: list[str]) -> DataFrame:
        out = self.spark.table(names[0])
        for name in names[1:]:
            out = out.unionByName(self.spark.table(name))
        return out

    def _drop(self, names: list[str]) -> None:
        for name in names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")

    def split(self, keys: DataFrame) -> DataFrame:
        """``keys`` with ``seen``: whether a run holds the key. Runs are joined largest first."""
        names = [n for level in reversed(self.levels) for n in level]
        out = keys.withColumn("seen", F.lit(False))
        for name in names:
            run = self.spark.table(name).hint("merge").withColumn("hit", F.lit(True))
            out = out.join(run, KEY, "left").withColumn("seen", F.col("seen") | F.col("hit").isNotNull()).drop("hit")
        return out

    def close(self) -> None:
        self._drop([n for level in self.levels for n in level])


def repeated_lines(docs: DataFrame, min_chars: int = 10, batches: int = 4, fan_in: int = 2) -> DataFrame:
    """(doc_id, text_hash, places): the lines of each document that an earlier one holds.

    A key counts as repeated if two different doc_ids hold it. The smallest
    doc_id keeps all its lines. Rows with null doc_id neither lose lines nor
    count as holders.
    """
    spark = docs.sparkSession
    rows = docs.where("doc_id is not null").select("doc_id", F.xxhash64("text").alias("text_hash"),
                                                    F.posexplode(F.transform(_lines(F.col("text")), line_key)))
    rows = rows.where(F.char_length("col") >= min_chars).select(
        "doc_id", "text_hash", F.col("pos").alias("place"), F.xxhash64("col").alias("h1"),
        F.xxhash64(F.lit(17), F.col("col")).alias("h2"))
    rows = saved(rows, "lines")
    shares = [k / batches for k in range(1, batches + 1)]
    cuts = rows.agg(F.percentile_approx("doc_id", shares, 10_000)).first()[0]  # the last one is the largest doc_id
    parts = []
    if cuts:
        cuts = sorted(set(cuts))
        runs = Runs(spark, fan_in, int(spark.conf.get("spark.sql.shuffle.partitions")))
        for k, cut in enumerate(cuts):
            batch = rows.where(F.col("doc_id") <= cut) if k == 0 else rows.where(
                (F.col("doc_id") > cuts[k - 1]) & (F.col("doc_id") <= cut))
            keys = batch.groupBy(*KEY).agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
            keys = saved(runs.split(keys), "line-keys")
            if k < len(cuts) - 1:
                runs.add(keys.where("not seen"))
            found = keys.where("seen or first < last").select(*KEY, "seen", "first")
            parts.append(batch.join(found, KEY).where("seen or doc_id > first").select("doc_id", "text_hash", "place"))
        runs.close()
    if not parts:
        return spark.createDataFrame([], "doc_id long, text_hash long, places array<int>")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.groupBy("doc_id", "text_hash").agg(F.collect_set("place").alias("places"))


def dedup_lines(docs: DataFrame, min_chars: int = 10, batches: int = 4, fan_in: int = 2) -> DataFrame:
    """``docs`` with each repeated line kept in the smallest doc_id only.

    The key of a line is the line without blanks at its ends, in lower case
    (A-Z). Keys of ``min_chars`` code points or more found under two doc_ids
    lose all lines but those of the smallest one. All columns of ``docs`` stay;
    ``text`` is what remains, joined by line feeds, and ``n_lines`` (before)
    and ``n_dropped`` are added (columns of these names are replaced). Null
    text counts as one empty line and becomes an empty text. Rows with null
    doc_id stay as they are. Repeated rows of one doc_id count as one document:
    its lines are not repeats of each other. No document goes.
    """
    docs = docs.drop("n_lines", "n_dropped")
    own = uuid.uuid4().hex  # the names below clash with no column of docs
    doc, text_hash, places, split = (f"{name}_{own}" for name in ("doc", "hash", "places", "lines"))
    drops = saved(repeated_lines(docs.select("doc_id", "text"), min_chars, batches, fan_in), "line-drops").toDF(doc, text_hash, places)
    rows = docs.join(drops, (F.col("doc_id") == F.col(doc)) & (F.xxhash64("text") == F.col(text_hash)), "left")
    left = F.array_except(F.sequence(F.lit(0), F.size(split) - 1), F.col(places))
    kept = F.when(F.col(places).isNull(), F.coalesce("text", F.lit(""))).otherwise(
        F.array_join(F.transform(left, lambda i: F.col(split)[i]), "\n"))
    columns = [kept.alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns]
    return rows.withColumn(split, _lines(F.col("text"))).select(
        *columns, F.size(split).cast("long").alias("n_lines"),
        F.coalesce(F.size(places), F.lit(0)).cast("long").alias("n_dropped"))
