"""The ten booking tables as one bundle of DataFrames; load and write them."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import SCHEMAS, TABLES


@dataclass(frozen=True)
class Tables:
    producer: DataFrame
    users: DataFrame
    theater: DataFrame
    movie: DataFrame
    showtime: DataFrame
    movie_genre: DataFrame
    booking: DataFrame
    seat: DataFrame
    booking_seat: DataFrame
    payment: DataFrame

    def get(self, name: str) -> DataFrame:
        return getattr(self, name)

    def with_(self, **changed: DataFrame) -> "Tables":
        """A new snapshot with some tables replaced (inputs are never modified)."""
        return replace(self, **changed)

    def items(self):
        return [(f.name, getattr(self, f.name)) for f in fields(self)]


def conform(df: DataFrame, name: str) -> DataFrame:
    """Select and cast the columns of ``name`` in schema order."""
    schema = SCHEMAS[name]
    return df.select([F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])


def load_tables(spark: SparkSession, path: str, fmt: str = "parquet",
                options: dict[str, str] | None = None) -> Tables:
    """Read the ten tables from ``{path}/{table}`` with their fixed schemas.

    Any Spark source works (``parquet``, ``orc``, ``delta`` where installed,
    ``jdbc`` with ``dbtable`` options per table). The schema is given, so no
    inference pass runs and column pruning reaches the scan.
    """
    def read(name: str) -> DataFrame:
        reader = spark.read.format(fmt).options(**(options or {}))
        if fmt == "jdbc":
            return conform(reader.option("dbtable", name).load(), name)
        return reader.schema(SCHEMAS[name]).load(f"{path.rstrip('/')}/{name}")

    return Tables(**{name: read(name) for name in TABLES})


def write_tables(t: Tables, path: str, mode: str = "errorifexists", fmt: str = "parquet",
                 only: tuple[str, ...] | None = None,
                 rows_per_file: int | None = None) -> None:
    """Write a snapshot; each table to ``{path}/{table}``.

    With ``rows_per_file`` each table is first cut into files of about that
    many rows (a 25-row table stays one file, a large one gets many), so later
    scans get one task per useful split.
    """
    for name, df in t.items():
        if only and name not in only:
            continue
        out = df
        if rows_per_file:
            n = df.count()
            out = df.repartition(max(1, -(-n // rows_per_file)))
        out.write.mode(mode).format(fmt).save(f"{path.rstrip('/')}/{name}")


# Bucketing of a stored snapshot: the three booking-keyed tables share one
# bucket count on booking_id, so their joins and per-booking aggregates need
# no shuffle. Other tables stay plain: their joins use other keys (or
# several), where fixed buckets only constrain the plan.
BUCKET_KEYS = {"booking": "booking_id", "booking_seat": "booking_id", "payment": "booking_id"}


def save_bucketed(t: Tables, database: str, path: str, buckets: int,
                  rows_per_file: int | None = None) -> None:
    """Write a snapshot as catalog tables ``{database}.{table}`` at ``{path}/{table}``,
    bucketed (and sorted within buckets) by the keys above; the other tables
    cut into files of about ``rows_per_file`` rows."""
    spark = t.booking.sparkSession
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {database}")
    for name, df in t.items():
        if name in BUCKET_KEYS:
            df = df.repartition(buckets, BUCKET_KEYS[name])   # one file per bucket
        elif rows_per_file:
            df = df.repartition(max(1, -(-df.count() // rows_per_file)))
        w = df.write.mode("overwrite").format("parquet").option("path", f"{path.rstrip('/')}/{name}")
        if name in BUCKET_KEYS:
            w = w.bucketBy(buckets, BUCKET_KEYS[name]).sortBy(BUCKET_KEYS[name])
        w.saveAsTable(f"{database}.{name}")


def load_catalog_tables(spark: SparkSession, database: str) -> Tables:
    """The ten tables from the catalog (keeps their bucketing for the planner)."""
    return Tables(**{name: conform(spark.table(f"{database}.{name}"), name) for name in TABLES})


def tables_from_rows(spark: SparkSession, rows: dict[str, list[tuple]]) -> Tables:
    """Typed literal rows (test fixtures): ``{table: [tuple, ...]}``."""
    return Tables(**{name: spark.createDataFrame(rows.get(name, []), SCHEMAS[name])
                     for name in TABLES})


def existing(df: DataFrame, wanted: list[str] | tuple[str, ...]) -> list[str]:
    """Keep only the wanted columns that ``df`` really has (column introspection)."""
    have = set(df.columns)
    return [c for c in wanted if c in have]
