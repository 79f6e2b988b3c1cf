"""Request and event tables: read from JSON payloads, or derived from test data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import split_seat_text
from ..schemas import BOOKING_EVENT, BOOKING_MOVE, BOOKING_REQUEST, TS
from .bridge import read_source, seat_of_line, showtime_of_order

# Fixed values of the event derivation: source event type -> booking action; by event_id, some become
# a refund or a status set to one of these (the last two are refused).
EVENT_ACTIONS = {"purchase": "pay", "click": "checkin", "view": "use", "error": "cancel",
                 "signup": "create_payment"}
SET_STATUSES = ("Pending", "Confirmed", "Cancelled", "Used", "Lost", "")
EVENTS_PER_BOOKING = 5


KINDS = {"booking": BOOKING_REQUEST, "event": BOOKING_EVENT, "move": BOOKING_MOVE}
RAW = "raw"  # the column that keeps the text of a malformed payload


def read_requests(spark: SparkSession, path: str, kind: str = "booking",
                  fmt: str = "json") -> DataFrame:
    """Request payloads (one JSON object per line) with a fixed schema.

    PERMISSIVE mode: a malformed line becomes a row of nulls, which the
    change operators refuse as missing fields instead of failing the batch.
    :func:`read_payloads` keeps the text of such lines as well.
    """
    return spark.read.schema(KINDS[kind]).option("mode", "PERMISSIVE").format(fmt).load(path)


def parse_payloads(lines: DataFrame, kind: str = "booking") -> tuple[DataFrame, DataFrame]:
    """``lines`` (``value``: a JSON object each) -> (requests, malformed).

    A line that is no JSON object, or has a value of another type than the
    schema's, goes to ``malformed`` (outcome, raw), which keeps its text;
    nothing of it reaches the requests. Empty and null lines are skipped, as a
    text reader does. Absent fields are null.
    """
    schema = KINDS[kind]
    wide = schema.simpleString()[len("struct<"):-1]
    parsed = (lines.where(F.trim(F.coalesce("value", F.lit(""))) != "")
              .select("value", F.from_json("value", f"struct<{wide},{RAW}:string>",
                                           {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": RAW}).alias("p")))
    # a JSON value that is no object parses to null fields without being corrupt
    whole = F.col(f"p.{RAW}").isNull() & F.col("value").rlike(r"^\s*\{")
    good = parsed.where(whole).select(*[F.col(f"p.{f.name}").alias(f.name) for f in schema.fields])
    bad = parsed.where(~whole).select(F.lit("malformed").alias("outcome"), F.col("value").alias(RAW))
    return good, bad


def read_payloads(spark: SparkSession, path: str, kind: str = "booking") -> tuple[DataFrame, DataFrame]:
    """:func:`parse_payloads` over the lines of text files."""
    return parse_payloads(spark.read.text(path), kind)


def booking_requests_from(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One request per order: its customer, a showtime at or after the order's own, one seat per line item."""
    orders = read_source(spark, sf_dir, "orders")
    lineitem = read_source(spark, sf_dir, "lineitem")
    n_parts = read_source(spark, sf_dir, "part").select(F.count(F.lit(1))).scalar()
    seats = (lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey"))
             .agg(F.array_sort(F.collect_list(
                 seat_of_line(F.col("l_partkey"), F.col("l_linenumber")))).alias("seats")))
    return (orders.join(seats, "o_orderkey", "left")
            .select(F.col("o_orderkey").cast("long").alias("request_id"),
                    F.col("o_custkey").cast("long").alias("user_id"),
                    showtime_of_order(F.col("o_orderkey"), F.col("o_custkey") + F.col("o_orderkey") % 3, n_parts)
                    .cast("long").alias("showtime_id"),
                    "seats",
                    F.col("o_orderdate").cast(TS).alias("requested_at")))


def booking_events_from(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One event per row of ``events``: five events per booking on average.

    booking_id = event_id % (count(events) / 5); the actor is the booking's
    user, joined in by the caller (``with_actor``) since it needs the bookings.
    """
    events = read_source(spark, sf_dir, "events")
    n_events = events.select(F.count(F.lit(1))).scalar()
    mapping = F.create_map(*[F.lit(x) for kv in EVENT_ACTIONS.items() for x in kv])
    kind = F.col("event_id") % 11
    status = F.element_at(F.array(*[F.lit(x) for x in SET_STATUSES]), (F.col("event_id") % 6 + 1).cast("int"))
    return events.select(
        (F.col("event_id") % F.floor(n_events / EVENTS_PER_BOOKING)).cast("long").alias("booking_id"),
        F.col("event_id").cast("long").alias("seq"),
        F.when(kind.isin(3, 8), "refund").when(kind == 5, "set_status")
         .otherwise(F.element_at(mapping, F.col("event_type"))).alias("action"),
        F.lit(None).cast("long").alias("actor_id"),
        F.when(kind == 5, status).alias("new_status"),
        F.col("ts").cast(TS).alias("at"))


def with_actor(events: DataFrame, booking: DataFrame) -> DataFrame:
    """Fill actor_id with the booking's own user (events on unknown bookings keep null)."""
    owners = booking.select("booking_id", F.col("user_id").alias("_owner"))
    return (events.join(owners, "booking_id", "left")
            .withColumn("actor_id", F.coalesce("actor_id", "_owner"))
            .drop("_owner"))


def requests_from_text(df: DataFrame) -> DataFrame:
    """Form input (``seats_text`` like ``'1, 2,3'``) -> booking request rows.

    The seat text is split on commas and trimmed, as the booking form does;
    an empty text gives an empty list (refused as empty_seats).
    """
    text = F.col("seats_text")
    seats = F.when(F.trim(text) == "", F.array().cast("array<string>")).otherwise(split_seat_text(text))
    return df.select(F.col("request_id").try_cast("long").alias("request_id"),
                     F.col("user_id").try_cast("long").alias("user_id"),
                     F.col("showtime_id").try_cast("long").alias("showtime_id"), seats.alias("seats"),
                     F.lit(None).cast(TS).alias("requested_at"))


def payload_lines_from(requests: DataFrame) -> DataFrame:
    """Requests as JSON lines (``value``), for two thirds of the request_ids; every 29th line is cut off,
    every 31st has a text for a user, every 37th is a list."""
    r = F.col("request_id")
    whole = F.to_json(F.struct("request_id", "user_id", "showtime_id", "seats"))
    head = F.concat(F.lit('{"request_id":'), r.cast("string"))
    return requests.where(r % 3 != 1).select(
        F.when(r % 29 == 0, F.concat(head, F.lit(',"seats":["1"')))
         .when(r % 31 == 0, F.concat(head, F.lit(',"user_id":"nobody","showtime_id":1,"seats":["1"]}')))
         .when(r % 37 == 0, F.concat(F.lit("["), r.cast("string"), F.lit("]")))
         .otherwise(whole).alias("value"))


def form_rows_from(requests: DataFrame) -> DataFrame:
    """The other third as form input: the seats typed as one text, with odd blanks; every 41st user is no number."""
    r = F.col("request_id")
    typed = F.concat(F.lit(" "), F.array_join("seats", " ,  "))
    return requests.where(r % 3 == 1).select(
        "request_id", F.when(r % 41 == 0, "nobody").otherwise(F.col("user_id").cast("string")).alias("user_id"),
        "showtime_id", typed.alias("seats_text"))
