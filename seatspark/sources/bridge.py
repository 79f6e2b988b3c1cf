"""Booking tables derived from the TPC-H-like test data (the "bridge").

Every rule here is a fixed mapping, so the DuckDB oracle can rebuild the very
same rows (``oracle/bridge.py``). All derivations are narrow projections and
filters over the source scans, except ``booking_seat`` (lineitem joined to its
order, then one row per (showtime, seat)) and ``movie_genre`` (a distinct union).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import MONEY, RATING, TS
from .tables import Tables

# Fixed values of the bridge mapping.
STAFF_EVERY = 50          # c_custkey % 50 = 0 -> staff, = 1 -> admin
NO_BOOKING_CUSTOMER = (40, 7)   # orders with o_custkey % 40 = 7 have no booking
NO_PAYMENT_ORDER = (8, 7)       # orders with o_orderkey % 8 = 7 have no payment
UNOWNED_PRODUCERS = 5     # owner_id = p_partkey % (count(supplier) + 5)
THEATERS = 25             # theater_id = (p_partkey + 7k) % 25
SEATS_PER_THEATER = 60
FIRST_SHOW = "2026-01-01 10:00:00"


def read_source(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def seat_of_line(partkey: Column, linenumber: Column) -> Column:
    return ((partkey * 7 + linenumber * 13) % SEATS_PER_THEATER + 1).cast("string")


def showtime_of_order(orderkey: Column, custkey: Column, n_parts: Column) -> Column:
    return (orderkey * 31 + custkey) % (n_parts * 2)


def booking_status(orderstatus: Column, orderkey: Column) -> Column:
    return (F.when(orderstatus == "P", "Cancelled")
            .when(orderstatus == "O", "Pending")
            .when(orderkey % 10 == 0, "Used")
            .otherwise("Confirmed"))


def bridge_tables(spark: SparkSession, sf_dir: str) -> Tables:
    src = lambda name: read_source(spark, sf_dir, name)
    customer, supplier, nation = src("customer"), src("supplier"), src("nation")
    part, orders, lineitem = src("part"), src("orders"), src("lineitem")

    # Scalar subqueries: evaluated once, no join with the big side.
    n_suppliers = supplier.select(F.count(F.lit(1))).scalar()
    n_parts = part.select(F.count(F.lit(1))).scalar()

    users = customer.select(
        F.col("c_custkey").cast("long").alias("user_id"),
        F.col("c_name").alias("name"),
        F.concat(F.lit("u"), F.col("c_custkey").cast("string"), F.lit("@example.com")).alias("email"),
        F.concat(F.lit("pw"), F.col("c_custkey").cast("string")).alias("password"),
        F.when(F.col("c_custkey") % STAFF_EVERY == 0, "staff")
         .when(F.col("c_custkey") % STAFF_EVERY == 1, "admin")
         .otherwise("customer").alias("role"))

    producer = supplier.select(F.col("s_suppkey").cast("long").alias("owner_id"),
                               F.col("s_name").alias("owner_name"))
    theater = nation.select(F.col("n_nationkey").cast("long").alias("theater_id"),
                            F.col("n_name").alias("theater_name"))

    movie = part.select(
        F.col("p_partkey").cast("long").alias("movie_id"),
        (F.col("p_partkey") % (n_suppliers + UNOWNED_PRODUCERS)).cast("long").alias("owner_id"),
        F.col("p_name").alias("title"),
        (F.col("p_size") + 60).cast("int").alias("duration"),
        F.col("p_type").alias("description"),
        F.lit(None).cast("string").alias("poster_url"),
        F.col("p_size").cast(RATING).alias("rating"))

    movie_genre = (
        part.where(F.col("p_partkey") % 9 != 0)
            .select(F.col("p_partkey").cast("long").alias("movie_id"), F.col("p_type").alias("genre"))
        .union(part.where(F.col("p_partkey") % 2 == 0)
                   .select(F.col("p_partkey").cast("long").alias("movie_id"),
                           F.col("p_brand").alias("genre")))
        .distinct())

    k = F.col("k")
    showtime = (part.select("p_partkey", "p_retailprice",
                            F.explode(F.array(F.lit(0), F.lit(1))).alias("k"))
                .select(
                    (F.col("p_partkey") * 2 + k).cast("long").alias("showtime_id"),
                    F.col("p_partkey").cast("long").alias("movie_id"),
                    ((F.col("p_partkey") + k * 7) % THEATERS).cast("long").alias("theater_id"),
                    (F.lit(FIRST_SHOW).cast(TS)
                     + F.make_dt_interval((F.col("p_partkey") % 90).cast("int"),
                                          (k * 5).cast("int"))).alias("show_date"),
                    F.col("p_retailprice").cast(MONEY).alias("price")))

    seat = nation.select(
        F.explode(F.transform(F.sequence(F.lit(1), F.lit(SEATS_PER_THEATER)),
                              lambda r: r.cast("string"))).alias("seat_number"),
        F.col("n_nationkey").cast("long").alias("theater_id"))

    kept_orders = orders.where(F.col("o_custkey") % NO_BOOKING_CUSTOMER[0] != NO_BOOKING_CUSTOMER[1])
    booking = kept_orders.select(
        F.col("o_orderkey").cast("long").alias("booking_id"),
        F.col("o_custkey").cast("long").alias("user_id"),
        showtime_of_order(F.col("o_orderkey"), F.col("o_custkey"), n_parts)
            .cast("long").alias("showtime_id"),
        booking_status(F.col("o_orderstatus"), F.col("o_orderkey")).alias("status"),
        F.col("o_orderdate").cast(TS).alias("booking_date"))

    # One line item = one wanted seat; the first booking (lowest id) per
    # (showtime, seat) keeps it. min() aggregates map-side before the shuffle,
    # so even a showtime holding a third of all lines moves at most 60 rows
    # per map task.
    lines = lineitem.select(F.col("l_orderkey").alias("booking_id"),
                            seat_of_line(F.col("l_partkey"), F.col("l_linenumber")).alias("seat_number"))
    booking_seat = (lines.join(booking.select("booking_id", "showtime_id"), "booking_id")
                    .join(showtime.select("showtime_id", "theater_id"), "showtime_id")
                    .groupBy("showtime_id", "theater_id", "seat_number")
                    .agg(F.min("booking_id").alias("booking_id"))
                    .select("booking_id", "seat_number", "theater_id", "showtime_id"))

    # o_orderkey is the orders key, so "orders joined to its booking" is the
    # same row: payment is a filter of orders, no join needed.
    status = booking_status(F.col("o_orderstatus"), F.col("o_orderkey"))
    payment = kept_orders.where(F.col("o_orderkey") % NO_PAYMENT_ORDER[0] != NO_PAYMENT_ORDER[1]).select(
        (F.col("o_orderkey") + 1000000).cast("long").alias("payment_id"),
        F.col("o_orderkey").cast("long").alias("booking_id"),
        F.col("o_totalprice").cast(MONEY).alias("amount"),
        F.when(status.isin("Confirmed", "Used"), "Confirmed")
         .when(status == "Pending", "Pending")
         .when(F.col("o_orderkey") % 2 == 0, "Refunded")
         .otherwise("Cancelled").alias("status"),
        F.col("o_orderdate").cast(TS).alias("payment_date"))

    return Tables(producer=producer, users=users, theater=theater, movie=movie,
                  showtime=showtime, movie_genre=movie_genre, booking=booking, seat=seat,
                  booking_seat=booking_seat, payment=payment)
