"""Bulk-change scenarios over the bridge tables: inputs derived from test data.

Each returns the DataFrame a registered query reports (usually the outcomes).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators.admit import admit_bookings
from .operators.audit import audit
from .operators.dml import (delete_cascade, insert_rows, patch_movies, register_users,
                            replace_showtimes, table_sizes)
from .operators.events import apply_booking_events
from .operators.ids import max_id, next_ids
from .operators.moves import reassign_bookings
from .plans.views import register_views
from .session import cut_lineage
from .sources.bridge import bridge_tables, read_source
from .sources.tables import Tables
from .sources.requests import (booking_events_from, booking_requests_from, form_rows_from, parse_payloads,
                               payload_lines_from, requests_from_text, with_actor)


def _tables(spark: SparkSession, sf_dir: str, t: Tables | None) -> Tables:
    return t if t is not None else bridge_tables(spark, sf_dir)


def _held_once(t: Tables) -> Tables:
    """The held seats as a stored table: a change that reads them several times derives them once."""
    return t.with_(booking_seat=cut_lineage(t.booking_seat))


def admission(spark: SparkSession, sf_dir: str, t: Tables | None = None,
              requests: DataFrame | None = None):
    """Every order asks for its line items' seats, two thirds of them in a later showtime than the booked one."""
    t = _tables(spark, sf_dir, t)
    if requests is None:
        requests = booking_requests_from(spark, sf_dir)
    return admit_bookings(t, requests)


def admit_outcomes(spark: SparkSession, sf_dir: str, t: Tables | None = None) -> DataFrame:
    return admission(spark, sf_dir, t)[1]


def booking_events(spark: SparkSession, sf_dir: str, t: Tables | None = None,
                   events: DataFrame | None = None):
    """Every row of ``events`` becomes an action on a booking, by the booking's user."""
    t = _tables(spark, sf_dir, t)
    if events is None:
        events = with_actor(booking_events_from(spark, sf_dir), t.booking)
    return apply_booking_events(t, events)


def event_outcomes(spark: SparkSession, sf_dir: str, t: Tables | None = None) -> DataFrame:
    return booking_events(spark, sf_dir, t)[1]


def events_booking_after(spark: SparkSession, sf_dir: str, t: Tables | None = None) -> DataFrame:
    return booking_events(spark, sf_dir, t)[0].booking


def events_payment_after(spark: SparkSession, sf_dir: str, t: Tables | None = None) -> DataFrame:
    return booking_events(spark, sf_dir, t)[0].payment


# ---- M5-M9 inputs derived from part / customer / supplier -------------------------

BIG = 1_000_000_000  # offset that makes an id unknown to the bridge tables


def _counts(spark: SparkSession, sf_dir: str):
    part = read_source(spark, sf_dir, "part")
    supplier = read_source(spark, sf_dir, "supplier")
    return (part, supplier, part.select(F.count(F.lit(1))).scalar(),
            supplier.select(F.count(F.lit(1))).scalar())


def movie_insert_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every 5th part re-inserts its movie; the others pair up on a new id."""
    part, _, _, n_supp = _counts(spark, sf_dir)
    k = F.col("p_partkey")
    return part.select(
        k.cast("long").alias("request_id"),
        F.when(k % 5 == 0, k).otherwise(F.lit(BIG) + F.floor(k / 2)).cast("long").alias("movie_id"),
        (k % (n_supp + 5)).cast("long").alias("owner_id"),
        F.col("p_name").alias("title"),
        F.when(F.col("p_size") % 7 == 0, 0).otherwise(F.col("p_size") + 60).cast("int").alias("duration"))


def user_register_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and e-mails collide with existing users and with each other (case-insensitively)."""
    c = F.col("c_custkey")
    cust = read_source(spark, sf_dir, "customer")
    return cust.select(
        c.cast("long").alias("request_id"),
        F.when(c % 4 == 0, c).otherwise(F.lit(BIG) + F.floor(c / 3)).cast("long").alias("user_id"),
        F.col("c_name").alias("name"),
        F.when(c % 6 == 1, F.concat(F.lit("U"), c.cast("string"), F.lit("@EXAMPLE.COM")))
         .when(c % 6 == 2, F.concat(F.lit("shared"), F.floor(c / 12).cast("string"),
                                    F.lit("@example.com")))
         .otherwise(F.concat(F.lit("new"), c.cast("string"), F.lit("@example.com"))).alias("email"),
        F.when(c % 11 == 0, "").otherwise("pw").alias("password"),
        F.when(c % 13 == 0, "staff").when(c % 13 == 1, "customer").alias("role"))


def showtime_replace_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two replacements per showtime; some unknown showtimes, movies, theaters, zero prices."""
    part, _, n_parts, _ = _counts(spark, sf_dir)
    k = F.col("k")
    p = F.col("p_partkey")
    return (part.select("p_partkey", "p_retailprice",
                        F.explode(F.array(F.lit(0), F.lit(1))).alias("k"))
            .select((p * 2 + k).cast("long").alias("request_id"),
                    F.when(p % 4 == 3, p * 2 + BIG).otherwise(p * 2).cast("long").alias("showtime_id"),
                    ((p * 7 + k) % (n_parts + 3)).cast("long").alias("movie_id"),
                    ((p + k) % 27).cast("long").alias("theater_id"),
                    (F.lit("2026-03-01 18:00:00").cast("timestamp_ntz")
                     + F.make_dt_interval((p % 30).cast("int"), k.cast("int"))).alias("show_date"),
                    F.when(p % 10 == 9, 0).otherwise(F.col("p_retailprice") + k)
                    .cast("decimal(10,2)").alias("price")))


def movie_patch_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six kinds of patch, two patches per movie, some on unknown movies."""
    part, _, _, _ = _counts(spark, sf_dir)
    p = F.col("p_partkey")
    kind = p % 6
    keys = (F.when(kind == 0, F.array(F.lit("title"), F.lit("rating")))
            .when(kind == 1, F.array(F.lit("duration")))
            .when(kind == 2, F.array(F.lit("owner_id")))
            .when(kind == 3, F.array(F.lit("description"), F.lit("poster_url")))
            .when(kind == 4, F.array(F.lit("title")))
            .otherwise(F.array(F.lit("movie_id"))))
    values = (F.when(kind == 0, F.array(F.upper("p_name"), F.lit("7.5")))
              .when(kind == 1, F.array(F.concat(F.col("p_size").cast("string"), F.lit("x"))))
              .when(kind == 2, F.array((p % 120).cast("string")))
              .when(kind == 3, F.array(F.lit(None).cast("string"),
                                       F.concat(F.lit("http://img/"), p.cast("string"))))
              .when(kind == 4, F.array(F.lit(None).cast("string")))
              .otherwise(F.array(F.lit("5"))))
    return part.select(
        p.cast("long").alias("request_id"),
        F.when(p % 17 == 0, p + BIG).otherwise(F.floor(p / 2)).cast("long").alias("movie_id"),
        F.map_from_arrays(keys, values).alias("patch"))


def movie_delete_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every part names its movie or an unknown one."""
    p = F.col("p_partkey")
    return read_source(spark, sf_dir, "part").select(
        p.cast("long").alias("request_id"),
        F.when(p % 10 == 3, p).otherwise(p + BIG).cast("long").alias("movie_id"))


def showtime_delete_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every part names one of its showtimes or an unknown one."""
    p = F.col("p_partkey")
    return read_source(spark, sf_dir, "part").select(
        p.cast("long").alias("request_id"),
        F.when(p % 6 == 0, p * 2 + p % 4).otherwise(p * 2 + BIG).cast("long").alias("showtime_id"))


def genre_delete_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every part drops its type as a genre, in upper case; parts without that genre are not found."""
    p = F.col("p_partkey")
    return read_source(spark, sf_dir, "part").select(
        p.cast("long").alias("request_id"), p.cast("long").alias("movie_id"), F.upper("p_type").alias("genre"))


def theater_insert_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every 4th supplier reuses a theater's id (0 counts as missing); the others pair up on a new id."""
    k = F.col("s_suppkey")
    return read_source(spark, sf_dir, "supplier").select(
        k.cast("long").alias("request_id"),
        F.when(k % 4 == 0, k % 30).otherwise(F.lit(BIG) + F.floor(k / 2)).cast("long").alias("theater_id"),
        F.when(k % 7 == 0, "").otherwise(F.col("s_name")).alias("theater_name"))


def producer_delete_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = read_source(spark, sf_dir, "supplier")
    k = F.col("s_suppkey")
    return s.select(k.cast("long").alias("request_id"),
                                      k.cast("long").alias("owner_id"))


def insert_movies(spark, sf_dir, t=None):
    return insert_rows(_tables(spark, sf_dir, t), "movie", movie_insert_rows(spark, sf_dir))


def register_new_users(spark, sf_dir, t=None):
    return register_users(_tables(spark, sf_dir, t), user_register_rows(spark, sf_dir))


def replace_some_showtimes(spark, sf_dir, t=None):
    return replace_showtimes(_tables(spark, sf_dir, t), showtime_replace_rows(spark, sf_dir))


def patch_some_movies(spark, sf_dir, t=None):
    return patch_movies(_tables(spark, sf_dir, t), movie_patch_rows(spark, sf_dir))


def delete_some_movies(spark, sf_dir, t=None):
    return delete_cascade(_tables(spark, sf_dir, t), "movie", movie_delete_keys(spark, sf_dir))


def delete_some_showtimes(spark, sf_dir, t=None):
    return delete_cascade(_tables(spark, sf_dir, t), "showtime", showtime_delete_keys(spark, sf_dir))


def delete_some_genres(spark, sf_dir, t=None):
    return delete_cascade(_tables(spark, sf_dir, t), "movie_genre", genre_delete_keys(spark, sf_dir))


def insert_theaters(spark, sf_dir, t=None):
    return insert_rows(_tables(spark, sf_dir, t), "theater", theater_insert_rows(spark, sf_dir))


def view_pending_totals(spark: SparkSession, sf_dir: str, t: Tables | None = None) -> DataFrame:
    """SQL over the registered views, bookings and money pending per user."""
    register_views(spark, _tables(spark, sf_dir, t))
    return spark.sql("SELECT user_id, count(*) AS n_bookings, CAST(sum(total_price) AS DECIMAL(18,2)) AS pending "
                     "FROM booking_detail WHERE status = 'Pending' GROUP BY user_id")


def delete_some_producers(spark, sf_dir, t=None):
    return delete_cascade(_tables(spark, sf_dir, t), "producer",
                          producer_delete_keys(spark, sf_dir))


def outcomes_of(fn):
    return lambda spark, sf_dir, t=None: fn(spark, sf_dir, t)[1]


def table_after(fn, name):
    return lambda spark, sf_dir, t=None: fn(spark, sf_dir, t)[0].get(name)


def sizes_after(fn):
    return lambda spark, sf_dir, t=None: table_sizes(fn(spark, sf_dir, t)[0])


def booking_move_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order moves its booking: keep or change showtime, two seats or none."""
    orders = read_source(spark, sf_dir, "orders")
    n_parts = read_source(spark, sf_dir, "part").select(F.count(F.lit(1))).scalar()
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    seat = lambda x: x.cast("string")
    return orders.select(
        o.cast("long").alias("request_id"),
        F.when(o % 91 == 0, o + BIG).when(o % 17 == 0, o - 7).otherwise(o)
         .cast("long").alias("booking_id"),
        F.when(o % 49 == 0, c + 1).otherwise(c).cast("long").alias("actor_id"),
        F.when(o % 3 == 0, F.lit(None))
         .when(o % 3 == 1, (o * 31 + c + 2) % (n_parts * 2))
         .otherwise(o + BIG).cast("long").alias("showtime_id"),
        F.when(o % 5 == 0, F.lit(None).cast("array<string>"))
         .when(o % 11 == 0, F.array().cast("array<string>"))
         .otherwise(F.array(seat((o * 3) % 60 + 1), seat((F.floor(o / 7) * 5) % 62 + 1)))
         .alias("seats"))


def move_some_bookings(spark, sf_dir, t=None):
    t = t if t is not None else _held_once(bridge_tables(spark, sf_dir))
    return reassign_bookings(t, booking_move_rows(spark, sf_dir))


def new_payment_ids(spark: SparkSession, sf_dir: str, t: Tables | None = None) -> DataFrame:
    """M4: the ids a payment run would give every booking without a payment."""
    t = _tables(spark, sf_dir, t)
    unpaid = t.booking.join(t.payment.select("booking_id"), "booking_id", "left_anti")
    return next_ids(unpaid.select("booking_id"), ["booking_id"],
                    max_id(t.payment, "payment_id"), "payment_id")


def genre_insert_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of parts add a genre to one movie; some repeat a genre in another case."""
    part, _, _, _ = _counts(spark, sf_dir)
    p = F.col("p_partkey")
    return part.select(
        p.cast("long").alias("request_id"),
        F.when(p % 11 == 0, F.floor(p / 2) + BIG).otherwise(F.floor(p / 2)).cast("long").alias("movie_id"),
        F.when(p % 3 == 0, F.lower("p_type"))
         .when(p % 3 == 1, F.concat(F.lit("Genre"), (p % 4).cast("string")))
         .otherwise(F.lit("")).alias("genre"))


def showtime_insert_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New showtimes: some reuse an id, pairs share a new id, some point nowhere."""
    part, _, n_parts, _ = _counts(spark, sf_dir)
    p = F.col("p_partkey")
    return part.select(
        p.cast("long").alias("request_id"),
        F.when(p % 5 == 0, p * 2).otherwise(F.floor(p / 2) + BIG).cast("long").alias("showtime_id"),
        ((p * 3) % (n_parts + 4)).cast("long").alias("movie_id"),
        (p % 26).cast("long").alias("theater_id"),
        (F.lit("2026-06-01 12:00:00").cast("timestamp_ntz")
         + F.make_dt_interval((p % 30).cast("int"))).alias("show_date"),
        F.col("p_retailprice").cast("decimal(10,2)").alias("price"))


def insert_genres(spark, sf_dir, t=None):
    return insert_rows(_tables(spark, sf_dir, t), "movie_genre", genre_insert_rows(spark, sf_dir))


def insert_showtimes(spark, sf_dir, t=None):
    return insert_rows(_tables(spark, sf_dir, t), "showtime", showtime_insert_rows(spark, sf_dir))


def dirty_tables(t: Tables) -> Tables:
    """The bridge tables with every kind of violation, prices, amounts and ratings of other types than the schema's."""
    u, b, p = F.col("user_id"), F.col("booking_id"), F.col("payment_id")
    mail = (F.when(u % 70 == 3, F.concat(F.lit("U"), (u - 1).cast("string"), F.lit("@EXAMPLE.COM")))
            .when(u % 90 != 5, F.col("email")))
    text = F.col("amount").cast("string")
    amount = (F.when(b % 37 == 0, "n/a").when(b % 41 == 0, (F.col("amount") * 10000).cast("string")).otherwise(text))
    show = F.col("showtime_id")
    return t.with_(
        users=t.users.withColumns({"name": F.when(u % 80 == 4, F.repeat("name", F.lit(8))).otherwise(F.col("name")),
                                   "email": mail}),
        movie=t.movie.withColumn("rating", (3 * F.col("rating")).cast("string")).unionByName(
            t.movie.where(F.col("movie_id") % 101 == 0).withColumn("rating", F.col("rating").cast("string"))),
        showtime=t.showtime.withColumn("price", F.when(show % 83 == 0, F.col("price") * 1000000).otherwise(F.col("price"))
                                       .cast("decimal(18,2)")),
        booking=t.booking.where(b % 71 != 0).withColumns({
            "user_id": F.when(b % 59 != 0, u), "showtime_id": F.when(b % 61 == 0, show + 1).otherwise(show),
            "status": F.when(b % 53 == 0, "Lost").otherwise(F.col("status"))}),
        booking_seat=t.booking_seat.withColumn(
            "theater_id", F.when(b % 67 == 0, F.col("theater_id") + 1).otherwise(F.col("theater_id"))).unionByName(
            t.booking_seat.where(b % 73 == 0).withColumn("booking_id", b + 1)),
        payment=t.payment.withColumn("amount", amount).unionByName(
            t.payment.where(b % 50 < 2).withColumns({
                "amount": text, "payment_id": F.when(b % 2 == 0, p).otherwise(p + 500000000)})))


def audit_dirty(spark: SparkSession, sf_dir: str, t: Tables | None = None) -> DataFrame:
    """The audit of tables that violate every rule somewhere."""
    return audit(dirty_tables(_tables(spark, sf_dir, t)))


# ---- key tables, payloads, callers --------------------------------------------------

def error_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users with an error event: a key table, each user many times over."""
    return read_source(spark, sf_dir, "events").where(F.col("event_type") == "error").select("user_id")


def urgent_bookings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bookings of urgent orders, by their key; some orders have no booking."""
    return read_source(spark, sf_dir, "orders").where(F.col("o_orderpriority") == "1-URGENT").select(
        F.col("o_orderkey").alias("booking_id"))


def dear_showtimes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Showtimes of large parts."""
    return read_source(spark, sf_dir, "part").where(F.col("p_size") > 45).select(
        (F.col("p_partkey") * 2 + 1).alias("showtime_id"))


def by_keys(report, keys, **options):
    """A report for the keys of a table, made from the same source tables."""
    return lambda spark, sf_dir, t=None: report(_tables(spark, sf_dir, t), keys(spark, sf_dir), **options)


#: When a request without a time is dated.
AS_OF = "2026-01-01 00:00:00"


def payload_admission(spark: SparkSession, sf_dir: str, t: Tables | None = None):
    """Every order's request as a JSON line or as form text, some malformed; requests without a time get AS_OF."""
    requests = cut_lineage(booking_requests_from(spark, sf_dir))  # built once, read as JSON, as form text and for its malformed lines
    good, bad = parse_payloads(payload_lines_from(requests))
    typed = requests_from_text(form_rows_from(requests))
    nxt, outcomes = admit_bookings(_tables(spark, sf_dir, t), good.unionByName(typed),
                                   as_of=F.lit(AS_OF).cast("timestamp_ntz"))
    return nxt, outcomes.withColumn("raw", F.lit(None).cast("string")).unionByName(
        bad.select(F.lit(None).cast("long").alias("request_id"), "outcome", F.lit(None).cast("long").alias("booking_id"), "raw"))


def user_create_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accounts of every role: ids and e-mails that clash in chains, request ids repeated, missing and malformed."""
    c = F.col("c_custkey")
    mail = F.concat(F.lit("Link"), F.floor((c + 1) / 2).cast("string"), F.lit("@example.com"))
    return read_source(spark, sf_dir, "customer").select(
        F.when(c % 331 == 0, "none").when(c % 337 == 0, F.lit(None)).when(c % 341 == 0, (c - 1).cast("string"))
         .otherwise(c.cast("string")).alias("request_id"),
        F.when(c % 343 == 0, "x").otherwise((F.lit(BIG) + F.floor(c / 2)).cast("string")).alias("user_id"),
        F.col("c_name").alias("name"),
        F.when(c % 4 < 2, mail).otherwise(F.lower(mail)).alias("email"),
        F.lit("pw").alias("password"),
        F.when(c % 347 == 0, "").when(c % 3 == 0, "staff").when(c % 3 == 1, "admin").otherwise("customer").alias("role"))


def create_users(spark, sf_dir, t=None):
    """Accounts made by an admin: any role, all fields required."""
    return insert_rows(_tables(spark, sf_dir, t), "users", user_create_rows(spark, sf_dir))


# ---- tables that tell more faults apart ---------------------------------------------------

def lettered(t: Tables) -> Tables:
    """Half of the seats have letters, spelled 'Row7' by the theater and 'row7' where they are held."""
    def spelled(prefix: str):
        n = F.col("seat_number")
        return F.when(n.cast("int") <= 30, F.concat(F.lit(prefix), n)).otherwise(n)
    return t.with_(seat=t.seat.withColumn("seat_number", spelled("Row")),
                   booking_seat=t.booking_seat.withColumn("seat_number", spelled("row")))


def lettered_admission(spark: SparkSession, sf_dir: str, t: Tables | None = None):
    """The admission with seats in three spellings; what is stored is the theater's."""
    requests = booking_requests_from(spark, sf_dir).withColumn("seats", F.transform(
        "seats", lambda s: F.when(s.cast("int") <= 30, F.concat(F.lit("ROW"), s)).otherwise(s)))
    return admit_bookings(lettered(_tables(spark, sf_dir, t)), requests)


def two_payments(t: Tables) -> Tables:
    """A twenty-fifth of the bookings have a second, later payment."""
    b, p = F.col("booking_id"), F.col("payment_id")
    more = t.payment.where(b % 50 < 2).withColumns({
        "payment_id": p + 500000000, "status": F.when(b % 3 == 0, "Pending").otherwise("Confirmed"),
        "amount": F.lit(7).cast("decimal(10,2)")})
    return t.with_(payment=t.payment.unionByName(more))


def two_payment_events(spark: SparkSession, sf_dir: str, t: Tables | None = None):
    return booking_events(spark, sf_dir, two_payments(_tables(spark, sf_dir, t)))


def two_payment_moves(spark: SparkSession, sf_dir: str, t: Tables | None = None):
    t = t if t is not None else _held_once(bridge_tables(spark, sf_dir))
    return move_some_bookings(spark, sf_dir, two_payments(t))
