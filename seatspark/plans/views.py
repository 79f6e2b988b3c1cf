"""The four views of the data model and the seat-availability building blocks.

Seat availability is computed per showtime, not per (showtime, seat): each
theater's seat list is a small array (one row per theater), the seats held in
a showtime are a set gathered with a map-side partial aggregate, and
"free" is the list minus the set. Held sets join first and seat lists last, so
no shuffle carries a seat list per showtime; only the final output is exploded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import actively_held, all_of, seat_total, sorted_ci, without
from ..sources.tables import Tables
from .lookups import keyed


# ---- building blocks --------------------------------------------------------

def theater_seat_lists(t: Tables) -> DataFrame:
    """theater_id -> seats sorted as text (case-insensitive), one row per theater."""
    return (t.seat.groupBy("theater_id")
            .agg(sorted_ci(F.collect_list("seat_number")).alias("seats")))


def active_holds_by_booking_showtime(t: Tables, showtimes: DataFrame | None = None) -> DataFrame:
    """(showtime_id of the booking, theater_id) -> seats held by Pending/Confirmed bookings.

    With ``showtimes`` (a report of some showtimes), only those are aggregated.
    """
    active = t.booking.where(actively_held("status")).select("booking_id", "showtime_id")
    if showtimes is not None:
        active = active.join(showtimes.select("showtime_id"), "showtime_id", "left_semi")
    return (t.booking_seat.select("booking_id", "theater_id", "seat_number")
            .join(active, "booking_id")
            .groupBy("showtime_id", "theater_id")
            .agg(F.collect_set(F.lower("seat_number")).alias("held")))


def _seats_of(t: Tables, showtimes: DataFrame | None) -> DataFrame:
    """Held seats, of some showtimes only if they are given."""
    if showtimes is None:
        return t.booking_seat
    return t.booking_seat.join(showtimes.select("showtime_id"), "showtime_id", "left_semi")


def active_holds_by_seat_showtime(t: Tables, showtimes: DataFrame | None = None) -> DataFrame:
    """(showtime_id of the held seat, theater_id) -> seats held by active bookings; of ``showtimes`` only, if given."""
    active = t.booking.where(actively_held("status")).select("booking_id")
    return (_seats_of(t, showtimes).select("booking_id", "showtime_id", "theater_id", "seat_number")
            .join(active, "booking_id", "left_semi")
            .groupBy("showtime_id", "theater_id")
            .agg(F.collect_set(F.lower("seat_number")).alias("held")))


def any_holds(t: Tables, showtimes: DataFrame | None = None) -> DataFrame:
    """showtime_id -> every seat with a Booking_Seat row, whatever the booking status; of ``showtimes`` only, if given."""
    return (_seats_of(t, showtimes).groupBy("showtime_id")
            .agg(F.collect_set(F.lower("seat_number")).alias("held")))


def free_seat_lists(t: Tables, showtimes: DataFrame, some: bool = False) -> DataFrame:
    """showtime columns + ``free``: the theater's seats with no active hold, sorted.

    ``some``: the showtimes are filtered, so holds of the others are left out early.
    """
    held = active_holds_by_booking_showtime(t, showtimes if some else None)
    return (showtimes.join(held, ["showtime_id", "theater_id"], "left")
            .join(theater_seat_lists(t), "theater_id")
            .withColumn("free", without(F.col("seats"), F.col("held")))
            .drop("seats", "held"))


# ---- views --------------------------------------------------------------------

def booking_totals(t: Tables) -> DataFrame:
    """R1 Booking_Detail: user_id, booking_id, total_price (seats x price), status.

    Bookings without held seats drop out (inner join), as in the view.
    """
    seats = t.booking_seat.groupBy("booking_id").agg(F.count("seat_number").alias("n"))
    return (t.booking.join(seats, "booking_id")
            .join(t.users.select("user_id"), "user_id", "left_semi")
            .join(t.showtime.select("showtime_id", "price"), "showtime_id")
            .select("user_id", "booking_id", seat_total("n", "price").alias("total_price"),
                    "status"))


def confirmed_bookings(t: Tables) -> DataFrame:
    """R2 Confirmed_Booking: every Booking column, status Confirmed."""
    return t.booking.where(F.col("status") == "Confirmed")


def available_seats(t: Tables, showtime_id: int | DataFrame | None = None) -> DataFrame:
    """R9 Available_Seats: seats of the showtime's theater with no active hold.

    A hold counts when its booking is Pending or Confirmed and the booking's
    showtime is this showtime; Cancelled and Used bookings free the seat.
    """
    st = keyed(t.showtime.select("showtime_id", "theater_id"), "showtime_id", showtime_id)
    return (free_seat_lists(t, st, showtime_id is not None)
            .select(F.explode("free").alias("seat_number"), "theater_id", "showtime_id"))


def bookable_seats(t: Tables, showtime_id: int | DataFrame | None = None) -> DataFrame:
    """Seats a new booking may take: no Booking_Seat row at all for the showtime."""
    st = keyed(t.showtime.select("showtime_id", "theater_id"), "showtime_id", showtime_id)
    return (st.join(any_holds(t, None if showtime_id is None else st), "showtime_id", "left")
            .join(theater_seat_lists(t), "theater_id")
            .select(F.explode(without(F.col("seats"), F.col("held"))).alias("seat_number"),
                    "theater_id", "showtime_id"))


def showtime_free_lists(t: Tables, keep: list[Column] | None = None) -> DataFrame:
    """Showtime_Detail before the explode: one row per showtime with free seats, of those that pass ``keep``."""
    st = (t.showtime.join(t.movie.select("movie_id", "title"), "movie_id")
          .join(t.theater.select("theater_id", "theater_name"), "theater_id"))
    return (free_seat_lists(t, st.where(all_of(keep or [])), bool(keep))
            .where(F.size("free") > 0)
            .select("showtime_id", "title", "theater_name", "show_date", "price", "free"))


def showtime_detail(t: Tables) -> DataFrame:
    """R11 Showtime_Detail: showtime, title, theater, date, price, one free seat per row."""
    return (showtime_free_lists(t)
            .select("showtime_id", "title", "theater_name", "show_date", "price",
                    F.explode("free").alias("seat_number")))


def register_views(spark: SparkSession, t: Tables) -> None:
    """The tables and the four views as temp views for SQL users."""
    for name, df in t.items():
        df.createOrReplaceTempView(name)
    booking_totals(t).createOrReplaceTempView("booking_detail")
    available_seats(t).createOrReplaceTempView("available_seats")
    showtime_detail(t).createOrReplaceTempView("showtime_detail")
    confirmed_bookings(t).createOrReplaceTempView("confirmed_booking")
