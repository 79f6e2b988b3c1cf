"""Read reports over the booking tables.

A key argument the reference takes from the URL is optional here: without it
the report covers every key, which is the form run at scale; it may also be a
table of keys (:mod:`.lookups`). Aggregations are
pushed below joins by hand where the grouping key allows it (seat counts per
booking, revenue per showtime before the movie join), because Catalyst does
not move aggregates across joins itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import (all_of, as_total, contains_ci, customers_only, date_equals,
                                 display_date, empty_strings, equals_ci, joined, seat_total,
                                 seats_or_full, sorted_ci, visible_to)
from ..schemas import NO_PAYMENT, STAFF_ROLES
from ..sources.tables import Tables, existing
from .lookups import keyed
from .views import active_holds_by_seat_showtime, booking_totals, showtime_free_lists, theater_seat_lists


def _show_info(t: Tables) -> DataFrame:
    """showtime_id -> movie title, theater name, date, price (J1 dimension side)."""
    return (t.showtime.join(t.movie.select("movie_id", "title"), "movie_id")
            .join(t.theater.select("theater_id", "theater_name"), "theater_id")
            .select("showtime_id", "title", "theater_name", "show_date", "price"))


def _seat_counts(t: Tables, of: DataFrame | None = None) -> DataFrame:
    """Seats per booking; with ``of``, of its bookings only."""
    held = t.booking_seat
    if of is not None:
        held = held.join(of.select("booking_id"), "booking_id", "left_semi")
    return held.groupBy("booking_id").agg(F.count("seat_number").alias("seat_count"))


# ---- R3 lists -----------------------------------------------------------------

def movie_list(t: Tables) -> DataFrame:
    return t.movie.select("movie_id", "title")


def theater_list(t: Tables) -> DataFrame:
    return t.theater.select("theater_id", "theater_name")


def user_list(t: Tables) -> DataFrame:
    """Users without the password column."""
    return t.users.select("user_id", "name", "email", "role")


# ---- movies ---------------------------------------------------------------------

def genre_arrays(t: Tables) -> DataFrame:
    """movie_id -> genres sorted (case-insensitive); one row per movie with a genre."""
    return t.movie_genre.groupBy("movie_id").agg(sorted_ci(F.collect_list("genre")).alias("genres"))


def movie_detail(t: Tables, movie_id: int | DataFrame | None = None) -> DataFrame:
    """Movie columns that exist, producer name, genres array ([] when none)."""
    wanted = ["movie_id", "owner_id", "title", "duration"] + existing(
        t.movie, ["description", "poster_url", "rating"])
    m = keyed(t.movie, "movie_id", movie_id).select(*wanted)
    return (m.join(t.producer.select("owner_id", F.col("owner_name").alias("producer")),
                   "owner_id", "left")
            .join(genre_arrays(t), "movie_id", "left")
            .select(*wanted, "producer",
                    F.coalesce(F.col("genres"), empty_strings()).alias("genres")))


def genres_by_movie(t: Tables) -> DataFrame:
    """movie_id, title, genres as 'a, b' in text order; movies with a genre only."""
    g = t.movie_genre.groupBy("movie_id").agg(
        joined(sorted_ci(F.collect_list("genre"))).alias("genres"))
    return t.movie.select("movie_id", "title").join(g, "movie_id")


def genre_list(t: Tables, movie_id: int | DataFrame | None = None) -> DataFrame:
    """movie_id, genres array."""
    return keyed(genre_arrays(t), "movie_id", movie_id)


def search_movies(t: Tables, title: str | None = None, genre: str | None = None,
                  producer: str | None = None) -> DataFrame:
    """Movies matching every given contains-filter; distinct, by title.

    The genre join of the reference only multiplies rows that DISTINCT then
    removes, so it becomes an EXISTS (left semi join) and is skipped when no
    genre filter is given.
    """
    m = t.movie.select("movie_id", "title", "duration", "owner_id")
    if title:
        m = m.where(contains_ci("title", title))
    if genre:
        m = m.join(t.movie_genre.where(contains_ci("genre", genre)).select("movie_id"),
                   "movie_id", "left_semi")
    p = t.producer.select("owner_id", F.col("owner_name").alias("producer"))
    out = m.join(p, "owner_id", "left")
    if producer:
        out = out.where(contains_ci("producer", producer))
    return (out.select("movie_id", "title", "duration", "producer").distinct()
            .orderBy(F.lower("title"), "title", "movie_id"))


def _revenue(t: Tables, confirmed_only: bool, movie_id: int | DataFrame | None = None) -> DataFrame:
    shows = keyed(t.showtime.select("showtime_id", "movie_id"), "movie_id", movie_id)
    booked = t.booking.select("booking_id", "showtime_id")
    if movie_id is not None:
        booked = booked.join(shows.select("showtime_id"), "showtime_id", "left_semi")
    pay = t.payment.select("booking_id", "amount", "status")
    if confirmed_only:
        pay = pay.where(F.col("status") == "Confirmed")
    per_show = (pay.join(booked, "booking_id")
                .groupBy("showtime_id").agg(F.sum("amount").alias("amount")))
    per_movie = (per_show.join(shows, "showtime_id")
                 .groupBy("movie_id").agg(F.sum("amount").alias("total_revenue")))
    return (per_movie.join(t.movie.select("movie_id", "title"), "movie_id")
            .select("movie_id", "title", as_total("total_revenue").alias("total_revenue")))


def revenue_by_movie(t: Tables) -> DataFrame:
    """Confirmed payments summed per movie, highest first."""
    return _revenue(t, True).orderBy(F.desc("total_revenue"), "movie_id")


def top_movies(t: Tables, n: int = 1) -> DataFrame:
    """The n best-selling movies (ties broken by movie_id)."""
    return _revenue(t, True).orderBy(F.desc("total_revenue"), "movie_id").limit(n)


def revenue_all_statuses(t: Tables, movie_id: int | DataFrame | None = None) -> DataFrame:
    """Every payment status summed per movie."""
    return _revenue(t, False, movie_id)


# ---- showtimes --------------------------------------------------------------------

def search_showtimes(t: Tables, title: str | None = None, theater: str | None = None,
                     show_date: str | None = None) -> DataFrame:
    """Showtimes with free seats, the seats as one sorted string."""
    preds = []
    if title:
        preds.append(contains_ci("title", title))
    if theater:
        preds.append(contains_ci("theater_name", theater))
    if show_date:
        preds.append(date_equals("show_date", show_date))
    return (showtime_free_lists(t, preds)
            .select("showtime_id", "title", "theater_name", "show_date", "price",
                    joined(F.col("free")).alias("seats")))


def seats_by_title(t: Tables, title: str) -> DataFrame:
    """As R12 for one exact title (case-insensitive equality)."""
    return (showtime_free_lists(t, [equals_ci("title", title)])
            .select("showtime_id", "title", "theater_name", "show_date", "price",
                    joined(F.col("free")).alias("seats")))


def seat_layout(t: Tables, showtime_id: int | DataFrame | None = None) -> DataFrame:
    """Every seat of the showtime's theater, Booked or Available, by showtime and seat text.

    Rows come out in order: showtimes are range-partitioned and sorted while
    they are one row each, and their seat lists are sorted already, so the seat
    rows that the explode makes need no sort of their own.
    """
    st = keyed(t.showtime.select("showtime_id", "theater_id"), "showtime_id", showtime_id)
    held = active_holds_by_seat_showtime(t, None if showtime_id is None else st)
    rows = (st.join(held, ["showtime_id", "theater_id"], "left")
            .join(theater_seat_lists(t), "theater_id")
            .select("showtime_id", F.coalesce("held", empty_strings()).alias("held"), "seats"))
    out = (rows.repartitionByRange("showtime_id").sortWithinPartitions("showtime_id")
           .select("showtime_id", "held", F.explode("seats").alias("seat_number")))
    return out.select(
        "showtime_id", "seat_number",
        F.when(F.array_contains("held", F.lower("seat_number")), "Booked")
         .otherwise("Available").alias("status"))


def showtime_by_id(t: Tables, showtime_id: int | DataFrame | None = None) -> DataFrame:
    """Every Showtime column."""
    return keyed(t.showtime, "showtime_id", showtime_id)


# ---- bookings -------------------------------------------------------------------------

def _history(t: Tables, user_id: int | DataFrame | None = None) -> DataFrame:
    b = keyed(t.booking.select("booking_id", "user_id", "showtime_id", "status"), "user_id", user_id)
    some = None if user_id is None else b
    pay = t.payment if some is None else t.payment.join(b.select("booking_id"), "booking_id", "left_semi")
    pay = pay.select("booking_id", F.col("status").alias("p_status"), "amount").distinct()
    # both booking_id joins first, while rows are partitioned by booking_id
    rows = (b.join(_seat_counts(t, some), "booking_id")
            .join(pay, "booking_id", "left")
            .join(_show_info(t), "showtime_id"))
    return (rows.select(
        "user_id", "booking_id", "title", "theater_name", "show_date", "price", "status",
        F.coalesce("p_status", F.lit(NO_PAYMENT)).alias("payment_status"),
        F.coalesce(as_total("amount"), seat_total("seat_count", "price")).alias("total_amount")))


def booking_history(t: Tables, user_id: int | DataFrame | None = None) -> DataFrame:
    """Bookings with seats, their payment ('NoPayment' when none), newest show first.

    One row per (booking, distinct payment status and amount), as the
    reference's GROUP BY gives; total is the payment amount, else seats x price.
    """
    return _history(t, user_id).orderBy(F.desc("show_date"), "booking_id")


def pending_summary(t: Tables, user_id: int | DataFrame | None = None) -> DataFrame:
    """Per customer, Pending bookings (with seats) and their total; zeros kept."""
    mine = t.with_(booking=keyed(t.booking, "user_id", user_id).where(F.col("status") == "Pending"))
    if user_id is not None:
        mine = mine.with_(booking_seat=t.booking_seat.join(mine.booking.select("booking_id"), "booking_id", "left_semi"))
    pend = (booking_totals(mine)
            .groupBy("user_id")
            .agg(F.count("booking_id").alias("total_bookings"),
                 F.sum("total_price").alias("total_pending")))
    u = keyed(customers_only(t.users.select("user_id", "role")), "user_id", user_id)
    return (u.join(pend, "user_id", "left")
            .select("user_id",
                    F.coalesce("total_bookings", F.lit(0)).cast("long").alias("total_bookings"),
                    as_total(F.coalesce("total_pending", F.lit(0))).alias("total_pending")))


def booking_detail(t: Tables, booking_id: int | DataFrame | None = None, caller_id: int | None = None,
                   role: str | None = None) -> DataFrame:
    """A booking with its showtime, movie and theater."""
    b = keyed(t.booking, "booking_id", booking_id)
    out = (b.join(_show_info(t), "showtime_id")
           .select("booking_id", "user_id", "showtime_id", "status", "booking_date",
                   "title", "theater_name", "show_date", "price"))
    return visible_to(out, caller_id, role)


def bookings(t: Tables, user_id: int | DataFrame | None = None) -> DataFrame:
    """Every Booking column (all bookings, or one user's)."""
    return keyed(t.booking, "user_id", user_id)


def payment_record(t: Tables, booking_id: int | DataFrame | None = None, caller_id: int | None = None,
                   role: str | None = None) -> DataFrame:
    """Payments of existing bookings; customers see only their own."""
    p = keyed(t.payment, "booking_id", booking_id)
    cols = ["payment_id", "booking_id", "amount", "status", "payment_date"]
    if role in STAFF_ROLES or (caller_id is None and role is None):
        return p.join(t.booking.select("booking_id"), "booking_id", "left_semi").select(*cols)
    owned = p.join(t.booking.select("booking_id", "user_id"), "booking_id")
    return visible_to(owned, caller_id, role).select(*cols)


def pay_quote(t: Tables, booking_id: int | DataFrame | None = None) -> DataFrame:
    """What paying would charge: seats (0 kept) x current price, per payment row."""
    b = keyed(t.booking.select("booking_id", "user_id", "status", "showtime_id"),
             "booking_id", booking_id)
    pay = t.payment.select("booking_id", "payment_id", F.col("status").alias("payment_status"))
    rows = (b.join(_seat_counts(t, None if booking_id is None else b), "booking_id", "left")
            .join(pay, "booking_id", "left")
            .join(t.showtime.select("showtime_id", "price"), "showtime_id"))
    n = F.coalesce("seat_count", F.lit(0)).cast("long")
    return rows.select("booking_id", "user_id", "status", n.alias("seat_count"), "price",
                       "payment_id", "payment_status", seat_total(n, "price").alias("amount"))


def staff_bookings(t: Tables) -> DataFrame:
    """Every booking with its user, movie, theater and date, newest show first."""
    return (t.booking.join(t.users.select("user_id", F.col("name").alias("user_name")), "user_id")
            .join(_show_info(t), "showtime_id")
            .select("booking_id", "user_id", "user_name", "title", "theater_name", "show_date",
                    "status")
            .orderBy(F.desc("show_date"), "booking_id"))


def staff_check(t: Tables, booking_id: int | DataFrame | None = None) -> DataFrame:
    """Booking, customer name, title, show date, status."""
    st = t.showtime.select("showtime_id", "movie_id", "show_date").join(
        t.movie.select("movie_id", "title"), "movie_id")
    return (keyed(t.booking, "booking_id", booking_id)
            .join(t.users.select("user_id", "name"), "user_id")
            .join(st, "showtime_id")
            .select("booking_id", "name", "title", "show_date", "status"))


def user_bookings(t: Tables, user_id: int | DataFrame | None = None) -> DataFrame:
    """A user's bookings with title, theater, date and price (user_id kept)."""
    return (keyed(t.booking.select("booking_id", "user_id", "showtime_id"), "user_id", user_id)
            .join(_show_info(t), "showtime_id")
            .select("user_id", "booking_id", "title", "theater_name", "show_date", "price"))


def customers_without_booking(t: Tables) -> DataFrame:
    """Customers with no booking at all (anti join)."""
    return (customers_only(t.users).join(t.booking.select("user_id"), "user_id", "left_anti")
            .select("user_id", "name"))


def user_profile(t: Tables, user_id: int | DataFrame | None = None, caller_id: int | None = None,
                 role: str | None = None) -> DataFrame:
    """user_id, name, email, role; customers see only themselves."""
    return visible_to(keyed(user_list(t), "user_id", user_id), caller_id, role)


def held_totals(t: Tables, booking_id: int | DataFrame | None = None) -> DataFrame:
    """Seats held x price of the held seat's showtime, per booking and showtime."""
    per = (keyed(t.booking_seat, "booking_id", booking_id)
           .groupBy("booking_id", "showtime_id").agg(F.count("seat_number").alias("n")))
    return (per.join(t.showtime.select("showtime_id", "price"), "showtime_id")
            .select("booking_id", "showtime_id", seat_total("n", "price").alias("total_price")))


def booking_flags(t: Tables, user_id: int | DataFrame | None = None) -> DataFrame:
    """UI flags on the history rows: can pay, can check in."""
    h = _history(t, user_id)
    return h.select(
        "booking_id", "status", "payment_status",
        ((F.col("payment_status") != "Confirmed") & (F.col("status") != "Cancelled"))
        .alias("payable"),
        (F.col("status") == "Confirmed").alias("checkin_allowed"))


def showtime_cards(t: Tables, title: str | None = None, theater: str | None = None,
                   show_date: str | None = None) -> DataFrame:
    """R12 as the UI shows it: date text, 'FULL' for an empty seat string, can-book flag."""
    s = search_showtimes(t, title, theater, show_date)
    has_seats = F.col("seats").isNotNull() & (F.trim("seats") != "")
    return s.select("showtime_id", "title", "theater_name", "price",
                    display_date("show_date").alias("date_text"),
                    seats_or_full(F.col("seats")).alias("seats_text"),
                    has_seats.alias("can_book"))
