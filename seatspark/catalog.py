"""Named queries over the bridge tables of a test-data folder.

Each entry takes (spark, sf_dir) and returns a DataFrame; the matching DuckDB
text lives in ``oracle/``. Parametric reports run with fixed search terms,
never with key subsets: every entry reads its whole tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .operators.audit import audit
from .plans import reports as R
from .plans import views as V
from . import scenarios as S
from .sources.bridge import bridge_tables
from .sources.tables import Tables

Query = Callable[[SparkSession, str], DataFrame]


TablesQuery = Callable[..., DataFrame]  # (spark, sf_dir, tables or None) -> DataFrame


def _on_tables(report: Callable[[Tables], DataFrame]) -> TablesQuery:
    def run(spark: SparkSession, sf_dir: str, t: Tables | None = None) -> DataFrame:
        return report(t if t is not None else bridge_tables(spark, sf_dir))
    run.__doc__ = report.__doc__
    return run


REPORTS: dict[str, Callable[[Tables], DataFrame]] = {
    "booking_totals": V.booking_totals,
    "confirmed_bookings": V.confirmed_bookings,
    "movie_list": R.movie_list,
    "theater_list": R.theater_list,
    "user_list": R.user_list,
    "movie_detail": R.movie_detail,
    "genres_by_movie": R.genres_by_movie,
    "genre_list": R.genre_list,
    "search_movies": lambda t: R.search_movies(t, title="red"),
    "search_movies_filtered": lambda t: R.search_movies(t, title="o_", genre="brand#1",
                                                        producer="#00000001"),
    "revenue_by_movie": R.revenue_by_movie,
    "available_seats": V.available_seats,
    "bookable_seats": V.bookable_seats,
    "showtime_detail": V.showtime_detail,
    "search_showtimes": R.search_showtimes,
    "search_showtimes_filtered": lambda t: R.search_showtimes(
        t, title="plate", theater="nation_1", show_date="2026-01-15"),
    "seats_by_title": lambda t: R.seats_by_title(t, "Red Plate"),
    "seat_layout": R.seat_layout,
    "showtime_by_id": R.showtime_by_id,
    "top_movies": lambda t: R.top_movies(t, 1),
    "revenue_all_statuses": R.revenue_all_statuses,
    "booking_history": R.booking_history,
    "pending_summary": R.pending_summary,
    "booking_detail": R.booking_detail,
    "bookings": R.bookings,
    "payment_record": R.payment_record,
    "pay_quote": R.pay_quote,
    "staff_bookings": R.staff_bookings,
    "staff_check": R.staff_check,
    "user_bookings": R.user_bookings,
    "customers_without_booking": R.customers_without_booking,
    "user_profile": R.user_profile,
    "held_totals": R.held_totals,
    "booking_flags": R.booking_flags,
    "showtime_cards": R.showtime_cards,
    "audit": audit,
}


CHANGES: dict[str, TablesQuery] = {
    "admit_bookings": S.admit_outcomes,
    "admit_bookings_booking": S.table_after(S.admission, "booking"),
    "admit_bookings_seats": S.table_after(S.admission, "booking_seat"),
    "apply_booking_events": S.event_outcomes,
    "events_booking_after": S.events_booking_after,
    "events_payment_after": S.events_payment_after,
    "insert_movies": S.outcomes_of(S.insert_movies),
    "insert_movies_table": S.table_after(S.insert_movies, "movie"),
    "insert_genres": S.outcomes_of(S.insert_genres),
    "insert_genres_table": S.table_after(S.insert_genres, "movie_genre"),
    "insert_theaters": S.outcomes_of(S.insert_theaters),
    "insert_theaters_table": S.table_after(S.insert_theaters, "theater"),
    "insert_showtimes": S.outcomes_of(S.insert_showtimes),
    "insert_showtimes_table": S.table_after(S.insert_showtimes, "showtime"),
    "register_users": S.outcomes_of(S.register_new_users),
    "register_users_table": S.table_after(S.register_new_users, "users"),
    "replace_showtimes": S.outcomes_of(S.replace_some_showtimes),
    "replace_showtimes_table": S.table_after(S.replace_some_showtimes, "showtime"),
    "patch_movies": S.outcomes_of(S.patch_some_movies),
    "patch_movies_table": S.table_after(S.patch_some_movies, "movie"),
    "delete_movies": S.outcomes_of(S.delete_some_movies),
    "delete_movies_sizes": S.sizes_after(S.delete_some_movies),
    "delete_movies_booking_seat": S.table_after(S.delete_some_movies, "booking_seat"),
    "delete_movies_payment": S.table_after(S.delete_some_movies, "payment"),
    "delete_showtimes": S.outcomes_of(S.delete_some_showtimes),
    "delete_showtimes_booking": S.table_after(S.delete_some_showtimes, "booking"),
    "delete_genres": S.outcomes_of(S.delete_some_genres),
    "delete_genres_table": S.table_after(S.delete_some_genres, "movie_genre"),
    "delete_producers": S.outcomes_of(S.delete_some_producers),
    "reassign_bookings": S.outcomes_of(S.move_some_bookings),
    "reassign_bookings_booking": S.table_after(S.move_some_bookings, "booking"),
    "reassign_bookings_seats": S.table_after(S.move_some_bookings, "booking_seat"),
    "reassign_bookings_payment": S.table_after(S.move_some_bookings, "payment"),
    "next_ids": S.new_payment_ids,
    "view_pending_totals": S.view_pending_totals,
    "audit_dirty": S.audit_dirty,
    "create_users": S.outcomes_of(S.create_users),
    "create_users_table": S.table_after(S.create_users, "users"),
    "admit_payloads": S.outcomes_of(S.payload_admission),
    "admit_payloads_booking": S.table_after(S.payload_admission, "booking"),
    "admit_lettered": S.outcomes_of(S.lettered_admission),
    "admit_lettered_seats": S.table_after(S.lettered_admission, "booking_seat"),
    "events_two_payments": S.table_after(S.two_payment_events, "payment"),
    "moves_two_payments": S.table_after(S.two_payment_moves, "payment"),
    "bookings_of_users": S.by_keys(R.bookings, S.error_users),
    "booking_detail_of_keys": S.by_keys(R.booking_detail, S.urgent_bookings),
    "pay_quote_of_keys": S.by_keys(R.pay_quote, S.urgent_bookings),
    "booking_history_of_users": S.by_keys(R.booking_history, S.error_users),
    "bookable_seats_of_keys": S.by_keys(V.bookable_seats, S.dear_showtimes),
    "seat_layout_of_keys": S.by_keys(R.seat_layout, S.dear_showtimes),
    "booking_detail_of_caller": lambda spark, sf_dir, t=None: S.by_keys(
        R.booking_detail, S.urgent_bookings, caller_id=4, role="customer")(spark, sf_dir, t),
    "payments_of_caller": _on_tables(lambda t: R.payment_record(t, caller_id=4, role="customer")),
    "payments_of_staff": _on_tables(lambda t: R.payment_record(t, caller_id=50, role="staff")),
    "profile_of_caller": _on_tables(lambda t: R.user_profile(t, caller_id=4, role="customer")),
}


def table_queries() -> dict[str, TablesQuery]:
    """Every query as (spark, sf_dir, tables): tables default to the bridge of sf_dir."""
    out: dict[str, TablesQuery] = {name: _on_tables(fn) for name, fn in REPORTS.items()}
    out.update(CHANGES)
    return out


def queries() -> dict[str, Query]:
    """Every query as (spark, sf_dir): booking tables derived from the test data."""
    return {name: (lambda fn: lambda spark, sf_dir: fn(spark, sf_dir, None))(fn)
            for name, fn in table_queries().items()}
