"""Hand-derived results on the invented seed rows (conftest.SEED)."""

from conftest import d, rows

from seatspark.operators.audit import violations_only
from seatspark.plans import reports as R
from seatspark.plans import views as V


def test_booking_totals(seed):
    got = rows(V.booking_totals(seed), "booking_id", "user_id", "total_price", "status")
    assert got == [(201, 1, d(200), "Confirmed"), (202, 2, d(100), "Pending"),
                   (203, 3, d(100), "Cancelled"), (204, 1, d(80), "Used"),
                   (205, 2, d(120), "Pending"), (206, 3, d(50), "Confirmed")]  # 207: no seats


def test_confirmed_bookings(seed):
    assert rows(V.confirmed_bookings(seed), "booking_id") == [(201,), (206,)]


def test_available_seats_cancelled_and_used_free_the_seat(seed):
    got = rows(V.available_seats(seed), "showtime_id", "seat_number")
    assert got == [(11, "3"),                                   # 203 Cancelled frees 3
                   (12, "1"), (12, "2"), (12, "A"),             # 204 Used frees 1
                   (13, "10"), (13, "2"), (13, "3"),
                   (15, "1"), (15, "2"), (15, "A")]             # 14 sold out
    assert rows(V.available_seats(seed, 12), "seat_number") == [("1",), ("2",), ("A",)]


def test_bookable_seats_any_row_blocks(seed):
    got = rows(V.bookable_seats(seed), "showtime_id", "seat_number")
    assert got == [(12, "2"), (12, "A"), (13, "10"), (13, "2"), (13, "3"),
                   (15, "1"), (15, "2"), (15, "A")]


def test_search_showtimes_sorted_seat_text_and_sold_out_gone(seed):
    got = rows(R.search_showtimes(seed), "showtime_id", "seats")
    assert got == [(11, "3"), (12, "1, 2, A"), (13, "10, 2, 3"), (15, "1, 2, A")]
    assert rows(R.search_showtimes(seed, title="owl r"), "showtime_id") == [(13,), (15,)]
    assert rows(R.search_showtimes(seed, theater="birch", show_date="2026-05-04"),
                "showtime_id") == [(15,)]
    assert rows(R.seats_by_title(seed, "night_owl"), "showtime_id") == [(11,), (12,)]


def test_seat_layout(seed):
    got = rows(R.seat_layout(seed, 11), "seat_number", "status")
    assert got == [("1", "Booked"), ("10", "Booked"), ("2", "Booked"), ("3", "Available")]


def test_revenue(seed):
    assert rows(R.revenue_by_movie(seed), "movie_id", "total_revenue") == [(501, d(280)), (503, d(50))]
    assert rows(R.top_movies(seed, 1), "movie_id") == [(501,)]
    assert rows(R.revenue_all_statuses(seed), "movie_id", "total_revenue") == [
        (501, d(480)), (503, d(100))]


def test_booking_history(seed):
    got = rows(R.booking_history(seed), "booking_id", "status", "payment_status", "total_amount")
    assert got == [(201, "Confirmed", "Confirmed", d(200)), (202, "Pending", "Pending", d(100)),
                   (203, "Cancelled", "Refunded", d(100)), (204, "Used", "Confirmed", d(80)),
                   (205, "Pending", "NoPayment", d(120)),
                   (206, "Confirmed", "Confirmed", d(50)), (206, "Confirmed", "Pending", d(50))]
    newest_first = [r["booking_id"] for r in R.booking_history(seed, user_id=1).collect()]
    assert newest_first == [204, 201]


def test_pending_summary_keeps_zero_rows(seed):
    got = rows(R.pending_summary(seed), "user_id", "total_bookings", "total_pending")
    assert got == [(1, 0, d(0)), (2, 2, d(220)), (3, 0, d(0)), (6, 0, d(0))]


def test_customers_without_booking(seed):
    assert rows(R.customers_without_booking(seed)) == [(6, "Fay")]


def test_search_movies_wildcards_and_case(seed):
    assert rows(R.search_movies(seed, title="night_owl"), "movie_id") == [(501,), (502,)]
    assert rows(R.search_movies(seed, genre="DRAMA"), "movie_id") == [(501,)]
    assert rows(R.search_movies(seed, producer="bo"), "movie_id") == [(502,)]
    assert rows(R.search_movies(seed), "movie_id") == [(501,), (502,), (503,)]


def test_genres_text_order_is_case_insensitive(seed):
    assert rows(R.genres_by_movie(seed), "movie_id", "genres") == [(501, "action, Drama"),
                                                                   (502, "Comedy")]
    detail = {r["movie_id"]: r for r in R.movie_detail(seed).collect()}
    assert detail[501]["genres"] == ["action", "Drama"]
    assert detail[503]["genres"] == [] and detail[503]["producer"] is None


def test_pay_quote_counts_zero_seats(seed):
    got = rows(R.pay_quote(seed, 207), "booking_id", "seat_count", "amount", "payment_id")
    assert got == [(207, 0, d(0), None)]
    assert len(rows(R.pay_quote(seed, 206))) == 2   # one row per payment


def test_visibility(seed):
    mine = rows(R.booking_detail(seed, caller_id=2, role="customer"), "booking_id")
    assert mine == [(202,), (205,)]
    assert len(rows(R.booking_detail(seed, caller_id=4, role="staff"))) == 7
    assert rows(R.payment_record(seed, 206, caller_id=1, role="customer")) == []


def test_booking_flags(seed):
    got = {r["booking_id"]: (r["payable"], r["checkin_allowed"])
           for r in R.booking_flags(seed).where("booking_id IN (203, 205, 201)").collect()}
    assert got == {201: (False, True), 203: (False, False), 205: (True, False)}


def test_held_totals_by_seat_showtime(seed):
    assert rows(R.held_totals(seed, 201)) == [(201, 11, d(200))]


def test_audit_finds_the_seeded_problems(seed):
    got = rows(violations_only(seed), "rule", "table_name", "columns", "violations")
    assert got == [("foreign_key", "movie", "owner_id", 1),
                   ("one_payment_per_booking", "payment", "booking_id", 1)]


def test_showtime_cards(seed):
    got = rows(R.showtime_cards(seed), "showtime_id", "date_text", "seats_text", "can_book")
    assert got == [(11, "5/1/2026", "3", True), (12, "5/2/2026", "1, 2, A", True),
                   (13, "5/2/2026", "10, 2, 3", True), (15, "5/4/2026", "1, 2, A", True)]


def test_register_views_for_sql_users(spark, seed):
    V.register_views(spark, seed)
    assert spark.sql("SELECT count(*) AS n FROM available_seats").first()["n"] == 10
    assert spark.sql("SELECT booking_id FROM confirmed_booking ORDER BY 1").collect()[0][0] == 201
    got = spark.sql("SELECT user_id, sum(total_price) AS s FROM booking_detail "
                    "WHERE status = 'Pending' GROUP BY user_id").collect()
    assert [(r[0], r[1]) for r in got] == [(2, d(220))]


def test_read_requests_permissive(spark, seed, tmp_path):
    from seatspark.operators.admit import admit_bookings
    from seatspark.sources.requests import read_requests
    path = tmp_path / "req.json"
    path.write_text('{"request_id": 1, "user_id": 6, "showtime_id": 15, "seats": ["2"]}\n'
                    '{"request_id": 2, "user_id": 6, "showtime_id": 15, "seats": "oops"}\n')
    req = read_requests(spark, str(path))
    _, out = admit_bookings(seed, req)
    got = rows(out, "request_id", "outcome")
    assert got[0] == (1, "accepted") and got[1][1] == "missing_fields"


def test_a_customer_without_an_id_sees_nothing(seed):
    assert rows(R.booking_detail(seed, role="customer")) == []


def test_held_seats_match_without_case(spark, seed):
    held = spark.createDataFrame([(207, "a", 8, 15)], seed.booking_seat.schema)
    t = seed.with_(booking_seat=held)
    assert "A" not in {r["seat_number"] for r in V.available_seats(t, 15).collect()}
    assert "A" not in {r["seat_number"] for r in V.bookable_seats(t, 15).collect()}
    booked = {r["seat_number"]: r["status"] for r in R.seat_layout(t, 15).collect()}
    assert booked["A"] == "Booked"
