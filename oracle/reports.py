"""DuckDB oracle text for the read reports, from the survey's definitions.

Totals come from per-booking seat counts, revenue from per-booking sums, free
seats from a set difference of (showtime, seat) slots and holds, history from
parts that are grouped beforehand. Bodies run after the bridge CTEs. Money is
DECIMAL(18,2); texts order by lower(x), x; seats match without regard to case.
"""

from .bridge import with_bridge

COUNTS = """
seats_of AS (SELECT booking_id, count(seat_number) AS n FROM booking_seat GROUP BY booking_id),
shows AS (
  SELECT showtime_id, movie_id, theater_id, show_date, price,
         (SELECT any_value(title) FROM movie WHERE movie.movie_id = showtime.movie_id) AS title,
         (SELECT any_value(theater_name) FROM theater WHERE theater.theater_id = showtime.theater_id)
           AS theater_name
  FROM showtime)
"""

TOTALS = COUNTS + """,
totals AS (
  SELECT user_id, booking_id, CAST(n * price AS DECIMAL(18,2)) AS total_price, status
  FROM seats_of JOIN booking USING (booking_id) JOIN showtime USING (showtime_id)
  WHERE user_id IN (FROM users SELECT user_id))
"""

FREE = COUNTS + """,
slots AS (SELECT showtime_id, theater_id, lower(seat_number) AS k FROM seat JOIN showtime USING (theater_id)),
blocking AS (FROM booking SELECT booking_id, showtime_id WHERE status = 'Pending' OR status = 'Confirmed'),
open_slots AS (
  FROM slots EXCEPT
  SELECT blocking.showtime_id, theater_id, lower(seat_number) FROM booking_seat JOIN blocking USING (booking_id)),
free AS (
  SELECT seat_number, theater_id, showtime_id
  FROM seat JOIN open_slots USING (theater_id) WHERE lower(seat_number) = k),
free_text AS (
  SELECT showtime_id, string_agg(seat_number, ', ' ORDER BY lower(seat_number), seat_number) AS seats
  FROM free GROUP BY showtime_id),
cards AS (
  SELECT showtime_id, title, theater_name, show_date, price, seats
  FROM free_text JOIN shows USING (showtime_id) WHERE title IS NOT NULL AND theater_name IS NOT NULL)
"""

REVENUE = """
paid AS (FROM payment SELECT booking_id, sum(amount) AS got {filter} GROUP BY booking_id),
earned AS (
  SELECT movie_id, CAST(sum(got) AS DECIMAL(18,2)) AS total_revenue
  FROM showtime JOIN (FROM booking JOIN paid USING (booking_id)) USING (showtime_id) GROUP BY movie_id),
revenue AS (SELECT movie_id, title, total_revenue FROM movie JOIN earned USING (movie_id))
"""
CONFIRMED_REVENUE = REVENUE.format(filter="WHERE status = 'Confirmed'")

HISTORY = COUNTS + """,
history AS (
  SELECT user_id, booking_id, title, theater_name, show_date, price, bk.status,
         ifnull(pay.status, 'NoPayment') AS payment_status,
         CAST(CASE WHEN pay.amount IS NULL THEN n * price ELSE pay.amount END AS DECIMAL(18,2)) AS total_amount
  FROM seats_of JOIN booking bk USING (booking_id) JOIN shows USING (showtime_id)
  LEFT JOIN (SELECT DISTINCT booking_id, status, amount FROM payment) pay USING (booking_id)
  WHERE title IS NOT NULL AND theater_name IS NOT NULL)
"""

FILMS = """
films AS (
  SELECT movie_id, title, duration,
         (SELECT any_value(owner_name) FROM producer WHERE producer.owner_id = movie.owner_id) AS producer
  FROM movie)
"""
GENRES = """
genre_lists AS (
  SELECT movie_id, [g.b FOR g IN list_sort(list({'a': lower(genre), 'b': genre}))] AS genres
  FROM movie_genre GROUP BY movie_id)
"""


def _seen(columns: str, keep: str = "TRUE") -> str:
    """Bookings with their showtime's title and theater."""
    return f"""
        SELECT {columns} FROM booking JOIN shows USING (showtime_id)
        WHERE title IS NOT NULL AND {keep}"""


_BODIES: dict[str, tuple[str, str]] = {
    "showtime_cards": ("""
        SELECT showtime_id, title, theater_name, price, strftime(show_date, '%-m/%-d/%Y') AS date_text,
               if(trim(ifnull(seats, '')) = '', 'FULL', seats) AS seats_text,
               trim(ifnull(seats, '')) <> '' AS can_book
        FROM cards""", FREE),
    "booking_totals": ("FROM totals", TOTALS),
    "confirmed_bookings": ("FROM booking WHERE status = 'Confirmed'", ""),
    "movie_list": ("FROM movie SELECT movie_id, title", ""),
    "theater_list": ("FROM theater SELECT theater_id, theater_name", ""),
    "user_list": ("FROM users SELECT user_id, name, email, role", ""),
    "movie_detail": ("""
        SELECT movie_id, movie.owner_id, movie.title, movie.duration, description, poster_url, rating,
               films.producer, ifnull(genres, CAST([] AS VARCHAR[])) AS genres
        FROM movie JOIN films USING (movie_id) LEFT JOIN genre_lists USING (movie_id)""", FILMS + "," + GENRES),
    "genres_by_movie": ("""
        SELECT movie_id, title, array_to_string(genres, ', ') AS genres
        FROM genre_lists JOIN movie USING (movie_id)""", GENRES),
    "genre_list": ("FROM genre_lists", GENRES),
    "search_movies": ("FROM films WHERE contains(lower(title), 'red')", FILMS),
    "search_movies_filtered": ("""
        FROM films WHERE title ILIKE '%o_%' AND contains(lower(producer), '#00000001')
          AND movie_id IN (FROM movie_genre SELECT movie_id WHERE contains(lower(genre), 'brand#1'))""", FILMS),
    "revenue_by_movie": ("FROM revenue", CONFIRMED_REVENUE),
    "top_movies": ("FROM revenue ORDER BY total_revenue DESC, movie_id LIMIT 1", CONFIRMED_REVENUE),
    "revenue_all_statuses": ("FROM revenue", REVENUE.format(filter="")),
    "available_seats": ("FROM free", FREE),
    "bookable_seats": ("""
        SELECT seat_number, theater_id, showtime_id
        FROM seat JOIN (
          FROM slots SELECT showtime_id, theater_id, k
          WHERE (showtime_id, k) NOT IN (FROM booking_seat SELECT (showtime_id, lower(seat_number))
                                         WHERE showtime_id IS NOT NULL AND seat_number IS NOT NULL))
          USING (theater_id) WHERE lower(seat_number) = k""", FREE),
    "showtime_detail": ("""
        SELECT showtime_id, title, theater_name, show_date, price, seat_number
        FROM free JOIN shows USING (showtime_id) WHERE title IS NOT NULL AND theater_name IS NOT NULL""", FREE),
    "search_showtimes": ("FROM cards", FREE),
    "search_showtimes_filtered": ("""
        FROM cards WHERE contains(lower(title), 'plate') AND theater_name ILIKE '%nation_1%'
          AND date_trunc('day', show_date) = TIMESTAMP '2026-01-15'""", FREE),
    "seats_by_title": ("FROM cards WHERE lower(title) = 'red plate'", FREE),
    "seat_layout": ("""
        SELECT showtime_id, seat_number, if(held.k IS NULL, 'Available', 'Booked') AS status
        FROM (SELECT showtime_id, theater_id, seat_number, lower(seat_number) AS k
              FROM seat JOIN showtime USING (theater_id))
        LEFT JOIN (SELECT DISTINCT showtime_id, theater_id, lower(seat_number) AS k FROM booking_seat
                   WHERE booking_id IN (FROM blocking SELECT booking_id)) held
          USING (showtime_id, theater_id, k)""", FREE),
    "showtime_by_id": ("FROM showtime", ""),
    "booking_history": ("FROM history", HISTORY),
    "booking_flags": ("""
        SELECT booking_id, status, payment_status,
               NOT (payment_status = 'Confirmed' OR status = 'Cancelled') AS payable,
               status = 'Confirmed' AS checkin_allowed
        FROM history""", HISTORY),
    "pending_summary": ("""
        SELECT user_id, ifnull(n, 0) AS total_bookings, CAST(ifnull(s, 0) AS DECIMAL(18,2)) AS total_pending
        FROM users LEFT JOIN (FROM totals SELECT user_id, count(*) AS n, sum(total_price) AS s
                              WHERE status = 'Pending' GROUP BY user_id) USING (user_id)
        WHERE role = 'customer'""", TOTALS),
    "view_pending_totals": ("""
        SELECT user_id, count(*) AS n_bookings, CAST(sum(total_price) AS DECIMAL(18,2)) AS pending
        FROM totals WHERE status = 'Pending' GROUP BY user_id""", TOTALS),
    "booking_detail": (_seen("booking_id, user_id, showtime_id, status, booking_date, title, theater_name, "
                             "show_date, price", "theater_name IS NOT NULL"), COUNTS),
    "bookings": ("FROM booking", ""),
    "payment_record": ("FROM payment WHERE booking_id IN (FROM booking SELECT booking_id)", ""),
    "pay_quote": ("""
        SELECT booking_id, user_id, bk.status, ifnull(n, 0) AS seat_count, price, payment_id,
               pay.status AS payment_status, CAST(ifnull(n, 0) * price AS DECIMAL(18,2)) AS amount
        FROM booking bk JOIN showtime USING (showtime_id) LEFT JOIN seats_of USING (booking_id)
        LEFT JOIN payment pay USING (booking_id)""", COUNTS),
    "staff_bookings": ("""
        SELECT booking_id, user_id, name AS user_name, title, theater_name, show_date, status
        FROM users JOIN (""" + _seen("*", "theater_name IS NOT NULL") + ") USING (user_id)", COUNTS),
    "staff_check": ("SELECT booking_id, name, title, show_date, status FROM users JOIN (" + _seen("*")
                    + ") USING (user_id)", COUNTS),
    "user_bookings": (_seen("user_id, booking_id, title, theater_name, show_date, price",
                            "theater_name IS NOT NULL"), COUNTS),
    "customers_without_booking": ("""
        SELECT user_id, name FROM users WHERE role = 'customer'
          AND user_id NOT IN (FROM booking SELECT user_id WHERE user_id IS NOT NULL)""", ""),
    "user_profile": ("FROM users SELECT user_id, name, email, role", ""),
    "held_totals": ("""
        SELECT booking_id, showtime_id, CAST(n * price AS DECIMAL(18,2)) AS total_price
        FROM (FROM booking_seat SELECT booking_id, showtime_id, count(seat_number) AS n GROUP BY ALL)
        JOIN showtime USING (showtime_id)""", ""),
}


#: Key tables of the lookups, and the caller of the reports that hide other customers' rows.
_USERS = "user_id IN (FROM events SELECT user_id WHERE event_type = 'error')"
_BOOKINGS = "booking_id IN (FROM orders SELECT o_orderkey WHERE o_orderpriority = '1-URGENT')"
_SHOWS = "showtime_id IN (FROM part SELECT 2 * p_partkey + 1 WHERE p_size > 45)"
_CALLER = "user_id = 4"

for _name, _of, _keep in (("bookings_of_users", "bookings", _USERS), ("booking_detail_of_keys", "booking_detail", _BOOKINGS),
                          ("pay_quote_of_keys", "pay_quote", _BOOKINGS), ("booking_history_of_users", "booking_history", _USERS),
                          ("bookable_seats_of_keys", "bookable_seats", _SHOWS), ("seat_layout_of_keys", "seat_layout", _SHOWS),
                          ("booking_detail_of_caller", "booking_detail", f"{_BOOKINGS} AND {_CALLER}"),
                          ("payments_of_staff", "payment_record", "TRUE"), ("profile_of_caller", "user_profile", _CALLER),
                          ("payments_of_caller", "payment_record", f"booking_id IN (FROM booking SELECT booking_id WHERE {_CALLER})")):
    _BODIES[_name] = (f"SELECT * FROM ({_BODIES[_of][0]}) WHERE {_keep}", _BODIES[_of][1])


def report_sql() -> dict[str, str]:
    return {name: with_bridge(body, extra) for name, (body, extra) in _BODIES.items()}
