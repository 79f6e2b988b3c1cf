"""DuckDB text for inserts, replacements, patches and cascading deletes."""

from .bridge import with_bridge
from .changes import with_two_payments

BIG = 1000000000

MOVIE_INS = f"""
ins AS (
  SELECT CAST(p_partkey AS BIGINT) AS request_id,
         CAST(CASE WHEN p_partkey % 5 = 0 THEN p_partkey ELSE {BIG} + p_partkey // 2 END AS BIGINT) AS movie_id,
         CAST(p_partkey % ((SELECT count(*) FROM supplier) + 5) AS BIGINT) AS owner_id,
         p_name AS title,
         CAST(CASE WHEN p_size % 7 = 0 THEN 0 ELSE p_size + 60 END AS INTEGER) AS duration
  FROM part),
chk AS (
  SELECT i.*,
         CASE WHEN movie_id IS NULL OR movie_id = 0 OR owner_id IS NULL OR owner_id = 0
                   OR title IS NULL OR title = '' OR duration IS NULL OR duration = 0
                THEN 'missing_fields'
              WHEN length(title) > 100 THEN 'value_too_long'
              WHEN EXISTS (SELECT 1 FROM movie m WHERE m.movie_id = i.movie_id) THEN 'duplicate_key'
              WHEN NOT EXISTS (SELECT 1 FROM producer p WHERE p.owner_id = i.owner_id)
                THEN 'unknown_reference' END AS pre
  FROM ins i),
dec AS (
  SELECT *, COALESCE(pre, CASE WHEN request_id = min(request_id) FILTER (WHERE pre IS NULL)
                                   OVER (PARTITION BY movie_id)
                               THEN 'inserted' ELSE 'duplicate_key' END) AS outcome
  FROM chk)
"""

USER_REG = f"""
reg AS (
  SELECT CAST(c_custkey AS BIGINT) AS request_id,
         CAST(CASE WHEN c_custkey % 4 = 0 THEN c_custkey ELSE {BIG} + c_custkey // 3 END AS BIGINT) AS user_id,
         c_name AS name,
         CASE WHEN c_custkey % 6 = 1 THEN 'U' || CAST(c_custkey AS VARCHAR) || '@EXAMPLE.COM'
              WHEN c_custkey % 6 = 2 THEN 'shared' || CAST(c_custkey // 12 AS VARCHAR) || '@example.com'
              ELSE 'new' || CAST(c_custkey AS VARCHAR) || '@example.com' END AS email,
         CASE WHEN c_custkey % 11 = 0 THEN '' ELSE 'pw' END AS password,
         COALESCE(CASE WHEN c_custkey % 13 = 0 THEN 'staff' WHEN c_custkey % 13 = 1 THEN 'customer' END,
                  'customer') AS role
  FROM customer),
chk AS (
  SELECT r.*,
         CASE WHEN user_id IS NULL OR user_id = 0 OR name IS NULL OR name = '' OR email IS NULL
                   OR email = '' OR password IS NULL OR password = '' THEN 'missing_fields'
              WHEN role <> 'customer' THEN 'role_not_allowed'
              WHEN length(name) > 100 OR length(email) > 100 OR length(password) > 100
                   OR length(role) > 10 THEN 'value_too_long'
              WHEN EXISTS (SELECT 1 FROM users u WHERE u.user_id = r.user_id) THEN 'duplicate_key'
              WHEN EXISTS (SELECT 1 FROM users u WHERE lower(u.email) = lower(r.email))
                THEN 'duplicate_email' END AS pre,
         row_number() OVER (ORDER BY request_id) AS rn
  FROM reg r),
walk AS (
  SELECT CAST(0 AS BIGINT) AS rn, CAST([] AS BIGINT[]) AS ids, CAST([] AS VARCHAR[]) AS mails,
         CAST(NULL AS BIGINT) AS request_id, CAST(NULL AS VARCHAR) AS outcome
  UNION ALL
  SELECT c.rn,
         CASE WHEN x.outcome = 'inserted' THEN list_append(w.ids, c.user_id) ELSE w.ids END,
         CASE WHEN x.outcome = 'inserted' THEN list_append(w.mails, lower(c.email)) ELSE w.mails END,
         c.request_id, x.outcome
  FROM walk w JOIN chk c ON c.rn = w.rn + 1,
  LATERAL (SELECT COALESCE(c.pre,
                  CASE WHEN list_contains(w.ids, c.user_id) THEN 'duplicate_key'
                       WHEN list_contains(w.mails, lower(c.email)) THEN 'duplicate_email'
                       ELSE 'inserted' END) AS outcome) x)
"""

_WALK = USER_REG[USER_REG.index("walk AS ("):]

USER_CREATE = f"""
raw AS (
  SELECT TRY_CAST(CASE WHEN c_custkey % 331 = 0 THEN 'none' WHEN c_custkey % 337 = 0 THEN NULL
                       WHEN c_custkey % 341 = 0 THEN CAST(c_custkey - 1 AS VARCHAR)
                       ELSE CAST(c_custkey AS VARCHAR) END AS BIGINT) AS request_id,
         TRY_CAST(CASE WHEN c_custkey % 343 = 0 THEN 'x' ELSE CAST({BIG} + c_custkey // 2 AS VARCHAR) END AS BIGINT) AS user_id,
         c_name AS name,
         CASE WHEN c_custkey % 4 < 2 THEN 'L' ELSE 'l' END || 'ink' || CAST((c_custkey + 1) // 2 AS VARCHAR) || '@example.com' AS email,
         'pw' AS password,
         CASE WHEN c_custkey % 347 = 0 THEN '' WHEN c_custkey % 3 = 0 THEN 'staff' WHEN c_custkey % 3 = 1 THEN 'admin'
              ELSE 'customer' END AS role
  FROM customer),
counted AS (SELECT *, count(*) OVER (PARTITION BY request_id) AS n_same FROM raw),
refused AS (
  SELECT request_id, CASE WHEN request_id IS NULL THEN 'missing_fields' ELSE 'duplicate_request' END AS outcome
  FROM counted WHERE request_id IS NULL OR n_same > 1),
reg AS (FROM counted WHERE request_id IS NOT NULL AND n_same = 1),
chk AS (
  SELECT r.*,
         CASE WHEN user_id IS NULL OR user_id = 0 OR name = '' OR email = '' OR password = '' OR role = '' THEN 'missing_fields'
              WHEN length(name) > 100 OR length(email) > 100 OR length(role) > 10 THEN 'value_too_long'
              WHEN user_id IN (FROM users SELECT user_id) THEN 'duplicate_key'
              WHEN lower(email) IN (FROM users SELECT lower(email)) THEN 'duplicate_email' END AS pre,
         row_number() OVER (ORDER BY request_id) AS rn
  FROM reg r),
""" + _WALK

SHOW_REP = f"""
rep AS (
  SELECT CAST(p.p_partkey * 2 + k AS BIGINT) AS request_id,
         CAST(CASE WHEN p.p_partkey % 4 = 3 THEN p.p_partkey * 2 + {BIG} ELSE p.p_partkey * 2 END AS BIGINT) AS showtime_id,
         CAST((p.p_partkey * 7 + k) % ((SELECT count(*) FROM part) + 3) AS BIGINT) AS movie_id,
         CAST((p.p_partkey + k) % 27 AS BIGINT) AS theater_id,
         TIMESTAMP '2026-03-01 18:00:00' + to_days(CAST(p.p_partkey % 30 AS INTEGER))
           + to_hours(CAST(k AS INTEGER)) AS show_date,
         CAST(CASE WHEN p.p_partkey % 10 = 9 THEN 0 ELSE p.p_retailprice + k END AS DECIMAL(10,2)) AS price
  FROM part p, (SELECT unnest([0, 1]) AS k) ks),
dec AS (
  SELECT r.*,
         CASE WHEN movie_id IS NULL OR movie_id = 0 OR theater_id IS NULL OR theater_id = 0
                   OR show_date IS NULL OR price IS NULL OR price = 0 THEN 'missing_fields'
              WHEN NOT EXISTS (SELECT 1 FROM showtime s WHERE s.showtime_id = r.showtime_id) THEN 'not_found'
              WHEN NOT EXISTS (SELECT 1 FROM movie m WHERE m.movie_id = r.movie_id)
                   OR NOT EXISTS (SELECT 1 FROM theater t WHERE t.theater_id = r.theater_id)
                THEN 'unknown_reference'
              ELSE 'updated' END AS outcome
  FROM rep r),
last_upd AS (
  SELECT showtime_id, arg_max(movie_id, request_id) AS movie_id,
         arg_max(theater_id, request_id) AS theater_id, arg_max(show_date, request_id) AS show_date,
         arg_max(price, request_id) AS price
  FROM dec WHERE outcome = 'updated' GROUP BY showtime_id)
"""

MOVIE_PATCH = f"""
pat AS (
  SELECT CAST(p_partkey AS BIGINT) AS request_id,
         CAST(CASE WHEN p_partkey % 17 = 0 THEN p_partkey + {BIG} ELSE p_partkey // 2 END AS BIGINT) AS movie_id,
         p_partkey % 6 AS kind, p_name, p_size, p_partkey
  FROM part),
cols AS (
  SELECT request_id, movie_id,
         kind IN (0, 4) AS has_title, CASE WHEN kind = 0 THEN upper(p_name) END AS v_title,
         kind = 1 AS has_duration, CAST(p_size AS VARCHAR) || 'x' AS s_duration,
         kind = 2 AS has_owner, CAST(p_partkey % 120 AS VARCHAR) AS s_owner,
         kind = 3 AS has_desc, kind = 3 AS has_poster,
         'http://img/' || CAST(p_partkey AS VARCHAR) AS v_poster,
         kind = 0 AS has_rating, '7.5' AS s_rating
  FROM pat),
dec AS (
  SELECT c.*,
         CASE WHEN NOT (has_title OR has_duration OR has_owner OR has_desc OR has_poster OR has_rating)
                THEN 'nothing_to_update'
              WHEN NOT EXISTS (SELECT 1 FROM movie m WHERE m.movie_id = c.movie_id) THEN 'not_found'
              WHEN (has_duration AND TRY_CAST(s_duration AS INTEGER) IS NULL)
                   OR (has_owner AND TRY_CAST(s_owner AS BIGINT) IS NULL)
                   OR (has_rating AND TRY_CAST(s_rating AS DECIMAL(3,1)) IS NULL) THEN 'invalid_value'
              WHEN (has_title AND length(v_title) > 100) OR (has_poster AND length(v_poster) > 255)
                THEN 'value_too_long'
              WHEN has_title AND v_title IS NULL THEN 'null_not_allowed'
              WHEN has_owner AND NOT EXISTS (SELECT 1 FROM producer p
                                             WHERE p.owner_id = TRY_CAST(c.s_owner AS BIGINT))
                THEN 'unknown_reference'
              ELSE 'updated' END AS outcome
  FROM cols c),
last_upd AS (
  SELECT movie_id,
         max(request_id) FILTER (WHERE has_title) AS r_title,
         arg_max(v_title, request_id) FILTER (WHERE has_title) AS v_title,
         max(request_id) FILTER (WHERE has_duration) AS r_duration,
         arg_max(TRY_CAST(s_duration AS INTEGER), request_id) FILTER (WHERE has_duration) AS v_duration,
         max(request_id) FILTER (WHERE has_owner) AS r_owner,
         arg_max(TRY_CAST(s_owner AS BIGINT), request_id) FILTER (WHERE has_owner) AS v_owner,
         max(request_id) FILTER (WHERE has_desc) AS r_desc,
         max(request_id) FILTER (WHERE has_poster) AS r_poster,
         arg_max(v_poster, request_id) FILTER (WHERE has_poster) AS v_poster,
         max(request_id) FILTER (WHERE has_rating) AS r_rating,
         arg_max(TRY_CAST(s_rating AS DECIMAL(3,1)), request_id) FILTER (WHERE has_rating) AS v_rating
  FROM dec WHERE outcome = 'updated' GROUP BY movie_id)
"""

MOVIE_DEL = f"""
del AS (
  SELECT CAST(p_partkey AS BIGINT) AS request_id,
         CAST(CASE WHEN p_partkey % 10 = 3 THEN p_partkey ELSE p_partkey + {BIG} END AS BIGINT) AS movie_id
  FROM part),
gone_movie AS (SELECT movie_id FROM movie WHERE movie_id IN (SELECT movie_id FROM del)),
gone_show AS (SELECT showtime_id FROM showtime WHERE movie_id IN (SELECT movie_id FROM gone_movie)),
gone_booking AS (SELECT booking_id FROM booking WHERE showtime_id IN (SELECT showtime_id FROM gone_show))
"""

BODIES = {
    "insert_movies": ("SELECT request_id, outcome FROM dec", MOVIE_INS),
    "insert_movies_table": ("""
        SELECT * FROM movie
        UNION ALL
        SELECT movie_id, owner_id, title, duration, CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR),
               CAST(NULL AS DECIMAL(3,1))
        FROM dec WHERE outcome = 'inserted'""", MOVIE_INS),
    "register_users": ("SELECT request_id, outcome FROM walk WHERE rn > 0", USER_REG),
    "register_users_table": ("""
        SELECT * FROM users
        UNION ALL
        SELECT c.user_id, c.name, c.email, c.password, c.role
        FROM walk w JOIN chk c ON c.request_id = w.request_id WHERE w.outcome = 'inserted'""",
                             USER_REG),
    "create_users": ("SELECT request_id, outcome FROM walk WHERE rn > 0 UNION ALL FROM refused", USER_CREATE),
    "create_users_table": ("""
        FROM users UNION ALL
        SELECT chk.user_id, name, email, password, role FROM walk JOIN chk USING (request_id)
        WHERE walk.outcome = 'inserted'""", USER_CREATE),
    "replace_showtimes": ("SELECT request_id, outcome FROM dec", SHOW_REP),
    "replace_showtimes_table": ("""
        SELECT s.showtime_id, COALESCE(u.movie_id, s.movie_id) AS movie_id,
               CASE WHEN u.showtime_id IS NULL THEN s.theater_id ELSE u.theater_id END AS theater_id,
               COALESCE(u.show_date, s.show_date) AS show_date, COALESCE(u.price, s.price) AS price
        FROM showtime s LEFT JOIN last_upd u ON u.showtime_id = s.showtime_id""", SHOW_REP),
    "patch_movies": ("SELECT request_id, outcome FROM dec", MOVIE_PATCH),
    "patch_movies_table": ("""
        SELECT m.movie_id,
               CASE WHEN u.r_owner IS NOT NULL THEN u.v_owner ELSE m.owner_id END AS owner_id,
               CASE WHEN u.r_title IS NOT NULL THEN u.v_title ELSE m.title END AS title,
               CASE WHEN u.r_duration IS NOT NULL THEN u.v_duration ELSE m.duration END AS duration,
               CASE WHEN u.r_desc IS NOT NULL THEN NULL ELSE m.description END AS description,
               CASE WHEN u.r_poster IS NOT NULL THEN u.v_poster ELSE m.poster_url END AS poster_url,
               CASE WHEN u.r_rating IS NOT NULL THEN u.v_rating ELSE m.rating END AS rating
        FROM movie m LEFT JOIN last_upd u ON u.movie_id = m.movie_id""", MOVIE_PATCH),
    "delete_movies": ("""
        SELECT request_id,
               CASE WHEN movie_id IN (SELECT movie_id FROM movie) THEN 'deleted' ELSE 'not_found' END
                 AS outcome
        FROM del""", MOVIE_DEL),
    "delete_movies_sizes": ("""
        SELECT 'producer' AS table_name, count(*) AS rows FROM producer
        UNION ALL SELECT 'users', count(*) FROM users
        UNION ALL SELECT 'theater', count(*) FROM theater
        UNION ALL SELECT 'movie', count(*) FROM movie WHERE movie_id NOT IN (SELECT movie_id FROM gone_movie)
        UNION ALL SELECT 'showtime', count(*) FROM showtime
                  WHERE showtime_id NOT IN (SELECT showtime_id FROM gone_show)
        UNION ALL SELECT 'movie_genre', count(*) FROM movie_genre
                  WHERE movie_id NOT IN (SELECT movie_id FROM gone_movie)
        UNION ALL SELECT 'booking', count(*) FROM booking
                  WHERE booking_id NOT IN (SELECT booking_id FROM gone_booking)
        UNION ALL SELECT 'seat', count(*) FROM seat
        UNION ALL SELECT 'booking_seat', count(*) FROM booking_seat
                  WHERE booking_id NOT IN (SELECT booking_id FROM gone_booking)
                    AND showtime_id NOT IN (SELECT showtime_id FROM gone_show)
        UNION ALL SELECT 'payment', count(*) FROM payment
                  WHERE booking_id NOT IN (SELECT booking_id FROM gone_booking)""", MOVIE_DEL),
    "delete_producers": ("""
        SELECT CAST(s_suppkey AS BIGINT) AS request_id,
               CASE WHEN NOT EXISTS (SELECT 1 FROM producer p WHERE p.owner_id = s.s_suppkey) THEN 'not_found'
                    WHEN EXISTS (SELECT 1 FROM movie m WHERE m.owner_id = s.s_suppkey) THEN 'restricted'
                    ELSE 'deleted' END AS outcome
        FROM supplier s""", ""),
}


MOVES = f"""
mv AS (
  SELECT CAST(o_orderkey AS BIGINT) AS request_id,
         CAST(CASE WHEN o_orderkey % 91 = 0 THEN o_orderkey + {BIG}
                   WHEN o_orderkey % 17 = 0 THEN o_orderkey - 7 ELSE o_orderkey END AS BIGINT) AS booking_id,
         CAST(CASE WHEN o_orderkey % 49 = 0 THEN o_custkey + 1 ELSE o_custkey END AS BIGINT) AS actor_id,
         CAST(CASE WHEN o_orderkey % 3 = 0 THEN NULL
                   WHEN o_orderkey % 3 = 1 THEN (o_orderkey * 31 + o_custkey + 2) % ((SELECT count(*) FROM part) * 2)
                   ELSE o_orderkey + {BIG} END AS BIGINT) AS showtime_id,
         CASE WHEN o_orderkey % 5 = 0 THEN NULL
              WHEN o_orderkey % 11 = 0 THEN CAST([] AS VARCHAR[])
              ELSE [CAST((o_orderkey * 3) % 60 + 1 AS VARCHAR),
                    CAST(((o_orderkey // 7) * 5) % 62 + 1 AS VARCHAR)] END AS seats
  FROM orders),
mv2 AS (
  SELECT m.*, b.user_id AS owner, b.status AS b_status, b.showtime_id AS cur_show,
         b.booking_id IS NOT NULL AS found, COALESCE(m.showtime_id, b.showtime_id) AS target,
         min(m.request_id) OVER (PARTITION BY m.booking_id) AS first_req
  FROM mv m LEFT JOIN booking b ON b.booking_id = m.booking_id),
mv_seat AS (
  SELECT m.request_id, m.booking_id, m.target, u.s FROM mv2 m, unnest(m.seats) AS u(s)),
bad_seat AS (
  SELECT DISTINCT ms.request_id
  FROM mv_seat ms JOIN showtime st ON st.showtime_id = ms.target
  LEFT JOIN seat ON seat.theater_id = st.theater_id AND lower(seat.seat_number) = lower(ms.s)
  WHERE seat.seat_number IS NULL),
held AS (
  SELECT DISTINCT ms.request_id
  FROM mv_seat ms JOIN booking_seat bs
    ON bs.showtime_id = ms.target AND lower(bs.seat_number) = lower(ms.s)
   AND bs.booking_id <> ms.booking_id),
mv3 AS (
  SELECT m.*, st.theater_id AS target_theater, st.price, st.showtime_id IS NOT NULL AS show_ok,
         m.request_id IN (SELECT request_id FROM bad_seat) AS bad_seat,
         m.request_id IN (SELECT request_id FROM held) AS held
  FROM mv2 m LEFT JOIN showtime st ON st.showtime_id = m.target),
chk AS (
  SELECT *,
    CASE WHEN showtime_id IS NULL AND seats IS NULL THEN 'nothing_to_update'
         WHEN request_id <> first_req THEN 'duplicate_move'
         WHEN NOT found THEN 'not_found'
         WHEN actor_id IS DISTINCT FROM owner THEN 'unauthorized'
         WHEN b_status IN ('Cancelled', 'Used') THEN 'closed_booking'
         WHEN showtime_id IS NOT NULL AND showtime_id <> cur_show AND seats IS NULL THEN 'seats_required'
         WHEN NOT show_ok THEN 'showtime_not_found'
         WHEN seats IS NOT NULL AND len(seats) = 0 THEN 'empty_seats'
         WHEN seats IS NOT NULL AND bad_seat THEN 'seat_not_found'
         WHEN seats IS NOT NULL AND held THEN 'already_booked' END AS pre,
    list_distinct(list_transform(seats, lambda x: lower(x))) AS keys
  FROM mv3),
cand AS (
  SELECT request_id, target, keys, len(keys) < len(seats) AS dup,
         row_number() OVER (PARTITION BY target ORDER BY request_id) AS rn
  FROM chk WHERE pre IS NULL AND seats IS NOT NULL),
fold AS (
  SELECT target, CAST(0 AS BIGINT) AS rn, CAST([] AS VARCHAR[]) AS taken,
         CAST(NULL AS BIGINT) AS request_id, CAST(NULL AS VARCHAR) AS outcome
  FROM cand GROUP BY target
  UNION ALL
  SELECT c.target, c.rn,
         CASE WHEN list_has_any(f.taken, c.keys) OR c.dup THEN f.taken
              ELSE list_concat(f.taken, c.keys) END,
         c.request_id,
         CASE WHEN list_has_any(f.taken, c.keys) THEN 'already_booked'
              WHEN c.dup THEN 'duplicate_seat' ELSE 'moved' END
  FROM fold f JOIN cand c ON c.target = f.target AND c.rn = f.rn + 1),
dec AS (
  SELECT request_id, pre AS outcome FROM chk WHERE pre IS NOT NULL
  UNION ALL SELECT request_id, outcome FROM fold WHERE request_id IS NOT NULL
  UNION ALL SELECT request_id, 'moved' FROM chk WHERE pre IS NULL AND seats IS NULL),
done AS (SELECT c.* FROM chk c JOIN dec d ON d.request_id = c.request_id WHERE d.outcome = 'moved'),
new_bs AS (
  SELECT bs.* FROM booking_seat bs
  WHERE bs.booking_id NOT IN (SELECT booking_id FROM done WHERE seats IS NOT NULL)
  UNION ALL
  SELECT d.booking_id, seat.seat_number, d.target_theater, d.target
  FROM done d, unnest(d.keys) u(k)
  JOIN seat ON seat.theater_id = d.target_theater AND lower(seat.seat_number) = u.k
  WHERE d.seats IS NOT NULL),
amounts AS (
  SELECT booking_id, arg_min(amount, showtime_id) AS amount FROM (
    SELECT nb.booking_id, nb.showtime_id, CAST(count(*) * st.price AS DECIMAL(10,2)) AS amount
    FROM new_bs nb JOIN showtime st ON st.showtime_id = nb.showtime_id
    WHERE nb.booking_id IN (SELECT booking_id FROM done)
    GROUP BY nb.booking_id, nb.showtime_id, st.price) x
  GROUP BY booking_id)
"""

BODIES.update({
    "reassign_bookings": ("SELECT request_id, outcome FROM dec", MOVES),
    "reassign_bookings_booking": ("""
        SELECT booking_id, user_id, ifnull(target, b.showtime_id) AS showtime_id, status, booking_date
        FROM booking b LEFT JOIN (SELECT booking_id, target FROM done) USING (booking_id)""", MOVES),
    "reassign_bookings_seats": ("SELECT * FROM new_bs", MOVES),
    "reassign_bookings_payment": ("""
        SELECT p.payment_id, p.booking_id, COALESCE(a.amount, p.amount) AS amount, p.status,
               p.payment_date
        FROM payment p LEFT JOIN amounts a ON a.booking_id = p.booking_id
          AND p.payment_id = (SELECT min(q.payment_id) FROM payment q WHERE q.booking_id = p.booking_id)""", MOVES),
    "next_ids": ("""
        SELECT b.booking_id,
               (SELECT max(payment_id) FROM payment) + row_number() OVER (ORDER BY b.booking_id)
                 AS payment_id
        FROM booking b WHERE NOT EXISTS (SELECT 1 FROM payment p WHERE p.booking_id = b.booking_id)""",
                 ""),
})


GENRE_INS = f"""
ins AS (
  SELECT CAST(p_partkey AS BIGINT) AS request_id,
         CAST(CASE WHEN p_partkey % 11 = 0 THEN p_partkey // 2 + {BIG} ELSE p_partkey // 2 END AS BIGINT) AS movie_id,
         CASE WHEN p_partkey % 3 = 0 THEN lower(p_type)
              WHEN p_partkey % 3 = 1 THEN 'Genre' || CAST(p_partkey % 4 AS VARCHAR)
              ELSE '' END AS genre
  FROM part),
chk AS (
  SELECT i.*,
         CASE WHEN movie_id IS NULL OR movie_id = 0 OR genre IS NULL OR genre = '' THEN 'missing_fields'
              WHEN length(genre) > 100 THEN 'value_too_long'
              WHEN EXISTS (SELECT 1 FROM movie_genre g WHERE g.movie_id = i.movie_id
                                                         AND lower(g.genre) = lower(i.genre)) THEN 'duplicate_key'
              WHEN NOT EXISTS (SELECT 1 FROM movie m WHERE m.movie_id = i.movie_id) THEN 'unknown_reference'
         END AS pre
  FROM ins i),
dec AS (
  SELECT *, COALESCE(pre, CASE WHEN request_id = min(request_id) FILTER (WHERE pre IS NULL)
                                   OVER (PARTITION BY movie_id, lower(genre))
                               THEN 'inserted' ELSE 'duplicate_key' END) AS outcome
  FROM chk)
"""

SHOW_INS = f"""
ins AS (
  SELECT CAST(p_partkey AS BIGINT) AS request_id,
         CAST(CASE WHEN p_partkey % 5 = 0 THEN p_partkey * 2 ELSE p_partkey // 2 + {BIG} END AS BIGINT) AS showtime_id,
         CAST((p_partkey * 3) % ((SELECT count(*) FROM part) + 4) AS BIGINT) AS movie_id,
         CAST(p_partkey % 26 AS BIGINT) AS theater_id,
         TIMESTAMP '2026-06-01 12:00:00' + to_days(CAST(p_partkey % 30 AS INTEGER)) AS show_date,
         CAST(p_retailprice AS DECIMAL(10,2)) AS price
  FROM part),
chk AS (
  SELECT i.*,
         CASE WHEN showtime_id IS NULL OR showtime_id = 0 OR movie_id IS NULL OR movie_id = 0
                   OR theater_id IS NULL OR theater_id = 0 OR show_date IS NULL
                   OR price IS NULL OR price = 0 THEN 'missing_fields'
              WHEN EXISTS (SELECT 1 FROM showtime s WHERE s.showtime_id = i.showtime_id) THEN 'duplicate_key'
              WHEN NOT EXISTS (SELECT 1 FROM movie m WHERE m.movie_id = i.movie_id)
                   OR NOT EXISTS (SELECT 1 FROM theater t WHERE t.theater_id = i.theater_id)
                THEN 'unknown_reference' END AS pre
  FROM ins i),
dec AS (
  SELECT *, COALESCE(pre, CASE WHEN request_id = min(request_id) FILTER (WHERE pre IS NULL)
                                   OVER (PARTITION BY showtime_id)
                               THEN 'inserted' ELSE 'duplicate_key' END) AS outcome
  FROM chk)
"""

BODIES.update({
    "insert_genres": ("SELECT request_id, outcome FROM dec", GENRE_INS),
    "insert_showtimes": ("SELECT request_id, outcome FROM dec", SHOW_INS),
    "insert_showtimes_table": ("""
        SELECT * FROM showtime
        UNION ALL
        SELECT showtime_id, movie_id, theater_id, show_date, price FROM dec WHERE outcome = 'inserted'""",
                               SHOW_INS),
})


THEATER_INS = f"""
ins AS (
  SELECT s_suppkey AS request_id, CASE WHEN s_suppkey % 4 = 0 THEN s_suppkey % 30 ELSE {BIG} + s_suppkey // 2 END AS id,
         CASE WHEN s_suppkey % 7 <> 0 THEN s_name ELSE '' END AS label
  FROM supplier),
dec AS (
  SELECT request_id, id, label,
         CASE WHEN id = 0 OR label = '' THEN 'missing_fields'
              WHEN id IN (FROM theater SELECT theater_id)
                OR request_id > min(request_id) FILTER (WHERE label <> '') OVER (PARTITION BY id) THEN 'duplicate_key'
              ELSE 'inserted' END AS outcome
  FROM ins)
"""

SHOW_DEL = f"""
del AS (
  SELECT p_partkey AS request_id,
         2 * p_partkey + CASE WHEN p_partkey % 6 = 0 THEN p_partkey % 4 ELSE {BIG} END AS showtime_id
  FROM part)
"""

GENRE_DEL = "del AS (SELECT p_partkey AS request_id, p_partkey AS movie_id, lower(p_type) AS k FROM part)"

BODIES.update({
    "insert_genres_table": ("FROM movie_genre UNION ALL SELECT movie_id, genre FROM dec WHERE outcome = 'inserted'",
                            GENRE_INS),
    "insert_theaters": ("SELECT CAST(request_id AS BIGINT) AS request_id, outcome FROM dec", THEATER_INS),
    "insert_theaters_table": ("FROM theater UNION ALL SELECT CAST(id AS BIGINT), label FROM dec "
                              "WHERE outcome = 'inserted'", THEATER_INS),
    "delete_movies_booking_seat": ("FROM booking_seat WHERE showtime_id NOT IN (FROM gone_show) "
                                   "AND booking_id NOT IN (FROM gone_booking)", MOVIE_DEL),
    "delete_movies_payment": ("FROM payment WHERE booking_id NOT IN (FROM gone_booking)", MOVIE_DEL),
    "delete_showtimes": ("""
        SELECT CAST(request_id AS BIGINT) AS request_id,
               if(showtime_id IN (FROM showtime SELECT showtime_id), 'deleted', 'not_found') AS outcome
        FROM del""", SHOW_DEL),
    "delete_showtimes_booking": ("FROM booking WHERE showtime_id NOT IN (FROM del SELECT showtime_id)", SHOW_DEL),
    "delete_genres": ("""
        SELECT CAST(request_id AS BIGINT) AS request_id,
               if((movie_id, k) IN (FROM movie_genre SELECT (movie_id, lower(genre))), 'deleted', 'not_found') AS outcome
        FROM del""", GENRE_DEL),
    "delete_genres_table": ("FROM movie_genre WHERE (movie_id, lower(genre)) NOT IN (FROM del SELECT (movie_id, k))",
                            GENRE_DEL),
})


def dml_sql() -> dict[str, str]:
    out = {name: with_bridge(body, extra, recursive=("walk" in extra or "fold" in extra))
           for name, (body, extra) in BODIES.items()}
    out["moves_two_payments"] = with_two_payments(out["reassign_bookings_payment"], "mv")
    return out
