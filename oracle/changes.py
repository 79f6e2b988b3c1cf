"""DuckDB text for the bulk changes, written as sequential models.

Order-dependent changes (admission) are a recursive CTE that walks each
showtime's requests one by one in request order, which is the reference's
one-request-at-a-time behaviour stated directly.
"""

from .bridge import with_bridge

REQUESTS_CTES = """
req_lines AS (
  SELECT l_orderkey,
         list(CAST((7 * l_partkey + 13 * l_linenumber) % 60 + 1 AS VARCHAR)
              ORDER BY CAST((7 * l_partkey + 13 * l_linenumber) % 60 + 1 AS VARCHAR)) AS seats
  FROM lineitem GROUP BY l_orderkey),
req AS (
  SELECT CAST(o.o_orderkey AS BIGINT) AS request_id, CAST(o.o_custkey AS BIGINT) AS user_id,
         CAST((31 * o.o_orderkey + o.o_custkey + o.o_orderkey % 3) % (2 * (SELECT count(*) FROM part)) AS BIGINT) AS showtime_id,
         l.seats, CAST(o.o_orderdate AS TIMESTAMP) AS requested_at
  FROM orders o LEFT JOIN req_lines l ON l.l_orderkey = o.o_orderkey)
"""

_ADMIT = """,
bs0 AS (SELECT * FROM booking_seat),
req_seat AS (
  SELECT r.request_id, r.showtime_id, u.s
  FROM req r, unnest(r.seats) AS u(s)),
bad_seat AS (
  SELECT DISTINCT rs.request_id
  FROM req_seat rs
  JOIN showtime st ON st.showtime_id = rs.showtime_id
  LEFT JOIN seat ON seat.theater_id = st.theater_id AND lower(seat.seat_number) = lower(rs.s)
  WHERE seat.seat_number IS NULL),
held0 AS (
  SELECT DISTINCT rs.request_id
  FROM req_seat rs JOIN bs0 ON bs0.showtime_id = rs.showtime_id
                          AND lower(bs0.seat_number) = lower(rs.s)),
chk AS (
  SELECT r.request_id, r.showtime_id,
         CASE WHEN r.user_id IS NULL OR r.showtime_id IS NULL OR r.seats IS NULL THEN 'missing_fields'
              WHEN len(r.seats) = 0 THEN 'empty_seats'
              WHEN NOT EXISTS (SELECT 1 FROM showtime st WHERE st.showtime_id = r.showtime_id)
                THEN 'showtime_not_found'
              WHEN r.request_id IN (SELECT request_id FROM bad_seat) THEN 'seat_not_found'
              WHEN r.request_id IN (SELECT request_id FROM held0) THEN 'already_booked'
         END AS pre,
         CASE WHEN NOT EXISTS (SELECT 1 FROM users u WHERE u.user_id = r.user_id) THEN 'unknown_user'
              WHEN len(list_distinct(list_transform(r.seats, lambda x: lower(x)))) < len(r.seats)
                THEN 'duplicate_seat'
         END AS blocker,
         list_distinct(list_transform(r.seats, lambda x: lower(x))) AS keys
  FROM req r),
cand AS (
  SELECT request_id, showtime_id, keys, blocker,
         row_number() OVER (PARTITION BY showtime_id ORDER BY request_id) AS rn
  FROM chk WHERE pre IS NULL),
fold AS (
  SELECT showtime_id, CAST(0 AS BIGINT) AS rn, CAST([] AS VARCHAR[]) AS taken,
         CAST(NULL AS BIGINT) AS request_id, CAST(NULL AS VARCHAR) AS outcome
  FROM cand GROUP BY showtime_id
  UNION ALL
  SELECT c.showtime_id, c.rn,
         CASE WHEN NOT list_has_any(f.taken, c.keys) AND c.blocker IS NULL
              THEN list_concat(f.taken, c.keys) ELSE f.taken END,
         c.request_id,
         CASE WHEN list_has_any(f.taken, c.keys) THEN 'already_booked'
              WHEN c.blocker IS NOT NULL THEN c.blocker ELSE 'accepted' END
  FROM fold f JOIN cand c ON c.showtime_id = f.showtime_id AND c.rn = f.rn + 1),
decided AS (
  SELECT request_id, pre AS outcome FROM chk WHERE pre IS NOT NULL
  UNION ALL
  SELECT request_id, outcome FROM fold WHERE request_id IS NOT NULL)
"""

ADMIT_CTES = REQUESTS_CTES + _ADMIT

#: Orders as JSON lines (some malformed) and as form text; see ``scenarios.payload_admission``.
PAYLOAD_CTES = REQUESTS_CTES.replace("req AS (", "asked AS (") + """,
malformed AS (
  SELECT CASE WHEN request_id % 29 = 0 THEN '{"request_id":' || request_id || ',"seats":["1"'
              WHEN request_id % 31 = 0 THEN '{"request_id":' || request_id || ',"user_id":"nobody","showtime_id":1,"seats":["1"]}'
              ELSE '[' || request_id || ']' END AS raw, request_id
  FROM asked WHERE request_id % 3 <> 1 AND (request_id % 29 = 0 OR request_id % 31 = 0 OR request_id % 37 = 0)),
req AS (
  SELECT request_id, CASE WHEN request_id % 3 <> 1 OR request_id % 41 <> 0 THEN user_id END AS user_id, showtime_id, seats,
         TIMESTAMP '2026-01-01 00:00:00' AS requested_at
  FROM asked WHERE request_id NOT IN (FROM malformed SELECT request_id))""" + _ADMIT

ADMIT_BODY = """
SELECT d.request_id, d.outcome,
       CASE WHEN d.outcome = 'accepted' THEN
         (SELECT max(booking_id) FROM booking)
         + row_number() OVER (PARTITION BY d.outcome = 'accepted' ORDER BY d.request_id)
       END AS booking_id
FROM decided d
"""



ADMIT_TABLES = {
    "admit_bookings_booking": f"""
        FROM booking UNION ALL
        SELECT booking_id, user_id, showtime_id, 'Pending', requested_at
        FROM ({ADMIT_BODY}) JOIN req USING (request_id) WHERE outcome = 'accepted'""",
    "admit_bookings_seats": f"""
        FROM booking_seat UNION ALL
        SELECT booking_id, seat_number, seat.theater_id, got.showtime_id
        FROM ({ADMIT_BODY}) JOIN req_seat got USING (request_id) JOIN showtime USING (showtime_id)
        JOIN seat ON seat.theater_id = showtime.theater_id AND lower(seat_number) = lower(s)
        WHERE outcome = 'accepted'""",
}

EVENTS_CTES = """
ev AS (
  SELECT CAST(event_id % (SELECT count(*) // 5 FROM events) AS BIGINT) AS booking_id,
         CAST(event_id AS BIGINT) AS seq,
         CASE WHEN event_id % 11 IN (3, 8) THEN 'refund' WHEN event_id % 11 = 5 THEN 'set_status' ELSE
         CASE event_type WHEN 'purchase' THEN 'pay' WHEN 'click' THEN 'checkin'
              WHEN 'view' THEN 'use' WHEN 'error' THEN 'cancel'
              WHEN 'signup' THEN 'create_payment' END END AS action,
         CASE WHEN event_id % 11 = 5 THEN ['Pending', 'Confirmed', 'Cancelled', 'Used', 'Lost', ''][event_id % 6 + 1]
         END AS new_status,
         CAST(ts AS TIMESTAMP) AS ev_at
  FROM events),
ctx AS (
  SELECT k.booking_id, b.user_id AS owner, b.status AS b0, st.price,
         COALESCE(s.n, 0) AS n_seats, p.payment_id, p.status AS p0,
         b.booking_id IS NOT NULL AS exists_, st.showtime_id IS NOT NULL AS show_ok
  FROM (SELECT DISTINCT booking_id FROM ev) k
  LEFT JOIN booking b ON b.booking_id = k.booking_id
  LEFT JOIN showtime st ON st.showtime_id = b.showtime_id
  LEFT JOIN (SELECT booking_id, count(seat_number) AS n FROM booking_seat GROUP BY booking_id) s
         ON s.booking_id = k.booking_id
  LEFT JOIN (SELECT booking_id, min(payment_id) AS payment_id,
                    arg_min(status, payment_id) AS status
             FROM payment GROUP BY booking_id) p ON p.booking_id = k.booking_id),
evc AS (
  SELECT ev.*, c.exists_, c.show_ok, c.n_seats > 0 AS has_seats,
         -- the actor is the booking's own user
         c.owner IS NOT NULL AS is_owner,
         row_number() OVER (PARTITION BY ev.booking_id ORDER BY ev.seq) AS rn
  FROM ev JOIN ctx c ON c.booking_id = ev.booking_id),
fold AS (
  SELECT booking_id, CAST(0 AS BIGINT) AS rn, b0 AS b, p0 AS p, 0 AS a, 0 AS i,
         CAST(NULL AS BIGINT) AS seq, CAST(NULL AS VARCHAR) AS action,
         CAST(NULL AS VARCHAR) AS outcome, CAST(NULL AS TIMESTAMP) AS ev_at, 0 AS inserted_here
  FROM ctx
  UNION ALL
  SELECT booking_id, rn,
         CASE WHEN outcome <> 'ok' THEN b
              WHEN action = 'cancel' OR action = 'refund' THEN 'Cancelled'
              WHEN action IN ('pay', 'create_payment') THEN 'Confirmed'
              WHEN action IN ('use', 'checkin') THEN 'Used'
              WHEN action = 'set_status' THEN new_status END,
         CASE WHEN outcome <> 'ok' THEN p
              WHEN action = 'pay' THEN 'Confirmed'
              WHEN action = 'create_payment' THEN 'Pending'
              WHEN action = 'refund' THEN 'Refunded' ELSE p END,
         CASE WHEN outcome = 'ok' AND action IN ('pay', 'create_payment') THEN 1 ELSE a END,
         CASE WHEN outcome = 'ok' AND ((action = 'pay' AND p IS NULL) OR action = 'create_payment')
              THEN 1 ELSE i END,
         seq, action, outcome, ev_at,
         CASE WHEN outcome = 'ok' AND ((action = 'pay' AND p IS NULL) OR action = 'create_payment')
              THEN 1 ELSE 0 END
  FROM (
    SELECT f.booking_id, e.rn, f.b, f.p, f.a, f.i, e.seq, e.action, e.new_status, e.ev_at,
      CASE
        WHEN e.exists_ AND f.b NOT IN ('Pending', 'Confirmed', 'Cancelled', 'Used') THEN 'invalid_state'
        WHEN e.action = 'cancel' THEN CASE
          WHEN NOT e.exists_ THEN 'not_found' WHEN NOT e.is_owner THEN 'unauthorized'
          WHEN f.b = 'Cancelled' THEN 'already_cancelled' WHEN f.b = 'Used' THEN 'already_used'
          ELSE 'ok' END
        WHEN e.action = 'pay' THEN CASE
          WHEN NOT e.exists_ OR NOT e.show_ok THEN 'not_found'
          WHEN NOT e.is_owner THEN 'unauthorized'
          WHEN f.b = 'Cancelled' THEN 'cancelled_booking'
          WHEN f.p = 'Confirmed' THEN 'already_paid' ELSE 'ok' END
        WHEN e.action = 'create_payment' THEN CASE
          WHEN NOT e.exists_ THEN 'not_found' WHEN NOT e.is_owner THEN 'unauthorized'
          WHEN f.p IS NOT NULL THEN 'payment_exists'
          WHEN NOT e.show_ok OR NOT e.has_seats THEN 'no_seats' ELSE 'ok' END
        WHEN e.action = 'use' THEN CASE
          WHEN NOT e.exists_ THEN 'not_found' WHEN f.b = 'Cancelled' THEN 'cancelled_booking'
          WHEN f.b = 'Used' THEN 'already_used' ELSE 'ok' END
        WHEN e.action = 'checkin' THEN CASE
          WHEN NOT e.exists_ THEN 'not_found' WHEN f.b = 'Cancelled' THEN 'cancelled_booking'
          WHEN f.b = 'Used' THEN 'already_used' WHEN f.b <> 'Confirmed' THEN 'not_confirmed'
          ELSE 'ok' END
        WHEN e.action = 'set_status' THEN CASE
          WHEN e.new_status IS NULL OR e.new_status = '' THEN 'status_required'
          WHEN e.new_status NOT IN ('Pending', 'Confirmed', 'Cancelled', 'Used') THEN 'invalid_status'
          WHEN NOT e.exists_ THEN 'not_found' ELSE 'ok' END
        WHEN e.action = 'refund' THEN CASE
          WHEN f.p IS NULL THEN 'payment_not_found' WHEN f.p = 'Refunded' THEN 'already_refunded'
          WHEN f.p <> 'Confirmed' THEN 'not_confirmed' WHEN NOT e.exists_ THEN 'not_found'
          WHEN f.b = 'Used' THEN 'used_booking' ELSE 'ok' END
        ELSE 'invalid_action' END AS outcome
    FROM fold f JOIN evc e ON e.booking_id = f.booking_id AND e.rn = f.rn + 1) x),
final AS (
  SELECT f.booking_id, f.b, f.p, f.a, f.i
  FROM fold f JOIN (SELECT booking_id, max(rn) AS rn FROM fold GROUP BY booking_id) m
    ON m.booking_id = f.booking_id AND m.rn = f.rn),
ins AS (SELECT booking_id, seq, ev_at FROM fold WHERE inserted_here = 1)
"""

EVENTS_BODIES = {
    "apply_booking_events": "SELECT booking_id, seq, action, outcome FROM fold WHERE rn > 0",
    "events_booking_after": """
        SELECT b.booking_id, b.user_id, b.showtime_id,
               CASE WHEN c.exists_ AND b.status IN ('Pending', 'Confirmed', 'Cancelled', 'Used')
                    THEN f.b ELSE b.status END AS status,
               b.booking_date
        FROM booking b LEFT JOIN final f ON f.booking_id = b.booking_id
        LEFT JOIN ctx c ON c.booking_id = b.booking_id""",
    "events_payment_after": """
        SELECT p.payment_id, p.booking_id,
               CASE WHEN f.i = 0 AND f.a = 1 THEN CAST(c.n_seats * c.price AS DECIMAL(10,2))
                    ELSE p.amount END AS amount,
               CASE WHEN f.i = 0 THEN f.p ELSE p.status END AS status, p.payment_date
        FROM payment p
        LEFT JOIN ctx c ON c.payment_id = p.payment_id
        LEFT JOIN final f ON f.booking_id = c.booking_id
        UNION ALL
        SELECT (SELECT max(payment_id) FROM payment) + row_number() OVER (ORDER BY ins.seq),
               f.booking_id, CAST(c.n_seats * c.price AS DECIMAL(10,2)), f.p, ins.ev_at
        FROM final f JOIN ins ON ins.booking_id = f.booking_id
        JOIN ctx c ON c.booking_id = f.booking_id
        WHERE f.i = 1""",
}


#: A twenty-fifth of the bookings with a second payment; goes before the other CTEs, the bridge's payment renamed.
TWO_PAYMENTS = """
payment AS (
  FROM one_payment UNION ALL
  SELECT payment_id + 500000000, booking_id, CAST(7 AS DECIMAL(10,2)), if(booking_id % 3 = 0, 'Pending', 'Confirmed'), payment_date
  FROM one_payment WHERE booking_id % 50 < 2),
"""


def with_two_payments(sql: str, first: str) -> str:
    """``sql`` over the tables with second payments; ``first`` is the name of its first CTE after the bridge."""
    sql = sql.replace("payment AS (", "one_payment AS (", 1)
    at = sql.index(f"\n{first} AS (")
    return sql[:at] + TWO_PAYMENTS + sql[at:]


#: A refund reaches all payments of its booking; other events the one of lowest payment_id.
EVENTS_TWO = EVENTS_BODIES["events_payment_after"].replace(
    "CASE WHEN f.i = 0 AND f.a = 1 THEN", "CASE WHEN c.payment_id = p.payment_id AND f.i = 0 AND f.a = 1 THEN").replace(
    "CASE WHEN f.i = 0 THEN f.p ELSE p.status END", """CASE WHEN c.payment_id = p.payment_id AND f.i = 0 THEN f.p
         WHEN p.booking_id IN (FROM fold SELECT booking_id WHERE action = 'refund' AND outcome = 'ok') THEN 'Refunded'
         ELSE p.status END""").replace("LEFT JOIN ctx c ON c.payment_id = p.payment_id", "LEFT JOIN ctx c ON c.booking_id = p.booking_id")


def lettered(sql: str) -> str:
    """``sql`` with half of the seats named by letters: 'Row7' in the theater, 'row7' where held, 'ROW7' where asked for."""
    seat = "CAST((7 * l{0}partkey + 13 * l{0}linenumber) % 60 + 1 AS VARCHAR)"
    held, asked = seat.format(".l_"), seat.format("_")
    named = lambda text, prefix: f"regexp_replace({text}, '^([12]?[0-9]|30)$', '{prefix}\\1')"
    sql = sql.replace(asked, named(asked, "ROW")).replace(f"{held} AS seat_number", f"{named(held, 'row')} AS seat_number")
    return sql.replace("CAST(r AS VARCHAR) AS seat_number", f"{named('CAST(r AS VARCHAR)', 'Row')} AS seat_number")


def changes_sql() -> dict[str, str]:
    out = {"admit_bookings": with_bridge(ADMIT_BODY, ADMIT_CTES, recursive=True)}
    for name, body in ADMIT_TABLES.items():
        out[name] = with_bridge(body, ADMIT_CTES, recursive=True)
    out["admit_payloads"] = with_bridge(f"""
        SELECT request_id, outcome, booking_id, CAST(NULL AS VARCHAR) AS raw FROM ({ADMIT_BODY})
        UNION ALL SELECT NULL, 'malformed', NULL, raw FROM malformed""", PAYLOAD_CTES, recursive=True)
    out["admit_payloads_booking"] = with_bridge(ADMIT_TABLES["admit_bookings_booking"], PAYLOAD_CTES, recursive=True)
    out["admit_lettered"] = lettered(out["admit_bookings"])
    out["admit_lettered_seats"] = lettered(out["admit_bookings_seats"])
    out["events_two_payments"] = with_two_payments(with_bridge(EVENTS_TWO, EVENTS_CTES, recursive=True), "ev")
    for name, body in EVENTS_BODIES.items():
        out[name] = with_bridge(body, EVENTS_CTES, recursive=True)
    return out
