"""DuckDB text of the bridge tables, prepended as CTEs to every oracle query.

It restates the mapping of ``seatspark/sources/bridge.py`` in SQL over the
pre-registered source views (customer, supplier, nation, part, orders,
lineitem, events). DuckDB drops CTEs a query does not use.
"""

BRIDGE_CTES = """
users AS (
  SELECT CAST(c_custkey AS BIGINT) AS user_id, c_name AS name,
         'u' || CAST(c_custkey AS VARCHAR) || '@example.com' AS email,
         'pw' || CAST(c_custkey AS VARCHAR) AS password,
         CASE WHEN c_custkey % 50 = 0 THEN 'staff' WHEN c_custkey % 50 = 1 THEN 'admin'
              ELSE 'customer' END AS role
  FROM customer),
producer AS (
  SELECT CAST(s_suppkey AS BIGINT) AS owner_id, s_name AS owner_name FROM supplier),
theater AS (
  SELECT CAST(n_nationkey AS BIGINT) AS theater_id, n_name AS theater_name FROM nation),
movie AS (
  SELECT CAST(p_partkey AS BIGINT) AS movie_id,
         CAST(p_partkey % ((SELECT count(*) FROM supplier) + 5) AS BIGINT) AS owner_id,
         p_name AS title, CAST(p_size + 60 AS INTEGER) AS duration,
         p_type AS description, CAST(NULL AS VARCHAR) AS poster_url,
         CAST(p_size AS DECIMAL(3,1)) AS rating
  FROM part),
movie_genre AS (
  SELECT CAST(p_partkey AS BIGINT) AS movie_id, p_type AS genre FROM part WHERE p_partkey % 9 <> 0
  UNION
  SELECT CAST(p_partkey AS BIGINT), p_brand FROM part WHERE p_partkey % 2 = 0),
showtime AS (
  SELECT CAST(p_partkey * 2 + k AS BIGINT) AS showtime_id, CAST(p_partkey AS BIGINT) AS movie_id,
         CAST((p_partkey + 7 * k) % 25 AS BIGINT) AS theater_id,
         TIMESTAMP '2026-01-01 10:00:00' + to_days(CAST(p_partkey % 90 AS INTEGER))
           + to_hours(CAST(5 * k AS INTEGER)) AS show_date,
         CAST(p_retailprice AS DECIMAL(10,2)) AS price
  FROM part, (SELECT unnest([0, 1]) AS k) ks),
seat AS (
  SELECT CAST(r AS VARCHAR) AS seat_number, CAST(n_nationkey AS BIGINT) AS theater_id
  FROM nation, (SELECT unnest(generate_series(1, 60)) AS r) rs),
booking AS (
  SELECT CAST(o_orderkey AS BIGINT) AS booking_id, CAST(o_custkey AS BIGINT) AS user_id,
         CAST((31 * o_orderkey + o_custkey) % (2 * (SELECT count(*) FROM part)) AS BIGINT) AS showtime_id,
         CASE WHEN o_orderstatus = 'P' THEN 'Cancelled' WHEN o_orderstatus = 'O' THEN 'Pending'
              WHEN o_orderkey % 10 = 0 THEN 'Used' ELSE 'Confirmed' END AS status,
         CAST(o_orderdate AS TIMESTAMP) AS booking_date
  FROM orders WHERE o_custkey % 40 <> 7),
booking_seat AS (
  SELECT min(b.booking_id) AS booking_id,
         CAST((7 * l.l_partkey + 13 * l.l_linenumber) % 60 + 1 AS VARCHAR) AS seat_number,
         st.theater_id, b.showtime_id
  FROM lineitem l JOIN booking b ON l.l_orderkey = b.booking_id
  JOIN showtime st ON b.showtime_id = st.showtime_id
  GROUP BY b.showtime_id, st.theater_id, CAST((7 * l.l_partkey + 13 * l.l_linenumber) % 60 + 1 AS VARCHAR)),
payment AS (
  SELECT CAST(o.o_orderkey + 1000000 AS BIGINT) AS payment_id, b.booking_id,
         CAST(o.o_totalprice AS DECIMAL(10,2)) AS amount,
         CASE WHEN b.status IN ('Confirmed', 'Used') THEN 'Confirmed'
              WHEN b.status = 'Pending' THEN 'Pending'
              WHEN o.o_orderkey % 2 = 0 THEN 'Refunded' ELSE 'Cancelled' END AS status,
         CAST(o.o_orderdate AS TIMESTAMP) AS payment_date
  FROM orders o JOIN booking b ON o.o_orderkey = b.booking_id
  WHERE o.o_orderkey % 8 <> 7)
"""


def with_bridge(body: str, extra_ctes: str = "", recursive: bool = False) -> str:
    """Prefix a query body with the bridge CTEs (and optional extra CTEs)."""
    ctes = BRIDGE_CTES.strip()
    if extra_ctes.strip():
        ctes += ",\n" + extra_ctes.strip()
    return f"WITH {'RECURSIVE ' if recursive else ''}{ctes}\n{body.strip()}"
