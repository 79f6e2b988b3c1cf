"""DuckDB text of the constraint audit, one SELECT per check, UNION ALL."""

from seatspark.schemas import (FOREIGN_KEYS, NOT_NULL, PRIMARY_KEYS, SCHEMAS, STATUS_SETS,
                               UNIQUE_KEYS, VARCHAR_LIMITS)
from pyspark.sql import types as T

from .bridge import with_bridge


def _k(table: str, col: str) -> str:
    if isinstance(SCHEMAS[table][col].dataType, T.StringType):
        return f"lower({col})"
    return col


def _sel(rule: str, table: str, cols, count_sql: str, from_sql: str) -> str:
    return (f"SELECT '{rule}' AS rule, '{table}' AS table_name, '{','.join(cols)}' AS columns, "
            f"CAST(COALESCE({count_sql}, 0) AS BIGINT) AS violations FROM {from_sql}")


#: Tables with every kind of violation; the same rows as ``scenarios.dirty_tables``.
DIRTY = """
users_dirty AS (
  SELECT user_id, CASE WHEN user_id % 80 = 4 THEN repeat(name, 8) ELSE name END AS name,
         CASE WHEN user_id % 70 = 3 THEN 'U' || CAST(user_id - 1 AS VARCHAR) || '@EXAMPLE.COM'
              WHEN user_id % 90 <> 5 THEN email END AS email, password, role FROM users),
movie_dirty AS (
  SELECT * REPLACE (CAST(3 * rating AS VARCHAR) AS rating) FROM movie
  UNION ALL FROM movie WHERE movie_id % 101 = 0),
showtime_dirty AS (
  SELECT * REPLACE (CAST(CASE WHEN showtime_id % 83 = 0 THEN price * 1000000 ELSE price END AS DECIMAL(18,2)) AS price)
  FROM showtime),
booking_dirty AS (
  SELECT booking_id, CASE WHEN booking_id % 59 <> 0 THEN user_id END AS user_id,
         CASE WHEN booking_id % 61 = 0 THEN showtime_id + 1 ELSE showtime_id END AS showtime_id,
         CASE WHEN booking_id % 53 = 0 THEN 'Lost' ELSE status END AS status, booking_date
  FROM booking WHERE booking_id % 71 <> 0),
booking_seat_dirty AS (
  SELECT booking_id, seat_number, CASE WHEN booking_id % 67 = 0 THEN theater_id + 1 ELSE theater_id END AS theater_id,
         showtime_id FROM booking_seat
  UNION ALL
  SELECT booking_id + 1, seat_number, theater_id, showtime_id FROM booking_seat WHERE booking_id % 73 = 0),
payment_dirty AS (
  SELECT payment_id, booking_id,
         CASE WHEN booking_id % 37 = 0 THEN 'n/a' WHEN booking_id % 41 = 0 THEN CAST(amount * 10000 AS VARCHAR)
              ELSE CAST(amount AS VARCHAR) END AS amount, status, payment_date FROM payment
  UNION ALL
  SELECT payment_id + CASE WHEN booking_id % 2 = 0 THEN 0 ELSE 500000000 END, booking_id, CAST(amount AS VARCHAR),
         status, payment_date FROM payment WHERE booking_id % 50 < 2)
"""


def audit_dirty_sql() -> str:
    return audit_sql({t: f"{t}_dirty" for t in ("users", "movie", "showtime", "booking", "booking_seat", "payment")}, DIRTY)


def audit_sql(names: dict[str, str] | None = None, extra: str = "") -> str:
    """One SELECT per check; ``names`` reads other tables in place of the bridge's."""
    at = lambda table: (names or {}).get(table, table)
    parts = []
    for table, cols in PRIMARY_KEYS.items():
        keys = ", ".join(_k(table, c) for c in cols)
        parts.append(_sel("primary_key", table, cols, "count(*)",
                          f"(SELECT {keys} FROM {at(table)} GROUP BY {keys} HAVING count(*) > 1) d"))
    for table, uniq in UNIQUE_KEYS.items():
        for cols in uniq:
            keys = ", ".join(_k(table, c) for c in cols)
            nn = " AND ".join(f"{c} IS NOT NULL" for c in cols)
            parts.append(_sel("unique", table, cols, "count(*)",
                              f"(SELECT {keys} FROM {at(table)} WHERE {nn} GROUP BY {keys} "
                              f"HAVING count(*) > 1) d"))
    for table in SCHEMAS:
        for col in NOT_NULL.get(table, ()):
            parts.append(_sel("not_null", table, (col,), f"count(*) FILTER (WHERE {col} IS NULL)",
                              at(table)))
        if table in STATUS_SETS:
            allowed = ", ".join(f"'{s}'" for s in STATUS_SETS[table])
            parts.append(_sel("status_set", table, ("status",),
                              f"count(*) FILTER (WHERE status IS NOT NULL AND status NOT IN ({allowed}))",
                              at(table)))
        for col, limit in VARCHAR_LIMITS.get(table, {}).items():
            parts.append(_sel("varchar_length", table, (col,),
                              f"count(*) FILTER (WHERE length({col}) > {limit})", at(table)))
        for f in SCHEMAS[table].fields:
            if isinstance(f.dataType, T.DecimalType):
                kind = f"DECIMAL({f.dataType.precision},{f.dataType.scale})"
                parts.append(_sel("decimal_range", table, (f.name,),
                                  f"count({f.name}) - count(TRY_CAST({f.name} AS {kind}))", at(table)))
    for child, ccols, parent, pcols, _ in FOREIGN_KEYS:
        nn = " AND ".join(f"c.{c} IS NOT NULL" for c in ccols)
        on = " AND ".join(f"{_k(parent, p).replace(p, 'p.' + p)} = {_k(child, c).replace(c, 'c.' + c)}"
                          for c, p in zip(ccols, pcols))
        parts.append(_sel("foreign_key", child, ccols, "count(*)",
                          f"{at(child)} c WHERE {nn} AND NOT EXISTS "
                          f"(SELECT 1 FROM {at(parent)} p WHERE {on})"))
    parts.append(_sel("held_seat_showtime", "booking_seat", ("booking_id", "showtime_id"), "count(*)",
                      f"{at('booking_seat')} bs JOIN {at('booking')} b ON bs.booking_id = b.booking_id "
                      "WHERE bs.showtime_id IS DISTINCT FROM b.showtime_id"))
    parts.append(_sel("held_seat_theater", "booking_seat", ("showtime_id", "theater_id"), "count(*)",
                      f"{at('booking_seat')} bs JOIN {at('showtime')} st ON bs.showtime_id = st.showtime_id "
                      "WHERE bs.theater_id <> st.theater_id"))
    parts.append(_sel("one_payment_per_booking", "payment", ("booking_id",), "count(*)",
                      f"(SELECT booking_id FROM {at('payment')} GROUP BY booking_id HAVING count(*) > 1) d"))
    return with_bridge("\nUNION ALL\n".join(parts), extra)
