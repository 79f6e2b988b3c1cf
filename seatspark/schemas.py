"""Table schemas, keys, foreign keys and status sets of the booking data model."""

from __future__ import annotations

from pyspark.sql import types as T

LONG = T.LongType()
INT = T.IntegerType()
STR = T.StringType()
TS = T.TimestampNTZType()
MONEY = T.DecimalType(10, 2)
RATING = T.DecimalType(3, 1)
# Totals (count x price, sums) are reported as decimal(18,2) everywhere.
TOTAL = T.DecimalType(18, 2)


def _struct(*fields: tuple[str, T.DataType, bool]) -> T.StructType:
    return T.StructType([T.StructField(n, t, nullable) for n, t, nullable in fields])


SCHEMAS: dict[str, T.StructType] = {
    "producer": _struct(("owner_id", LONG, False), ("owner_name", STR, True)),
    "users": _struct(("user_id", LONG, False), ("name", STR, True), ("email", STR, True),
                     ("password", STR, True), ("role", STR, True)),
    "theater": _struct(("theater_id", LONG, False), ("theater_name", STR, True)),
    "movie": _struct(("movie_id", LONG, False), ("owner_id", LONG, True), ("title", STR, True),
                     ("duration", INT, True), ("description", STR, True),
                     ("poster_url", STR, True), ("rating", RATING, True)),
    "showtime": _struct(("showtime_id", LONG, False), ("movie_id", LONG, True),
                        ("theater_id", LONG, True), ("show_date", TS, True),
                        ("price", MONEY, True)),
    "movie_genre": _struct(("movie_id", LONG, False), ("genre", STR, True)),
    "booking": _struct(("booking_id", LONG, False), ("user_id", LONG, True),
                       ("showtime_id", LONG, True), ("status", STR, True),
                       ("booking_date", TS, True)),
    "seat": _struct(("seat_number", STR, False), ("theater_id", LONG, False)),
    "booking_seat": _struct(("booking_id", LONG, False), ("seat_number", STR, False),
                            ("theater_id", LONG, False), ("showtime_id", LONG, True)),
    "payment": _struct(("payment_id", LONG, False), ("booking_id", LONG, True),
                       ("amount", MONEY, True), ("status", STR, True),
                       ("payment_date", TS, True)),
}

TABLES = tuple(SCHEMAS)

# Fixed values of the data model (they must equal the reference's).
BOOKING_STATUSES = ("Pending", "Confirmed", "Cancelled", "Used")
PAYMENT_STATUSES = ("Pending", "Confirmed", "Refunded", "Cancelled")
ACTIVE_HOLD_STATUSES = ("Pending", "Confirmed")
ROLES = ("customer", "staff", "admin")
STAFF_ROLES = ("staff", "admin")
NO_PAYMENT = "NoPayment"
MOVIE_PATCHABLE = ("title", "duration", "owner_id", "description", "poster_url", "rating")

PRIMARY_KEYS: dict[str, tuple[str, ...]] = {
    "producer": ("owner_id",),
    "users": ("user_id",),
    "theater": ("theater_id",),
    "movie": ("movie_id",),
    "showtime": ("showtime_id",),
    "movie_genre": ("movie_id", "genre"),
    "booking": ("booking_id",),
    "seat": ("seat_number", "theater_id"),
    "booking_seat": ("booking_id", "seat_number", "theater_id"),
    "payment": ("payment_id",),
}

UNIQUE_KEYS: dict[str, tuple[tuple[str, ...], ...]] = {
    "users": (("email",),),
    "booking_seat": (("seat_number", "theater_id", "showtime_id"),),
}

NOT_NULL: dict[str, tuple[str, ...]] = {
    "producer": ("owner_id", "owner_name"),
    "users": ("user_id", "name", "email", "password", "role"),
    "theater": ("theater_id", "theater_name"),
    "movie": ("movie_id", "owner_id", "title", "duration"),
    "showtime": ("showtime_id", "movie_id", "theater_id", "show_date", "price"),
    "movie_genre": ("movie_id", "genre"),
    "booking": ("booking_id", "user_id", "showtime_id", "status", "booking_date"),
    "seat": ("seat_number", "theater_id"),
    "booking_seat": ("booking_id", "seat_number", "theater_id", "showtime_id"),
    "payment": ("payment_id", "booking_id", "amount", "status"),
}

# VARCHAR lengths of the DDL.
VARCHAR_LIMITS: dict[str, dict[str, int]] = {
    "producer": {"owner_name": 100},
    "users": {"name": 100, "email": 100, "password": 100, "role": 10},
    "theater": {"theater_name": 100},
    "movie": {"title": 100, "description": 255, "poster_url": 255},
    "movie_genre": {"genre": 100},
    "booking": {"status": 20},
    "seat": {"seat_number": 10},
    "booking_seat": {"seat_number": 10},
    "payment": {"status": 20},
}

STATUS_SETS: dict[str, tuple[str, ...]] = {
    "booking": BOOKING_STATUSES,
    "payment": PAYMENT_STATUSES,
}

# Foreign keys: (child, child columns, parent, parent columns, cascades on delete).
FOREIGN_KEYS: tuple[tuple[str, tuple[str, ...], str, tuple[str, ...], bool], ...] = (
    ("movie", ("owner_id",), "producer", ("owner_id",), False),
    ("showtime", ("movie_id",), "movie", ("movie_id",), True),
    ("showtime", ("theater_id",), "theater", ("theater_id",), True),
    ("movie_genre", ("movie_id",), "movie", ("movie_id",), True),
    ("booking", ("user_id",), "users", ("user_id",), True),
    ("booking", ("showtime_id",), "showtime", ("showtime_id",), True),
    ("seat", ("theater_id",), "theater", ("theater_id",), True),
    ("booking_seat", ("booking_id",), "booking", ("booking_id",), True),
    ("booking_seat", ("seat_number", "theater_id"), "seat", ("seat_number", "theater_id"), True),
    ("booking_seat", ("showtime_id",), "showtime", ("showtime_id",), True),
    ("payment", ("booking_id",), "booking", ("booking_id",), True),
)

# Request and event tables of the bulk changes.
BOOKING_REQUEST = _struct(("request_id", LONG, False), ("user_id", LONG, True),
                          ("showtime_id", LONG, True),
                          ("seats", T.ArrayType(STR, True), True),
                          ("requested_at", TS, True))
BOOKING_EVENT = _struct(("booking_id", LONG, True), ("seq", LONG, False),
                        ("action", STR, True), ("actor_id", LONG, True),
                        ("new_status", STR, True), ("at", TS, True))
BOOKING_MOVE = _struct(("request_id", LONG, False), ("booking_id", LONG, True),
                       ("actor_id", LONG, True), ("showtime_id", LONG, True),
                       ("seats", T.ArrayType(STR, True), True))
MOVIE_PATCH = _struct(("request_id", LONG, False), ("movie_id", LONG, True),
                      ("patch", T.MapType(STR, STR, True), True))
