import os
import sys
import tempfile
from datetime import datetime
from decimal import Decimal

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from seatspark.session import get_session  # noqa: E402
from seatspark.sources.tables import tables_from_rows  # noqa: E402

SMALL_SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    scratch = tempfile.mkdtemp(prefix="seatspark-test-")
    s = get_session("local[4]", app="seatspark-tests", shuffle_partitions=4,
                    extra={"spark.sql.warehouse.dir": os.path.join(scratch, "warehouse")})
    s.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="seatspark-test-ckpt-"))
    yield s
    s.stop()


def ts(text: str) -> datetime:
    return datetime.fromisoformat(text)


def d(x) -> Decimal:
    return Decimal(str(x)).quantize(Decimal("0.01"))


# Invented seed rows (not the reference's): three theaters, one of them with a
# single seat that is held (sold out); seat '10' to test text order; a title
# with '_'; mixed-case genres and e-mails; a booking without seats; a booking
# with two payments; a movie whose producer is missing; a customer without
# bookings.
SEED = {
    "producer": [(61, "Ava Films"), (62, "Bo Studio"), (63, "Cy Pictures")],
    "users": [(1, "Ann", "ann@x.io", "p1", "customer"), (2, "Ben", "BEN@x.io", "p2", "customer"),
              (3, "Cat", "cat@x.io", "p3", "customer"), (4, "Dee", "dee@x.io", "p4", "staff"),
              (5, "Eve", "eve@x.io", "p5", "admin"), (6, "Fay", "fay@x.io", "p6", "customer")],
    "theater": [(7, "Aster Hall"), (8, "Birch Room"), (9, "Cedar Box")],
    "seat": [("1", 7), ("2", 7), ("3", 7), ("10", 7), ("1", 8), ("2", 8), ("A", 8), ("1", 9)],
    "movie": [(501, 61, "Night_Owl", 95, "owls", None, d(7.1)),
              (502, 62, "NIGHT OWL returns", 100, None, None, None),
              (503, 99, "Quiet Field", 80, "calm", "http://p/503", d(6.0))],
    "movie_genre": [(501, "action"), (501, "Drama"), (502, "Comedy")],
    "showtime": [(11, 501, 7, ts("2026-05-01 18:00"), d(100)), (12, 501, 8, ts("2026-05-02 18:00"), d(80)),
                 (13, 502, 7, ts("2026-05-02 20:00"), d(120)), (14, 503, 9, ts("2026-05-03 10:00"), d(50)),
                 (15, 502, 8, ts("2026-05-04 12:00"), d(90))],
    "booking": [(201, 1, 11, "Confirmed", ts("2026-04-01 09:00")), (202, 2, 11, "Pending", ts("2026-04-01 10:00")),
                (203, 3, 11, "Cancelled", ts("2026-04-02 09:00")), (204, 1, 12, "Used", ts("2026-04-02 10:00")),
                (205, 2, 13, "Pending", ts("2026-04-03 09:00")), (206, 3, 14, "Confirmed", ts("2026-04-03 10:00")),
                (207, 1, 15, "Pending", ts("2026-04-04 09:00"))],
    "booking_seat": [(201, "1", 7, 11), (201, "10", 7, 11), (202, "2", 7, 11), (203, "3", 7, 11),
                     (204, "1", 8, 12), (205, "1", 7, 13), (206, "1", 9, 14)],
    "payment": [(901, 201, d(200), "Confirmed", ts("2026-04-01 09:30")),
                (902, 202, d(100), "Pending", ts("2026-04-01 10:30")),
                (903, 203, d(100), "Refunded", ts("2026-04-02 09:30")),
                (904, 204, d(80), "Confirmed", ts("2026-04-02 10:30")),
                (905, 206, d(50), "Confirmed", ts("2026-04-03 10:30")),
                (906, 206, d(50), "Pending", ts("2026-04-03 11:30"))],
}


@pytest.fixture(scope="session")
def seed(spark):
    return tables_from_rows(spark, SEED)


def rows(df, *cols):
    """Sorted tuples of the given columns (all columns when none given)."""
    cols = cols or tuple(df.columns)
    return sorted(tuple(r[c] for c in cols) for r in df.collect())
