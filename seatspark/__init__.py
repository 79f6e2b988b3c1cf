"""seatspark: seat booking analytics on Spark DataFrames.

    from seatspark import get_session, load_tables, reports, admit_bookings
    t = load_tables(spark, "s3://bucket/booking-snapshot")
    reports.revenue_by_movie(t).write.parquet(...)
    nxt, outcomes = admit_bookings(t, requests)
"""

from .operators.admit import admit_bookings
from .operators.audit import audit, violations_only
from .operators.dml import (delete_cascade, insert_rows, patch_movies, register_users,
                            replace_showtimes, table_sizes)
from .operators.events import apply_booking_events
from .operators.ids import next_ids
from .operators.moves import reassign_bookings
from .plans import reports, views
from .session import checkpoint_dir, get_session
from .sources.requests import read_requests, requests_from_text
from .sources.tables import (Tables, load_catalog_tables, load_tables, save_bucketed,
                             tables_from_rows, write_tables)

__all__ = [
    "Tables", "admit_bookings", "apply_booking_events", "audit", "checkpoint_dir",
    "delete_cascade", "get_session", "insert_rows", "load_catalog_tables", "load_tables",
    "next_ids", "patch_movies", "read_requests", "reassign_bookings", "register_users",
    "replace_showtimes", "reports", "requests_from_text", "save_bucketed", "table_sizes",
    "tables_from_rows", "views", "violations_only", "write_tables",
]
