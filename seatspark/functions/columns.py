"""Column-level helpers: predicates, money, text ordering, display flags.

All are built-in Spark expressions, so they stay inside whole-stage codegen.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import ACTIVE_HOLD_STATUSES, STAFF_ROLES, TOTAL



def empty_strings() -> Column:
    """An empty array<string> literal (built lazily: needs an active session)."""
    return F.array().cast("array<string>")


# ---- predicates -----------------------------------------------------------

def contains_ci(col: Column | str, text: str) -> Column:
    """``col LIKE '%text%'`` under a case-insensitive collation.

    The text is not escaped: ``_`` and ``%`` act as wildcards, as in the
    reference's parameterised LIKE.
    """
    return F.col(col).ilike(f"%{text}%") if isinstance(col, str) else col.ilike(f"%{text}%")


def equals_ci(col: Column | str, text: str) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    return F.lower(c) == F.lower(F.lit(text))


def date_equals(col: Column | str, day: str) -> Column:
    """``DATE(col) = 'yyyy-mm-dd'``."""
    c = F.col(col) if isinstance(col, str) else col
    return F.to_date(c) == F.lit(day).cast("date")


def all_of(preds: list[Column]) -> Column:
    """AND of only the filters given; no filter means every row."""
    return reduce(and_, preds, F.lit(True))


def actively_held(status: Column | str = "status") -> Column:
    c = F.col(status) if isinstance(status, str) else status
    return c.isin(*ACTIVE_HOLD_STATUSES)


def visible_to(df: DataFrame, user_id: int | None = None, role: str | None = None,
               owner_col: str = "user_id") -> DataFrame:
    """Staff and admin see all rows; any other caller sees their own, and none without an id.

    Called with neither id nor role, there is no caller to hide rows from (a report run by the house).
    """
    if role in STAFF_ROLES or (user_id is None and role is None):
        return df
    if user_id is None:
        return df.where(F.lit(False))
    return df.where(F.col(owner_col) == F.lit(user_id))


def customers_only(df: DataFrame, role_col: str = "role") -> DataFrame:
    return df.where(F.col(role_col) == "customer")


# ---- money ----------------------------------------------------------------

def seat_total(seat_count: Column | str, price: Column | str) -> Column:
    """``COUNT(seat) * price`` as decimal(18,2)."""
    n = F.col(seat_count) if isinstance(seat_count, str) else seat_count
    p = F.col(price) if isinstance(price, str) else price
    return (n * p).cast(TOTAL)


def as_total(col: Column | str) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    return c.cast(TOTAL)


# ---- text -----------------------------------------------------------------

def sorted_ci(arr: Column) -> Column:
    """Sort strings as a case-insensitive collation does: lower(x), then x."""
    keyed = F.transform(arr, lambda x: F.struct(F.lower(x).alias("k"), x.alias("v")))
    return F.transform(F.array_sort(keyed), lambda s: s["v"])


def joined(arr: Column, sep: str = ", ") -> Column:
    """``GROUP_CONCAT(x ORDER BY x SEPARATOR sep)`` from an already sorted array."""
    return F.array_join(arr, sep)


def split_seat_text(text: Column) -> Column:
    """A typed seat list ``'1, 2,3'`` -> ``['1', '2', '3']`` (trimmed)."""
    return F.transform(F.split(text, ","), lambda x: F.trim(x))


def seats_or_full(seats: Column) -> Column:
    """The UI shows FULL for an empty seat string."""
    return F.when(seats.isNull() | (F.trim(seats) == ""), F.lit("FULL")).otherwise(seats)


def display_date(col: Column | str) -> Column:
    """The UI's short date text (month/day/year, no leading zeros)."""
    c = F.col(col) if isinstance(col, str) else col
    return F.date_format(c, "M/d/yyyy")


def without(arr: Column, blocked: Column) -> Column:
    """Elements of ``arr`` whose lower case is not in ``blocked`` (order and repeats of arr kept)."""
    blocked = F.coalesce(blocked, empty_strings())
    return F.filter(arr, lambda s: ~F.array_contains(blocked, F.lower(s)))
