"""Constraint audit: the DDL's keys, NOT NULLs, CHECKs, FKs and lengths as a batch job.

MySQL enforces these on every write; here they are checked over whole tables.
The result has one row per check, zero violations included:
``rule, table_name, columns, violations``.

All checks are settled by one tagged-key aggregation. Every table is scanned
once, and each row emits a short row for each key it takes part in: the key's
domain (a referenced primary key, or a unique key), the key itself, the side
(the table that owns the key, or one of the tables that refer to it) and, where
a check compares a column across the two sides, that column's value. Row-local
violations (NOT NULL, status sets, lengths, number ranges) are emitted the same
way, only where there are some. Three aggregates follow:

1. counts by (domain, key, value), combined in the map tasks, so a key that
   holds a third of all rows costs a row per map task;
2. by (domain, key): is the key repeated, is it referred to but absent, do the
   values of the two sides differ;
3. by domain: a row for each, turned into one row per check.

Text keys compare lower-cased, as the reference's case-insensitive collation does.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import (FOREIGN_KEYS, NOT_NULL, PRIMARY_KEYS, SCHEMAS, STATUS_SETS, UNIQUE_KEYS,
                       VARCHAR_LIMITS)
from ..sources.tables import Tables


def _is_text(table: str, col: str) -> bool:
    return isinstance(SCHEMAS[table][col].dataType, T.StringType)


def key_expr(table: str, col: str, alias: str | None = None) -> Column:
    c = F.lower(F.col(col)) if _is_text(table, col) else F.col(col)
    return c.alias(alias or col)


class Domain(NamedTuple):
    """A key, the tables that refer to it, and the columns compared across.

    ``refs``: (table, columns in the order of the key). ``compared``: (rule,
    columns it is listed under, index in ``refs``, the referring table's column,
    the owner's column, whether nulls count as different).
    """

    owner: str
    key: tuple[str, ...]
    rule: str
    refs: tuple[tuple[str, tuple[str, ...]], ...] = ()
    compared: tuple[str, tuple[str, ...], int, str, str, bool] | None = None


# Held seats must agree with their booking's showtime and with that showtime's theater.
_AGREEMENT = {
    "booking": ("held_seat_showtime", ("booking_id", "showtime_id"), "showtime_id", "showtime_id", True),
    "showtime": ("held_seat_theater", ("showtime_id", "theater_id"), "theater_id", "theater_id", False),
}
#: Keys that another table may use once only, beside the DDL's own unique keys.
_ONCE = ("one_payment_per_booking", "payment", ("booking_id",))


def domains() -> list[Domain]:
    """Every key that some check is about, in a fixed order."""
    out = []
    for owner, key in PRIMARY_KEYS.items():
        refs = []
        for child, ccols, parent, pcols, _ in FOREIGN_KEYS:
            if parent == owner:
                refs.append((child, tuple(ccols[pcols.index(k)] for k in key)))
        compared = None
        if owner in _AGREEMENT:
            rule, listed, child_col, owner_col, nulls = _AGREEMENT[owner]
            at = next(i for i, (child, _) in enumerate(refs) if child == "booking_seat")
            compared = (rule, listed, at, child_col, owner_col, nulls)
        out.append(Domain(owner, key, "primary_key", tuple(refs), compared))
    out += [Domain(tb, cols, "unique") for tb, keys in UNIQUE_KEYS.items() for cols in keys]
    out.append(Domain(_ONCE[1], _ONCE[2], _ONCE[0]))
    return out


def _decimal_columns(table: str) -> list[str]:
    return [f.name for f in SCHEMAS[table].fields if isinstance(f.dataType, T.DecimalType)]


def row_checks(table: str) -> list[tuple[str, str, str]]:
    """(rule, column, SQL condition of a violation) of the checks that need one row of ``table`` only.

    Number ranges are checked on whatever type the column has: text that is no
    number and numbers of too many digits count, as an insert would be refused.
    """
    out = [("not_null", c, f"{c} IS NULL") for c in NOT_NULL.get(table, ())]
    if table in STATUS_SETS:
        allowed = ", ".join(f"'{x}'" for x in STATUS_SETS[table])
        out.append(("status_set", "status", f"status NOT IN ({allowed})"))
    out += [("varchar_length", c, f"length({c}) > {n}") for c, n in VARCHAR_LIMITS.get(table, {}).items()]
    out += [("decimal_range", c, f"({c} IS NOT NULL AND try_cast({c} AS {SCHEMAS[table][c].dataType.simpleString()}) IS NULL)")
            for c in _decimal_columns(table)]
    return out


def _entry(table: str, domain: int, cols: tuple[str, ...], side: int, value: str | None = None) -> str:
    """SQL of one entry. A key is two numbers and a text, null where it has fewer; no key has more."""
    texts = [f"lower({c})" for c in cols if _is_text(table, c)] + ["NULL"]
    longs = [c for c in cols if not _is_text(table, c)] + ["NULL", "NULL"]
    return (f"named_struct('domain', {domain}, 'k0', CAST({longs[0]} AS BIGINT), 'k1', CAST({longs[1]} AS BIGINT), "
            f"'k2', CAST({texts[0]} AS STRING), 'value', CAST({value or 'NULL'} AS BIGINT), 'side', {side})")


def _emitted(t: Tables, table: str, doms: list[Domain], local: dict[tuple[str, str, str], int]) -> DataFrame:
    """The entries of one table's rows; row-local violations are entries of domains of their own.

    The expressions are SQL text, which the planner takes in one piece; as Python columns they are
    thousands of calls.
    """
    whole = lambda cols: " AND ".join(f"{c} IS NOT NULL" for c in cols)
    entries = []
    for i, d in enumerate(doms):
        if d.owner == table:
            entry = _entry(table, i, d.key, 0, d.compared[4] if d.compared else None)
            # a unique index ignores rows with a null in the key
            entries.append(f"IF({whole(d.key)}, {entry}, NULL)" if d.rule == "unique" else entry)
        for j, (child, cols) in enumerate(d.refs):
            if child == table:
                value = d.compared[3] if d.compared and d.compared[2] == j else None
                entries.append(f"IF({whole(cols)}, {_entry(table, i, cols, j + 1, value)}, NULL)")
    made = f"array({', '.join(entries)})"
    broken = [(cond, _entry(table, local[rule, table, col], (), 0)) for rule, col, cond in row_checks(table)]
    if broken:  # few rows break a rule of their own, so only those carry the entries for it
        some = " OR ".join(f"coalesce({cond}, false)" for cond, _ in broken)
        made = f"IF({some}, concat({made}, array({', '.join(f'IF({cond}, {entry}, NULL)' for cond, entry in broken)})), {made})"
    return t.get(table).select(F.explode(F.expr(made)).alias("e")).where("e is not null").select("e.*")


def audit(t: Tables) -> DataFrame:
    """C1-C5, C7-C9 over whole tables: one row per check."""
    doms = domains()
    local = {}
    for tb in SCHEMAS:
        for rule, col, _ in row_checks(tb):
            local[rule, tb, col] = len(doms) + len(local)
    emitted = reduce(DataFrame.unionByName, [_emitted(t, tb, doms, local) for tb in SCHEMAS])

    sides = max(len(d.refs) for d in doms)
    n = lambda k: F.count_if(F.col("side") == k).alias(f"n{k}")
    by_value = emitted.groupBy("domain", "k0", "k1", "k2", "value").agg(*[n(k) for k in range(sides + 1)])

    # pairs of rows across the two sides, less those of equal value
    differ = F.lit(None).cast("decimal(38,0)")
    product = lambda a, b: F.col(a).cast("decimal(19,0)") * F.col(b).cast("decimal(19,0)")
    sums = [F.sum(f"n{k}").alias(f"n{k}") for k in range(sides + 1)]
    for i, d in enumerate(doms):
        if d.compared:
            at = f"n{d.compared[2] + 1}"
            same, valued = f"same{i}", F.col("value").isNotNull() | F.lit(d.compared[5])
            here = F.col("domain") == i
            sums += [F.sum(F.when(here & valued, product("n0", at))).alias(same),
                     F.sum(F.when(here & valued, F.col("n0"))).alias(f"own{i}"),
                     F.sum(F.when(here & valued, F.col(at))).alias(f"ref{i}")]
            differ = F.when(here, product(f"own{i}", f"ref{i}") - F.col(same)).otherwise(differ)
    by_key = by_value.groupBy("domain", "k0", "k1", "k2").agg(*sums)
    measures = [F.sum(F.when(F.col("domain") >= len(doms), F.col("n0")).otherwise((F.col("n0") > 1).cast("long"))).alias("m0")]
    measures += [F.sum(F.when(F.col("n0") == 0, F.col(f"n{k}")).otherwise(0)).alias(f"m{k}") for k in range(1, sides + 1)]
    measures.append(F.sum(differ).alias(f"m{sides + 1}"))
    by_domain = by_key.groupBy("domain").agg(*measures)
    found = by_domain.select("domain", F.posexplode(F.array(*[
        F.col(f"m{k}").cast("long") for k in range(sides + 2)])).alias("measure", "n"))

    checks = [(i, 0, d.rule, d.owner, ",".join(d.key)) for i, d in enumerate(doms)]
    checks += [(i, j + 1, "foreign_key", child, ",".join(_listed(child, d.owner, cols)))
               for i, d in enumerate(doms) for j, (child, cols) in enumerate(d.refs)]
    checks += [(i, sides + 1, d.compared[0], d.refs[d.compared[2]][0], ",".join(d.compared[1]))
               for i, d in enumerate(doms) if d.compared]
    checks += [(i, 0, *key) for key, i in local.items()]
    listed = t.booking.sparkSession.createDataFrame(
        checks, "domain int, measure int, rule string, table_name string, columns string")
    return listed.join(found, ["domain", "measure"], "left").select(
        "rule", "table_name", "columns", F.coalesce("n", F.lit(0)).cast("long").alias("violations"))


def _listed(child: str, parent: str, cols: tuple[str, ...]) -> tuple[str, ...]:
    """The foreign key's columns in the order of the DDL."""
    return next(cc for c, cc, p, _, _ in FOREIGN_KEYS if c == child and p == parent and set(cc) == set(cols))


def check_list() -> list[tuple[str, str, str]]:
    """(rule, table, columns) of every check."""
    out = [(d.rule, d.owner, ",".join(d.key)) for d in domains()]
    out += [(rule, tb, col) for tb in SCHEMAS for rule, col, _ in row_checks(tb)]
    out += [("foreign_key", child, ",".join(cc)) for child, cc, _, _, _ in FOREIGN_KEYS]
    return out + [(rule, "booking_seat", ",".join(listed)) for rule, listed, *_ in _AGREEMENT.values()]


def violations_only(t: Tables) -> DataFrame:
    return audit(t).where(F.col("violations") > 0)
