"""M5-M9: inserts, replacements, patches and cascading deletes over snapshots.

Every operator takes the current tables and a batch of change rows (each with
a ``request_id``: the order the reference would have applied them one by
one), and returns the next snapshot plus outcomes ``request_id, outcome``.
Inputs are never modified: the new table is a join of old rows and accepted
changes, written out as a new snapshot by the caller.

In every batch, rows without a request_id are refused as missing_fields and
rows that share one as duplicate_request (they have no order); values that do
not cast count as missing, and so do columns that the batch does not have.

Order matters only through keys: a later insert of a taken key fails, a later
update of the same row wins. Both are resolved with grouped min/max_by over
the key (map-side combined, so a hot key is no bottleneck). Users have two
keys (user_id and e-mail) that interact; see :func:`_settled`.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import (FOREIGN_KEYS, MOVIE_PATCHABLE, PRIMARY_KEYS, SCHEMAS, TABLES,
                       VARCHAR_LIMITS)
from ..session import cut_lineage
from ..sources.tables import Tables, conform, existing
from .admit import usable_ids
from .audit import key_expr
from .links import connected_components

# Fields a request must carry (Python truthiness: null, '', 0 are missing).
REQUIRED = {
    "movie": ("movie_id", "owner_id", "title", "duration"),
    "theater": ("theater_id", "theater_name"),
    "showtime": ("showtime_id", "movie_id", "theater_id", "show_date", "price"),
    "movie_genre": ("movie_id", "genre"),
    "users": ("user_id", "name", "email", "password", "role"),
}


def missing(col: str, dtype: T.DataType) -> Column:
    c = F.col(col)
    if isinstance(dtype, T.StringType):
        return c.isNull() | (c == "")
    if isinstance(dtype, (T.TimestampNTZType, T.TimestampType, T.DateType)):
        return c.isNull()
    return c.isNull() | (c == 0)


def _any(conds: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conds, F.lit(False))


def _too_long(table: str) -> Column:
    return _any([F.length(c) > n for c, n in VARCHAR_LIMITS.get(table, {}).items()])


def _fk_missing(t: Tables, table: str, rows: DataFrame) -> DataFrame:
    """rows + ``_fk_bad``: some non-null FK value has no parent row."""
    out = rows.withColumn("_fk_bad", F.lit(False))
    for i, (child, ccols, parent, pcols, _) in enumerate(FOREIGN_KEYS):
        if child != table:
            continue
        flag = f"_fk{i}"
        parent_keys = (t.get(parent).select(*[key_expr(parent, p, f"_pk{j}")
                                             for j, p in enumerate(pcols)])
                       .distinct().withColumn(flag, F.lit(True)))
        cond = reduce(lambda a, b: a & b,
                      [key_expr(child, c) == F.col(f"_pk{j}") for j, c in enumerate(ccols)])
        nonnull = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in ccols])
        out = (out.join(parent_keys, cond, "left")
               .withColumn("_fk_bad", F.col("_fk_bad") | (nonnull & F.col(flag).isNull()))
               .drop(flag, *[f"_pk{j}" for j in range(len(pcols))]))
    return out


def _typed(rows: DataFrame, table: str) -> tuple[DataFrame, DataFrame]:
    """request_id and the table's columns in their types (null where a value does not cast or the batch
    has no such column), for rows with a request_id of their own; and the outcomes of the others."""
    have = set(rows.columns)
    cols = [(F.col(f.name).try_cast(f.dataType) if f.name in have else F.lit(None).cast(f.dataType)).alias(f.name)
            for f in SCHEMAS[table].fields]
    return usable_ids(rows.select(F.col("request_id").try_cast("long").alias("request_id"), *cols))


def insert_rows(t: Tables, table: str, rows: DataFrame) -> tuple[Tables, DataFrame]:
    """M8: add rows; missing_fields, value_too_long, unknown_reference,
    duplicate_key (existing key or an earlier accepted row of the batch)."""
    req, refused = _typed(rows, table)
    nxt, outcomes = _insert(t, table, req)
    return nxt, outcomes.unionByName(refused)


def _insert(t: Tables, table: str, req: DataFrame) -> tuple[Tables, DataFrame]:
    schema = SCHEMAS[table]
    pk = PRIMARY_KEYS[table]
    if table == "users":
        return _insert_users(t, req)
    need = _any([missing(c, schema[c].dataType) for c in REQUIRED.get(table, pk)])
    keys = [key_expr(table, c, f"_k{i}") for i, c in enumerate(pk)]
    kcols = [f"_k{i}" for i in range(len(pk))]
    have = t.get(table).select(*keys).distinct().withColumn("_exists", F.lit(True))
    checked = cut_lineage(_fk_missing(t, table, req.select("*", *keys))
                          .join(have, kcols, "left"))
    pre = (F.when(need, "missing_fields").when(_too_long(table), "value_too_long")
           .when(F.col("_exists").isNotNull(), "duplicate_key")
           .when(F.col("_fk_bad"), "unknown_reference"))
    checked = checked.withColumn("_pre", pre)
    first = (checked.where(F.col("_pre").isNull()).groupBy(*kcols)
             .agg(F.min("request_id").alias("_first")))
    decided = (checked.join(first, kcols, "left")
               .withColumn("outcome", F.coalesce(
                   F.col("_pre"),
                   F.when(F.col("request_id") == F.col("_first"), "inserted")
                    .otherwise("duplicate_key"))))
    outcomes = decided.select("request_id", "outcome")
    added = conform(decided.where(F.col("outcome") == "inserted"), table)
    return t.with_(**{table: t.get(table).unionByName(added)}), outcomes


#: Rows of linked users that one task folds.
FOLD_ROWS = 20_000


def _round(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted rows, rows still open) after one round over (request_id, k1, k2).

    The lowest request of both its keys is accepted; rows that share a key with it are refused.
    """
    low1 = rows.groupBy("k1").agg(F.min("request_id").alias("low1"))
    low2 = rows.groupBy("k2").agg(F.min("request_id").alias("low2"))
    ranked = cut_lineage(rows.join(low1, "k1").join(low2, "k2"))
    won = ranked.where((F.col("request_id") == F.col("low1")) & (F.col("request_id") == F.col("low2"))).select(
        "request_id", "k1", "k2")
    rest = (ranked.select("request_id", "k1", "k2").join(won.select("k1"), "k1", "left_anti")
            .join(won.select("k2"), "k2", "left_anti"))
    return won, cut_lineage(rest)


def _fold(members: DataFrame) -> DataFrame:
    """request_ids accepted, each ``component`` of (request_id, k1, k2) folded in request order."""
    asked = F.array_sort(F.collect_list(F.struct("request_id", "k1", "k2")))
    empty = F.struct(F.array().cast("array<bigint>").alias("k1"), F.array().cast("array<string>").alias("k2"),
                     F.array().cast("array<bigint>").alias("won"))
    return members.groupBy("component").agg(asked.alias("asked")).select(F.explode(F.aggregate(
        "asked", empty, lambda acc, r: F.when(
            F.array_contains(acc["k1"], r["k1"]) | F.array_contains(acc["k2"], r["k2"]), acc).otherwise(F.struct(
                F.array_append(acc["k1"], r["k1"]).alias("k1"), F.array_append(acc["k2"], r["k2"]).alias("k2"),
                F.array_append(acc["won"], r["request_id"]).alias("won"))))["won"]).alias("request_id"))


def _settled(rows: DataFrame, fold_rows: int = FOLD_ROWS) -> DataFrame:
    """request_ids accepted when rows (request_id, k1 long, k2 text) are served one by one: a row is
    accepted if no accepted one before it has its k1 or its k2.

    Two rounds settle the rows that clash with nothing and thin out hot keys.
    Rows left are tied to the lowest request of each of their keys; the
    connected components of those ties do not affect each other, so each is
    folded on its own, in order, whatever the length of its chains. Components
    above ``fold_rows`` go through two more rounds and fall apart, or come round again.
    """
    accepted, rest = [], rows
    while True:
        for _ in range(2):
            won, rest = _round(rest)
            accepted.append(won.select("request_id"))
        if rest.isEmpty():
            break
        ties = [rest.join(rest.groupBy(k).agg(F.min("request_id").alias("low")), k).select("request_id", "low")
                for k in ("k1", "k2")]
        comps = connected_components(ties[0].unionByName(ties[1]), "request_id", "low")
        placed = cut_lineage(rest.join(comps.select(F.col("node").alias("request_id"), "component"), "request_id", "left")
                             .withColumn("component", F.coalesce("component", "request_id")))  # a row may be left without ties
        large = placed.groupBy("component").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > fold_rows).select("component")
        large = cut_lineage(large)
        accepted.append(cut_lineage(_fold(placed.join(large, "component", "left_anti"))))
        rest = placed.join(large, "component", "left_semi").select("request_id", "k1", "k2")
        if large.isEmpty():
            break
    return reduce(DataFrame.unionByName, accepted)


def _insert_users(t: Tables, req: DataFrame, fold_rows: int = FOLD_ROWS) -> tuple[Tables, DataFrame]:
    schema = SCHEMAS["users"]
    need = _any([missing(c, schema[c].dataType) for c in REQUIRED["users"]])
    ids = t.users.select("user_id").distinct().withColumn("_id_taken", F.lit(True))
    mails = (t.users.select(F.lower("email").alias("_mail")).distinct()
             .withColumn("_mail_taken", F.lit(True)))
    checked = cut_lineage(req.withColumn("_mail", F.lower("email"))
                          .join(ids, "user_id", "left").join(mails, "_mail", "left")
                          .withColumn("_pre", F.when(need, "missing_fields")
                                      .when(_too_long("users"), "value_too_long")
                                      .when(F.col("_id_taken").isNotNull(), "duplicate_key")
                                      .when(F.col("_mail_taken").isNotNull(), "duplicate_email")))
    open_ = checked.where(F.col("_pre").isNull())
    won = _settled(open_.select("request_id", F.col("user_id").alias("k1"), F.col("_mail").alias("k2")), fold_rows)
    accepted = cut_lineage(open_.join(won, "request_id", "left_semi").select(
        "request_id", F.col("user_id").alias("_id"), F.lit(True).alias("_won")))
    # a loser lost its id if an earlier accepted row has the same id, else its email
    holders = accepted.select(F.col("_id").alias("user_id"), F.col("request_id").alias("_holder"))
    decided = (checked.join(accepted.select("request_id", "_won"), "request_id", "left")
               .join(holders, "user_id", "left")
               .withColumn("outcome", F.coalesce(
                   F.col("_pre"), F.when(F.col("_won"), "inserted")
                   .when(F.col("_holder") < F.col("request_id"), "duplicate_key").otherwise("duplicate_email"))))
    added = conform(decided.where(F.col("outcome") == "inserted"), "users")
    return t.with_(users=t.users.unionByName(added)), decided.select("request_id", "outcome")


def register_users(t: Tables, rows: DataFrame) -> tuple[Tables, DataFrame]:
    """M9: public registration: role defaults to customer, any other role refused."""
    schema = SCHEMAS["users"]
    req, refused = _typed(rows, "users")
    need = _any([missing(c, schema[c].dataType) for c in ("user_id", "name", "email", "password")])
    r = req.withColumn("role", F.coalesce("role", F.lit("customer")))
    bad = need | (F.col("role") != "customer")
    refused = refused.unionByName(r.where(bad).select(
        "request_id", F.when(need, "missing_fields").otherwise("role_not_allowed").alias("outcome")))
    nxt, outcomes = _insert(t, "users", r.where(~bad))
    return nxt, outcomes.unionByName(refused)


def replace_showtimes(t: Tables, rows: DataFrame) -> tuple[Tables, DataFrame]:
    """M5: full replacement of movie, theater, date and price of existing showtimes.

    missing_fields, not_found, unknown_reference; of several valid updates of
    one showtime the last (highest request_id) is the one left standing.
    """
    schema = SCHEMAS["showtime"]
    req, refused = _typed(rows, "showtime")
    need = _any([missing(c, schema[c].dataType)
                 for c in ("movie_id", "theater_id", "show_date", "price")])
    have = t.showtime.select("showtime_id").withColumn("_found", F.lit(True))
    checked = cut_lineage(_fk_missing(t, "showtime", req).join(have, "showtime_id", "left"))
    outcome = (F.when(need, "missing_fields").when(F.col("_found").isNull(), "not_found")
               .when(F.col("_fk_bad"), "unknown_reference").otherwise("updated"))
    decided = checked.withColumn("outcome", outcome)
    cols = ["movie_id", "theater_id", "show_date", "price"]
    last = (decided.where(F.col("outcome") == "updated").groupBy("showtime_id")
            .agg(F.max_by(F.struct(*cols), F.col("request_id")).alias("_new")))
    showtime = (t.showtime.join(last, "showtime_id", "left")
                .select("showtime_id", *[F.when(F.col("_new").isNotNull(), F.col(f"_new.{c}"))
                                         .otherwise(F.col(c)).alias(c) for c in cols]))
    return t.with_(showtime=showtime), decided.select("request_id", "outcome").unionByName(refused)


def patch_movies(t: Tables, patches: DataFrame) -> tuple[Tables, DataFrame]:
    """M6: patch allowed movie columns from a ``map<string,string>``.

    Only allowed keys that the Movie table really has are used; a key present
    with a null value sets null. Outcomes: nothing_to_update, not_found,
    invalid_value (does not cast), null_not_allowed (NOT NULL column),
    unknown_reference (owner without producer), else updated. Per column the
    last valid patch carrying the key wins.
    """
    cols = existing(t.movie, list(MOVIE_PATCHABLE))
    schema = SCHEMAS["movie"]
    p, refused = usable_ids(patches.select(F.col("request_id").try_cast("long").alias("request_id"),
                                           F.col("movie_id").try_cast("long").alias("movie_id"), "patch"))
    has = {c: F.map_contains_key(F.coalesce("patch", F.create_map().cast("map<string,string>")),
                                 F.lit(c)) for c in cols}
    vals = {c: F.element_at("patch", F.lit(c)) for c in cols}
    typed = {c: F.when(has[c], vals[c].try_cast(schema[c].dataType)) for c in cols}
    bad_cast = _any([has[c] & vals[c].isNotNull() & typed[c].isNull() for c in cols])
    not_null = [c for c in cols if c in ("title", "duration", "owner_id")]
    null_set = _any([has[c] & vals[c].isNull() for c in not_null])
    too_long = _any([has[c] & (F.length(vals[c]) > n)
                     for c, n in VARCHAR_LIMITS["movie"].items() if c in cols])
    have = t.movie.select("movie_id").withColumn("_found", F.lit(True))
    owners = t.producer.select(F.col("owner_id").alias("_owner")).distinct().withColumn(
        "_owner_ok", F.lit(True))
    rows = (p.select("request_id", "movie_id",
                     *[has[c].alias(f"_has_{c}") for c in cols],
                     *[typed[c].alias(f"_v_{c}") for c in cols],
                     _any(list(has.values())).alias("_any"),
                     bad_cast.alias("_bad"), null_set.alias("_null"), too_long.alias("_long"))
            .join(have, "movie_id", "left"))
    if "owner_id" in cols:
        rows = rows.join(owners, F.col("_v_owner_id") == F.col("_owner"), "left").drop("_owner")
        fk_bad = F.col("_has_owner_id") & F.col("_v_owner_id").isNotNull() & F.col("_owner_ok").isNull()
    else:
        fk_bad = F.lit(False)
    decided = cut_lineage(rows.withColumn("outcome", F.when(~F.col("_any"), "nothing_to_update")
                                          .when(F.col("_found").isNull(), "not_found")
                                          .when(F.col("_bad"), "invalid_value")
                                          .when(F.col("_long"), "value_too_long")
                                          .when(F.col("_null"), "null_not_allowed")
                                          .when(fk_bad, "unknown_reference")
                                          .otherwise("updated")))
    ok = decided.where(F.col("outcome") == "updated")
    # per column: the value of the last valid patch that carries the column
    last = ok.groupBy("movie_id").agg(*[
        F.max_by(F.struct(F.col(f"_v_{c}").alias("v")),
                 F.when(F.col(f"_has_{c}"), F.col("request_id"))).alias(f"_n_{c}") for c in cols])
    movie = (t.movie.join(last, "movie_id", "left")
             .select(*[F.when(F.col(f"_n_{f.name}").isNotNull(), F.col(f"_n_{f.name}.v"))
                        .otherwise(F.col(f.name)).alias(f.name)
                       if f.name in cols else F.col(f.name) for f in schema.fields]))
    return t.with_(movie=movie), decided.select("request_id", "outcome").unionByName(refused)


# ---- cascading delete ----------------------------------------------------------------

def _children(table: str):
    return [(c, cc, pc, cascade) for c, cc, p, pc, cascade in FOREIGN_KEYS if p == table]


def _cascade_order(table: str) -> list[str]:
    """The tables that a delete in ``table`` may reach, parents before their children."""
    reached, edges = {table}, []
    frontier = [table]
    while frontier:
        parent = frontier.pop()
        for child, _, _, cascade in _children(parent):
            if cascade:
                edges.append((parent, child))
                if child not in reached:
                    reached.add(child)
                    frontier.append(child)
    order = []
    while len(order) < len(reached):
        order += [n for n in TABLES if n in reached and n not in order
                  and all(p in order for p, c in edges if c == n)]
    return order


def _matches(child: str, ccols: tuple[str, ...], keys: DataFrame) -> tuple[DataFrame, Column]:
    """``keys`` under names of their own, and the condition that a row of ``child`` refers to one."""
    named = keys.toDF(*[f"_p{i}" for i in range(len(ccols))])
    return named, reduce(lambda a, b: a & b, [key_expr(child, c) == F.col(f"_p{i}") for i, c in enumerate(ccols)])


def delete_cascade(t: Tables, table: str, keys: DataFrame) -> tuple[Tables, DataFrame]:
    """M7: delete rows of ``table`` by key, following ON DELETE CASCADE.

    ``keys`` holds ``request_id`` and the key columns of ``table``. Outcomes:
    deleted, not_found, restricted (a non-cascading child row still points at
    the row, e.g. a producer with movies). Only short sets of doomed primary
    keys travel down the FK graph, parents first: a table keeps its rows by one
    anti join for each foreign key to a table that loses some, and passes on
    the keys of the rows it loses (one semi join for each) if it has children
    of its own. Whole rows are never gathered as doomed.
    """
    pk = PRIMARY_KEYS[table]
    req, refused = _typed(keys.select("request_id", *existing(keys, pk)), table)
    kexprs = [key_expr(table, c, f"_k{i}") for i, c in enumerate(pk)]
    kcols = [f"_k{i}" for i in range(len(pk))]
    have = t.get(table).select(*kexprs).distinct().withColumn("_found", F.lit(True))
    restricted = F.lit(False)
    checked = req.select("request_id", *kexprs).join(have, kcols, "left")
    for child, ccols, pcols, cascade in _children(table):
        if cascade:
            continue
        refs = (t.get(child).select(*[key_expr(child, c, f"_k{pcols.index(p)}")
                                      for c, p in zip(ccols, pcols)])
                .distinct().withColumn(f"_ref_{child}", F.lit(True)))
        checked = checked.join(refs, kcols, "left")
        restricted = restricted | F.col(f"_ref_{child}").isNotNull()
    decided = cut_lineage(checked.withColumn(
        "outcome", F.when(F.col("_found").isNull(), "not_found")
        .when(restricted, "restricted").otherwise("deleted")))

    first, *others = _cascade_order(table)
    # doomed primary keys, columns in the order of PRIMARY_KEYS (every foreign key refers to a whole one)
    gone = {first: cut_lineage(decided.where(F.col("outcome") == "deleted").select(*kcols).distinct())}
    named, cond = _matches(first, pk, gone[first])
    new = {first: t.get(first).join(named, cond, "left_anti")}
    for name in others:
        old, own = t.get(name), PRIMARY_KEYS[name]
        kept, lost = old, []
        for child, ccols, parent, pcols, cascade in FOREIGN_KEYS:
            if child == name and cascade and parent in gone:
                in_order = tuple(ccols[pcols.index(c)] for c in PRIMARY_KEYS[parent])
                named, cond = _matches(name, in_order, gone[parent])
                kept = kept.join(named, cond, "left_anti")
                lost.append(old.join(named, cond, "left_semi").select(*[key_expr(name, c) for c in own]))
        new[name] = kept
        if any(cascade for *_, cascade in _children(name)):
            gone[name] = cut_lineage(reduce(DataFrame.unionByName, lost).distinct())
    return t.with_(**new), decided.select("request_id", "outcome").unionByName(refused)


def table_sizes(t: Tables) -> DataFrame:
    """table_name, rows: one small row per table (a summary of a snapshot)."""
    parts = [t.get(n).agg(F.count(F.lit(1)).alias("rows")).select(
        F.lit(n).alias("table_name"), "rows") for n in TABLES]
    return reduce(DataFrame.unionByName, parts)
