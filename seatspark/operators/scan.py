"""Ordered per-key folds over a finite state set, without gathering a key's rows.

A fold ``state = step(state, event)`` in ``order`` within each key is
sequential, and one key may hold a large share of all events. When the state
takes few values (K), every run of events is a function {0..K-1} -> {0..K-1}
(an array of K ints), and such functions compose. So:

1. Chunks: an event's rank within its key comes from its position in a range
   partitioning by (key, order), so chunk ``rank div W`` holds exactly W events
   (the last one fewer), however sparse or large the order values are. A
   chunk's function is its events applied to each of the K start states.
2. Up-sweep: chunk functions are grouped W at a time (``floor(c / W)``) and
   composed, level after level, until one group per key is left; each child
   keeps the composition of the children before it (its prefix).
3. Down-sweep: the key's start state goes down the tree (start of a child =
   its prefix applied to its parent's start), then each chunk replays its
   events from its own start, giving every event the state before it.

No group ever exceeds W elements, whatever the key skew, and the levels
number log_W(events of the largest key). Each level is checkpointed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .ids import next_ids

Step = Callable[[Column, Column], Column]  # (state int, event struct) -> next state int


def _levels(most: int, width: int) -> int:
    """Levels of the tree over a key of ``most`` events."""
    levels = 1
    while (most - 1) // width ** levels:
        levels += 1
    return levels


def _div(value: Column, width: int) -> Column:
    return F.call_function("div", value, F.lit(width).cast("long"))


def ranked(events: DataFrame, key: str, order: str) -> DataFrame:
    """``events`` with ``rank``: 0, 1, 2, ... within each key, by ``order``; (key, order) is unique.

    Positions over all keys come first (no key is gathered), then each key's
    smallest one is taken off.
    """
    placed = next_ids(events, [key, order], 0, "_place")
    first = placed.groupBy(key).agg(F.min("_place").alias("_first"))
    return placed.join(first, key).withColumn("rank", F.col("_place") - F.col("_first")).drop("_place", "_first")


def _apply(fn: Column, state: Column) -> Column:
    return F.element_at(fn, state + 1)


def _compose(children: Column, n_states: int) -> Column:
    """struct(total, prefixes): total = children applied in order; prefixes[i] = before child i."""
    ident = F.sequence(F.lit(0), F.lit(n_states - 1))
    init = F.struct(ident.alias("cur"), F.array().cast("array<array<int>>").alias("pre"))
    return F.aggregate(
        children, init,
        lambda acc, ch: F.struct(
            F.transform(acc["cur"], lambda x: _apply(ch["fn"], x)).alias("cur"),
            F.array_append(acc["pre"], acc["cur"]).alias("pre")))


def _replay(groups: DataFrame, key: str, step: Step) -> DataFrame:
    """(key, evs sorted, s = start state) -> one row per event with state_before."""
    init = F.struct(F.col("s").alias("cur"), F.array().cast("array<int>").alias("before"))
    replay = groups.select(key, "evs", F.aggregate(
        F.col("evs"), init,
        lambda acc, e: F.struct(step(acc["cur"], e).cast("int").alias("cur"),
                                F.array_append(acc["before"], acc["cur"]).alias("before")))
        ["before"].alias("before"))
    pairs = F.transform("evs", lambda e, i: F.struct(
        e.alias("e"), F.element_at(F.col("before"), i + 1).alias("b")))
    return (replay.select(key, F.explode(pairs).alias("z"))
            .select(key, "z.e.*", F.col("z.b").alias("state_before")))


def _hot_scan(ev: DataFrame, key: str, order: str, cols: list[str], st: DataFrame,
              step: Step, n_states: int, width: int, most: int) -> DataFrame:
    """Events of keys with more than ``width`` events: chunk functions + tree."""
    levels = _levels(most, width)

    # level 1: chunks of `width` events, sorted, with their function
    chunks = cut_lineage(
        ranked(ev, key, order).groupBy(key, _div(F.col("rank"), width).alias("c"))
          .agg(F.array_sort(F.collect_list(F.struct(*cols))).alias("evs"))
          .withColumn("fn", F.transform(
              F.sequence(F.lit(0), F.lit(n_states - 1)),
              lambda s0: F.aggregate(F.col("evs"), s0.cast("int"),
                                     lambda s, e: step(s, e).cast("int")))))

    # up-sweep: compose W children at a time, keep each child's prefix
    tiers = []  # per level >= 2: (key, c, children[struct(kc, kpre)])
    below = chunks.select(key, "c", "fn")
    for _ in range(2, levels + 1):
        grouped = (below.groupBy(key, _div(F.col("c"), width).alias("p"))
                   .agg(F.array_sort(F.collect_list(F.struct("c", "fn"))).alias("kids")))
        comp = grouped.select(key, "p", "kids", _compose(F.col("kids"), n_states).alias("x"))
        tier = cut_lineage(comp.select(
            key, F.col("p").alias("c"), F.col("x.cur").alias("fn"),
            F.transform("kids", lambda k, i: F.struct(
                k["c"].alias("kc"), F.element_at(F.col("x.pre"), i + 1).alias("kpre")))
            .alias("kids")))
        tiers.append(tier)
        below = tier.select(key, "c", "fn")

    # down-sweep: start states from the top tier to the chunks
    top = below.select(key, "c").join(st, key)
    for tier in reversed(tiers):
        kids = (tier.join(top, [key, "c"])
                .select(key, "s", F.explode("kids").alias("k"))
                .select(key, F.col("k.kc").alias("c"),
                        _apply(F.col("k.kpre"), F.col("s")).alias("s")))
        top = cut_lineage(kids)
    return _replay(chunks.join(top, [key, "c"]), key, step)


def fold_scan(events: DataFrame, key: str, order: str, fields: list[str], start: DataFrame,
              step: Step, n_states: int, width: int = 1024) -> DataFrame:
    """Add ``state_before`` and ``state_after`` to every event.

    ``start`` has (key, state) for every key of ``events``; ``fields`` are the
    event columns ``step`` reads (as struct fields). Keys with at most
    ``width`` events (almost all) are folded directly from their start state
    in one bounded group; only hotter keys take the chunk-function tree.
    """
    ev = events.select(key, order, *[c for c in fields if c not in (key, order)])
    cols = [order] + [c for c in fields if c not in (key, order)]
    st = start.select(key, F.col(start.columns[1]).cast("int").alias("s"))
    sizes = cut_lineage(ev.groupBy(key).agg(F.count(F.lit(1)).alias("n")))
    cool_keys = sizes.where(F.col("n") <= width).select(key)
    hot_keys = sizes.where(F.col("n") > width).select(key)

    cool = (ev.join(cool_keys, key, "left_semi").groupBy(key)
            .agg(F.array_sort(F.collect_list(F.struct(*cols))).alias("evs"))
            .join(st, key))
    out = _replay(cool, key, step)
    most = sizes.agg(F.max("n")).first()[0] or 0
    if most > width:
        hot = ev.join(hot_keys, key, "left_semi")
        out = out.unionByName(_hot_scan(hot, key, order, cols, st, step, n_states, width, most))
    return out.withColumn("state_after",
                          step(F.col("state_before"), F.struct(*[F.col(c) for c in cols])).cast("int"))
