"""M4: dense new ids (max + 1, max + 2, ...) in a given order, at scale.

``row_number()`` over an un-partitioned window would pull every row into one
task. Instead: range-partition and sort by the order columns, take each row's
position inside its partition, count rows per partition (one small row per
partition), turn the counts into offsets and add them back. The partition
table has one row per shuffle partition, so broadcasting it is bounded by
configuration, not by data. The positioned rows are checkpointed first, so a
lost executor cannot recompute different positions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

_POS_BITS = 33  # monotonically_increasing_id = partition index << 33 | position


def next_ids(df: DataFrame, order_cols: list[str], base: Column | int,
             id_col: str = "new_id") -> DataFrame:
    """Add ``id_col`` = base + 1 + rank of the row by ``order_cols`` (unique order)."""
    base_col = base if isinstance(base, Column) else F.lit(base)
    positioned = cut_lineage(
        df.repartitionByRange(*order_cols)
          .sortWithinPartitions(*order_cols)
          .withColumn("_mid", F.monotonically_increasing_id()))
    part = F.shiftright(F.col("_mid"), _POS_BITS)
    pos = F.col("_mid").bitwiseAND(F.lit((1 << _POS_BITS) - 1))
    counts = positioned.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    offsets = counts.select(
        "_part",
        (F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)))
        .alias("_off"))
    return (positioned.withColumn("_part", part).withColumn("_pos", pos)
            .join(F.broadcast(offsets), "_part")
            .withColumn(id_col, (base_col + F.coalesce("_off", F.lit(0)) + F.col("_pos") + 1)
                        .cast("long"))
            .drop("_mid", "_part", "_pos", "_off"))


def max_id(df: DataFrame, col: str) -> Column:
    """``COALESCE(MAX(col), 0)`` as a scalar subquery."""
    return df.select(F.coalesce(F.max(col), F.lit(0)).cast("long")).scalar()
