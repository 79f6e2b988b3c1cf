"""Lookups of many keys: the rows of a table whose key is in a key table.

The distinct keys are written once, so that the planner knows their size. Their
smallest and largest become plain comparisons, which reach the scan of the big
table and skip row groups. The join itself is a semi join: a key table below
the broadcast threshold is broadcast, a larger one is shuffled, and then Spark's
runtime filter (a Bloom filter of the keys, built first) drops most other rows
in the scan, before they are shuffled. The comparisons on the key side are what
makes that side selective in the planner's eyes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stored


def lookup(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Rows of ``df`` whose ``key`` occurs in ``keys`` (a table with that column; repeats and nulls may occur)."""
    wanted = stored(keys.where(F.col(key).isNotNull()).select(F.col(key).cast(df.schema[key].dataType).alias(key)).distinct(),
                    "keys")
    low, high = wanted.agg(F.min(key), F.max(key)).first()
    if low is None:
        return df.where(F.lit(False))
    near = F.col(key).between(F.lit(low), F.lit(high))
    return df.where(near).join(wanted.where(near), key, "left_semi")


def keyed(df: DataFrame, key: str, value) -> DataFrame:
    """``df`` for one key (a value), for many (a table with the key column), or as it is (None)."""
    if value is None:
        return df
    if isinstance(value, DataFrame):
        return lookup(df, value, key)
    return df.where(F.col(key) == value)
