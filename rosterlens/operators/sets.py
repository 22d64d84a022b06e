"""Unions that tag or copy rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import col


def tagged_union(branches: Mapping[str, DataFrame], tag: str) -> DataFrame:
    """All rows of all branches, each with the name of its branch; missing columns become NULL."""
    tagged = [df.select(F.lit(name).alias(tag), "*") for name, df in branches.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)


def fan_out_key(df: DataFrame, key: str, source: str, copies: Sequence[str]) -> DataFrame:
    """Repeat the rows of one key value under other values; only the key changes.

    The input is read once, whatever the number of copies.
    """
    all_ids = F.array(F.lit(source), *map(F.lit, copies))
    ids = F.when(col(key) == source, all_ids).otherwise(F.array(col(key)))
    return df.withColumn(key, F.explode(ids))
