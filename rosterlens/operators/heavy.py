"""Keys that hold many rows, found by mergeable sketches of fixed size."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import col

# A sketch counts so many keys at once: what it says of a key is off by 3.5 / TRACKED of all rows at most. Keys
# beyond the first LISTED hold less than a thousandth of the rows each, which one task can take.
TRACKED = 4096
LISTED = 1024
MERGERS = 64

Listed = list[tuple[str, int]]


def key_text(
    df: DataFrame, on: Sequence[str], kinds: Mapping[str, T.DataType] | None = None, nulls: bool = False
) -> Column:
    """One text per key, the same for equal keys only. NULL if a part of the key is NULL, unless `nulls` are a value."""
    parts = []
    for c in on:
        value, kind = col(c), df.schema[c].dataType
        if kinds and kinds[c] != kind:
            value, kind = value.cast(kinds[c]), kinds[c]
        if isinstance(kind, (T.FloatType, T.DoubleType)):
            value = value + F.lit(0.0).cast(kind)  # -0.0 and 0.0 are one key
        text = value.cast("string")
        part = F.concat(F.length(text).cast("string"), F.lit(":"), text)
        parts.append(F.coalesce(part, F.lit("n")) if nulls else part)
    return F.concat(*parts)


def text_of(value: str) -> str:
    """What a text adds to a `key_text`."""
    return f"{len(value)}:{value}"


def heavy_keys(df: DataFrame, on: Sequence[str], kinds: Mapping[str, T.DataType] | None = None) -> DataFrame:
    """(key, rows) of the keys with the most rows, as part of the plan: LISTED rows at most.

    Tasks sketch what they read and send sketches only. They are merged by groups of tasks, then as a whole.
    Only keys that occur are listed.
    """
    keys = df.select(key_text(df, on, kinds).alias("key")).filter(F.col("key").isNotNull())
    merged = (
        keys.groupBy(F.pmod(F.spark_partition_id(), F.lit(MERGERS)).alias("part"))
        .agg(F.call_function("approx_top_k_accumulate", F.col("key"), F.lit(TRACKED)).alias("sketch"))
        # By a constant, so that of no rows there is no sketch to be read.
        .groupBy(F.lit(1).alias("all")).agg(F.call_function("approx_top_k_combine", F.col("sketch"), F.lit(TRACKED)).alias("sketch"))
    )
    return merged.select(F.inline(F.call_function("approx_top_k_estimate", F.col("sketch"), F.lit(LISTED)))).select(
        F.col("item").alias("key"), F.col("count").alias("rows")
    ).filter(F.col("key").isNotNull())


class KeySketches:
    """Keys with many rows of tables that were written, sketched in the write itself.

    `watch` goes before the write, `of` after it. What `of` lists does occur in the table.
    """

    def __init__(self) -> None:
        self.observed: dict[str, tuple[Observation, dict[tuple[str, ...], str]]] = {}
        self.found: dict[tuple[str, tuple[str, ...]], Listed] = {}

    def watch(self, name: str, df: DataFrame, keys: Sequence[Sequence[str]], nulls: bool = False) -> DataFrame:
        names = {tuple(on): f"keys{i}" for i, on in enumerate(keys) if set(on) <= set(df.columns)}
        if not names:
            return df
        seen = Observation()
        self.observed[name] = (seen, names)
        return df.observe(seen, *[
            F.call_function("approx_top_k", key_text(df, on, nulls=nulls), F.lit(LISTED), F.lit(TRACKED)).alias(alias) for on, alias in names.items()
        ])

    def of(self, name: str, *on: str) -> Listed | None:
        """(key, rows) of the heaviest keys; None if the table was not watched, or not by this key."""
        if (name, on) not in self.found:
            if name not in self.observed or on not in self.observed[name][1]:
                return None
            seen, names = self.observed[name]
            for columns, alias in names.items():
                listed = seen.get[alias] or []
                self.found[name, columns] = [(r["item"], r["count"]) for r in listed if r["item"] is not None]
        return self.found[name, on]


def common_kinds(left: DataFrame, right: DataFrame, on: Sequence[str]) -> dict[str, T.DataType]:
    """The types in which keys of both sides are compared."""
    both = left.select(*map(col, on)).union(right.select(*map(col, on)))
    return {c: both.schema[c].dataType for c in on}


def with_route(branches: Mapping[str, Listed | None]) -> Listed | None:
    """The lists of a tagged union's branches, the tag being the second part of the key."""
    if any(listed is None for listed in branches.values()):
        return None
    return [(key + text_of(route), n) for route, listed in branches.items() for key, n in listed]


def any_null(on: Sequence[str]) -> Column:
    return reduce(Column.__or__, [col(c).isNull() for c in on])
