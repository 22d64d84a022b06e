"""Declared data-quality checks. A check's result is the number of failing rows or values."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import col


@dataclass(frozen=True)
class Unique:
    """Non-null values that occur more than once fail."""

    column: str


@dataclass(frozen=True)
class NotNull:
    """NULL rows fail."""

    column: str


@dataclass(frozen=True)
class AcceptedValues:
    """Non-null values outside the list fail, each distinct one once. Compared as text."""

    column: str
    values: tuple[str, ...]


@dataclass(frozen=True)
class UniqueCombination:
    """Combinations that occur more than once fail; NULLs count as equal."""

    columns: tuple[str, ...]


Check = Unique | NotNull | AcceptedValues | UniqueCombination


def columns_of(check: Check) -> tuple[str, ...]:
    return tuple(check.columns) if isinstance(check, UniqueCombination) else (check.column,)


def kind_of(check: Check) -> str:
    """The name a check has in results, such as not_null."""
    return "".join("_" + c.lower() if c.isupper() else c for c in type(check).__name__).lstrip("_")


def _failing(check: Check) -> Column:
    """The measure over groups of equal values, `_n` rows each."""
    repeated = F.col("_n") > 1
    match check:
        case Unique(c):
            return F.when(repeated & col(c).isNotNull(), 1)
        case NotNull(c):
            return F.when(col(c).isNull(), F.col("_n"))
        case AcceptedValues(c, values):
            return F.when(~col(c).cast("string").isin(*values), 1)
        case UniqueCombination():
            return F.when(repeated, 1)


def check_table(df: DataFrame, checks: Sequence[Check]) -> DataFrame:
    """(check, columns, failing_rows) for every check, from one scan.

    The sets of columns whose values are counted are grouping sets: each row is expanded once per set, equal values
    combine before the one shuffle they share, and a last aggregation lays the groups out as a row per check. Null
    checks go with a set that has their column, or are counted beside the first set. Tables with null checks alone are not
    grouped.
    """
    sets: dict[frozenset[str], list[Check]] = {}
    for check in checks:
        if not isinstance(check, NotNull):
            sets.setdefault(frozenset(columns_of(check)), []).append(check)
    alone = []
    for check in checks:
        if isinstance(check, NotNull):
            with_it = [found for columns, found in sets.items() if check.column in columns]
            (with_it[0] if with_it else alone).append(check)

    nulls = [F.count_if(col(c.column).isNull()).alias(f"_nulls{i}") for i, c in enumerate(alone)]
    if sets:
        names = sorted(frozenset().union(*sets))
        # A column's bit is set where it is not part of the set; the first column has the highest one.
        ids = [sum(1 << i for i, c in enumerate(reversed(names)) if c not in columns) for columns in sets]
        groups = df.groupingSets([[col(c) for c in sorted(columns)] for columns in sets], *map(col, names)).agg(
            F.grouping_id().alias("_set"), F.count("*").alias("_n"), *nulls
        )
        measures = [
            (check, F.sum(F.when(F.col("_set") == id, _failing(check))))
            for id, found in zip(ids, sets.values()) for check in found
        ]
        measures += [(c, F.sum(F.when(F.col("_set") == ids[0], F.col(f"_nulls{i}")))) for i, c in enumerate(alone)]
        totals = groups.agg(*[m.alias(f"m{i}") for i, (_, m) in enumerate(measures)])
    else:
        measures = [(c, None) for c in alone]
        totals = df.agg(*[n.alias(f"m{i}") for i, n in enumerate(nulls)])
    rows = F.array(*[
        F.struct(
            F.lit(kind_of(check)).alias("check"),
            F.lit(", ".join(columns_of(check))).alias("columns"),
            F.coalesce(F.col(f"m{i}"), F.lit(0)).cast("long").alias("failing_rows"),
        )
        for i, (check, _) in enumerate(measures)
    ])
    return totals.select(F.inline(rows))
