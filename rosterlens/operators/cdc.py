"""Turning a change feed into current rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import col
from .joins import hashable

# The three ways a model treats the delete mark.
KEEP_UNMARKED = "op <> 'D' or op is null"
KEEP_MARKED_LIVE = "op <> 'D'"


def _quoted(names: Sequence[str]) -> list[str]:
    return ["`" + n.replace("`", "``") + "`" for n in names]


def latest_row(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[tuple[str, str]],
    tiebreak: Sequence[str] | None = None,
    keep: str | Column | None = None,
    rank_col: str = "row_number",
    keep_rank: bool = True,
) -> DataFrame:
    """The first row per key under `order`; `keep` is applied to the chosen rows only.

    Filtering on rank 1 lets Spark cut each map task down to one row per key before the shuffle, so a
    key with very many versions sends at most one row per task. Ties fall to `tiebreak`, by default
    every other column, so that the choice does not depend on how the data is laid out.
    """
    if tiebreak is None:
        used = {*keys, *(c for c, _ in order)}
        tiebreak = [
            f.name for f in df.schema.fields
            if f.name not in used and hashable(f.dataType)
        ]
    sort = [
        f"{name} {'desc' if way == 'desc' else 'asc'} nulls last"
        for name, way in zip(
            _quoted([c for c, _ in order] + list(tiebreak)), [w for _, w in order] + ["asc"] * len(tiebreak)
        )
    ]
    rank = F.expr(
        f"row_number() over (partition by {', '.join(_quoted(keys))} order by {', '.join(sort)})"
    )
    ranked = df.withColumn(rank_col, rank).filter(F.col(rank_col) == 1)
    if keep is not None:
        ranked = ranked.filter(keep)
    return ranked.withColumn(rank_col, F.lit(1).cast("long")) if keep_rank else ranked.drop(rank_col)


def undeleted_groups(
    df: DataFrame, keys: Sequence[str], op: str = "op", flag: str = "has_d_value"
) -> DataFrame:
    """Keys no row of which is a delete, with the text flag '0'.

    The flag is a maximum, so removing duplicate rows first would change nothing: one aggregation with
    map-side combine does the work of distinct and group.
    """
    return (
        df.groupBy(*map(col, keys))
        .agg(F.max(F.when(col(op) == "D", "1").otherwise("0")).alias(flag))
        .filter(F.col(flag) == "0")
    )
