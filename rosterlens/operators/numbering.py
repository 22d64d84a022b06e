"""Row numbers over groups of any size, as plans."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import col
from .heavy import Listed, key_text
from .joins import row_hash

# One task sorts a group up to this size; larger ones are cut into ordered ranges.
TASK_ROWS = 5_000_000
RANGES = 1024  # of one group at most
SAMPLED = 16  # rows per range that its borders come from


@dataclass(frozen=True)
class Numbering:
    keys: Sequence[str]
    order: Sequence[str]
    name: str


def _plain(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str) -> DataFrame:
    window = Window.partitionBy(*map(col, keys)).orderBy(*[col(c).asc_nulls_last() for c in order])
    return df.withColumn(name, F.row_number().over(window).cast("long"))


def large_groups(df: DataFrame, keys: Sequence[str], task_rows: int, heavy: Listed | None) -> DataFrame | None:
    """(_key, _rows) of the groups above `task_rows`, at most rows / task_rows of them; None if there are none for sure.

    From a list sketched when `df` was written, with NULLs as values, or counted exactly within the plan: a sketch could
    differ between two runs of it, and numbers must not.
    """
    if heavy is None:
        counted = df.groupBy(key_text(df, keys, nulls=True).alias("_key")).agg(F.count("*").alias("_rows"))
        return counted.filter(F.col("_rows") > task_rows)
    listed = [(key, n) for key, n in heavy if n > task_rows]
    return df.sparkSession.createDataFrame(listed, "_key string, _rows long") if listed else None


def _place(order: Sequence[str]) -> Column:
    """What rows of a group are ordered by, as one value: NULLs last, then a hash of the row."""
    return F.struct(*[F.struct(col(c).isNull().alias("none"), col(c).alias("value")).alias(f"c{i}") for i, c in enumerate(order)], F.col("_hash"))


def _borders(df: DataFrame, large: DataFrame, order: Sequence[str], task_rows: int) -> DataFrame:
    """(_key, _borders): quantiles of the places in each large group, from rows picked by a hash of their content."""
    ranges = F.least(F.ceil(2 * F.col("_rows") / task_rows), F.lit(RANGES)).cast("int")
    share = F.least(F.lit(1.0), SAMPLED * F.col("_ranges") / F.col("_rows"))
    picked = F.pmod(F.xxhash64(F.col("_hash"), F.lit(1)), F.lit(1 << 30)) < share * (1 << 30)
    sample = df.join(F.broadcast(large.withColumn("_ranges", ranges)), "_key").filter(picked)
    places = sample.groupBy("_key").agg(F.sort_array(F.collect_list(_place(order))).alias("_places"), F.max("_ranges").alias("_ranges"))
    at = F.transform(F.sequence(F.lit(1), F.greatest("_ranges", F.lit(2)) - 1), lambda i: F.floor(i * F.size("_places") / F.col("_ranges")).cast("int"))
    return places.select("_key", F.array_distinct(F.transform(at, lambda i: F.get("_places", i))).alias("_borders"))


def _range_of(place: Column, borders: Column) -> Column:
    """How many borders are not behind the place, by halving."""
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(RANGES.bit_length()))])

    def further(at: Column, step: Column) -> Column:
        return F.when((at + step <= F.size(borders)) & (F.get(borders, at + step - 1) <= place), at + step).otherwise(at)

    return F.when(borders.isNull(), 0).otherwise(F.aggregate(steps, F.lit(0), further))


def number_rows(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str, task_rows: int = TASK_ROWS,
    heavy: Listed | None = None,
) -> DataFrame:
    """`row_number()` per key, ascending with NULLs last, as a plan; no task sorts much more than `task_rows` rows.

    Groups above that, NULL groups too, are cut into ordered ranges whose borders are quantiles of the group, from a bounded
    sample taken within the plan. Rows are numbered within (group, range), which is what they are dealt by, and the rows of
    earlier ranges are added. Rows that are alike in all columns cannot be parted. `heavy` lists the largest groups, sketched when
    `df` was written; where it names none above the bound the plan is a plain window. Without it they are counted
    within the plan, which then reads `df` four times, so it should be a table.
    """
    large = large_groups(df, keys, task_rows, heavy)
    if large is None:
        return _plain(df, keys, order, name)
    keyed = df.withColumns({"_key": key_text(df, keys, nulls=True), "_hash": row_hash(df)})
    borders = _borders(keyed, large, order, task_rows)
    ranged = keyed.join(F.broadcast(borders), "_key", "left").withColumn(
        "_range", _range_of(_place(order), F.col("_borders")))
    earlier = Window.partitionBy("_key").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    # A row per range of a large group.
    carried = (
        ranged.filter(F.col("_borders").isNotNull()).groupBy("_key", "_range").agg(F.count("*").alias("_n"))
        .select("_key", "_range", F.sum("_n").over(earlier).alias("_carry")).filter("_carry > 0")
    )
    within = Window.partitionBy(*map(col, keys), F.col("_range")).orderBy(
        *[col(c).asc_nulls_last() for c in order], F.col("_hash"))
    return (
        ranged.withColumn(name, F.row_number().over(within).cast("long"))
        .join(F.broadcast(carried), ["_key", "_range"], "left")
        .withColumn(name, F.col(name) + F.coalesce("_carry", F.lit(0)))
        .select(*map(col, df.columns), name)
    )


def number_within(
    df: DataFrame, owner: str, numberings: Sequence[Numbering], task_rows: int = TASK_ROWS, heavy: Listed | None = None
) -> DataFrame:
    """Several row numbers whose groups never reach across two values of `owner`: one shuffle for all.

    Rows of owners above `task_rows` are numbered by ranges, each numbering alone. `heavy` lists the owners with the most rows,
    as for `number_rows`.
    """
    large = large_groups(df, [owner], task_rows, heavy)

    def together(rows: DataFrame) -> DataFrame:
        rows = rows.repartition(col(owner))
        for n in numberings:
            rows = _plain(rows, [owner, *(k for k in n.keys if k != owner)], n.order, n.name)
        return rows

    if large is None:
        return together(df)
    keyed, large = df.withColumn("_owner", key_text(df, [owner], nulls=True)), F.broadcast(large.select(F.col("_key").alias("_owner")))
    apart = keyed.join(large, "_owner", "left_semi").drop("_owner")
    for n in numberings:
        apart = number_rows(apart, n.keys, n.order, n.name, task_rows)
    return together(keyed.join(large, "_owner", "left_anti").drop("_owner")).unionByName(apart)
