"""Left joins that hold up when one key has a large share of the rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import col
from .heavy import Listed, any_null, common_kinds, heavy_keys, key_text, with_route
from .sets import tagged_union

# A key with more rows than this is split.
SPLIT_ROWS = 5_000_000
NULL_SPREAD = 4096


def hashable(kind: T.DataType) -> bool:
    """No map or variant anywhere inside: what can be hashed, compared and sorted by."""
    if isinstance(kind, T.StructType):
        return all(hashable(f.dataType) for f in kind.fields)
    if isinstance(kind, T.ArrayType):
        return hashable(kind.elementType)
    return not isinstance(kind, (T.MapType, T.VariantType))


def row_hash(df: DataFrame) -> Column:
    """A hash over all columns of a row that can be hashed."""
    return F.xxhash64(*[col(f.name) for f in df.schema.fields if hashable(f.dataType)])


def split_left_join(
    left: DataFrame, right: DataFrame, on: Sequence[str], split_rows: int = SPLIT_ROWS,
    heavy: Listed | DataFrame | None = None,
) -> DataFrame:
    """`left.join(right, on, "left")` that also splits large right keys.

    Spark's own skew handling splits the left side of a left join, never the right. `heavy` lists the keys
    with the most rows, from a sketch taken when the right table was written, so that the right side is derived
    once. Without a list they are sketched within the plan, from `heavy` if it is a table with the keys of the right side, which
    may be cheaper to derive, or else from the right side. Every key listed must occur on the right. The right rows of a key
    above `split_rows` are dealt out by a hash of the row and of the task it comes from, which parts copies too, and
    the left rows of that key are repeated once per part. A large key has a match in some part, so repeats that met an empty part are dropped. Left rows with a NULL key match nothing; they
    are spread instead of meeting in one task. Rows are moved as they are, so no value changes.
    """
    right = right.dropna(subset=list(on))
    columns = [*left.columns, *(c for c in right.columns if c not in on)]
    spread = -1 - F.pmod(row_hash(left), F.lit(NULL_SPREAD)).cast("int")
    kinds = common_kinds(left, right, on)
    if isinstance(heavy, list) and any(right.schema[c].dataType != kinds[c] for c in on):
        heavy = None  # listed in another type than the keys are compared in
    if isinstance(heavy, list):
        heavy = [(key, n) for key, n in heavy if n > split_rows]
        if not heavy:
            parted = left.withColumn("_part", F.when(any_null(on), spread).otherwise(0))
            return parted.join(right.withColumn("_part", F.lit(0)), [*on, "_part"], "left").select(*columns)
        found = left.sparkSession.createDataFrame(heavy, "key string, rows long")
    else:
        found = heavy_keys(right if heavy is None else heavy, on, kinds)
    large = F.broadcast(
        found.filter(F.col("rows") > split_rows)
        .select(F.col("key").alias("_key"), F.ceil(F.col("rows") / split_rows).cast("int").alias("_parts"))
    )
    parts = (
        F.when(any_null(on), F.array(spread))
        .when(F.col("_parts").isNull(), F.array(F.lit(0)))
        .otherwise(F.sequence(F.lit(0), F.col("_parts") - 1))
    )
    repeated = (
        left.withColumn("_key", key_text(left, on, kinds)).join(large, "_key", "left")
        .withColumn("_part", F.explode(parts)).drop("_key")
    )
    part = F.when(F.col("_parts").isNull(), 0).otherwise(
        F.pmod(F.xxhash64(row_hash(right), F.spark_partition_id()), F.col("_parts"))
    )
    dealt = right.withColumn("_key", key_text(right, on, kinds)).join(large, "_key", "left").select(
        *right.columns, part.cast("int").alias("_part"), F.lit(True).alias("_found")
    )
    return (
        repeated.join(dealt, [*on, "_part"], "left")
        .filter(F.col("_parts").isNull() | F.col("_found"))
        .select(*columns)
    )


def routed_left_join(
    left: DataFrame,
    key: str,
    route: str,
    branches: Mapping[str, DataFrame],
    split_rows: int = SPLIT_ROWS,
    heavy: Mapping[str, Listed | None] | None = None,
) -> DataFrame:
    """Left join each row to the branch named by its `route` column, on `key`.

    Every branch has a column named `key`. A row can match one branch only, so the branches are
    unioned with their names as a second key and the left side is shuffled once, not once per branch.
    Rows with another route stay, with NULLs. `heavy` lists the keys of each branch, as for `split_left_join`.
    """
    one_kind = len({df.schema[key].dataType for df in branches.values()}) == 1
    listed = with_route({name: (heavy or {}).get(name) for name in branches}) if one_kind else None
    return split_left_join(left, tagged_union(branches, route), [key, route], split_rows, listed)


def smallest_shared(
    pairs: DataFrame, left_links: DataFrame, right_links: DataFrame, a: str, b: str, via: str
) -> DataFrame:
    """For each pair (a, b): the smallest `via` linked to both, pairs without one left out.

    `left_links` has (a, via), `right_links` has (b, via). Each pair walks the shorter of its two link
    lists and looks the rest up, so a value linked to very many others on both sides never produces
    all their combinations.
    """
    a_links = left_links.select(a, via).dropna().distinct()
    b_links = right_links.select(b, via).dropna().distinct()
    sized = (
        pairs.select(a, b)
        .join(a_links.groupBy(a).agg(F.count("*").alias("_na")), a)
        .join(b_links.groupBy(b).agg(F.count("*").alias("_nb")), b)
    )
    walk_a = sized.filter("_na <= _nb").join(a_links, a).join(b_links, [b, via], "left_semi")
    walk_b = sized.filter("_na > _nb").join(b_links, b).join(a_links, [a, via], "left_semi")
    found = walk_a.select(a, b, via).unionByName(walk_b.select(a, b, via))
    return found.groupBy(a, b).agg(F.min(via).alias(via))
