"""What several operators share: staged tables, batches of text, linked components."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterable, Iterator
from pathlib import Path

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder of `spark.checkpoint.dir`; where that is unset (tests), one in the warehouse."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    return (found or spark.conf.get("spark.sql.warehouse.dir") + "/staged").rstrip("/")


def staged(df: DataFrame, *folders: str) -> DataFrame:
    """`df` written to the shared folder and read back: lineage ends here, lost executors cost nothing.

    `folders` are columns of few values that each have a folder, so that a filter on them reads no other rows.
    """
    path = f"{shared_dir(df.sparkSession)}/llm-{uuid.uuid4().hex}"
    df.write.partitionBy(*folders).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def importable(spark: SparkSession) -> None:
    """Workers that have no installed copy find this package where the driver has it."""
    root = str(Path(__file__).parents[2])
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [env.get("PYTHONPATH"), root]))


def quoted(name: str) -> str:
    """The exact name of a column, dots included, where an expression is read."""
    return "`" + name.replace("`", "``") + "`"


def unused(df: DataFrame, name: str) -> str:
    """`name`, or a longer one that no column has, in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    importable(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def slices(
    batches: Iterable[pa.RecordBatch], text: str, field: str | None = None, most_bytes: int = 8 << 20
) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut so that the texts of each take about `most_bytes` (a longer text stands alone).

    The texts are a column, or a field of a column of structs.
    """
    for batch in batches:
        start, size = 0, 0
        texts = batch.column(text) if field is None else batch.column(text).field(field)
        for i, n in enumerate(pc.binary_length(texts).to_pylist()):
            n = n or 0
            if size and size + n > most_bytes:
                yield batch.slice(start, i - start)
                start, size = i, 0
            size += n
        if start < batch.num_rows:
            yield batch.slice(start)


def _are_stars(edges: DataFrame) -> bool:
    """Every node is either a leaf of one edge (as `a`) or a root (as `b`)."""
    ends = edges.select(F.col("a").alias("id"), F.lit(1).alias("leaf")).union(edges.select("b", F.lit(0)))
    nodes = ends.groupBy("id").agg(F.sum("leaf").alias("leaves"), F.min("leaf").alias("least"))
    return nodes.where((F.col("leaves") > 1) | ((F.col("leaves") == 1) & (F.col("least") == 0))).isEmpty()


def components(links: DataFrame) -> DataFrame:
    """(id, component) of every id in `links` (a, b): the smallest id it is linked with, at any distance.

    Alternates large-star and small-star steps, each a grouping and a join, until all edges are stars; long
    chains take logarithmically many rounds. The tables of a round are staged, and hot centres are plain
    shuffled joins of two staged tables, which adaptive execution splits. No links: no rows.
    """
    # Towards the smaller id, so that a root is the smallest of its star.
    edges = staged(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while not _are_stars(edges):
        # Each node's larger neighbours move to the smallest node it knows.
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = staged(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")))
        large = staged(both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")))
        # Then its smaller ones, and it itself.
        least = staged(large.groupBy("a").agg(F.min("b").alias("m")))
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = staged(small.union(least.select("a", F.col("m").alias("b"))).distinct())
    ids = edges.select(F.col("a").alias("id"), F.col("b").alias("component"))
    roots = edges.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
    return ids.union(roots)
