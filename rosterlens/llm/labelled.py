"""Bounded samples of labelled rows, and which rows are held out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SAMPLE_ROWS = 12_000


def remainder(id_col: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo `modulus`; null for a null id."""
    return F.crc32(id_col.cast("string").cast("binary")) % modulus


def held_out_rows(id_col: Column, modulus: int, rest: int) -> Column:
    """True for the ids with that remainder; a null id is not held out."""
    return F.coalesce(remainder(id_col, modulus) == rest, F.lit(False))


def labelled_sample(
    docs: DataFrame, labels: DataFrame, label: str, usable: Column, id_col: str, text_col: str, rows: int = SAMPLE_ROWS
) -> DataFrame:
    """(label, text) of at most `rows` labelled documents, those whose ids hash lowest.

    Which documents are taken depends on their ids alone. Labels other than 0 and 1 are not used; a document
    that repeats stands for each of its rows. The ids are bounded by `rows`, so they may be broadcast.
    """
    chosen = (
        labels.where(F.col(label).isin(0, 1) & usable).select(F.col(id_col).alias("key"), F.col(label).alias("label"))
        .orderBy(F.xxhash64("key"), "key").limit(rows)
    )
    return docs.select(F.col(id_col).alias("key"), F.col(text_col).cast("string").alias("text")).join(
        F.broadcast(chosen), "key"
    ).select("label", "text")
