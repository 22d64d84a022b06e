"""A corpus made ready for training: five stages over the table of documents.

Each stage takes (spark, docs, folder of tables) and returns what goes on: toxic documents go, repeated lines
go, one document of each near-duplicate group stays, documents that hold benchmark passages go, and the rest
is packed into sequences. All but the last return the columns of documents.

Defined results: an empty table stays empty. Rows with a null id are kept or dropped by their text like others;
of a near-duplicate group one row stays, the first by id with nulls last, also where rows repeat an id.
Columns besides those of documents pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rosterlens.llm.common import importable, quoted, staged, table, unused
from rosterlens.llm.decontaminate import contamination
from rosterlens.llm.labelled import labelled_sample
from rosterlens.llm.line_dedup import EDIT_WORDS, LEAST_WORDS, without_repeated_lines
from rosterlens.llm.minhash import near_groups
from rosterlens.llm.packing import packed
from rosterlens.llm.toxicity import fit_toxicity, toxicity_scores

TOXIC_FROM = 0.3


def drop_toxic(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    importable(spark)
    sample = labelled_sample(docs, table(spark, folder, "labels"), "toxic", F.lit(True), "doc_id", "text")
    score = unused(docs, "toxic")
    return toxicity_scores(docs, fit_toxicity(sample), score_col=score).where(F.col(score) < TOXIC_FROM).drop(score)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    out = without_repeated_lines(docs, least_words=LEAST_WORDS, edit_words=EDIT_WORDS)
    length = F.length("text").cast(docs.schema["n_chars"].dataType)
    return out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(length))


def drop_near_copies(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    importable(spark)
    rows = staged(
        near_groups(docs).where("group IS NOT NULL").groupBy("id", "version").agg(F.first("group").alias("group"), F.count(F.lit(1)).alias("n"))
    )
    place = F.struct(F.col("id").isNull(), "id", "version")
    first = rows.groupBy("group").agg(F.min(place).alias("first"))
    marked = staged(rows.join(first, "group").select("id", "version", place.eqNullSafe(F.col("first")).alias("stays"), "n"))
    # What stays as it is needs no mark; of a row that is repeated one stays. Rows travel whole, so their columns may have any name.
    gone, repeated = marked.where("NOT stays OR n > 1"), marked.where("stays AND n > 1")
    whole = docs.select(
        F.struct(*[F.col(quoted(c)) for c in docs.columns]).alias("row"), F.col("doc_id").alias("key"),
        F.xxhash64(F.col("text").cast("string")).alias("hash"),
    )
    same = F.col("key").eqNullSafe(F.col("id")) & (F.col("hash") == F.col("version"))
    once = whole.join(repeated, same, "left_semi").withColumn("text", F.col("row.text")).dropDuplicates(["key", "text"]).drop("text")
    return whole.join(gone, same, "left_anti").unionByName(once).select("row.*")


def drop_contaminated(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    importable(spark)
    found = contamination(docs, table(spark, folder, "benchmark"))
    return found.where("n_hit = 0").select("row.*")


def pack(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    importable(spark)
    return packed(docs)


STAGES = [
    ("toxicity", drop_toxic), ("line_dedup", drop_repeated_lines), ("near_dedup", drop_near_copies),
    ("decontamination", drop_contaminated), ("packing", pack),
]
# Training, signatures and dynamic programming have no form in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir))
    return docs
