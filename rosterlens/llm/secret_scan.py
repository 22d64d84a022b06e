"""Secrets found through a ledger of content-addressed blobs.

Every version of a path is one blob, named by the SHA-256 of its content. The ledger is a table that says which blobs
have been scanned by which version of the rules, and what was found. `scan_into` reads it, scans only the (blob, rules version)
pairs it lacks, each once however many paths hold it, appends them with what it found, and joins the
findings back to all paths. Each rule names a sieve that every match of it must contain, so blobs that pass
no sieve enter the ledger as clean without being moved; only the others are shuffled. Contents are read once: that
pass writes path, blob and, for suspects alone, the content.

Defined results: null content counts as empty and has no spans. Paths that repeat get a row for each of
their rows; null paths likewise. An empty table gives no rows. Columns besides path and content are not
read. Spans of a blob are ordered by start, then by the order of the rules.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rosterlens.llm.common import slices, staged


@dataclass(frozen=True)
class Rule:
    """Leftmost matches of `pattern` that do not overlap; those whose `group` is under `least` are dropped."""

    kind: str
    pattern: str
    sieve: str
    group: int = 0
    least: int = 0
    any_case: bool = False


BASE_RULES = (
    Rule(
        "assign",
        r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        r"(?i)(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]", group=2, least=6, any_case=True,
    ),
    Rule("access", r"AKIA[A-Z0-9]+", r"AKIA[A-Z0-9]{16}", least=20),
    Rule("hex", r"[0-9a-f]+", r"[0-9a-f]{24}", least=24),
)
# Kinds that the rules version of the library adds to the base.
MORE_RULES = (
    Rule("pem", r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----", "-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ"),
    Rule("forge", r"gh[pousr]_[A-Za-z0-9]{36,}", "gh[pousr]_[A-Za-z0-9]{36}"),
)
RULES = BASE_RULES + MORE_RULES
RULES_VERSION = "2"
FOUND = "array<struct<kind:string,start:long,end:long>>"


def spans_of(text: str, rules: tuple[Rule, ...]) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by start and then the order of the rules."""
    out = []
    for order, rule in enumerate(rules):
        flags = re.ASCII | (re.IGNORECASE if rule.any_case else 0)
        for m in re.finditer(rule.pattern, text, flags):
            if len(m[rule.group]) >= rule.least:
                out.append((m.start(), order, rule.kind, m.end()))
    return [(kind, start, end) for start, _, kind, end in sorted(out)]


def _scan(rules: tuple[Rule, ...]):
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "content"):
            found = [
                [{"kind": k, "start": s, "end": e} for k, s, e in spans_of(t, rules)]
                for t in batch.column("content").to_pylist()
            ]
            yield pa.record_batch([batch.column("blob"), pa.array(found, kind)], ["blob", "found"])

    return run


def sieved(content: Column, rules: tuple[Rule, ...]) -> Column:
    """True if some rule may match."""
    out = F.lit(False)
    for rule in rules:
        out = out | content.rlike(rule.sieve)
    return out


LEDGER = f"blob binary, rules_version string, found {FOUND}"


def empty_ledger(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], LEDGER)


def read_ledger(spark: SparkSession, folder: str) -> DataFrame:
    """The ledger in a folder; empty before the first scan."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return empty_ledger(spark)
    return spark.read.schema(LEDGER).parquet(folder)


def scan_versions(
    versions: DataFrame, path_col: str, content_col: str, ledger: DataFrame | None = None,
    rules: tuple[Rule, ...] = RULES, rules_version: str = RULES_VERSION,
) -> tuple[DataFrame, DataFrame]:
    """((path, blob, found) of every version, what the ledger gains)."""
    content = F.coalesce(F.col(content_col).cast("string"), F.lit(""))
    rows = versions.select(F.col(path_col).alias("path"), content.alias("content"))
    rows = rows.withColumn("blob", F.unhex(F.sha2("content", 256))).withColumn("suspect", sieved(F.col("content"), rules))
    manifest = staged(rows.select("path", "blob", "suspect", F.when(F.col("suspect"), F.col("content")).alias("content")))
    known = (ledger if ledger is not None else empty_ledger(versions.sparkSession)).where(
        F.col("rules_version") == rules_version
    ).select("blob", "found")
    suspects = manifest.where("suspect").select("blob", "content")
    # One scan for each unseen blob: copies fold within their task before the shuffle.
    todo = suspects.join(known.select("blob"), "blob", "left_anti").groupBy("blob").agg(F.first("content").alias("content"))
    fresh = staged(todo.mapInArrow(_scan(rules), f"blob binary, found {FOUND}").where(F.size("found") > 0))
    hits = fresh.union(known.where(F.size("found") > 0))
    none = F.array().cast(FOUND)
    dirty = (
        manifest.where("suspect").join(hits, "blob", "left")
        .select("path", "blob", F.coalesce("found", none).alias("found"))
    )
    clean = manifest.where(~F.col("suspect")).select("path", "blob", none.alias("found"))
    gained = manifest.select("blob").distinct().join(known.select("blob"), "blob", "left_anti")
    gained = gained.join(fresh, "blob", "left").select(
        "blob", F.lit(rules_version).alias("rules_version"), F.coalesce("found", none).alias("found")
    )
    return dirty.union(clean), gained


def scan_into(
    folder: str, versions: DataFrame, path_col: str, content_col: str, rules: tuple[Rule, ...] = RULES,
    rules_version: str = RULES_VERSION,
) -> DataFrame:
    """(path, blob, found) of every version; the ledger in `folder` gains what it lacked.

    The ledger is the only state: a scan that fails before its append leaves it as it was, and the next one does the work again.
    """
    found, gained = scan_versions(versions, path_col, content_col, read_ledger(versions.sparkSession, folder), rules, rules_version)
    found = staged(found)  # it may read the ledger, which is about to change
    gained.write.mode("append").parquet(folder)
    return found


def digest(found: Column, kinds: tuple[str, ...] | None = None) -> Column:
    """kind:start:end of the spans, comma-joined."""
    if kinds:
        found = F.filter(found, lambda s: s["kind"].isin(*kinds))
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def count_of(found: Column, kind: str) -> Column:
    return F.size(F.filter(found, lambda s: s["kind"] == kind)).cast("long")
