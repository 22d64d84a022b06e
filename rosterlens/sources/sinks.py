"""Writing tables, describing them and looking into them."""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import col

TARGET_FILE_BYTES = 52_428_800  # fixed value: wanted size of a table file
ADVISORY_SIZE = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
PREVIEW_ROWS = 100


def write_table(
    df: DataFrame,
    to: str,
    target_bytes: int | None = TARGET_FILE_BYTES,
    order: Sequence[str] = (),
    table: bool = False,
    ordered_as_a_whole: bool = False,
) -> None:
    """Replace a Snappy Parquet table: a path, or a catalog name with `table=True`.

    Every version of a catalog table has a folder of its own. Once it is written, one change of the catalog, the table's
    location, makes it the current one, so readers find the old version or the new one and never none, and a failed
    write leaves the old one. The version before stays on disk for those who are still reading it and goes with the next
    replacement. Where the columns have changed the table is registered anew. A path is written beside the old one, which it then
    replaces.

    The rebalance step lets adaptive execution merge small and split large output
    partitions towards `target_bytes` (of shuffle data, so file sizes are close, not equal). `order`
    sorts within files, or across them too with `ordered_as_a_whole`.
    """
    spark = df.sparkSession
    sort = [col(c).asc_nulls_last() for c in order]
    if ordered_as_a_whole:
        df = df.orderBy(*sort)
    else:
        df = df.hint("rebalance") if target_bytes is not None else df
        df = df.sortWithinPartitions(*sort) if order else df
    base = f"{_default_location(spark, to)}{VERSIONS}" if table else to.rstrip("/")
    new = f"{base}/{uuid.uuid4().hex}" if table else f"{base}__new_{uuid.uuid4().hex[:12]}"
    before = spark.conf.get(ADVISORY_SIZE, None)
    if target_bytes is not None:
        spark.conf.set(ADVISORY_SIZE, str(target_bytes))
    try:
        df.write.option("compression", "snappy").parquet(new)
    except BaseException:
        _delete(spark, new)
        raise
    finally:
        if before is None:
            spark.conf.unset(ADVISORY_SIZE)
        else:
            spark.conf.set(ADVISORY_SIZE, before)
    if table:
        _switch(spark, to, new)
    else:
        _delete(spark, to)
        files, path = _files(spark, new)
        if not files.rename(path, _files(spark, to)[1]):
            raise OSError(f"{new} was written but could not take the place of {to}")


VERSIONS = "__versions"


def _default_location(spark: SparkSession, name: str) -> str:
    """Where the catalog would put a table of this name."""
    schema, _, table = name.rpartition(".")
    found = spark.catalog.getDatabase(schema or spark.catalog.currentDatabase())
    return f"{found.locationUri.rstrip('/')}/{table}"


def _columns(df: DataFrame) -> list[tuple[str, str]]:
    return [(f.name, f.dataType.simpleString()) for f in df.schema.fields]


def _switch(spark: SparkSession, name: str, new: str) -> None:
    """Make the files in `new` the table, and remove versions that were no longer current before."""
    exists = spark.catalog.tableExists(name)
    old = location_of(spark, name) if exists else None
    written = spark.read.parquet(new)
    if exists and _columns(spark.table(name)) == _columns(written):
        spark.sql(f"ALTER TABLE {_name(name)} SET LOCATION {_text(new)}")
        spark.catalog.refreshTable(name)
    else:
        spark.sql(f"DROP TABLE IF EXISTS {_name(name)}")
        spark.catalog.createTable(name, path=new, source="parquet", schema=written.schema)
    files, path = _files(spark, new)
    keep = {path.getName(), _files(spark, old)[1].getName() if old else None}
    for version in files.listStatus(path.getParent()):
        if version.getPath().getName() not in keep:
            files.delete(version.getPath(), True)


def location_of(spark: SparkSession, name: str) -> str:
    """The folder of the table's current version."""
    [found] = [r.data_type for r in spark.sql(f"DESCRIBE EXTENDED {_name(name)}").collect() if r.col_name == "Location"]
    return found


def _files(spark: SparkSession, path: str):
    """The file system of a path, and the path."""
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark._jsc.hadoopConfiguration()), found


def _delete(spark: SparkSession, name: str) -> None:
    files, path = _files(spark, name)
    files.delete(path, True)


def _text(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _name(value: str) -> str:
    return ".".join("`" + part.replace("`", "``") + "`" for part in value.split("."))


def describe_table(
    spark: SparkSession,
    name: str,
    comment: str | None = None,
    columns: Mapping[str, str] | None = None,
    meta: Mapping[str, object] | None = None,
) -> None:
    """Keep descriptions and metadata with a catalog table; metadata goes under `meta.`."""
    if comment is not None:
        spark.sql(f"COMMENT ON TABLE {_name(name)} IS {_text(comment)}")
    for column, words in (columns or {}).items():
        quoted = "`" + column.replace("`", "``") + "`"
        spark.sql(f"ALTER TABLE {_name(name)} ALTER COLUMN {quoted} COMMENT {_text(words)}")
    if meta:
        pairs = ", ".join(
            f"{_text('meta.' + key)} = {_text(str(value).lower() if isinstance(value, bool) else str(value))}"
            for key, value in meta.items()
        )
        spark.sql(f"ALTER TABLE {_name(name)} SET TBLPROPERTIES ({pairs})")


def preview(df: DataFrame, n: int = PREVIEW_ROWS, order: Sequence[str | Column] = ()) -> DataFrame:
    """The first n rows, every cell as text, NULL as ''. `order` makes them the same each time."""
    if order:
        df = df.orderBy(*order)
    return df.limit(n).select(
        *[F.coalesce(col(c).cast("string"), F.lit("")).alias(c) for c in df.columns]
    )
