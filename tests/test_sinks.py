import os

import pytest
from pyspark.sql import functions as F

from rosterlens.sources.raw import RAW_TABLES, read_raw
from rosterlens.sources.sinks import ADVISORY_SIZE, describe_table, location_of, preview, write_table


def test_write_replaces_and_restores_settings(spark, tmp_path):
    path = str(tmp_path / "t")
    before = spark.conf.get(ADVISORY_SIZE, None)
    write_table(spark.range(100).withColumn("x", F.lit("a")), path)
    write_table(spark.range(10), path, order=["id"])
    out = spark.read.parquet(path)
    assert out.columns == ["id"] and out.count() == 10
    assert all(f.endswith(".snappy.parquet") for f in os.listdir(path) if f.startswith("part"))
    assert spark.conf.get(ADVISORY_SIZE, None) == before


@pytest.mark.parametrize("table", [False, True])
def test_a_failed_write_leaves_the_old_table(spark, tmp_path, table):
    to = "replaced" if table else str(tmp_path / "t")
    if table:
        spark.sql("drop table if exists replaced")
    write_table(spark.range(7), to, table=table)
    bad = spark.range(7).select(F.expr("if(id = 5, raise_error('bad row'), id)").cast("long").alias("id"))
    with pytest.raises(Exception, match="bad row"):
        write_table(bad, to, table=table)
    assert (spark.table(to) if table else spark.read.parquet(to)).count() == 7
    if table:
        assert [r.tableName for r in spark.sql("show tables").collect() if "__new_" in r.tableName] == []
    else:
        assert os.listdir(tmp_path) == ["t"]


def test_order_over_all_files(spark, tmp_path):
    path = str(tmp_path / "t")
    write_table(spark.range(1000).selectExpr("(id * 37) % 1000 AS a").repartition(5), path, order=["a"], ordered_as_a_whole=True)
    names = sorted(f for f in os.listdir(path) if f.startswith("part"))
    assert [r.a for f in names for r in spark.read.parquet(f"{path}/{f}").collect()] == list(range(1000))


def test_rebalance_is_planned(spark):
    df = spark.range(10).hint("rebalance")
    assert "REBALANCE_PARTITIONS" in df._jdf.queryExecution().executedPlan().toString()


def test_describe(spark):
    spark.sql("drop table if exists described")
    write_table(spark.range(3).withColumn("name", F.lit("x")), "described", table=True)
    describe_table(
        spark, "described", comment="It's \\ here", columns={"name": "the user's name"},
        meta={"owner": "analytics", "pii": False},
    )
    rows = spark.sql("describe extended described").collect()
    assert ("name", "the user's name") in {(r.col_name, r.comment) for r in rows}
    assert any(r.col_name == "Comment" and r.data_type == "It's \\ here" for r in rows)
    props = {r.key: r.value for r in spark.sql("show tblproperties described").collect()}
    assert props["meta.owner"] == "analytics" and props["meta.pii"] == "false"


def test_preview(frame):
    out = preview(frame([(2, None), (1, True), (3, False)], "id int, b boolean"), 2, order=["id"])
    assert [tuple(r) for r in out.collect()] == [("1", "true"), ("2", "")]


def test_read_raw(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "raw_team"))
    assert read_raw(spark, str(tmp_path), "raw_team").count() == 3
    with pytest.raises(KeyError):
        read_raw(spark, str(tmp_path), "raw_other")
    assert len(RAW_TABLES) == 28


def test_a_table_is_there_at_every_moment_of_its_replacement(spark):
    """A reader that never stops, while the table is replaced, finds one version or the other, whole."""
    import threading

    spark.sql("drop table if exists switched")
    write_table(spark.range(1000).selectExpr("id", "0 as version"), "switched", table=True)
    open_before = spark.table("switched")
    seen, stop = [], threading.Event()

    def read():
        while not stop.is_set():
            try:
                seen.append(tuple(spark.table("switched").selectExpr("count(*)", "min(version)", "max(version)").first()))
            except Exception as e:  # noqa: BLE001 - what a reader would see
                seen.append(str(e)[:300])

    reader = threading.Thread(target=read)
    reader.start()
    for version in (1, 2, 3):
        write_table(spark.range(1000).selectExpr("id", f"{version} as version"), "switched", table=True)
        if version == 1:  # the version before can still be read
            assert open_before.selectExpr("count(*)", "max(version)").first() == (1000, 0)
    stop.set()
    reader.join()
    assert set(seen) <= {(1000, v, v) for v in range(4)} and len(seen) > 3
    assert spark.table("switched").first().version == 3


def test_versions_that_nobody_reads_are_removed(spark):
    spark.sql("drop table if exists kept")
    for _ in range(4):
        write_table(spark.range(5), "kept", table=True)
    now = location_of(spark, "kept")
    folder = os.path.dirname(now.removeprefix("file:"))
    assert len(os.listdir(folder)) == 2 and os.path.basename(now) in os.listdir(folder)


def test_comments_stay_with_a_replaced_table_and_columns_may_change(spark):
    spark.sql("drop table if exists changed")
    write_table(spark.range(5), "changed", table=True)
    describe_table(spark, "changed", comment="kept")
    write_table(spark.range(6), "changed", table=True)
    rows = spark.sql("describe extended changed").collect()
    assert any(r.col_name == "Comment" and r.data_type == "kept" for r in rows)
    write_table(spark.range(7).selectExpr("id", "'x' as more"), "changed", table=True)
    assert spark.table("changed").columns == ["id", "more"] and spark.table("changed").count() == 7
