from collections import Counter

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from rosterlens.operators import numbering
from rosterlens.operators.heavy import KeySketches
from rosterlens.operators.numbering import Numbering, number_rows, number_within
from rosterlens.sources.staging import stage, staging_dir, staging_run


def bag(df):
    return Counter(tuple(r) for r in df.collect())


@pytest.fixture
def rows(spark):
    # Key 0 and the NULL key hold a third of the rows each, over several ranges.
    return stage(spark.range(3000).selectExpr(
        "case id % 3 when 0 then 'hot' when 1 then null else concat('k', id % 40) end as k",
        "if(id % 7 = 0, null, (id * 37) % 101) as v", "id", "id % 5 as role",
    ))


def plain(df, keys, order, name):
    window = Window.partitionBy(*keys).orderBy(*[F.col(c).asc_nulls_last() for c in order])
    return df.withColumn(name, F.row_number().over(window))


@pytest.fixture(autouse=True)
def many_ranges(spark):
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(key, "false")
    yield
    spark.conf.set(key, "true")


def listed(df, *keys):
    """`df` written, and its groups as the write has sketched them."""
    sketches = KeySketches()
    written = stage(sketches.watch("t", df, [keys], nulls=True))
    return written, sketches.of("t", *keys)


def test_hot_groups_are_cut_into_bounded_ranges(rows):
    keyed = rows.withColumns({"_key": numbering.key_text(rows, ["k"], nulls=True), "_hash": numbering.row_hash(rows)})
    borders = numbering._borders(keyed, numbering.large_groups(rows, ["k"], 100, None), ["v", "id"], 100)
    ranged = keyed.join(borders, "_key").withColumn("r", numbering._range_of(numbering._place(["v", "id"]), F.col("_borders")))
    sizes = {(r.k, r.r): r["count"] for r in ranged.groupBy("k", "r").count().collect()}
    assert {k for k, _ in sizes} == {"hot", None} and sum(sizes.values()) == 2000
    assert max(sizes.values()) <= 100 and min(sizes.values()) >= 20
    # Ranges follow the order.
    places = ranged.groupBy("k", "r").agg(F.min(numbering._place(["v", "id"])).alias("a"), F.max(numbering._place(["v", "id"])).alias("b"))
    wrong = places.alias("x").join(places.alias("y"), F.expr("x.k <=> y.k AND x.r < y.r AND NOT x.b < y.a"))
    assert wrong.count() == 0


@pytest.mark.parametrize("task_rows", [10, 200, 100_000])
def test_numbers_do_not_depend_on_the_way(rows, task_rows):
    expected = bag(plain(rows, ["k"], ["v", "id"], "n"))
    written, heavy = listed(rows, "k")
    for out in (number_rows(rows, ["k"], ["v", "id"], "n", task_rows), number_rows(written, ["k"], ["v", "id"], "n", task_rows, heavy)):
        assert bag(out) == expected
        assert out.columns == ["k", "v", "id", "role", "n"]
        assert dict(out.dtypes)["n"] == "bigint"


def test_numbering_starts_no_job_and_is_a_window_where_nothing_is_large(spark, rows):
    written, heavy = listed(rows, "k")
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("numbering", "numbering")
    ranged = number_rows(written, ["k"], ["v", "id"], "n", 100, heavy)
    usual = number_rows(written, ["k"], ["v", "id"], "n", 100_000, heavy)
    spark.sparkContext.setJobGroup("rest", "rest")
    assert list(tracker.getJobIdsForGroup("numbering")) == []
    text = usual._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange") == 1 and "Join" not in text and text.count("FileScan") == 1
    text = ranged._jdf.queryExecution().executedPlan().toString()
    assert "_range" in text and "CartesianProduct" not in text and "SinglePartition" not in text


def test_two_keys_by_range(rows):
    out = number_rows(rows, ["k", "role"], ["v", "id"], "n", 10)
    assert bag(out) == bag(plain(rows, ["k", "role"], ["v", "id"], "n"))


@pytest.mark.parametrize("task_rows", [10, 100_000])
def test_within_an_owner(rows, task_rows):
    many = [Numbering(["k", "role"], ["v", "id"], "n"), Numbering(["k"], ["id", "n"], "m")]
    expected = plain(plain(rows, ["k", "role"], ["v", "id"], "n"), ["k"], ["id", "n"], "m")
    written, heavy = listed(rows, "k")
    assert bag(number_within(rows, "k", many, task_rows)) == bag(expected)
    assert bag(number_within(written, "k", many, task_rows, heavy)) == bag(expected)


def test_within_an_owner_shuffles_once(rows):
    many = [Numbering(["k", "role"], ["v", "id"], "n"), Numbering(["k"], ["id", "n"], "m")]
    written, heavy = listed(rows, "k")
    plan = number_within(written, "k", many, heavy=heavy)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1


@pytest.mark.parametrize("task_rows", [3, 100_000])
def test_copies_are_numbered_one_by_one(spark, task_rows):
    df = stage(spark.range(60).selectExpr(
        "if(id < 40, 'a', null) as k", "if(id % 3 = 0, 1, id) as v", "if(id % 2 = 0, double('-0.0'), 0.0D) as z"
    ))
    out = number_rows(df, ["k"], ["v"], "n", task_rows)
    assert bag(out.select("k", "n")) == bag(plain(df, ["k"], ["v"], "n").select("k", "n"))
    assert bag(out.selectExpr("k", "v", "string(z)")) == bag(df.selectExpr("k", "v", "string(z)"))


def test_empty(rows):
    assert number_rows(rows.filter("false"), ["k"], ["v", "id"], "n", 10).count() == 0


def test_staged_tables_of_a_run_are_removed(spark, tmp_path):
    with staging_run(spark) as folder:
        df = stage(spark.range(5).toDF("a"))
        assert df.inputFiles()[0].removeprefix("file://").startswith(folder.removeprefix("file:"))
        df.write.parquet(str(tmp_path / "kept"))
    assert spark.read.parquet(str(tmp_path / "kept")).count() == 5
    assert not __import__("os").path.exists(folder.removeprefix("file:"))


def test_staging_folder_is_the_shared_one_or_in_the_warehouse():
    from types import SimpleNamespace

    def session(**conf):
        known = {k.replace("_", "."): v for k, v in conf.items()}
        return SimpleNamespace(conf=SimpleNamespace(get=lambda key, default=None: known.get(key, default)))

    assert staging_dir(session(spark_checkpoint_dir="s3://x/")) == "s3://x"
    assert staging_dir(session(spark_sql_warehouse_dir="/wh")) == "/wh/.staging"
