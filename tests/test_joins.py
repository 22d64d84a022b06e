from collections import Counter

import pytest
from conftest import as_set
from pyspark.sql import functions as F

from rosterlens.operators.joins import routed_left_join, split_left_join, smallest_shared


def bag(df):
    return Counter(tuple(r) for r in df.collect())


@pytest.mark.parametrize("split", [3, 50, 10_000])
def test_split_left_join_equals_left_join(spark, split):
    # A third of the rows on either side have key 0, some have none, some meet nothing.
    left = spark.range(120).selectExpr(
        "case when id % 3 = 0 then 0 when id % 11 = 0 then null else id end as k", "id % 2 as r", "id as a"
    )
    right = spark.range(200).selectExpr(
        "case when id % 3 = 0 then 0 when id % 13 = 0 then null else id end as k", "id % 2 as r", "id as b"
    )
    expected = left.join(right, ["k", "r"], "left").select("k", "r", "a", "b")
    assert bag(split_left_join(left, right, ["k", "r"], split)) == bag(expected)


def test_large_key_of_equal_rows_keeps_every_copy(frame):
    left = frame([("x", 1), ("y", 2)], "k string, a int")
    right = frame([("x", 7)] * 9, "k string, b int")
    assert bag(split_left_join(left, right, ["k"], 2)) == Counter({("x", 1, 7): 9, ("y", 2, None): 1})


@pytest.mark.parametrize("split", [1, 10_000])
def test_values_are_moved_as_they_are(spark, frame, split):
    """Negative zero and NaN are the same on both sides of the bound, inside arrays too."""
    left = frame([("x",), ("y",)], "k string")
    right = spark.sql("""
        SELECT 'x' AS k, double('-0.0') AS b, array(double('-0.0'), double('NaN')) AS c, map('m', double('-0.0')) AS d
        UNION ALL SELECT 'x', 0.0D, array(0.0D), map('m', 1.0D) UNION ALL SELECT 'x', double('NaN'), NULL, NULL""")
    rows = split_left_join(left, right, ["k"], split).select("k", F.expr("string(b)"), F.expr("string(c)"), F.expr("string(d)"))
    assert bag(rows) == Counter({
        ("x", "-0.0", "[-0.0, NaN]", "{m -> -0.0}"): 1, ("x", "0.0", "[0.0]", "{m -> 1.0}"): 1,
        ("x", "NaN", None, None): 1, ("y", None, None, None): 1,
    })


def test_routed_join_keeps_unrouted_rows(frame):
    left = frame(
        [("s1", "live"), ("s1", "ondemand"), ("s2", "live"), (None, None), ("s1", "other")],
        "session string, kind string",
    )
    live = frame([("s1", 1), ("s1", 2)], "session string, event int")
    ondemand = frame([("s1", "calm"), ("s2", "never")], "session string, skill string")
    out = routed_left_join(left, "session", "kind", {"live": live, "ondemand": ondemand})
    assert as_set(out.select("session", "kind", "event", "skill")) == {
        ("s1", "live", 1, None), ("s1", "live", 2, None), ("s1", "ondemand", None, "calm"),
        ("s2", "live", None, None), (None, None, None, None), ("s1", "other", None, None),
    }


def test_smallest_shared_equals_brute_force(spark):
    # Value 0 is linked to very many on both sides.
    a_links = spark.range(400).selectExpr(
        "if(id % 3 = 0, 0, id % 23) as a", "concat('t', (id * 7) % 61) as via"
    )
    b_links = spark.range(500).selectExpr(
        "if(id % 3 = 1, 0, id % 29) as b", "if(id % 50 = 0, null, concat('t', (id * 11) % 53)) as via"
    )
    pairs = spark.range(25).crossJoin(spark.range(31).withColumnRenamed("id", "b")).selectExpr("id as a", "b")
    expected = (
        pairs.join(a_links, "a").join(b_links, ["b", "via"]).groupBy("a", "b").agg(F.min("via").alias("via"))
    )
    assert as_set(smallest_shared(pairs, a_links, b_links, "a", "b", "via")) == as_set(
        expected.select("a", "b", "via")
    )
