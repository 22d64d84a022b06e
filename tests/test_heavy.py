from collections import Counter

import pytest

from rosterlens.operators.heavy import KeySketches, heavy_keys, key_text
from rosterlens.operators.joins import routed_left_join, split_left_join
from rosterlens.sources.staging import stage


def bag(df):
    return Counter(tuple(r) for r in df.collect())


@pytest.fixture
def right(spark):
    return spark.range(600).selectExpr(
        "case when id % 3 = 0 then 'hot' when id % 13 = 0 then null else concat('k', id) end as k", "int(id % 2) as r", "id as b"
    )


def test_heavy_keys_occur_and_come_first(right):
    found = {r.key: r.rows for r in heavy_keys(right, ["k"]).collect()}
    assert found["3:hot"] == 200
    assert found.keys() <= {f"{len(k)}:{k}" for (k, _, _) in bag(right) if k}
    both = {r.key: r.rows for r in heavy_keys(right, ["k", "r"]).collect()}
    assert both["3:hot1:0"] == both["3:hot1:1"] == 100


def test_keys_are_text_only_if_equal(frame):
    df = frame([("1", "23"), ("12", "3"), (None, "3")], "a string, b string")
    assert [r[0] for r in df.select(key_text(df, ["a", "b"])).collect()] == ["1:12:23", "2:121:3", None]
    assert df.select(key_text(df, ["a", "b"], nulls=True)).collect()[2][0] == "n1:3"
    zeros = frame([(0.0,), (-0.0,)], "a double")
    assert len({r[0] for r in zeros.select(key_text(zeros, ["a"])).collect()}) == 1


def test_keys_are_sketched_in_the_write(spark, right):
    keys = KeySketches()
    written = stage(keys.watch("t", right, [("k",), ("k", "r"), ("missing",)]))
    assert dict(keys.of("t", "k"))["3:hot"] == 200
    assert dict(keys.of("t", "k", "r"))["3:hot1:1"] == 100
    assert keys.of("t", "r") is None and keys.of("u", "k") is None and keys.of("t", "missing") is None
    assert bag(written) == bag(right)


@pytest.mark.parametrize("split", [3, 50, 10_000])
def test_split_join_with_a_list(spark, right, split):
    keys = KeySketches()
    written = stage(keys.watch("t", right, [("k", "r")]))
    left = spark.range(90).selectExpr(
        "case when id % 3 = 0 then 'hot' when id % 7 = 0 then null else concat('k', id) end as k", "int(id % 3) as r", "id as a"
    )
    expected = bag(left.join(written, ["k", "r"], "left").select("k", "r", "a", "b"))
    for heavy in (keys.of("t", "k", "r"), None, right.select("r", "k")):
        assert bag(split_left_join(left, written, ["k", "r"], split, heavy)) == expected
    listed = split_left_join(left, written, ["k", "r"], 10_000, keys.of("t", "k", "r"))
    plan = listed._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "ObjectHashAggregate" not in plan


def test_keys_of_two_types(spark, right):
    """Lists are not used where keys are compared in another type; sketches in the plan are."""
    keys = KeySketches()
    written = stage(keys.watch("t", right.select("r", "b"), [("r",)]))
    left = spark.createDataFrame([(0.0, 1), (1.0, 2), (2.5, 3), (-0.0, 4)], "r double, a int")
    expected = bag(left.join(written, "r", "left").select("r", "a", "b"))
    assert bag(split_left_join(left, written, ["r"], 10, keys.of("t", "r"))) == expected
    assert bag(split_left_join(left, written, ["r"], 10)) == expected


def test_routed_join_with_lists(spark, right):
    keys = KeySketches()
    live = stage(keys.watch("live", right.selectExpr("k as s", "b as x"), [("s",)]))
    other = stage(keys.watch("other", right.filter("b < 100").selectExpr("k as s", "b as y"), [("s",)]))
    left = spark.createDataFrame([("hot", "live"), ("hot", "other"), ("hot", None), ("k1", "live"), (None, "other")], "s string, way string")
    heavy = {"live": keys.of("live", "s"), "other": keys.of("other", "s")}
    out = [bag(routed_left_join(left, "s", "way", {"live": live, "other": other}, 7, h).select("s", "way", "x", "y")) for h in (heavy, None)]
    assert out[0] == out[1] and sum(out[0].values()) == 200 + 34 + 1 + 1 + 1


def test_many_keys_are_listed_up_to_a_bound(spark):
    from rosterlens.operators import heavy

    df = spark.range(60_000).selectExpr("if(id % 4 = 0, -1, id) as k")
    found = {r.key: r.rows for r in heavy_keys(df, ["k"]).collect()}
    assert len(found) <= heavy.LISTED
    assert abs(found["2:-1"] - 15_000) <= 60_000 * 3.5 / heavy.TRACKED


def test_empty_tables_and_null_keys(spark, right):
    left = spark.createDataFrame([("hot", 1, 1), (None, 2, 2)], "k string, r int, a long")
    for some in (right.filter("false"), right.selectExpr("cast(null as string) as k", "r", "b")):
        assert heavy_keys(some, ["k"]).collect() == []
        keys = KeySketches()
        written = stage(keys.watch("t", some, [("k",)]))
        assert keys.of("t", "k") == []
        expected = {("hot", 1, None), (None, 2, None)}
        for heavy in (None, [], keys.of("t", "k"), some):
            out = split_left_join(left, written.select("k", "b"), ["k"], 1, heavy)
            assert {(r.k, r.a, r.b) for r in out.collect()} == expected
