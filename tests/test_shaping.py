from pyspark.sql import functions as F

from rosterlens.sources import shaping


def test_feeds_made_from_keys_are_dealt_out_before_rows_are_multiplied(spark, monkeypatch):
    part = spark.range(1000).select(F.col("id").alias("p_partkey")).coalesce(1)
    for feed, each in ((shaping.raw_events, 5), (shaping.raw_scenario_goals, 3), (shaping.raw_events_mindset, 2)):
        plain = feed({"part": part}.get)
        monkeypatch.setattr(shaping, "SPREAD_ROWS", 100)
        dealt = feed({"part": part}.get)
        monkeypatch.undo()
        sizes = [r["count"] for r in dealt.groupBy(F.spark_partition_id()).count().collect()]
        assert len(sizes) > 5 and max(sizes) < each * 1.4 * 300
        assert sorted(map(str, dealt.collect())) == sorted(map(str, plain.collect()))
