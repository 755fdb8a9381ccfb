"""How many tasks a step gets: by what it makes of its rows, and not by the size of its input."""

from __future__ import annotations

from airspark.plans import explain, models


def test_few_instances_do_not_share_one_task(spark):
    few = spark.range(100).coalesce(1)
    dealt = explain._dealt(few, ["id"])
    assert dealt.count() == 100
    assert dealt.rdd.getNumPartitions() == 8


def test_instances_of_a_task_are_bounded(spark):
    many = spark.range(2000).select("id")
    assert explain._dealt(many, ["id"]).rdd.getNumPartitions() == -(-2000 // explain.INSTANCES)


def test_partitions_of_training_rows_do_not_grow_without_end(spark, monkeypatch):
    monkeypatch.setattr(models, "FIT_ROWS", 10)
    rows = models.packed(spark.range(0, 4000, 1, 40))
    assert rows.rdd.getNumPartitions() == models.FIT_WAVES * spark.sparkContext.defaultParallelism
    assert rows.count() == 4000
