"""Texts meet their labels in one shuffle, whatever their number."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from airspark.llm.toxicity import FitSettings, held_out, labelled_texts


def test_labels_and_texts_meet_in_one_shuffle(spark):
    rng = random.Random(2)
    texts = [(rng.randrange(900) if rng.random() < 0.97 else None, rng.choice([None, "", "a", "B b", "c c c"]), rng.choice([None, "x", "y"])) for _ in range(1500)]
    known = spark.range(0, 1400, 2).where(~held_out(F.col("id"))).select(F.col("id").alias("doc_id"), (F.col("id") % 5 == 0).cast("int").alias("toxic"), (F.col("id") % 3 == 0).alias("fit"))
    docs = spark.createDataFrame(texts, "doc_id long, text string, lang string").repartition(5)
    before = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.execution.arrow.maxRecordsPerBatch")}
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
        rows = labelled_texts(docs, known, 4, FitSettings())
        plan = rows._jdf.queryExecution().executedPlan().toString()
        got = rows.withColumn("part", F.spark_partition_id()).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert "SortMergeJoin" not in plan
    labels = {r["doc_id"]: (r["toxic"], r["fit"]) for r in known.collect()}
    want = {}
    for d, t, lang in texts:
        if d in labels:
            want[d] = min(want.get(d, ("~", "")), ((t or "").lower(), lang or ""))
    assert len(got) == len(want) and {r["doc_id"]: (r["text"], r["lang"]) for r in got} == want
    assert all((r["toxic"], r["fit"]) == labels[r["doc_id"]] for r in got)
    assert len({r["part"] for r in got}) == 4
