"""The toxicity network learns from every labelled row."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from airspark.llm.toxicity import held_out, score_all


def test_words_of_late_rows_are_learned(spark, prose):
    """A toxic word of those rows only that a fit on the first 2,000 toxic rows, by the order of their hashes, leaves out."""
    ids = spark.range(12_000).withColumn("own", ~held_out(F.col("id")) & (F.pmod(F.xxhash64("id", F.lit(7)), F.lit(4)) != 0))
    order = [r["id"] for r in ids.where("own and id % 2 = 0").orderBy(F.xxhash64("id", F.lit(7)), "id").collect()]
    late = set(order[2000:])
    assert len(late) > 500
    rng, rows = random.Random(2), []
    for i in range(12_000):
        words = prose(i, 8, 500)
        if i % 2 == 0:
            words[rng.randrange(8)] = "lateword" if i in late else "vileword"
        rows.append((i, " ".join(words), "en"))
    asked = [(20_000, "w1 w2 vileword w3", "en"), (20_001, "w1 w2 lateword w3", "en"), (20_002, "w1 w2 w4 w3", "en")]
    docs = spark.createDataFrame(rows + asked, "doc_id long, text string, lang string").repartition(4)
    labels = spark.createDataFrame([(i, int(i % 2 == 0)) for i in range(12_000)], "doc_id long, toxic int")
    found = {r["doc_id"]: r["score"] for r in score_all(docs, labels).where("doc_id >= 20000").collect()}
    assert found[20_000] > 0.9 and found[20_001] > 0.9 and found[20_002] < 0.1


def test_long_texts_are_learned(spark, prose):
    """Texts over 60,000 characters count as well."""
    rows = [(i, ("vileword " if i % 2 else "") + " ".join(prose(i % 2, 12_000)), "en") for i in range(24)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(24)], "doc_id long, toxic int")
    found = {r["doc_id"]: r["score"] for r in score_all(docs, labels).collect()}
    assert min(found[i] for i in range(1, 24, 2)) > max(found[i] for i in range(0, 24, 2))
