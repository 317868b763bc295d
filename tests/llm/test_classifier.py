import random

import numpy as np
from pyspark.sql import functions as F

from ledgerlake.llm import classifier as c
from tests.llm.util import documents, frame, prose


def data(spark, n=300):
    rng = random.Random(2)
    rows = [(k, prose(k, 60) if k % 3 else " ".join(rng.choice(["BUY!!", "NOW!!", "###"]) for _ in range(60)), int(k % 3 > 0)) for k in range(n)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    return docs, spark.createDataFrame([(r[0], r[2]) for r in rows] + [(None, 1), (7, None)], "doc_id long, quality int")


def test_held_out_accuracy(spark):
    docs, labels = data(spark)
    model = c.fit(docs, labels, training=~c.is_held_out("_id"))
    found = c.score(docs, model).join(labels.where("quality IS NOT NULL"), "doc_id").where(c.is_held_out("doc_id")).collect()
    assert len(found) > 60 and np.mean([(r.score >= 0.5) == r.quality for r in found]) > 0.98
    # labels of held-out rows don't matter
    turned = labels.withColumn("quality", F.when(c.is_held_out("doc_id"), 1 - F.col("quality")).otherwise(F.col("quality")))
    again = c.fit(docs, turned, training=~c.is_held_out("_id"))
    assert np.array_equal(model.weights, again.weights) and model.slope == again.slope


def test_edges(spark):
    docs, labels = data(spark, 30)
    scored = c.score(frame(spark), c.fit(docs, labels)).collect()
    assert len(scored) == len(documents()) and all(0 <= r.score <= 1 for r in scored)
    one = c.fit(docs, labels.where("quality = 1"))
    assert all(r.score > 0.99 for r in c.score(docs, one).collect())
    assert [r.score for r in c.score(docs.limit(1), c.fit(docs, labels.limit(0))).collect()] == [0.5]
    assert c.score(docs.limit(0), one).count() == 0


def test_descent_separates():
    rows = [np.array([k % 2, 2]) for k in range(20)]
    y = np.array([1.0 if k % 2 else -1.0 for k in range(20)])
    w = c.descend(rows, y, np.ones(3), np.ones(20))
    assert all(np.sign(w[r].sum() + w[-1]) == t for r, t in zip(rows, y, strict=True))


def test_shapes():
    assert [c.shape_of(x) for x in ("Abc,", "ABC!!", "x9-y", "12.5")] == ["Xx,", "X!!", "x9-x", "9.9"]


def test_long_texts_train_whole(spark, monkeypatch):
    rows = [(k, " ".join(f"w{k}x{j}" for j in range(4000)) + (" junk junk" if k % 2 else ""), 1 - k % 2) for k in range(40)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, quality int")
    # the repeated pair, in the last bucket, marks the bad ones
    model = c.fit(docs, labels)
    assert len(c.features(rows[0][1], c.WordHashes())) > 2000 and model.weights[-1] < 0
    monkeypatch.setattr(c, "MAX_FEATURES", 60_000)
    assert c.fit(docs, labels).weights[-1] < 0
