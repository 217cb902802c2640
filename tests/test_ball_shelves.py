"""A query is sent to shelves of blocks, not to every block, and its rows stay those of the exact search (F10, F11)."""

import numpy as np
from pyspark.sql import functions as F

from lexspan.operators import balls as bl
from lexspan.operators import vectors as vc


def test_a_query_goes_to_shelves(spark, monkeypatch):
    monkeypatch.setattr(bl, "BLOCK", 20)
    monkeypatch.setattr(bl, "ROUND", 100)
    draw = np.random.default_rng(5)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(draw.normal(size=(3000, 16)))]
    chunks = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4)
    asked = chunks.where("vec_id % 12 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    balls = bl.build(chunks, "vec_id", cells=12, buckets=3)
    every = asked.select("query_id", F.col("vector").cast("array<double>").alias("vector"), F.lit(False).alias("skip"), F.lit(-2.0).alias("limit"))
    sent = bl._sent(every, balls, False)
    shelves = balls.rings["shelf"].nunique()
    assert shelves < len(balls.rings) / 4
    assert sent.count() <= asked.count() * shelves
    found, _ = bl.search(asked, balls, 5)
    got = lambda df: sorted((r.query_id, r["rank"], r.vec_id, round(r.score, 8)) for r in df.collect())
    assert got(found) == got(vc.cosine_top_k(asked, chunks, 5, "vec_id"))
