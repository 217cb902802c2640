"""The ball partition: the same rows as the exact search, and pairs skipped where vectors cluster."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexspan.operators import balls as bl
from lexspan.operators import vectors as vc


def table(spark, vectors):
    rows = [(i, None if v is None else [float(x) for x in v], "het_hieu_luc" if i % 5 == 0 else None) for i, v in enumerate(vectors)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, validity_status string").repartition(4)


def clustered(count, seed=1, width=16, near=0.05):
    draw = np.random.default_rng(seed)
    middle = draw.normal(size=(20, width))
    return [middle[draw.integers(20)] + near * draw.normal(size=width) for _ in range(count)]


def rows(frame):
    return sorted((row.query_id, row["rank"], row.vec_id, round(row.score, 8)) for row in frame.collect())


def queries_of(chunks, step):
    return chunks.where(F.col("vec_id") % step == 0).select(
        F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"), (F.col("vec_id") % 2 == 0).alias("skip_expired"))


@pytest.mark.parametrize("kind", ["clusters", "noise", "copies"])
def test_rows_are_those_of_the_exact_search(spark, monkeypatch, kind):
    monkeypatch.setattr(bl, "BLOCK", 40)
    monkeypatch.setattr(bl, "SEEDS", 30)
    draw = np.random.default_rng(7)
    if kind == "clusters":
        vectors = clustered(900)
    elif kind == "noise":
        vectors = list(draw.normal(size=(500, 16)))
    else:  # a third of all rows is one vector
        vectors = [np.ones(16)] * 300 + clustered(600)
    vectors += [None, [], [0.0] * 16, [1.0, 2.0], [3.0, 1.0], -np.asarray(vectors[0])]
    chunks = table(spark, vectors)
    asked = queries_of(chunks, 7).unionByName(spark.createDataFrame([(-1, [0.0] * 16, False), (-2, [1.0, 1.0], True)], "query_id long, vector array<float>, skip_expired boolean"))
    found, _ = bl.search(asked, bl.build(chunks, "vec_id", cells=12, buckets=3), 10)
    assert rows(found) == rows(vc.cosine_top_k(asked, chunks, 10, "vec_id"))


def test_most_pairs_are_skipped_on_clusters(spark):
    chunks = table(spark, clustered(8000, seed=3))
    asked = queries_of(chunks, 40)
    found, pairs = bl.search(asked, bl.build(chunks, "vec_id", buckets=3), 10)
    assert pairs.first().pairs < 0.3 * asked.count() * 8000
    assert found.count() == 10 * asked.count()


def test_vectors_stay_in_their_buckets(spark):
    chunks = table(spark, clustered(500))
    balls = bl.build(chunks, "vec_id", buckets=3)
    plan = bl._scored(bl._sent(queries_of(chunks, 9).select("query_id", F.col("vector").cast("array<double>").alias("vector"), F.col("skip_expired").alias("skip"), F.lit(-2.0).alias("limit")), balls, True), balls, 5)
    tree = plan._jdf.queryExecution().executedPlan().toString()
    side = tree[tree.index("FlatMapCoGroups"):].split("\n")
    scan = next(i for i, line in enumerate(side) if "balls_" in line)
    assert not any("Exchange" in line for line in side[scan - 4 : scan])


def test_empty_tables(spark):
    chunks = table(spark, clustered(50))
    asked = queries_of(chunks, 5)
    assert bl.search(asked, bl.build(chunks.limit(0), "vec_id", buckets=2), 3)[0].count() == 0
    assert bl.search(asked.limit(0), bl.build(chunks, "vec_id", buckets=2), 3)[0].count() == 0
    assert bl.search(asked, bl.build(chunks.where("vec_id < 2"), "vec_id", buckets=2), 3)[0].where("query_id = 5").count() == 2
