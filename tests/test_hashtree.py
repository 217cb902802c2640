"""Hash trees: one digest for any partitioning, bounded groups, and differences from few rows."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from lexspan.operators import hashtree as ht


def plain_digest(items, capacity, depth=0):
    def sha(text):
        return hashlib.sha256(text.encode()).hexdigest()

    items = sorted(items)
    if len(items) <= capacity:
        return sha("\n".join(items))
    parts = {}
    for item in items:
        parts.setdefault(sha(item)[: depth + 1], []).append(item)
    return sha("\n".join(f"{prefix}:{plain_digest(some, capacity, depth + 1)}" for prefix, some in sorted(parts.items())))


@pytest.mark.parametrize("count,capacity", [(0, 5), (5, 5), (6, 5), (700, 7), (60, 1)])
def test_the_digest_is_that_of_the_set(spark, count, capacity):
    items = [f"id{i}" for i in range(count)]
    frame = spark.createDataFrame([(item,) for item in [*items, *items[:3], None]], "id string")
    for parts in (1, 7) if count > 5 else (2,):
        tree = ht.build(frame.repartition(parts), "id", capacity)
        assert tree.root().first().digest == plain_digest(items, capacity)
        assert tree.nodes.where("leaf").agg(F.max("n")).first()[0] in (None, *range(1, capacity + 1))
        assert tree.nodes.where("not leaf and n <= %d" % capacity).isEmpty()


def test_differences_are_found_from_few_rows(spark):
    pick = random.Random(4)
    items = [f"id{i}" for i in range(6000)]
    gone, added = pick.sample(items, 3), ["new1", "new2"]
    left = ht.build(spark.createDataFrame([(i,) for i in items], "id string"), "id", 32)
    right = ht.build(spark.createDataFrame([(i,) for i in items if i not in gone] + [(i,) for i in added], "id string"), "id", 32)
    only, read = ht.difference(left, right)
    assert sorted(map(tuple, only.collect())) == sorted([(i, "missing") for i in gone] + [(i, "orphan") for i in added])
    row = read.first()
    assert row["items"] < 1000 and row["nodes"] < 500
    same, read = ht.difference(left, left)
    assert same.count() == 0 and read.first()["items"] == 0 and read.first()["nodes"] == 1


def test_leaves_against_inner_nodes_and_empty_sets(spark):
    few = spark.createDataFrame([(f"id{i}",) for i in range(3)], "id string")
    many = spark.createDataFrame([(f"id{i}",) for i in range(1, 400)], "id string")
    a, b, none = ht.build(few, "id", 4), ht.build(many, "id", 4), ht.build(few.limit(0), "id", 4)
    assert {tuple(r) for r in ht.difference(a, b)[0].collect()} == {("id0", "missing"), *((f"id{i}", "orphan") for i in range(3, 400))}
    assert ht.difference(none, a)[0].count() == 3 and ht.difference(none, none)[0].count() == 0
    with pytest.raises(ValueError):
        ht.difference(a, ht.build(few, "id", 5))
