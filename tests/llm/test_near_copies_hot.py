"""Near-dedup where one key holds thousands of sets: unlike ones with a common passage, and a long chain."""

import random

import numpy as np
from pyspark.sql import functions as F

from lexspan.llm import near_copies
from lexspan.llm.scratch import stored

MANY = 5000


def passages(pick):
    """Texts of which two thirds are one passage: similarity 0.5, so many share a key, and none is a copy."""
    passage = " ".join(f"common{k}" for k in range(70))
    return [f"{passage} " + " ".join(f"w{pick.randrange(10**8)}" for _ in range(30)) for _ in range(MANY)]


def chain(pick):
    """Each text is similar to the one before it (0.9), the ends have nothing in common."""
    words = [f"c{pick.randrange(10**8)}" for _ in range(100)]
    out = []
    for k in range(MANY):
        words[k * 37 % 100] = f"c{pick.randrange(10**8)}"
        out.append(" ".join(words))
    return out


def test_one_hot_passage_and_one_long_chain(spark):
    pick = random.Random(8)
    texts = passages(pick) + chain(pick)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    kept = sorted(row.doc_id for row in near_copies.deduplicate(docs).select("doc_id").collect())
    assert kept == [*range(MANY), MANY]


def test_unlike_sets_of_one_passage_never_meet(spark):
    texts = passages(random.Random(9))[:2000]
    frame = spark.createDataFrame([(f"{k:05d}", text) for k, text in enumerate(texts)], "name string, text string")
    sets = stored(near_copies.with_sets(frame).select("name", F.col("name").alias("part"), "runs"), "sets")
    assert near_copies.joined_by_prefix(sets).count() == 0


def test_prefixes_find_every_similar_pair(spark):
    pick = random.Random(4)
    base = [[f"w{pick.randrange(400)}" for _ in range(pick.choice([1, 4, 6, 40, 90, 150]))] for _ in range(24)]
    texts = []
    for words in base:
        for _ in range(12):
            other = list(words)
            for _ in range(pick.randrange(3)):
                other[pick.randrange(len(other))] = f"n{pick.randrange(50)}"
            texts.append(" ".join(other[: len(other) - pick.randrange(3)] or other))
    sets = {f"{k:04d}": near_copies.shingle_set(text.encode()) for k, text in enumerate(dict.fromkeys(texts))}
    frame = spark.createDataFrame([(name, name, runs.view(np.int64).tolist()) for name, runs in sets.items()], "name string, part string, runs array<long>")
    rows = stored(frame, "sets")
    found = {tuple(sorted((row.a, row.b))) for row in near_copies._similar(near_copies.joined_by_prefix(rows), rows).collect()}
    want = {(a, b) for a in sets for b in sets if a < b and 5 * len(np.intersect1d(sets[a], sets[b])) >= 4 * len(np.union1d(sets[a], sets[b]))}
    assert found == want and len(want) > 100


def test_odd_rows_and_clashing_columns(spark):
    long = " ".join(f"w{k}" for k in range(200))
    rows = [(3, long, 1, {"a": 1}), (2, long + " more", 2, None), (2, long + " more", 2, None), (None, long, 3, {}), (None, None, 4, {}), (None, "", 5, {}), (9, "other words here", 6, {})]
    docs = spark.createDataFrame(rows, "doc_id long, text string, root int, name map<string,int>")
    kept = near_copies.deduplicate(docs)
    assert kept.columns == docs.columns
    got = kept.collect()
    assert sorted(str(row.doc_id) for row in got) == ["2", "9", "None"] and sum(row.root in (4, 5) for row in got) == 1
    assert near_copies.deduplicate(docs.limit(0)).count() == 0
