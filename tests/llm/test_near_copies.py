"""The near-dedup stage against brute-force Jaccard, and the stages after it."""

import random

import numpy as np

import corpus_pipeline
from lexspan.llm import near_copies, packing, secret_scan
from lexspan.llm.scratch import stored
from tests.llm.test_pipeline_plain import plain_secrets

SF = "/root/testdata/sf0.001"


def runs(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").split()
    width = min(5, len(words))
    return {" ".join(words[i : i + width]) for i in range(len(words) - width + 1)} if words else set()


def similar(a, b):
    return 5 * len(a & b) >= 4 * len(a | b)


def plain_kept(texts):
    """Ids that stay of texts by id, by brute force over all pairs."""
    sets = {i: runs(text) for i, text in texts.items()}
    root = {i: i for i in sets}
    for i in sorted(sets):
        for j in sorted(sets):
            if j < i and root[i] != root[j] and similar(sets[i], sets[j]):
                old, new = max(root[i], root[j]), min(root[i], root[j])
                root = {k: new if r == old else r for k, r in root.items()}
    return sorted(i for i, r in root.items() if i == r)


def corpus():
    pick = random.Random(11)
    texts = ["", None, "  ", "one", "One", "two words", "a b c d e", "a b c d e f"]
    for size in (30, 60, 200, 900):
        for _ in range(4):
            words = [f"w{pick.randrange(5000)}" for _ in range(size)]
            texts.append(" ".join(words))
            # A chain: each copy is like the one before it, the ends are unlike.
            for _ in range(12):
                for _ in range(max(1, size // 60)):
                    words[pick.randrange(size)] = f"n{pick.randrange(10**6)}"
                texts.append(" ".join(words))
            # Below the limit.
            for k in range(0, size, 8):
                words[k] = f"far{pick.randrange(10**6)}"
            texts.append(" ".join(words))
    pick.shuffle(texts)
    return dict(enumerate(texts))


def test_groups_are_those_of_brute_force(spark):
    texts = corpus()
    docs = spark.createDataFrame([(i, text) for i, text in texts.items()], "doc_id long, text string").repartition(4)
    kept = corpus_pipeline.dedup_stage(spark, docs, SF)
    assert sorted(row.doc_id for row in kept.collect()) == plain_kept(texts)
    assert corpus_pipeline.dedup_stage(spark, docs.limit(0), SF).count() == 0


def test_no_similar_pair_is_missed(spark):
    """Recall over pairs near the limit: every pair of 0.8 or more shares a band key."""
    pick = random.Random(5)
    tried = 0
    for _ in range(400):
        size = pick.randrange(20, 400)
        words = [str(pick.randrange(10**6)) for _ in range(size)]
        other = list(words)
        for _ in range(pick.randint(1, max(1, size // 40))):
            other[pick.randrange(size)] = "x"
        a, b = (near_copies.shingle_set(" ".join(one).encode()) for one in (words, other))
        if 5 * len(np.intersect1d(a, b)) >= 4 * len(np.union1d(a, b)):
            tried += 1
            assert (near_copies.band_keys(a) == near_copies.band_keys(b)).any()
    assert tried > 150


def test_stages_from_near_dedup_on(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    three = stored(stages["near_dedup"](spark, docs, SF), "three")
    assert sorted(row.doc_id for row in three.collect()) == plain_kept({row.doc_id: row.text for row in docs.collect()})
    four = stored(stages["secrets"](spark, three, SF), "four")
    assert sorted((row.doc_id, row.text) for row in four.collect()) == sorted(plain_secrets(three.collect(), secret_scan.train(three)))
    packed = stages["packing"](spark, four, SF).collect()
    counts = {row.doc_id: len(row.text.split()) for row in four.collect()}
    assert {i: sum(row.n_tokens for row in packed if row.doc_id == i) for i in counts} == counts
    histogram: dict[int, int] = {}
    for row in packed:
        histogram[row.n_tokens] = histogram.get(row.n_tokens, 0) + 1
    limits = packing.bounds(histogram, packing.BUCKETS)
    assert all(row.bucket == min(b for b in limits if b >= row.n_tokens) for row in packed)
