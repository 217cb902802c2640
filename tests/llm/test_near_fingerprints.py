"""The near-dedup stage takes its first candidates from fingerprints of five words."""

import random

from lexspan.llm import near_copies, simhash_dedup
from lexspan.llm.scratch import stored


def test_fingerprints_propose_pairs_of_near_copies(spark):
    pick = random.Random(3)
    texts = []
    for _ in range(30):
        words = [f"w{pick.randrange(10**6)}" for _ in range(600)]
        texts.append(" ".join(words))
        words[pick.randrange(600)] = "other"
        texts.append(" ".join(words))
    docs = spark.createDataFrame([(text,) for text in [*texts, "", None, "one"]], "text string")
    rows = stored(near_copies.sketches(docs).selectExpr("text", "sketch", "sketch.name as name"), "named")
    of = {row.name: row for row in rows.collect()}
    assert all(row.sketch.fp == simhash_dedup.fingerprint((row.text or "").encode(), 5) for row in of.values())
    proposed = {(row.a, row.b) for row in near_copies.fingerprint_pairs(rows).collect()}
    near = {(a, b) for a in of for b in of if a < b and bin((of[a].sketch.fp ^ of[b].sketch.fp) & (1 << 64) - 1).count("1") <= near_copies.RADIUS}
    # Every set has a fingerprint of its own here, so all links stand, except between unlike sizes.
    near = {(a, b) for a, b in near if 5 * min(of[a].sketch.size, of[b].sketch.size) >= 4 * max(of[a].sketch.size, of[b].sketch.size)}
    assert proposed == near and len(near) > 10
