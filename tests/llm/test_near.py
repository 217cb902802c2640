"""Fingerprints, links and components, and exact search, against brute force."""

import hashlib
import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from lexspan.llm import fingerprints, simhash_dedup, topk
from lexspan.llm.graph import components

WORDS = [f"w{k}{'x' * (k % 7)}" for k in range(300)]


def corpus(seed: int, count: int) -> list[str | None]:
    pick = random.Random(seed)
    texts: list[str | None] = [None, "", "  \n", "one", "Two words", "a b c"]
    while len(texts) < count:
        words = pick.choices(WORDS, k=pick.randint(3, 400))
        texts.append(" ".join(words))
        if pick.random() < 0.5:
            words[pick.randrange(len(words))] = "changed"
            texts.append("\t".join(words))
        if pick.random() < 0.2:
            texts.append(texts[-1])
    return texts


def plain_fingerprint(text: str | None) -> int:
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").split()
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] * bool(words)
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))


def roots(values: list[int], radius: int) -> list[int]:
    root = list(range(len(values)))
    for i in range(len(values)):
        for j in range(i):
            if (values[i] ^ values[j]).bit_count() <= radius and root[i] != root[j]:
                old, new = max(root[i], root[j]), min(root[i], root[j])
                root = [new if r == old else r for r in root]
    return root


def test_components_are_those_of_the_definition(spark):
    texts = corpus(3, 120)
    docs = spark.createDataFrame([(i, text, "x") for i, text in enumerate(texts)], "doc_id long, text string, component_id string").repartition(4)
    found = {row.doc_id: row for row in simhash_dedup.group(simhash_dedup.fingerprints(docs).drop("text")).withColumn("hex", simhash_dedup.as_hex(F.col("fp"))).collect()}
    want = [plain_fingerprint(text) for text in texts]
    assert [found[i].hex for i in range(len(texts))] == [f"{one:016x}" for one in want]
    assert [found[i].component_id for i in range(len(texts))] == roots(want, 3)


@pytest.mark.parametrize("radius", [0, 1, 3, 5, 7])
def test_no_link_is_lost(spark, radius):
    pick = random.Random(radius)
    values = {pick.getrandbits(64) for _ in range(40)}
    for one in list(values):
        for _ in range(4):
            for bit in pick.sample(range(64), pick.randint(1, 8)):
                one ^= 1 << bit
            values.add(one)
    values = sorted(values | {0, (1 << 64) - 1, 1, 3, 7 << 61})
    signed = {one - (1 << 64) if one >> 63 else one: one for one in values}
    frame = spark.createDataFrame([(one,) for one in [*signed, None]], "fp long")
    want = {(a, b) for a in values for b in values if a < b and (a ^ b).bit_count() <= radius}
    for method in (simhash_dedup.links, fingerprints.near):
        got = [tuple(sorted((signed[row.a], signed[row.b]))) for row in method(frame, radius).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_odd_ids_and_empty_tables(spark):
    docs = spark.createDataFrame([(None, "same text here"), (4, "same text here"), (4, "same text here"), (None, "all by itself now")], "doc_id long, text string")
    got = simhash_dedup.group(simhash_dedup.fingerprints(docs)).collect()
    assert sorted((row.text, str(row.component_id)) for row in got) == [("all by itself now", "None"), *[("same text here", "4")] * 3]
    empty = docs.limit(0)
    assert simhash_dedup.group(simhash_dedup.fingerprints(empty)).count() == 0
    assert fingerprints.describe(empty).count() == 0


def test_long_chains_are_one_component(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501), (7, 7), (None, 3)], "a long, b long")
    got = {row.node: row.root for row in components(links).collect()}
    assert got == {**{i: 0 for i in range(201)}, 500: 500, 501: 500}
    assert components(links.limit(0)).count() == 0


@pytest.mark.parametrize("spread", [1, 300, 70_000])
def test_edited_texts_and_neighbours(spark, spread):
    texts = ["é" + text if text else text for text in corpus(spread, 40)]
    ids = [(i - 3) * spread for i in range(len(texts))]
    rows = [*zip(ids, texts, strict=True), (None, "no place")]
    docs = spark.createDataFrame([(*row, "x") for row in rows], "doc_id long, text string, fp string").repartition(3)
    got = {row.doc_id: row for row in fingerprints.describe(docs).collect()}
    assert len(got) == len(rows)
    order = sorted(ids, reverse=True)
    text_of = {i: text or "" for i, text in rows}
    every = [int(row.fingerprint, 16) for row in got.values()]
    for at, i in enumerate(order):
        row, text, after = got[i], text_of[i], order[(at + 1) % len(order)]
        half = len(text) // 2
        edited = text[: len(text) - half] + text_of[after][:half]
        assert row.n_chars == len(text) and row.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        mine = int(row.fingerprint, 16)
        assert row.near_next == 1 - (mine ^ int(got[after].fingerprint, 16)).bit_count() / 64
        assert row.near_edited == 1 - (mine ^ int(row.edited_fingerprint, 16)).bit_count() / 64
        assert row.near_docs == sum((mine ^ other).bit_count() <= 3 for other in every) - 1
    assert got[None].near_next is None and got[None].edited_sha256 == hashlib.sha256(b"no p").hexdigest()


def plain_top(rows: list[tuple], k: int) -> list[tuple]:
    good = {}
    for i, vector in rows:
        if i is not None and vector and all(x is not None and np.isfinite(x) for x in vector):
            whole = [int(np.floor(1024 * float(x))) for x in vector]
            good[i] = min(good.get(i, whole), whole)
    out = []
    for q in good:
        if q % 100 == 0:
            scored = sorted((-sum(a * b for a, b in zip(good[q], v, strict=True)), i) for i, v in good.items() if i != q and len(v) == len(good[q]))
            out += [(q, rank + 1, i, -score) for rank, (score, i) in enumerate(scored[:k])]
    return sorted(out)


def test_exact_search(spark, monkeypatch):
    monkeypatch.setattr(topk, "CANDIDATES", 100)
    monkeypatch.setattr(topk, "QUERIES", 3)
    draw = np.random.default_rng(5)
    rows = [(i, draw.normal(size=32).round(3).tolist()) for i in range(900)]
    rows += [(i, rows[0][1]) for i in range(900, 960)]  # ties
    rows += [(2000, None), (2100, []), (2200, [1.0, None]), (2300, [float("nan")] * 32), (2400, [float("inf")] * 32), (None, [1.0] * 32)]
    rows += [(2500, [1.0, 2.0]), (2600, [-3.0, 2.5]), (2700, [1e10] * 32), (0, rows[0][1]), (100, [0.5] * 32)]
    frame = spark.createDataFrame([(*row, 1) for row in rows], "vec_id long, embedding array<double>, score int").repartition(3)
    got = sorted(tuple(row) for row in topk.top_k(frame, F.col("vec_id") % 100 == 0).collect())
    assert got == plain_top(rows, 10)
    assert topk.top_k(frame.limit(0), F.col("vec_id") % 100 == 0).count() == 0
    assert topk.top_k(frame.where("vec_id < 3"), F.col("vec_id") % 100 == 0).count() == 2
