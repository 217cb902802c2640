"""Every pipeline stage against a plain Python version of it, on the stage's own input."""

import math
import re

import corpus_pipeline
from lexspan.llm import langid, packing, quality, secret_scan
from lexspan.llm.scratch import stored
from tests.llm.test_corpus import plain_spans
from tests.llm.test_near import plain_fingerprint, roots

SF = "/root/testdata/sf0.001"


def plain_bins(text):
    words = re.split(r"[\x20\x09-\x0D]+", text)
    shares = [sum(c in some for c in text) / (len(text) + quality.SHORT) for some in ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", quality.SYMBOLS, "0123456789", "!?")]
    shares.append(sum(a != "" and a == b for a, b in zip(words, words[1:])) / (len(words) + quality.SHORT / 10))
    shares.append(len(words) / (len(text) + quality.SHORT))
    return [sum(s > edge for edge in quality.EDGES) for s in shares] + [math.floor(math.log2(len(words)) / 2)]


def plain_quality(rows, model):
    priors = {(row.host, row.path): row.path_prior for row in model.priors.collect()}
    kept = []
    for row in rows:
        evidence = sum(model.weights.get((k, which), 0.0) for k, which in enumerate(plain_bins(row.text or "")))
        prior = priors.get((row.source or "", row.lang or ""), model.middle)
        kept += [row] * (1 / (1 + math.exp(-evidence - math.log(prior / (1 - prior)))) >= corpus_pipeline.MIN_QUALITY)
    return kept


def plain_language(rows, filters):
    judged = [(row, *filters.judge(row.text, filters.chance())) for row in rows]
    return [row for row, lang, share in judged if lang != langid.UNDETERMINED and share >= corpus_pipeline.MIN_LANGUAGE]


def plain_dedup(rows):
    rows = sorted(rows, key=lambda row: row.doc_id)
    root = roots([plain_fingerprint(row.text) for row in rows], 3)
    return [row for i, row in enumerate(rows) if root[i] == i]


def plain_secrets(rows, model):
    out = []
    for row in rows:
        spans = [(start, end) for _, start, end in plain_spans(row.text)]
        for m in re.finditer(secret_scan.RUN, row.text or ""):
            own = sum(model.get(m[0][i : i + 2], 0) for i in range(len(m[0]) - 1))
            if own >= secret_scan.THRESHOLD * (len(m[0]) - 1) and all(e <= m.start() or m.end() <= s for s, e in spans[: len(plain_spans(row.text))]):
                spans.append((m.start(), m.end()))
        text, at = "", 0
        for start, end in sorted(spans):
            if start >= at:
                text += row.text[at:start] + "<secret>"
            at = max(at, end)
        out.append((row.doc_id, text + row.text[at:]))
    return out


def ids(rows):
    return sorted(row.doc_id for row in rows)


def test_stages(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    stages = dict(corpus_pipeline.STAGES)
    one = stored(stages["quality"](spark, docs, SF), "one")
    assert ids(one.collect()) == ids(plain_quality(docs.collect(), quality.fit(docs, labels)))
    two = stored(stages["language"](spark, one, SF), "two")
    assert ids(two.collect()) == ids(plain_language(one.collect(), langid.train(one)))
    three = stored(stages["near_dedup"](spark, two, SF), "three")
    assert ids(three.collect()) == ids(plain_dedup(two.collect()))
    four = stored(stages["secrets"](spark, three, SF), "four")
    assert sorted((row.doc_id, row.text) for row in four.collect()) == sorted(plain_secrets(three.collect(), secret_scan.train(three)))
    assert all(row.n_chars == len(row.text) for row in four.collect())
    packed = stages["packing"](spark, four, SF).collect()
    counts = {row.doc_id: len(row.text.split()) for row in four.collect()}
    assert {i: sum(row.n_tokens for row in packed if row.doc_id == i) for i in counts} == counts
    histogram: dict[int, int] = {}
    for row in packed:
        histogram[row.n_tokens] = histogram.get(row.n_tokens, 0) + 1
    limits = packing.bounds(histogram, packing.BUCKETS)
    assert all(row.bucket == min(b for b in limits if b >= row.n_tokens) for row in packed)
    assert sorted(map(tuple, packed)) == sorted(map(tuple, corpus_pipeline.run(spark, SF).collect()))
