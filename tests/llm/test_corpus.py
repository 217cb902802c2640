"""Language, quality, URL, packing and secret operators, and the pipeline, against brute force."""

import datetime
import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lexspan.llm import langid, packing, quality, secret_scan, url_filter
from lexspan.llm.scratch import stored

SF = "/root/testdata/sf0.001"


# Language ------------------------------------------------------------------------------
def test_language_of_held_out_texts(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    filters = langid.train(docs.where(~held))
    assert filters.languages == ["de", "en", "es", "fr"] and (filters.chance() < 0.05).all()
    judged = langid.predict(docs.where(held), filters).select("lang", "lang_pred", "score").collect()
    assert sum(row.lang == row.lang_pred for row in judged) >= 0.95 * len(judged) and all(0 <= row.score <= 1 for row in judged)
    odd = spark.createDataFrame([(None, "x"), ("", "x"), ("12 ... 34 !?", "x"), ("日本語", "x"), ("the " * 400_000, "x")], "text string, score string")
    got = langid.predict(odd, filters).collect()
    assert [row.lang_pred for row in got] == ["und", "und", "und", "de", "en"] and [row.score for row in got[:4]] == [0.0] * 4
    assert langid.predict(docs.limit(0), filters).count() == 0


def test_language_without_training_rows(spark):
    docs = spark.createDataFrame([(1, "some text", None), (2, None, "en")], "doc_id long, text string, lang string")
    assert [row.lang_pred for row in langid.predict(docs, langid.train(docs)).collect()] == ["und", "und"]


def test_more_languages_than_a_word_has_bits():
    import numpy as np

    words = {f"l{k:03d}": f"{chr(97 + k // 26)}{chr(97 + k % 26)}x{chr(122 - k % 26)}" for k in range(70)}
    grams = {name: np.concatenate(list(langid.gram_hashes(word))) for name, word in words.items()}
    filters = langid.Filters.build(grams)
    assert filters.slots.shape[0] == 2
    assert [filters.judge(word, filters.chance())[0] for word in words.values()] == list(words)


# Quality -------------------------------------------------------------------------------
def test_quality_agrees_with_labels(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    judged = quality.score(docs, quality.fit(docs, labels)).join(labels, "doc_id")
    good, bad = judged.where("quality = 1"), judged.where("quality = 0")
    assert good.where("quality_score >= 0.5").count() >= 0.97 * good.count()
    assert bad.where("quality_score < 0.5").count() >= 0.9 * bad.count()


def test_sparse_sites_lean_to_their_host(spark):
    plain, loud = "some quiet words of a text", "BUY NOW!!! " * 30
    rows = [(i, "h1", "p1", loud) for i in range(100)] + [(i, "h2", "p2", plain) for i in range(100, 300)] + [(300, "h1", "p9", plain), (301, "h3", None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, text string")
    labels = spark.createDataFrame([(i, int(i >= 100)) for i in range(0, 300, 3)] + [(None, 1), (7, None)], "doc_id long, quality int")
    model = quality.fit(docs, labels)
    prior = {(row.host, row.path): row for row in model.priors.collect()}
    assert prior["h1", "p1"].path_prior < 0.1 < 0.9 < prior["h2", "p2"].path_prior
    assert prior["h1", "p9"].host_prior < 0.2 and prior["h1", "p9"].path_prior < prior["h2", "p2"].path_prior
    scored = {row.doc_id: row.quality_score for row in quality.score(docs, model).collect()}
    assert len(scored) == 302 and max(scored[i] for i in range(100)) < 0.5 < min(scored[i] for i in range(100, 300))
    unseen = spark.createDataFrame([(1, "new", "new", plain)], docs.schema)
    assert quality.score(unseen, model).first().path_prior == round(model.middle, quality.ROUND)
    blind = quality.fit(docs, labels.limit(0))
    assert {row.evidence for row in quality.score(docs, blind).collect()} == {0.0}
    assert quality.score(docs.limit(0), quality.fit(docs.limit(0), labels)).count() == 0


# URLs ----------------------------------------------------------------------------------
def plain_verdict(url, at, entries):
    if url is None or at is None:
        return "none", None
    found = re.match(r"(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:@]*)(?::\d+)?([^?#]*)", url)
    if not found or not found[1]:
        return "none", None
    host, parts = found[1].lower(), [p for p in found[2].split("/") if p]
    labels = host.split(".")
    could = [".".join(labels[-k:]) for k in range(1, len(labels) + 1)] + [f"{host}/{'/'.join(parts[:k])}/" for k in range(1, len(parts) + 1)]
    for pattern in reversed(could):
        own = [(when, ("remove", "allow", "block").index(say)) for p, say, when in entries if p == pattern and say in ("remove", "allow", "block") and when is not None and when <= at]
        if own and max(own)[1]:
            return ("remove", "allow", "block")[max(own)[1]], pattern
    return "none", None


def test_lists_as_of_each_fetch(spark):
    pick, start = random.Random(2), datetime.datetime(2024, 1, 1)
    hosts = ["hot.example.com", "a.b.example.org", "Plain.Net", "example.com"]
    urls = [f"http://u:p@{h}:80/{p}?q#f".replace("u:p@", pick.choice(["", "user@"])) for h in hosts for p in ("", "x", "x/y/z", "x//y/")] + [None, "no url", "//", "mailto:x"]
    times = [start + datetime.timedelta(seconds=1800 * k) for k in range(60)]
    captures = [(i, pick.choice(urls + urls[:3] * 9), pick.choice([*times, None]), "old") for i in range(400)]
    captures += captures[:3]
    patterns = ["hot.example.com", "example.com", "com", "a.b.example.org", "b.example.org", "plain.net", "hot.example.com/x/", "hot.example.com/x/y/", None]
    entries = [(pick.choice(patterns + patterns[:1] * 9), pick.choice(["block", "allow", "remove", "odd", None]), pick.choice([*times, None])) for _ in range(300)]
    left = spark.createDataFrame(captures, "page_id long, url string, fetched_at timestamp, action string").repartition(3)
    right = spark.createDataFrame(entries, "pattern string, action string, listed_at timestamp")
    got = sorted(((row.page_id, row.action, row.pattern) for row in url_filter.judge(left, right).collect()), key=str)
    assert got == sorted(((i, *plain_verdict(url, at, entries)) for i, url, at, _ in captures), key=str)
    assert {row.action for row in url_filter.judge(left, right.limit(0)).collect()} == {"none"}
    assert url_filter.judge(left.limit(0), right).count() == 0
    spans = [row for row in url_filter.intervals(right).collect() if row.pattern == "hot.example.com"]
    assert [a.valid_to for a in sorted(spans, key=lambda r: r.valid_from)][:-1] == sorted(a.valid_from for a in spans)[1:]


# Packing -------------------------------------------------------------------------------
@pytest.mark.parametrize("seed", range(12))
def test_bounds_are_optimal(seed):
    pick = random.Random(seed)
    histogram = {length: pick.randint(1, 30) for length in pick.sample(range(40), pick.randint(1, 9))}
    buckets = pick.randint(1, 4)

    def padding(limits):
        return sum(n * (min(b for b in limits if b >= length) - length) for length, n in histogram.items())

    got = packing.bounds(histogram, buckets)
    lengths = sorted(histogram)
    least = min(padding([*some, lengths[-1]]) for k in range(min(buckets, len(lengths))) for some in itertools.combinations(lengths[:-1], k))
    assert got == sorted(set(got)) and len(got) <= buckets and got[-1] == lengths[-1] and padding(got) == least


def test_packed_batches_are_whole_and_full(spark):
    pick = random.Random(4)
    counts = [0, None, 1, 64, 65, 128, 1000] + [pick.randint(1, 300) for _ in range(300)]
    rows = [(i if i % 50 else None, n, i) for i, n in enumerate(counts)] + [(3, 64, 3)] * 20
    docs = spark.createDataFrame(rows, "doc_id long, n_tokens long, bucket long").repartition(3)
    got = packing.pack(docs, longest=64, budget=256, buckets=3, mark="bucket").collect()
    assert sum(row.n_tokens for row in got) == sum(n or 0 for _, n, _ in rows) and len(got) == sum(max(1, -(-(n or 0) // 64)) for _, n, _ in rows)
    assert all(row.n_tokens <= row.bucket <= 64 and row.start == 64 * row.piece for row in got)
    assert len({(row.bucket, row.batch, row.slot) for row in got}) == len(got)
    for bound in {row.bucket for row in got}:
        room = max(1, 256 // max(bound, 1))
        own = sorted((row.batch, row.slot) for row in got if row.bucket == bound)
        assert own == [(i // room, i % room) for i in range(len(own))]
    assert packing.pack(docs.limit(0)).count() == 0


# Secrets -------------------------------------------------------------------------------
PLAIN = {
    "assign": re.compile(r"(?ai:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"),
    "access": re.compile("AKIA[A-Z0-9]+"),
    "hex": re.compile("[0-9a-f]+"),
}


def plain_spans(text):
    out = []
    for rank, (kind, least) in enumerate((("assign", 6), ("access", 20), ("hex", 24))):
        for m in PLAIN[kind].finditer(text or ""):
            if len(m[1] if kind == "assign" else m[0]) >= least:
                out.append((m.start(), rank, kind, m.end()))
    return [(kind, start, end) for start, _, kind, end in sorted(out)]


def test_base_spans_and_masks(spark):
    pick = random.Random(6)
    bits = ["token", "TOKEN", "Api_Key", "apikey", "secret", " ", "  ", ":", "=", '"', "'", "abc", "abcdef", "0123456789ab", "f" * 13, "AKIA", "ABCDEFGH12345678", "é", "\U0001f600", "\n", "ſecret", "passwd", "=x."]
    texts = [None, "", "secret: token: abcdefgh", "AKIA" + "A" * 15, "AKIA" + "A" * 16, "x" + "0" * 24 + "y" + "a" * 23] + ["".join(pick.choices(bits, k=25)) for _ in range(400)]
    docs = spark.createDataFrame([(i, text, "x") for i, text in enumerate(texts)], "doc_id long, text string, found string")
    found = secret_scan.scan(docs, {})
    clean = {row.doc_id: row.text for row in secret_scan.masked(found).collect()}
    for row in found.collect():
        want = plain_spans(row.text)
        assert [tuple(span) for span in row.found] == want
        out, at = "", 0
        for _, start, end in want:
            if start >= at:
                out += (row.text or "")[at:start] + "<secret>"
            at = max(at, end)
        assert clean[row.doc_id] == (out + row.text[at:] if want else row.text)
    assert secret_scan.scan(docs.limit(0), secret_scan.train(docs.limit(0))).count() == 0


def test_models_add_random_strings_only(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = secret_scan.train(docs)
    assert len(model) <= len(secret_scan.ALPHABET) ** 2
    loose, plain = "q7Zt2LmXw9Kp4RvB8nYc3HdJ", "understandingthewhitehouses"
    rows = spark.createDataFrame([(f"see {loose} and {plain} here", 1), (f"token={loose}", 2)], "text string, n int")
    assert [[tuple(s) for s in row.found] for row in secret_scan.scan(rows, model).orderBy("n").collect()] == [[("markov", 4, 28)], [("assign", 0, 30)]]


# Pipeline ------------------------------------------------------------------------------
def test_stages_act_and_keep_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == columns
        docs = stored(docs, "stage")
        counts.append(docs.count())
    assert counts[0] > counts[1] >= counts[2] > counts[3] == counts[4]
    assert all(plain_spans(row.text) == [] for row in docs.collect())
    packed = corpus_pipeline.run(spark, SF)
    assert packed.select("doc_id").distinct().count() == counts[4]


def test_pipeline_on_odd_rows(spark):
    text = "und der die das ist ein guter Text mit vielen Worten " * 5
    rows = [(1, text, "de", "s", 1), (1, text, "de", "s", 1), (2, text, "de", "s", 1), (None, "ganz andere Worte stehen hier und sonst nichts davon", "de", None, None), (None, None, None, None, None), (5, "", "de", "s", 0), (6, "12 34", "de", "s", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert corpus_pipeline.language_stage(spark, docs, SF).count() == 4
    kept = corpus_pipeline.dedup_stage(spark, docs, SF).collect()
    assert sorted(str(row.doc_id) for row in kept) == ["1", "5", "6", "None"]
    assert corpus_pipeline.secrets_stage(spark, docs, SF).count() == 7
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), SF).count() == 0
