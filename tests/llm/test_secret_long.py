"""Secret scans of texts with very many spans: time grows with the text, results as ever."""

import random
import re
import time

from lexspan.llm import secret_scan


def test_a_text_of_very_many_values(spark):
    pick = random.Random(1)
    words = ["".join(pick.choices("0123456789abcdef", k=24)) for _ in range(100_000)]
    docs = spark.createDataFrame([(1, " ".join(words))], "doc_id long, text string")
    start = time.time()
    found = secret_scan.scan(docs, {"ab": 2000})
    row = secret_scan.masked(found).first()
    assert time.time() - start < 60  # thousands of seconds when lists were copied and overlaps tried one by one
    assert [(s.kind, s.start, s.end) for s in row.found[:2]] == [("hex", 0, 24), ("hex", 25, 49)] and len(row.found) == 100_000
    assert row.text == " ".join(["<secret>"] * 100_000)


def test_masks_over_blocks_and_overlaps(spark):
    pick = random.Random(2)
    rows = []
    for i in range(60):
        parts = []
        for _ in range(pick.randrange(1, 30)):
            parts.append(pick.choice(["é" * pick.randrange(1500), "\U0001f600\n", "token: " + "a1" * pick.randrange(2, 40), "f" * pick.randrange(20, 30), "AKIA" + "B7" * pick.randrange(5, 12), "secret=AKIA" + "C" * 20, " "]))
        rows.append((i, "".join(parts)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for row in secret_scan.masked(secret_scan.scan(docs, {}), found="found").collect():
        text, out, at = dict(rows)[row.doc_id], "", 0
        for s in row.found:
            if s.start >= at:
                out += text[at : s.start] + "<secret>"
            at = max(at, s.end)
        assert row.text == out + text[at:]


def test_runs_beside_and_within_base_spans(spark):
    """A run that any base span overlaps is left to that span, wherever it lies among many."""
    pick = random.Random(3)
    run = re.compile(secret_scan.RUN)
    rows = []
    for i in range(80):
        rows.append((i, pick.choice([" ", "/", ""]).join(pick.choice(["x" * 25, "f" * 24, "g" * 30, "AKIA" + "Z" * 16, "token=abcdef", "Q" * 19, "word"]) for _ in range(pick.randrange(40)))))
    model = {a + a: 3000 for a in "xgQZf"}
    for row in secret_scan.scan(spark.createDataFrame(rows, "doc_id long, text string"), model).collect():
        base = [(s.start, s.end) for s in row.found if s.kind != "markov"]
        score = lambda v: sum(model.get(v[k : k + 2], 0) for k in range(len(v) - 1)) >= 1000 * (len(v) - 1)
        want = [m.span() for m in run.finditer(row.text) if not any(a < m.end() and m.start() < b for a, b in base) and score(m[0])]
        assert [(s.start, s.end) for s in row.found if s.kind == "markov"] == want


def test_columns_named_like_temporaries_are_kept(spark):
    docs = spark.createDataFrame([(1, "f" * 30, "kept", {"a": 1})], "doc_id long, text string, _runs string, _hex map<string,int>")
    row = secret_scan.masked(secret_scan.scan(docs, {})).first()
    assert row.text == "<secret>" and row._runs == "kept" and row._hex == {"a": 1}
