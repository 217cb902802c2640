"""Exact dedup against plain grouping: lengths, prefixes, hot groups, odd rows."""

import hashlib
import random

from pyspark.sql import functions as F

from lexspan.llm import exact_dedup


def plain_normal(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def plain(rows):
    groups = {}
    for i, text in rows:
        groups.setdefault(plain_normal(text), []).append(i)
    return {key: (max((i for i in ids if i is not None), default=None), len(ids)) for key, ids in groups.items()}


def corpus():
    pick = random.Random(3)
    stem = "p" * exact_dedup.PREFIX
    texts = ["", None, "É", "é", "ß", "SS", "Ab", "aB", "ab ", stem + "x", stem + "y", stem.upper() + "X", "İ", "i̇", "K", "k"]
    texts += ["z" * exact_dedup.COUNTED, "Z" * exact_dedup.COUNTED, "z" * (exact_dedup.COUNTED + 1), "y" * (3 << 20), "y" * ((3 << 20) - 1) + "Y"]
    texts += ["hot Text"] * 150 + ["HOT text"] * 50
    texts += ["".join(pick.choices("aAbBéÉ", k=pick.randint(1, 3))) for _ in range(300)]
    pick.shuffle(texts)
    return list(enumerate(texts)) + [(None, "only without id"), (None, "hot text"), (None, "only Without id")]


def test_groups_are_those_of_the_definition(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    want = plain(rows)
    text_of = dict(rows)
    got = exact_dedup.decide(docs, digest="sha").collect()
    assert len(got) == len(rows)
    for row in got:
        if row.doc_id is None:
            continue
        text = plain_normal(text_of[row.doc_id])
        assert (row.keep_id, row.group_size) == want[text]
        assert row.kept == (row.doc_id == row.keep_id)
        assert row.sha == hashlib.sha256(text.encode()).hexdigest()
    nameless = sorted((row.group_size, row.keep_id is None, row.kept) for row in got if row.doc_id is None)
    assert nameless == [(2, True, False), (2, True, True), (201, False, False)]
    assert sum(row.kept for row in got) == len(want)


def test_joins_by_shuffle_give_the_same(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    one = sorted(map(str, exact_dedup.decide(docs).collect()))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert sorted(map(str, exact_dedup.decide(docs).collect())) == one
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_repeated_rows_clashing_columns_and_empty_tables(spark):
    rows = [(5, "a", 1, {"k": 1}), (5, "A", 2, {"k": 2}), (4, "a", 3, None), (9, "b", 4, {})]
    docs = spark.createDataFrame(rows, "doc_id long, text string, keep_id int, kept map<string,int>")
    kept = exact_dedup.deduplicate(docs)
    assert kept.columns == docs.columns
    got = kept.collect()
    assert sorted(row.doc_id for row in got) == [5, 9]
    assert exact_dedup.decide(docs.limit(0)).count() == 0
    assert exact_dedup.deduplicate(docs.limit(0)).count() == 0
    named = docs.select(F.col("doc_id").cast("string").alias("url"), F.col("text").alias("body"))
    assert sorted(row.url for row in exact_dedup.deduplicate(named, "url", "body").collect()) == ["5", "9"]
