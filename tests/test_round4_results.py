from datetime import datetime

from pyspark.sql import functions as F

from lexspan.catalog import sources
from lexspan.functions import text as tx


def test_numbers_are_rounded_by_their_binary_value(spark):
    numbers = [0.4975, 0.0625, -0.0001, 12345678.0005, float("inf"), float("nan"), None, 1e22]
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(numbers)], "i int, v double")
    seen = [r.t for r in rows.orderBy("i").select(tx.fixed(F.col("v"), 3).alias("t")).collect()]
    assert seen == ["0.497", "0.062", "-0.000", "12345678.000", "inf", "nan", None, "10000000000000000000000.000"]


def test_report_adds_scores_in_order_of_events(spark, tmp_path):
    values = [0.1, 0.2, 0.3, 1e16, -1e16, 40.0, 59.5, 0.15, None]
    rows = [(i, datetime(2024, 1, 1), 7, "view", v, "{}") for i, v in enumerate(values)]
    rows += [(100, datetime(2024, 1, 1), 8, "view", None, "{}")]
    events = spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double, props string")
    events.orderBy(F.desc("event_id")).write.parquet(f"{tmp_path}/events.parquet")
    lines = [r.line for r in sources.report_markdown(spark, str(tmp_path)).collect()]
    total = 0.0
    for value in values[:-1]:
        total += value
    assert f"- Score: {total / 8 / 100:.3f}" in lines and "- Pass rate: 0.00%" in lines
    assert lines.count("### u8 [FAIL]") == 1 and None in lines


def test_lists_of_documents_are_joined_once_for_each_set_of_names(spark):
    from lexspan.operators import analysis as an

    texts = spark.createDataFrame([("a", "see x and y"), ("b", "see x and y"), ("a", "only z"), ("c", "none"), ("b", "see x and y")], "k string, text string")
    terms = spark.createDataFrame([(f"d{i}", "x") for i in range(3)] + [("d1", "y"), ("e", "y"), ("f", "z")], "doc_id string, term string")
    out = an.resolve_documents(texts, terms, "k", "|")
    assert sorted((r["k"], r["doc_ids"]) for r in out.collect()) == [("a", "d0|d1|d2|e|f"), ("b", "d0|d1|d2|e")]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join Inner, (names") < plan.index("array_join")  # below the join, not for every row


def test_long_lists_are_dealt_to_more_parts(spark):
    from lexspan.operators import analysis as an

    texts = spark.range(40).select(F.col("id").alias("k"), F.concat(F.lit("see x"), F.col("id") % 20, F.lit("y")).alias("text"))
    terms = spark.range(400_000).select(F.concat(F.lit("document"), "id").alias("doc_id"), F.concat(F.lit("x"), F.col("id") % 20, F.lit("y")).alias("term"))
    out = an.resolve_documents(texts, terms, "k", "|")
    assert out.count() == 40 and out.rdd.getNumPartitions() > spark.sparkContext.defaultParallelism


def test_node_tree_parses_once(spark):
    from lexspan.catalog import metadata as mq

    plan = mq.nodes(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate posexplode") == 1


def test_headings_come_with_the_units_or_from_the_outline(spark):
    from lexspan.operators import metadata as md
    from lexspan.operators import structure as st

    text = "Chương I. Một\nMục 1. Hai\nĐiều 1. Ba\n1. Bốn\na) Năm\nb) Sáu\nChương II. Bảy\nĐiều 2. Tám\nChín."
    docs = spark.createDataFrame([(1, text, "T")], "doc_id long, text string, title string")
    outlined = st.outline(st.parse_lines(docs))
    once = md.nodes(docs, None, st.units(outlined, heads=True)).collect()
    apart = md.nodes(docs, outlined, st.units(outlined)).collect()
    assert sorted(map(repr, once)) == sorted(map(repr, apart)) and len(once) == 9


def test_files_beyond_one_value_are_digested(spark, tmp_path):
    import hashlib

    from lexspan.operators import integrity as ig

    held = {"small": b"abc", "large": bytes(range(256)) * 10, "other file": b"x" * 2000}
    (tmp_path / "below").mkdir()
    for name, data in held.items():
        (tmp_path / "below" / name).write_bytes(data)
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", "1000")
    try:
        seen = {r.path.split("/")[-1].replace("%20", " "): r.sha256 for r in ig.file_fingerprints(spark, str(tmp_path)).collect()}
    finally:
        spark.conf.unset("spark.sql.sources.binaryFile.maxLength")
    assert seen == {name: hashlib.sha256(data).hexdigest() for name, data in held.items()}


def test_kinds_of_chunks_come_from_one_parse(spark, monkeypatch):
    from lexspan.catalog import chunking as cq

    plans = []
    counted = cq.ck.chunk_documents
    monkeypatch.setattr(cq.ck, "chunk_documents", lambda units, forms, cases: plans.extend([units, forms]) or counted(units, forms, cases))
    cq.all_kinds(spark, "/root/testdata/sf0.001")
    assert len(plans) == 2
    # Both start from lines or units that are there, not from the texts.
    assert all("parquet" not in plan._jdf.queryExecution().optimizedPlan().toString() for plan in plans)


def test_authorities_are_scored_once(spark):
    from lexspan.catalog import grounding as gq

    plan = gq.primary_authorities(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "parquet" not in plan and "lower(" not in plan  # all steps start from the scored rows


def test_targets_that_a_row_answers_are_numbered(spark):
    from lexspan.operators import grounding as gr

    rows = spark.createDataFrame(
        [("c1", "Điều 5 Luật A", ["Điều 6", None, "Luật A"]), ("c2", "Điều 7", []), ("c3", None, ["zz"]), ("c4", "Điều 8", None)],
        "chunk_id string, citation string, targets array<string>").selectExpr("*", "'d' as doc_id", "'' as number", "'' as title", "'' as article_title")
    seen = {r.chunk_id: r.a for r in rows.select("chunk_id", gr.answered_targets(F.col("targets")).alias("a")).collect()}
    assert seen == {"c1": [2], "c2": None, "c3": [], "c4": None}


def test_scores_are_cut_before_they_are_shuffled(spark):
    from lexspan.operators import lexical as lx
    from lexspan.operators import ranking as rk

    chunks = spark.range(300).select(
        F.concat_ws("_", F.col("id") % 20, F.col("id")).alias("chunk_id"), F.concat(F.lit("alpha word"), F.col("id") % 7, F.lit(" word"), F.col("id") % 11).alias("text"))
    index = lx.build_index(chunks).withColumn("doc_id", F.substring_index("chunk_id", "_", 1))
    asked = spark.createDataFrame([("q1", "word3 word5"), ("q2", "word0 word9")], "query_id string, normalized_query string").selectExpr(
        "*", "array() as query_variants", "array() as keywords", "array() as key_phrases")
    asked = asked.withColumns({c: F.col(c).cast("array<string>") for c in ("query_variants", "keywords", "key_phrases")})

    def best(scores):
        return rk.diversify(scores.withColumns({"document_role": F.lit(""), "final": F.round("bm25", 6)}), 10)

    together = best(lx.bm25(asked, index, by="doc_id"))
    apart = best(lx.bm25(asked, index).withColumn("doc_id", F.substring_index("chunk_id", "_", 1)))
    rows = lambda df: sorted((r.query_id, r["rank"], r.chunk_id, r.final) for r in df.collect())
    assert rows(together) == rows(apart) and together.count() == 20
    shuffles = [line for line in together._jdf.queryExecution().executedPlan().toString().split("\n") if "Exchange hashpartitioning" in line]
    assert not any("query_id" in line and ("doc_id" in line or "_w0" in line) for line in shuffles)
    assert "WindowGroupLimit" in together._jdf.queryExecution().executedPlan().toString()
