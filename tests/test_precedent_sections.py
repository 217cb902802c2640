from pyspark.sql import functions as F

from lexspan.catalog.structure import precedent_texts
from lexspan.functions import text as tx
from lexspan.operators import integrity as ig
from lexspan.operators import structure as st


def _folder(spark, tmp_path, texts):
    rows = [(i, text, "en", "src1") for i, text in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


def test_empty_facts_are_empty(spark, tmp_path):
    parsed = st.parse_precedents(precedent_texts(spark, _folder(spark, tmp_path, ["12 34", "...", "some words here"])))
    assert [r.facts for r in parsed.orderBy("doc_id").collect()] == ["", "", "some words here"]
    issues = ig.parsed_precedent_issues(parsed).where("doc_id < 2").groupBy("issue").count()
    assert {r["issue"]: r["count"] for r in issues.collect()} == {"no_facts": 2, "truncated_provision": 2}


def test_a_filter_on_facts_does_not_repeat_the_parse(spark, tmp_path):
    parsed = st.parse_precedents(precedent_texts(spark, _folder(spark, tmp_path, ["some words here"]))).where("facts <> ''")
    plan = parsed._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Filter") < plan.index("Generate inline") < plan.index("NỘI DUNG VỤ (?:ÁN")


def test_collapse_keeps_its_results(spark):
    rows = spark.createDataFrame([("  a b \t c\nd e  f ",), ("a b c",), ("",), (" ",)], "t string")
    assert [r.c for r in rows.select(tx.collapse(F.col("t")).alias("c")).collect()] == ["a b c d e f", "a b c", "", ""]
