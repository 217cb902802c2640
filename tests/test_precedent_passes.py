from lexspan.catalog import load
from pyspark.sql import functions as F

from lexspan.functions import text as tx
from lexspan.operators import structure as st

SF = "/root/testdata/sf0.001"
HEADING = "NỘI DUNG VỤ (?:ÁN"


def _plan(spark, name):
    return load().QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()


def test_precedents_are_parsed_once(spark):
    once = _plan(spark, "structure_precedent_sections").count(HEADING)
    assert once > 0
    assert [_plan(spark, name).count(HEADING) for name in ("metadata_precedents",)] == [once]
    plan = _plan(spark, "whole_precedent_chunks")
    assert plan.count(HEADING) == once and "Join" not in plan


def test_page_marks_and_blanks(spark):
    texts = ["12", " 12 ", "a 12", "7 Án lệ này do X", "a\n12\n\nb", "a\n 5 \nb", "a 12  9  b", "　 x  ", "", "12\u000b"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    got = rows.select(st._without_page_marks(F.col("t")).alias("m"), tx.strip(F.col("t")).alias("s")).collect()
    want = rows.select(
        F.regexp_replace(F.regexp_replace(F.regexp_replace("t", st.FOOTNOTE_LINE, ""), st.PAGE_BREAK, "\n"), st.NUMBER_LINE, "").alias("m"),
        F.regexp_replace("t", r"(?U)^\s+|\s+$", "").alias("s")).collect()
    assert got == want
