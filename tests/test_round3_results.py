from pyspark.sql import functions as F

from lexspan.catalog import sources
from lexspan.catalog import text as tq


def test_planted_borders_are_ascii(spark):
    rows = spark.createDataFrame([("müde Leute",), ("made und de ",)], "text string")
    assert [r.t for r in rows.select(tq.planted(F.col("text")).alias("t")).collect()] == ["mükhoản 3 Leute", "made khoản 3 khoản 3 "]


def test_short_records_are_cut_too(spark, tmp_path):
    spark.createDataFrame([(9, "x"), (36, "y"), (18, "a much longer text than thirty characters"), (4, "x"), (5, "x")],
                          "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = {r["reason"]: r["n"] for r in sources.json_artifacts(spark, str(tmp_path)).collect()}
    assert found == {"unreadable": 3, "missing chunk_id": 1, "usable": 1}


def test_documents_of_a_name_are_listed_once_for_each_set_of_names(spark):
    from lexspan.operators import analysis as an

    texts = spark.createDataFrame([("a", "see x and y"), ("b", "see x and y"), ("a", "only z"), ("c", "none")], "k string, text string")
    terms = spark.createDataFrame([(f"d{i}", "x") for i in range(3)] + [("e", "y"), ("f", "z")], "doc_id string, term string")
    out = an.resolve_documents(texts, terms, "k")
    assert {r["k"]: r["doc_ids"] for r in out.collect()} == {"a": ["d0", "d1", "d2", "e", "f"], "b": ["d0", "d1", "d2", "e"]}
    assert "explode(names" in out._jdf.queryExecution().optimizedPlan().toString()


def test_candidates_are_ranked_without_texts(spark):
    from lexspan.catalog import ranking as rq

    folder = "/root/testdata/sf0.001"
    slim = rq.ranked(spark, folder, text=False)
    assert "text" not in slim.columns
    whole = rq.ranked(spark, folder)
    assert "text" in whole.columns and whole.count() == rq.candidates(spark, folder).count()
