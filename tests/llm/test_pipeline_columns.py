"""Stages carry columns of any name and type."""

from pyspark.sql import functions as F

import corpus_pipeline

SF = "/root/testdata/sf0.001"
CLASHING = ("evidence", "host_prior", "path_prior", "quality_score", "_host", "_path", "_lang", "_share", "_found", "_mark", "name", "root", "mark", "key")


def test_clashing_and_map_columns_come_back_unchanged(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    for name in CLASHING:
        docs = docs.withColumn(name, F.concat(F.lit(f"{name} of "), F.col("doc_id").cast("string")))
    docs = docs.withColumn("odd.name", F.create_map(F.lit("id"), F.col("doc_id")))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        rows = out.collect()
        assert rows and all(row[c] == f"{c} of {row.doc_id}" for row in rows for c in CLASHING), name
        assert all(row["odd.name"] == {"id": row.doc_id} for row in rows)
