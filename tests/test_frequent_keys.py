"""Registry lookup where most rows share a value that matches, or one that matches nothing."""

from pyspark.sql import functions as F

from lexspan.operators import governance as gv


def test_rows_of_a_frequent_value_are_dealt(spark):
    items = spark.range(20_000, numPartitions=16).select(
        "id", F.when(F.col("id") % 3 > 0, "hot").otherwise(F.concat(F.lit("d"), "id")).alias("doc_id"),
        F.lit("").alias("source_file"), F.when(F.col("id") % 2 == 0, "zz").alias("source_checksum_sha256"))
    entries = [(7, "hot", "a", "s7"), (5, "d3", "", "s5"), (2, None, "b", "zz"), (9, "hot", "c", None)]
    registry = spark.createDataFrame(entries, "idx long, doc_id string, source_file string, source_checksum_sha256 string")
    frequent = gv.frequent_values(items)
    assert frequent == {"doc_id": ["hot"], "source_file": [""], "source_checksum_sha256": ["zz"]}
    found = {row.id: row.entry_idx for row in gv.first_match(items, registry).collect()}
    assert len(found) == 20_000
    assert all(idx == (2 if i % 2 == 0 else 7 if i % 3 else 5 if i == 3 else None) for i, idx in found.items())
    dealt = gv.dealt_lookup(items, "doc_id", registry.where("idx = 7").selectExpr("doc_id as k", "idx"), "k", frequent["doc_id"])
    assert dealt.where("idx = 7").count() == items.where("doc_id = 'hot'").count()
