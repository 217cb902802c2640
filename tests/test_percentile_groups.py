from pyspark.sql import functions as F

from lexspan.operators import evaluation as ev


def test_a_group_is_not_shuffled_to_its_bracket(spark):
    values = spark.range(0, 30_000).select(F.when(F.col("id") >= 0, "all").otherwise("none").alias("g"), (F.col("id") * 7 % 30_000).cast("double").alias("x"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    try:
        found = ev.exact_percentiles(values, ["g"], "x", {"p50": 0.5})
        assert "BroadcastHashJoin" in found._jdf.queryExecution().executedPlan().toString()
        assert [tuple(r) for r in found.collect()] == [("all", 14999.5)]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")
