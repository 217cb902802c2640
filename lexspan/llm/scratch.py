"""Shared folders for files and lineage cuts, and small helpers on tables."""

import uuid

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexspan.session import scratch_dir


def fresh_folder(spark: SparkSession, name: str) -> str:
    """A new folder that the driver and all executors share."""
    return f"{scratch_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """`df` written once as Parquet in the shared folder and read again: cuts its lineage."""
    spark = df.sparkSession
    folder = fresh_folder(spark, name)
    df.write.parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Let Arrow hand texts to Python in batches that stay small even where texts are long."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > rows:
        spark.conf.set(key, str(rows))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use` of `value`, computed once: in a lambda, a column is computed for every element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def fresh(name: str) -> str:
    """A column name that no table has."""
    return f"_{name}_{uuid.uuid4().hex[:12]}"
