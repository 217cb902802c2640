"""Session settings, lineage cuts and size checks shared by all operators."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Largest row count a side may have before it is joined by shuffle instead.
BROADCAST_ROWS = 2_000_000


def get_session(app: str = "lexspan", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_dir(spark: SparkSession) -> str:
    """Shared folder for lineage cuts and files: the one that `spark.checkpoint.dir` names.

    Only a master of one machine may do without, and gets a folder of its own then.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    spark.sparkContext.setCheckpointDir(f"file://{folder}")
    return f"file://{folder}"


def materialize(df: DataFrame, eager: bool = True) -> DataFrame:
    """Cut lineage through a reliable checkpoint that survives executor loss."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(scratch_dir(df.sparkSession))
    return df.checkpoint(eager=eager)


def fits(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """True when a count proves that `df` has at most `rows` rows."""
    return df.limit(rows + 1).count() <= rows


def fixed_rows(spark: SparkSession, rows: list, schema: str) -> DataFrame:
    """A constant rule table (size fixed by the code, so safe to broadcast)."""
    return F.broadcast(spark.createDataFrame(rows, schema))


def spread(df: DataFrame, min_bytes: int = 1 << 20) -> DataFrame:
    """Rows over all cores when a scan gives fewer tasks than there are cores.

    One file with one row group is one task, however many cores wait. Large
    inputs have more tasks than cores and pass through without a shuffle.
    """
    context = df.sparkSession.sparkContext
    plan = df._jdf.queryExecution()
    if int(str(plan.optimizedPlan().stats().sizeInBytes())) < min_bytes:
        return df
    tasks = plan.toRdd().getNumPartitions()
    return df.repartition(context.defaultParallelism) if tasks < context.defaultParallelism else df
