"""Continuous ingest whose number of files stays bounded: parts merged by size tiers.

Every micro-batch adds one part. When a tier holds `fanout` parts they become one part of
the next tier, without the rows that a later batch replaced, so n batches leave at most
`fanout - 1` parts for each of log(n) tiers, and a row is rewritten once a tier. A manifest
names the live parts; a reader stays on the manifest it began with, and `vacuum` removes a
part only when none of the last manifests names it.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FANOUT = 4
#: Size of the files that a merge writes.
FILE_BYTES = 128 << 20
MANIFEST = "part string, tier int, stream string, through long"


def _folder(spark: SparkSession, path: str):
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()), folder


def versions(spark: SparkSession, target: str) -> list[int]:
    """Versions whose manifest was written to its end, oldest first."""
    fs, folder = _folder(spark, f"{target}/_manifests")
    if not fs.exists(folder):
        return []
    named = [s.getPath() for s in fs.listStatus(folder) if s.getPath().getName().isdigit()]
    marked = [p for p in named if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
    return sorted(int(p.getName()) for p in marked)


def manifest(spark: SparkSession, target: str, version: int | None = None) -> tuple[int, list]:
    """A version (the latest by default) and its rows: live parts, and how far each stream has come.

    It has a row for each live part and stream, so its size grows with the logarithm of the batches.
    """
    known = versions(spark, target)
    if not known:
        return 0, []
    version = known[-1] if version is None else version
    return version, spark.read.schema(MANIFEST).json(f"{target}/_manifests/{version:012d}").collect()


def parts_of(entries: list) -> list[tuple[str, int]]:
    return sorted((e["part"], e["tier"]) for e in entries if e["part"])


def add_batch(chunks: DataFrame, documents: DataFrame, stream: str, number: int, target: str, key: str = "doc_id",
              fanout: int = FANOUT, file_bytes: int = FILE_BYTES) -> None:
    """Publish the chunks of one micro-batch and merge the tiers that are full.

    A batch that the manifest knows already is left alone; one that failed before its
    manifest was written left a part that nobody names. One writer at a time.
    """
    spark = chunks.sparkSession
    last, entries = manifest(spark, target)
    marks = {e["stream"]: e["through"] for e in entries if e["stream"]}
    if marks.get(stream, -1) >= number:
        return
    version = last + 1
    name = f"{version:012d}-{uuid.uuid4().hex}"
    # Few files for a small batch: adaptive execution joins and splits the partitions by size.
    chunks.withColumn("_version", F.lit(version).cast("long")).hint("rebalance").write.parquet(f"{target}/parts/{name}/chunks")
    documents.select(key).distinct().withColumn("_version", F.lit(version).cast("long")).hint("rebalance").write.parquet(
        f"{target}/parts/{name}/documents")
    live = [*parts_of(entries), (name, 0)]
    marks[stream] = number
    tier = 0
    while sum(t == tier for _, t in live) >= fanout:
        full = [n for n, t in live if t == tier]
        live = [(n, t) for n, t in live if t != tier] + [(merge(spark, target, full, version, key, file_bytes), tier + 1)]
        tier += 1
    rows = [(n, t, None, None) for n, t in live] + [(None, None, s, t) for s, t in marks.items()]
    spark.createDataFrame(rows, MANIFEST).coalesce(1).write.mode("overwrite").json(f"{target}/_manifests/{version:012d}")


def merge(spark: SparkSession, target: str, names: list[str], version: int, key: str, file_bytes: int = FILE_BYTES) -> str:
    """One part of several: of each document the newest version, also when it has no chunks."""
    fs, _ = _folder(spark, target)
    size = sum(fs.getContentSummary(spark._jvm.org.apache.hadoop.fs.Path(f"{target}/parts/{n}")).getLength() for n in names)
    files = max(1, -(-size // file_bytes))
    name = f"{version:012d}-{uuid.uuid4().hex}"
    chunks, documents = newest(spark, target, names, key)
    chunks.repartition(files, key).write.parquet(f"{target}/parts/{name}/chunks")
    documents.repartition(files, key).write.parquet(f"{target}/parts/{name}/documents")
    return name


def newest(spark: SparkSession, target: str, names: list[str], key: str) -> tuple[DataFrame, DataFrame]:
    read = lambda kind: reduce(DataFrame.unionByName, [spark.read.parquet(f"{target}/parts/{n}/{kind}") for n in names])
    documents = read("documents").groupBy(key).agg(F.max("_version").alias("_version"))
    return read("chunks").join(documents, [key, "_version"], "left_semi"), documents


def latest(spark: SparkSession, target: str, key: str = "doc_id", version: int | None = None) -> DataFrame:
    """Chunks of each document's newest batch as of a version, the last by default."""
    version, entries = manifest(spark, target, version)
    if not version:
        raise FileNotFoundError(f"no manifest in {target}")
    return newest(spark, target, [n for n, _ in parts_of(entries)], key)[0].drop("_version")


def vacuum(spark: SparkSession, target: str, keep: int = 2) -> list[str]:
    """Remove parts that none of the `keep` last manifests names, older manifests too.

    Not while a batch is being written: its part is not named yet.
    """
    known = versions(spark, target)
    kept = known[-keep:]
    named = {n for v in kept for n, _ in parts_of(manifest(spark, target, v)[1])}
    fs, folder = _folder(spark, f"{target}/parts")
    dropped = [s.getPath().getName() for s in fs.listStatus(folder) if s.getPath().getName() not in named]
    for v in known[:-keep]:
        fs.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{target}/_manifests/{v:012d}"), True)
    for name in dropped:
        fs.delete(spark._jvm.org.apache.hadoop.fs.Path(folder, name), True)
    return sorted(dropped)


def tiered_ingest(stream: DataFrame, build: Callable[[DataFrame], DataFrame], target: str, checkpoint: str, key: str = "doc_id",
                  fanout: int = FANOUT):
    """New documents to chunks to a tiered table; a stream is known by its checkpoint."""

    def write(batch: DataFrame, number: int) -> None:
        add_batch(build(batch), batch, checkpoint, number, target, key, fanout)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
