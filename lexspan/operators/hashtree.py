"""Canonical hash trees of id sets: digests with bounded groups, differences without reading all.

An id's path is its SHA-256. A node of the tree is a path prefix; it is a leaf when at
most `capacity` ids share the prefix, else it has up to sixteen children. So the tree,
and the digest of its root, follow from the set alone: neither partitions nor order nor
a chosen depth has a part in them. No group is larger than a leaf, or sixteen children.

A stored tree has a table of nodes (prefix, depth, n, leaf, digest) by depth, and one of
ids by the first digits of their path. Two trees are compared from the root down: equal
digests end the walk, so only nodes on the way to a difference and the leaves that hold
one are joined.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexspan.session import materialize, scratch_dir

CAPACITY = 1024
DIGITS = 64
#: Leading digits that name the folders of the stored ids.
FOLDER_DIGITS = 2


@dataclass(frozen=True)
class HashTree:
    """`nodes`: depth, prefix, n, leaf, digest; `items`: top, path, item."""

    nodes: DataFrame
    items: DataFrame
    capacity: int

    def root(self) -> DataFrame:
        """One row, `digest`; that of no ids if there are none."""
        found = self.nodes.where("depth = 0").agg(F.max("digest").alias("digest"))
        return found.select(F.coalesce("digest", F.sha2(F.lit(""), 256)).alias("digest"))


def _cut(column: str, depth) -> Column:
    return F.substring(F.col(column), F.lit(1), depth if isinstance(depth, Column) else F.lit(depth))


def build(ids: DataFrame, column: str, capacity: int = CAPACITY) -> HashTree:
    """The tree of the distinct ids of a column, written to the shared folder; null ids are none."""
    spark = ids.sparkSession
    folder = f"{scratch_dir(spark).rstrip('/')}/tree-{uuid.uuid4().hex}"
    listed = ids.select(F.col(column).cast("string").alias("item")).where(F.col("item").isNotNull()).distinct()
    pathed = listed.withColumn("path", F.sha2("item", 256)).withColumn("top", F.substring("path", 1, FOLDER_DIGITS))
    pathed.write.partitionBy("top").parquet(f"{folder}/items")
    items = spark.read.schema("path string, item string, top string").parquet(f"{folder}/items")

    # Prefixes that are too full have children; each round counts only below those.
    inner, levels, depth = None, [], 0
    while depth <= DIGITS:
        open_ = items if inner is None else items.join(inner, _cut("path", depth - 1) == F.col("inside"), "left_semi")
        level = materialize(open_.groupBy(_cut("path", depth).alias("prefix")).agg(F.count("*").alias("n")).withColumns(
            {"depth": F.lit(depth), "leaf": (F.col("n") <= capacity) | F.lit(depth == DIGITS)}))
        levels.append(level)
        inner = level.where("not leaf").select(F.col("prefix").alias("inside"))
        if inner.isEmpty():
            break
        depth += 1

    # Leaves from their ids, then nodes from their children, deepest first.
    made = None
    for depth in range(len(levels) - 1, -1, -1):
        level = levels[depth]
        leaves = level.where("leaf").select(F.col("prefix").alias("own"))
        held = items.select("item", _cut("path", depth).alias("prefix")).join(leaves, F.col("prefix") == F.col("own"))
        digests = held.groupBy("prefix").agg(F.sha2(F.array_join(F.sort_array(F.collect_list("item")), "\n"), 256).alias("digest"))
        if made is not None:
            children = made.groupBy(_cut("prefix", depth).alias("up")).agg(
                F.sha2(F.array_join(F.sort_array(F.collect_list(F.concat_ws(":", "prefix", "digest"))), "\n"), 256).alias("digest"))
            digests = digests.unionByName(children.withColumnRenamed("up", "prefix"))
        made = materialize(level.join(digests, "prefix").select("prefix", "n", "leaf", "digest"))
        made.withColumn("depth", F.lit(depth)).write.mode("append").partitionBy("depth").parquet(f"{folder}/nodes")
    nodes = spark.read.schema("prefix string, n long, leaf boolean, digest string, depth int").parquet(f"{folder}/nodes")
    return HashTree(nodes, items, capacity)


def difference(left: HashTree, right: HashTree) -> tuple[DataFrame, DataFrame]:
    """Ids on one side only (`item, side`: `missing` is left only, `orphan` right only), and one row `nodes, items` read for it."""
    if left.capacity != right.capacity:
        raise ValueError("trees of different leaf sizes have different shapes")
    spark = left.nodes.sparkSession
    frontier, depth, seen = None, 0, []
    unlike = []
    while depth <= DIGITS:
        def side(tree: HashTree, end: str, depth=depth, frontier=frontier) -> DataFrame:
            rows = tree.nodes.where(F.col("depth") == depth)
            if frontier is not None:
                rows = rows.join(frontier, _cut("prefix", depth - 1) == F.col("inside"), "left_semi")
            return rows.select(F.col("prefix").alias(f"prefix_{end}"), F.col("leaf").alias(f"leaf_{end}"), F.col("digest").alias(f"digest_{end}"))

        met = side(left, "a").join(side(right, "b"), F.col("prefix_a") == F.col("prefix_b"), "full_outer")
        met = materialize(met.select(
            F.coalesce("prefix_a", "prefix_b").alias("prefix"), F.coalesce(F.col("digest_a") != F.col("digest_b"), F.lit(True)).alias("differ"),
            (F.coalesce("leaf_a", F.lit(True)) | F.coalesce("leaf_b", F.lit(True))).alias("last")))
        seen.append(met.agg(F.count("*").alias("nodes")))
        unlike.append(met.where("differ and last").select("prefix", F.lit(depth).alias("depth")))
        frontier = met.where("differ and not last").select(F.col("prefix").alias("inside"))
        if frontier.isEmpty():
            break
        depth += 1

    def held(tree: HashTree) -> DataFrame:
        found = None
        for at, some in enumerate(unlike):
            own = some.select(F.col("prefix").alias("own"), F.substring("prefix", 1, FOLDER_DIGITS).alias("own_top"))
            # Below the first digits, only the folders that hold a difference are read.
            near = (F.col("top") == F.col("own_top")) if at >= FOLDER_DIGITS else F.lit(True)
            rows = tree.items.join(own, near & (_cut("path", at) == F.col("own"))).select("item")
            found = rows if found is None else found.unionByName(rows)
        return found

    mine, theirs = materialize(held(left)), materialize(held(right))
    only = mine.join(theirs, "item", "left_anti").withColumn("side", F.lit("missing")).unionByName(
        theirs.join(mine, "item", "left_anti").withColumn("side", F.lit("orphan")))
    counts = mine.select(F.lit(0).alias("nodes"), F.lit(1).alias("items")).unionByName(theirs.select(F.lit(0).alias("nodes"), F.lit(1).alias("items")))
    for one in seen:
        counts = counts.unionByName(one.select("nodes", F.lit(0).alias("items")))
    return only, counts.agg(F.sum("nodes").alias("nodes"), F.sum("items").alias("items"))
