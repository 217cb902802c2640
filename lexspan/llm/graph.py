"""Connected components of a link table by alternating stars, all in shuffles."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexspan.llm.scratch import stored


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("node", "root").cast("decimal(38,0)")).alias("digest")).first()
    return row.n, row.digest


def _large_star(edges: DataFrame) -> DataFrame:
    """Every node hangs its larger neighbours on the least of its neighbours and itself."""
    both = edges.unionByName(edges.select(F.col("root").alias("node"), F.col("node").alias("root")))
    least = both.groupBy("node").agg(F.min("root").alias("least")).select("node", F.least("node", "least").alias("least"))
    return both.join(least, "node").where("root > node").select(F.col("root").alias("node"), F.col("least").alias("root")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node hangs itself and its smaller neighbours on the least of them."""
    least = edges.groupBy("node").agg(F.min("root").alias("least"))
    others = edges.join(least, "node").where("root <> least").select(F.col("root").alias("node"), F.col("least").alias("root"))
    return others.unionByName(least.select("node", F.col("least").alias("root"))).distinct()


def components(links: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """Columns node, root: the least node of the component, for every node that has a link.

    Links of a node with itself and links with a null end say nothing. The number of
    rounds grows with the logarithm of a component's size; each round's edges, at most
    as many as the links, are written to the shared folder.
    """
    edges = stored(
        links.where(F.col(left) != F.col(right)).select(F.greatest(left, right).alias("node"), F.least(left, right).alias("root")).distinct(),
        "edges",
    )
    before = _state(edges)
    while before[0]:
        edges = stored(_small_star(_large_star(edges)), "edges")
        now = _state(edges)
        if now == before:
            break
        before = now
    roots = edges.select(F.col("root").alias("node")).distinct()
    return edges.unionByName(roots.select("node", F.col("node").alias("root")))
