"""Exact cosine top-k over a stored ball partition.

Vectors lie in cells around centres; in a cell they are cut into rings by their angle to
the centre, so that a block is a ring of about BLOCK vectors (a ring that holds more,
such as one vector many times, is dealt to parts). Angles obey the triangle inequality:
a vector at angle b from the centre is at least |a - b| away from a query at angle a.
So a block's ring bounds the cosine of all its vectors, and blocks whose bound lies below
a query's k-th best score so far are skipped.

Blocks of neighbouring cells stand on a shelf, and a query is sent once to each shelf that
has a block open to it, with the marks of those blocks, so on vectors without clusters it
goes to the shelves and not to every block. Queries of a shelf are scored together by matrix
products, at most ROUND queries at a time. The vectors are written once, bucketed by shelf,
and are not shuffled for a search, whatever the number of queries. Results are those of
`vectors.cosine_top_k`; on vectors without any clusters nothing can be skipped and the
work is the same.

Centres are fitted on SAMPLE vectors (a hash decides which); they only decide how much is
skipped. The driver holds the centres and the histogram of angles: CELLS * RINGS counts
at most.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexspan.operators import vectors as vc
from lexspan.session import materialize, scratch_dir

SAMPLE, CELLS, PASSES = 16_384, 2048, 8
#: Fine rings of the histogram (of angles from 0 to pi), vectors in a block and in a cell.
RINGS, BLOCK, CELL = 128, 1024, 512
#: Vectors on a shelf at most (a larger block is dealt to shelves of its own), queries of a round and of a product.
SHELF, ROUND, BATCH = 16_384, 131_072, 2048
#: Vectors near a query that are scored first.
SEEDS = 512
#: Room for rounding, in radians and in scores.
ANGLE_ROOM, SCORE_ROOM = 1e-6, 2e-9


@dataclass(frozen=True)
class Balls:
    """`items`: item, embedding, expired, cell, ring, shelf, bucketed by shelf; `rings`: cell, ring, low, high, n, parts, shelf, by shelf.

    A ring of several parts has the shelf that is named and those that follow to itself.
    """

    items: DataFrame
    rings: pd.DataFrame
    centres: np.ndarray
    others: DataFrame
    id_column: str

    @property
    def width(self) -> int:
        return self.centres.shape[1]


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.asarray(column.flatten(), dtype=np.float64).reshape(-1, width)


def _unit(vectors: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(vectors, axis=1, keepdims=True)
    return np.divide(vectors, norms, out=np.zeros_like(vectors), where=norms > 0)


def fit_centres(vectors: np.ndarray, cells: int, passes: int = PASSES) -> np.ndarray:
    """Unit centres of unit vectors, by the mean direction of those next to each."""
    draw = np.random.default_rng(42)
    centres = vectors[draw.permutation(len(vectors))[:cells]]
    for _ in range(passes):
        nearest = np.argmax(vectors @ centres.T, axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, vectors)
        moved = _unit(sums)
        centres = np.where((np.abs(moved).sum(axis=1) > 0)[:, None], moved, centres)
    return centres


def _angles(unit: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(unit @ centres.T, -1.0, 1.0))


def _cut(histogram: pd.DataFrame, centres: np.ndarray, shelf: int) -> pd.DataFrame:
    """Fine rings of each cell put together until they hold a block: adds `ring`, `parts` and `shelf`."""
    rows = histogram.sort_values(["cell", "fine"], ignore_index=True)
    before = rows.groupby("cell")["n"].cumsum() - rows["n"]
    rows["ring"] = (before // BLOCK).astype(int)
    whole = rows.groupby(["cell", "ring"], as_index=False)["n"].sum()
    whole["parts"] = -(-whole["n"] // max(2 * BLOCK, shelf))
    # Cells next to each other stand together.
    regions = fit_centres(centres, max(1, min(len(centres), int(whole["n"].sum()) // shelf)))
    whole["region"] = np.argmax(centres @ regions.T, axis=1)[whole["cell"]]
    whole = whole.sort_values(["region", "cell", "ring"], ignore_index=True)
    places, last, held = [], -1, shelf
    for n, parts in zip(whole["n"], whole["parts"]):
        if parts > 1 or held + n > shelf:
            last, held = last + 1, 0
        places.append(last)
        last, held = (last + parts - 1, shelf) if parts > 1 else (last, held + n)
    whole["shelf"] = places
    return rows[["cell", "fine", "ring"]].merge(whole[["cell", "ring", "parts", "shelf"]], on=["cell", "ring"])


def build(chunks: DataFrame, id_column: str = "chunk_id", cells: int | None = None, buckets: int | None = None) -> Balls:
    """Partition a table of `<id>, embedding` (and `validity_status`); vectors without length have no cell and are kept apart."""
    spark = chunks.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    status = F.col("validity_status") if "validity_status" in chunks.columns else F.lit("")
    rows = chunks.where(F.size("embedding") > 0).select(
        F.col(id_column).alias("item"), F.col("embedding").cast("array<double>").alias("embedding"),
        (F.coalesce(status, F.lit("")) == vc.EXPIRED_STATUS).alias("expired"))
    counts = rows.groupBy(F.size("embedding").alias("width")).count().orderBy(F.desc("count"), "width").first()
    width, total = (counts["width"], counts["count"]) if counts else (1, 0)
    solid = (F.size("embedding") == width) & F.exists("embedding", lambda x: x != 0)
    sample = rows.where(solid).select("embedding").orderBy(F.xxhash64("item")).limit(SAMPLE).toArrow().column(0).combine_chunks()
    some = _unit(_matrix(sample, width)) if len(sample) else np.eye(1, width)
    centres = fit_centres(some, cells or min(CELLS, max(1, total // CELL)))
    shared = spark.sparkContext.broadcast(centres)
    # Some shelves for each core, while they hold a block.
    shelf = max(BLOCK, min(SHELF, total // (3 * spark.sparkContext.defaultParallelism)))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            unit = _unit(_matrix(batch.column(1), width))
            angles = _angles(unit, shared.value)
            cell = np.argmin(angles, axis=1)
            angle = angles[np.arange(len(cell)), cell]
            fine = np.minimum((angle * (RINGS / np.pi)).astype(np.int32), RINGS - 1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int32()), pa.array(fine, pa.int32()), pa.array(angle)], names=["item", "embedding", "expired", "cell", "fine", "angle"])

    kind = dict(rows.dtypes)["item"]
    placed = materialize(rows.where(solid).mapInArrow(place, f"item {kind}, embedding array<double>, expired boolean, cell int, fine int, angle double"))
    histogram = placed.groupBy("cell", "fine").agg(F.count("*").alias("n")).toPandas()  # CELLS * RINGS rows at most
    shape = "cell int, fine int, ring int, parts int, shelf int"
    cut = spark.createDataFrame(_cut(histogram, centres, shelf).astype("int32") if len(histogram) else [], shape)
    first = F.col("shelf")
    dealt = placed.join(F.broadcast(cut), ["cell", "fine"]).select(
        "item", "embedding", "expired", "cell", "ring", (first + F.pmod(F.xxhash64("item"), F.col("parts"))).cast("int").alias("shelf"),
        "angle", "parts", first.alias("first"))
    table = f"balls_{uuid.uuid4().hex}"
    folder = f"{scratch_dir(spark).rstrip('/')}/{table}"
    dealt.repartition(buckets, "shelf").write.bucketBy(buckets, "shelf").option("path", folder).format("parquet").saveAsTable(table)
    items = spark.table(table)
    rings = items.groupBy("cell", "ring").agg(
        F.min("angle").alias("low"), F.max("angle").alias("high"), F.count("*").alias("n"), F.max("parts").alias("parts"), F.max("first").alias("shelf")).toPandas()
    others = chunks.where((F.size("embedding") > 0) & ~F.coalesce(solid, F.lit(False)))
    return Balls(items.drop("parts", "first", "angle"), rings.sort_values(["shelf", "cell", "ring"], ignore_index=True), centres, others, id_column)


def bounds(queries: np.ndarray, balls: Balls) -> tuple[np.ndarray, np.ndarray]:
    """Greatest cosine of each query with each ring, and the queries' angles to the centres."""
    unit = _unit(queries)
    turn = _angles(unit, balls.centres)
    cell, low, high = (balls.rings[c].to_numpy() for c in ("cell", "low", "high"))
    at = turn[:, cell]
    gap = np.maximum(0.0, np.maximum(low - at, at - high) - ANGLE_ROOM)
    most = np.where(gap < np.pi, np.cos(np.minimum(gap, np.pi)), -1.0)
    most[np.abs(unit).sum(axis=1) == 0] = 0.0  # a query without length has 0 with all
    return most, turn


def _shelf_top_k(a: np.ndarray, skip: np.ndarray, limit: np.ndarray, marks: np.ndarray, b: np.ndarray, items: np.ndarray, expired: np.ndarray,
                 borders: np.ndarray, k: int, whole: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, int]]:
    """Rows of `a`, places in `b`, scores and pairs scored; block i of `b` is between borders i and i + 1 and goes with marks[:, i].

    `whole`: where most blocks are marked, one product for all of them, which costs less. Blocks without
    a mark hold what was found before or stays below the limit, so none of them is returned.
    """
    limit = limit.copy()
    if whole and marks.mean() > 0.5:
        blocks = [(np.flatnonzero(marks.any(axis=1)), slice(0, len(b)))]
    else:
        blocks = [(np.flatnonzero(marks[:, i]), slice(borders[i], borders[i + 1])) for i in range(marks.shape[1])]
    for rows, block in blocks:
        if len(rows) and block.stop > block.start:
            at, place, scores = vc.block_top_k(a[rows], skip[rows], b[block], items[block], expired[block], k, limit[rows] - SCORE_ROOM)
            full = np.flatnonzero(np.bincount(at, minlength=len(rows)) == k)
            least = np.full(len(rows), np.inf)
            np.minimum.at(least, at, scores)
            limit[rows[full]] = np.maximum(limit[rows[full]], least[full])
            place = place + block.start
            marked = marks[rows[at], np.searchsorted(borders, place, side="right") - 1]
            yield rows[at][marked], place[marked], scores[marked], len(rows) * (block.stop - block.start)


def _scored(asked: DataFrame, balls: Balls, k: int, whole: bool = False) -> DataFrame:
    """`query_id, item, score, pairs`: what may be among the k best of each query on a shelf; a row without item tells how many pairs were scored."""
    query_type, item_type = dict(asked.dtypes)["query_id"], dict(balls.items.dtypes)["item"]

    def score(qs: pd.DataFrame, cs: pd.DataFrame) -> pd.DataFrame:
        if qs.empty or cs.empty:
            return pd.DataFrame({"query_id": [], "item": [], "score": [], "pairs": []})
        # Blocks in the order in which the marks were made.
        cs = cs.sort_values(["cell", "ring", "item"], ignore_index=True)
        borders = np.append(np.flatnonzero(~cs.duplicated(["cell", "ring"])), len(cs))
        b, items, expired = np.stack(cs["embedding"].to_list()), cs["item"].to_numpy(), cs["expired"].to_numpy(bool)
        found, pairs = [], 0
        for start in range(0, len(qs), BATCH):
            some = qs.iloc[start:start + BATCH]
            marks = np.unpackbits(np.stack([np.frombuffer(m, np.uint8) for m in some["marks"]]), axis=1)[:, : len(borders) - 1].astype(bool)
            a, ids = np.stack(some["vector"].to_list()).astype(np.float64), some["query_id"].to_numpy()
            for row, place, scores, n in _shelf_top_k(a, some["skip"].to_numpy(bool), some["limit"].to_numpy(), marks, b, items, expired, borders, k, whole):
                pairs += n
                found.append(pd.DataFrame({"query_id": ids[row], "item": items[place], "score": scores, "pairs": 0}))
        found = [f for f in found if len(f)] + [pd.DataFrame({"query_id": [qs["query_id"].iloc[0]], "item": [None], "score": [np.nan], "pairs": [pairs]})]
        return pd.concat([f.astype({"item": object}) for f in found])

    return asked.groupBy("shelf").cogroup(balls.items.groupBy("shelf")).applyInPandas(score, f"query_id {query_type}, item {item_type}, score double, pairs long")


def _sent(queries: DataFrame, balls: Balls, seeds: bool) -> DataFrame:
    """Queries (`query_id, vector, skip, limit`) with the shelves that they look into, and marks (bits) of the blocks there:
    those nearest, or all others that reach the limit."""
    spark = queries.sparkSession
    # Centres, and a row for each ring: both have their bounds above.
    shared = spark.sparkContext.broadcast((balls.rings, balls.centres))
    width, query_type = balls.width, dict(queries.dtypes)["query_id"]

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rings, centres = shared.value
        own = Balls(None, rings, centres, None, "")
        n, parts, shelf = (rings[c].to_numpy() for c in ("n", "parts", "shelf"))
        starts = np.flatnonzero(np.append(True, shelf[1:] != shelf[:-1])) if len(shelf) else np.empty(0, np.int64)
        ends = np.append(starts[1:], len(shelf))
        for whole in batches:
            for at in range(0, whole.num_rows, 64):
                batch = whole.slice(at, 64)
                most, _ = bounds(_matrix(batch.column(1), width), own)
                order = np.argsort(-most, axis=1, kind="stable")
                ahead = np.take_along_axis(np.broadcast_to(n, most.shape), order, axis=1)
                first = np.zeros_like(most, dtype=bool)
                np.put_along_axis(first, order, np.cumsum(ahead, axis=1) - ahead < SEEDS, axis=1)
                limit = batch.column(3).to_numpy(zero_copy_only=False)
                wanted = first if seeds else ~first & (most >= limit[:, None] - SCORE_ROOM)
                for low, high in zip(starts, ends):
                    q = np.flatnonzero(wanted[:, low:high].any(axis=1))
                    if not len(q):
                        continue
                    marks = [row.tobytes() for row in np.packbits(wanted[q, low:high], axis=1)]
                    times = parts[low]
                    out = batch.take(pa.array(np.tile(q, times)))
                    yield pa.RecordBatch.from_arrays(
                        [*out.columns, pa.array(marks * times, pa.binary()), pa.array(np.repeat(shelf[low] + np.arange(times), len(q)), pa.int32())],
                        names=["query_id", "vector", "skip", "limit", "marks", "shelf"])

    return queries.mapInArrow(send, f"query_id {query_type}, vector array<double>, skip boolean, limit double, marks binary, shelf int")


def _rounds(queries: DataFrame, balls: Balls, seeds: bool, k: int, rounds: int) -> DataFrame:
    """Scored in rounds, so that the queries of a shelf fit a task, however many there are."""
    number = F.pmod(F.xxhash64("query_id"), F.lit(rounds))
    return reduce(DataFrame.unionByName, [_scored(_sent(queries.where(number == i), balls, seeds), balls, k, not seeds) for i in range(rounds)])


def search(queries: DataFrame, balls: Balls, k: int) -> tuple[DataFrame, DataFrame]:
    """Best k per query as `vectors.cosine_top_k` gives them, and one row `pairs`: how many were scored."""
    skip = F.col("skip_expired") if "skip_expired" in queries.columns else F.lit(False)
    every = queries.where(F.size("vector") > 0).select("query_id", F.col("vector").cast("array<double>").alias("vector"), skip.alias("skip"))
    own = every.where(F.size("vector") == balls.width)
    rounds = max(1, math.ceil(own.count() / ROUND))
    near = materialize(_rounds(own.withColumn("limit", F.lit(-2.0)), balls, True, k, rounds))
    place = Window.partitionBy("query_id").orderBy(F.desc("score"), "item")
    at_k = near.where("item is not null").withColumn("rank", F.row_number().over(place)).where(F.col("rank") == k).select("query_id", F.col("score").alias("limit"))
    limited = materialize(own.join(at_k, "query_id", "left").select("query_id", "vector", "skip", F.coalesce("limit", F.lit(-2.0)).alias("limit")))
    far = materialize(_rounds(limited, balls, False, k, rounds))
    both = near.unionByName(far)
    # Vectors without length or of other widths are compared as ever; so are the queries of other widths.
    apart = vc.cosine_top_k(every.withColumnRenamed("skip", "skip_expired"), balls.others, k, balls.id_column).select("query_id", F.col(balls.id_column).alias("item"), "score")
    rows = both.where("item is not null").select("query_id", "item", "score").unionByName(apart)
    best = rows.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k)
    return best.select("query_id", F.col("item").alias(balls.id_column), "score", "rank"), both.agg(F.coalesce(F.sum("pairs"), F.lit(0)).alias("pairs"))
