"""Exact top-k by inner product, pruned by segment means and deviations.

Vectors are cut into segments. With the mean and the deviation of each segment, the
inner product over a segment of m components is at most m (mean mean' + dev dev'), by
Cauchy-Schwarz on what is left after the means. The bound is taken with one segment,
then with four times as many, and so on: a pair whose bound lies below the tenth best
score that its query has in the block already is dropped, coarse bounds first. What
survives gets its exact integer score. (For vectors of one length this is the same as
bounding Euclidean distance from below.)

Candidates and queries are dealt in blocks; a task gets one block of each and returns
the k best of each query, so no query set or table is whole in one place. Bounds are
floating point and have a margin of their own rounding; scores are integers.

Cases: vectors that are null, empty, or hold null or non-finite components take no
part, nor do rows without an id; of repeated rows of one id the least vector counts;
vectors of different lengths are not compared; ties go to the smaller id; a query with
fewer than k others gets them all; an empty table gives no rows; other columns are not
read.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexspan.llm.scratch import stored

CANDIDATES = 4096
QUERIES = 1024
#: Exact scores computed at a time.
PAIRS = 1 << 18
#: Scores up to here are exact in floating point.
SAFE = 2.0**52
RESULT = "query_id long, vec_id long, score long"


def quantize(vector: Column, scale: int) -> Column:
    return F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))


def usable(vector: Column) -> Column:
    whole = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & F.coalesce(whole, F.lit(False))


def _statistics(rows: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Segment lengths, and of each row the segments' sums of means and of deviations, scaled."""
    edges = np.linspace(0, rows.shape[1], parts + 1).astype(int)
    sizes = np.diff(edges)
    sums = np.add.reduceat(rows, edges[:-1], axis=1)
    means = sums / sizes
    spread = np.add.reduceat(rows * rows, edges[:-1], axis=1) / sizes - means * means
    return sizes, means * np.sqrt(sizes), np.sqrt(np.maximum(spread, 0) * sizes)


def _exact(queries: np.ndarray, rows: np.ndarray, qi: np.ndarray, ci: np.ndarray) -> np.ndarray:
    """Integer inner products of pairs; values beyond a long are held at its ends."""
    largest = float(np.abs(queries).max(initial=0)) * float(np.abs(rows).max(initial=0)) * queries.shape[1]
    out = np.empty(len(qi), dtype=np.int64)
    for at in range(0, len(qi), PAIRS):
        a, b = queries[qi[at : at + PAIRS]], rows[ci[at : at + PAIRS]]
        if largest < 2.0**62:
            out[at : at + PAIRS] = np.einsum("ij,ij->i", a, b)
        else:
            exact = (a.astype(object) * b.astype(object)).sum(axis=1)
            out[at : at + PAIRS] = [max(-(1 << 63), min((1 << 63) - 1, int(x))) for x in exact]
    return out


def block_top_k(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """query_id, vec_id, score arrays of the k best rows for each query, within one block."""
    width = rows.shape[1]
    q, c = queries.astype(np.float64), rows.astype(np.float64)
    norms = np.sqrt((q * q).sum(axis=1))[:, None] * np.sqrt((c * c).sum(axis=1))[None, :]
    margin = norms * 1e-9 + 1e-6
    alive = query_ids[:, None] != ids[None, :]
    floor = np.full(len(query_ids), -np.inf)
    parts = 1
    while True:
        _, qm, qs = _statistics(q, parts)
        _, cm, cs = _statistics(c, parts)
        bound = qm @ cm.T + qs @ cs.T + margin
        bound[~alive] = -np.inf
        if parts == 1 and len(ids) > k:
            # The rows with the best coarse bounds set a first floor for each query.
            seeds = np.argpartition(-bound, k, axis=1)[:, : k + 1]
            qi = np.repeat(np.arange(len(query_ids)), seeds.shape[1])
            ci = seeds.ravel()
            scores = _exact(queries, rows, qi, ci).astype(np.float64).reshape(seeds.shape)
            scores[~alive[qi, ci].reshape(seeds.shape)] = -np.inf
            floor = np.sort(scores, axis=1)[:, -k]
        # A score beyond 2**53 loses its last bits as a floor, never by more than this share.
        alive &= bound >= (floor - np.abs(floor) * 1e-15)[:, None]
        if parts * 4 > max(1, width // 4):
            break
        parts *= 4
    qi, ci = np.nonzero(alive)
    scores = _exact(queries, rows, qi, ci)
    order = np.lexsort((ids[ci], -scores.astype(np.float64) if np.abs(scores.astype(np.float64)).max(initial=0) > SAFE else -scores, qi))
    if np.abs(scores.astype(np.float64)).max(initial=0) > SAFE:
        order = np.array(sorted(range(len(qi)), key=lambda i: (qi[i], -int(scores[i]), ids[ci[i]])), dtype=np.int64)
    qi, ci, scores = qi[order], ci[order], scores[order]
    starts = np.searchsorted(qi, qi, side="left")
    best = np.arange(len(qi)) - starts < k
    return [(query_ids[qi[best]], ids[ci[best]], scores[best])]


def _matrix(table: pa.Table) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """ids and vectors by length."""
    ids = table.column("vec_id").to_numpy()
    lists = table.column("vector").combine_chunks()
    if isinstance(lists, pa.ChunkedArray):
        lists = pa.concat_arrays(lists.chunks)
    sizes = np.diff(lists.offsets.to_numpy())
    flat, at = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()[:-1]
    out = {}
    for size in np.unique(sizes).tolist():
        some = np.nonzero(sizes == size)[0]
        out[size] = ids[some], flat[at[some][:, None] + np.arange(size)[None, :]]
    return out


def top_k(df: DataFrame, is_query: Column, k: int = 10, scale: int = 1024, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: for each row that `is_query` picks, the k best other rows."""
    whole = df.where(F.col(vec_id).isNotNull() & usable(F.col(vector)))
    rows = stored(
        whole.select(F.col(vec_id).cast("long").alias("vec_id"), quantize(F.col(vector), scale).alias("vector"), is_query.alias("asks"))
        .groupBy("vec_id").agg(F.min("vector").alias("vector"), F.max("asks").alias("asks")),
        "vectors",
    )
    sizes = rows.agg(F.count("*").alias("rows"), F.count_if("asks").alias("asks")).first()
    if not sizes.rows or not sizes.asks:
        return df.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    blocks, asking = -(-sizes.rows // CANDIDATES), -(-sizes.asks // QUERIES)
    dealt = rows.withColumn("spot", F.xxhash64("vec_id"))
    candidates = dealt.select("vec_id", "vector", F.pmod("spot", F.lit(blocks)).alias("block"), F.explode(F.sequence(F.lit(0), F.lit(asking - 1))).alias("ask"))
    queries = dealt.where("asks").select("vec_id", "vector", F.pmod("spot", F.lit(asking)).cast("int").alias("ask"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"))

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        found = []
        if left.num_rows and right.num_rows:
            have = _matrix(right)
            for size, (query_ids, asked) in _matrix(left).items():
                if size in have:
                    found += block_top_k(query_ids, asked, *have[size], k)
        columns = [np.concatenate([one[i] for one in found]) if found else np.zeros(0, dtype=np.int64) for i in range(3)]
        return pa.table(dict(zip(("query_id", "vec_id", "score"), columns, strict=True)))

    near = queries.groupBy("block", "ask").cogroup(candidates.groupBy("block", "ask")).applyInArrow(search, RESULT)
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
