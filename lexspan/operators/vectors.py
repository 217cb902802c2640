"""Vector tables: reuse, embedding through a plug-in, exact cosine search."""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


EMBED_BATCH = 32
QUERY_BLOCK, CHUNK_BLOCK = 8192, 32_768
#: Queries and chunks whose products exist at a time, and room for single precision, for each dimension.
ROWS, STRIP, SINGLE_ROOM = 512, 8192, 2e-7
EXPIRED_STATUS = "het_hieu_luc"


def reuse_embeddings(chunks: DataFrame, previous: DataFrame) -> DataFrame:
    """Keeps an old vector when id and text are unchanged and it is not empty."""
    usable = previous.where((F.size("embedding") > 0) & F.col("chunk_id").isNotNull())
    # One row per id, chosen before the join so a repeated id cannot fan out.
    latest = usable.groupBy("chunk_id").agg(F.max_by(F.struct("text", "embedding"), "text").alias("old"))
    joined = chunks.join(latest, "chunk_id", "left")
    return joined.withColumn("embedding", F.when(F.col("old.text") == F.col("text"), F.col("old.embedding"))).drop("old")


def hashing_embedder(dimensions: int = 64) -> Callable[[list[str]], list[list[float]]]:
    """Deterministic stand-in for a model: signed token hashing, unit length."""

    def embed(texts: list[str]) -> list[list[float]]:
        out = []
        for text in texts:
            vector = np.zeros(dimensions)
            for token in text.lower().split():
                code = zlib.crc32(token.encode("utf-8"))
                vector[code % dimensions] += 1.0 if code & 0x80000000 else -1.0
            length = float(np.linalg.norm(vector))
            out.append((vector / length if length else vector).tolist())
        return out

    return embed


def embed_missing(chunks: DataFrame, embedder: Callable[[list[str]], list[list[float]]], batch: int = EMBED_BATCH) -> DataFrame:
    """Fills empty vectors of non-empty texts in batches.

    A batch that returns another number of vectors counts as failed: all its
    rows stay without a vector.
    """
    columns = [c for c in chunks.columns if c != "embedding"]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chunks.select(*columns).schema)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            vectors = list(frame["embedding"])
            open_rows = [
                i for i, (v, t) in enumerate(zip(vectors, frame["text"])) if (v is None or len(v) == 0) and t
            ]
            for start in range(0, len(open_rows), batch):
                rows = open_rows[start:start + batch]
                made = embedder([frame["text"].iloc[i] for i in rows])
                if len(made) != len(rows):
                    made = [None] * len(rows)
                for i, vector in zip(rows, made):
                    vectors[i] = vector if vector is not None and len(vector) else None
            yield frame.assign(embedding=vectors)

    return chunks.select(*columns, "embedding").mapInPandas(run, f"{fields}, `embedding` array<float>")


def completeness(chunks: DataFrame) -> DataFrame:
    """One row: texts that need a vector, those that have one, and whether all do."""
    needs = F.coalesce("text", F.lit("")) != ""
    has = F.coalesce(F.size("embedding"), F.lit(0)) > 0
    return chunks.agg(
        F.count(F.when(needs, 1)).alias("expected"), F.count(F.when(needs & has, 1)).alias("embedded")
    ).withColumn("complete", F.col("expected") == F.col("embedded"))


def require_complete(chunks: DataFrame) -> DataFrame:
    row = completeness(chunks).first()
    if not row["complete"]:
        raise RuntimeError(f"embedding incomplete: {row['embedded']}/{row['expected']} chunks")
    return chunks


def query_text(variants: Column, fallback: Column) -> Column:
    return F.when(F.size(variants) > 0, F.array_join(variants, " ; ")).otherwise(fallback)


def _best_of(scores: np.ndarray, items: np.ndarray, k: int) -> np.ndarray:
    """Places of the k greatest finite scores, of equal ones those of smaller items."""
    places = np.flatnonzero(np.isfinite(scores))
    if len(places) > k:
        some = scores[places]
        places = places[some >= np.partition(some, len(some) - k)[len(some) - k]]
    places = places[np.argsort(items[places], kind="stable")]
    return places[np.argsort(-scores[places], kind="stable")][:k]


def block_top_k(a: np.ndarray, skip: np.ndarray, b: np.ndarray, items: np.ndarray, expired: np.ndarray, k: int, known: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row of `a`, place in `b` and score of each query's k best; `items` ascend.

    Products in single precision bound the scores of a strip; what may reach the k-th
    best so far is scored in double precision. `known`: scores that k others reach already,
    so that what stays below may be left out.
    """
    long_a, long_b = np.linalg.norm(a, axis=1), np.linalg.norm(b, axis=1)
    unit = lambda x, n: np.divide(x, n[:, None], out=np.zeros_like(x), where=n[:, None] > 0).astype(np.float32)
    near_a, near_b = unit(a, long_a), unit(b, long_b)
    strange = not (np.isfinite(near_a).all() and np.isfinite(near_b).all())
    room = np.float32(SINGLE_ROOM * (a.shape[1] + 8))
    kept = [(np.empty(0, np.int64), np.empty(0))] * len(a)
    limit = np.full(len(a), -np.inf, dtype=np.float32) if known is None else known.astype(np.float32)
    for first in range(0, len(a), ROWS):
        rows = np.arange(first, min(first + ROWS, len(a)))
        for at in range(0, len(b), STRIP):
            strip = slice(at, at + STRIP)
            rough = near_a[rows] @ near_b[strip].T
            hidden = np.flatnonzero(expired[strip])
            rough[np.ix_(skip[rows], np.isin(np.arange(rough.shape[1]), hidden))] = -np.inf
            least = limit[rows]
            if at == 0 and rough.shape[1] > k and (least < -1).any():
                # Nothing is known yet, but k of this strip are as good as its k-th.
                least = np.maximum(least, np.partition(rough, rough.shape[1] - k, axis=1)[:, rough.shape[1] - k] - room)
            may = (rough >= (least - room)[:, None]) & (rough > -np.inf) if not strange else rough != -np.inf
            counts = may.sum(axis=1)
            # Rows of many candidates, such as copies, by one product.
            dense = np.flatnonzero(counts > rough.shape[1] // 16)
            whole = dict(zip(dense, a[rows[dense]] @ b[strip].T)) if len(dense) else {}
            for i in np.flatnonzero(counts):
                row, places = rows[i], np.flatnonzero(may[i])
                products = whole[i][places] if i in whole else b[strip][places] @ a[row]
                lengths = long_b[strip][places] * long_a[row]
                scores = np.round(np.divide(products, lengths, out=np.zeros_like(lengths), where=lengths > 0), 9)
                places, scores = np.concatenate([kept[row][0], places + at]), np.concatenate([kept[row][1], scores])
                top = _best_of(scores, items[places], k)
                kept[row] = (places[top], scores[top])
                if len(top) == k:
                    limit[row] = max(limit[row], scores[top[-1]])
    sizes = [len(places) for places, _ in kept]
    return np.repeat(np.arange(len(a)), sizes), np.concatenate([p for p, _ in kept]), np.concatenate([s for _, s in kept])


def cosine_top_k(queries: DataFrame, chunks: DataFrame, k: int, id_column: str = "chunk_id") -> DataFrame:
    """Exact cosine top-k: `query_id, <id>, score, rank`.

    `queries`: query_id, vector, optional `skip_expired`. `chunks`: id,
    embedding, optional `validity_status`. Both sides are cut into bounded
    blocks; every pair of blocks is one task group that returns k rows per
    query, so neither all pairs nor an unbounded group ever exists. Vectors of
    another length than the query's never match.
    """
    asked, cores = queries.count(), queries.sparkSession.sparkContext.defaultParallelism
    # Large blocks, as each is sent all chunks; smaller ones while there are fewer blocks than cores.
    q_blocks = max(1, math.ceil(asked / QUERY_BLOCK), min(cores, math.ceil(asked / max(1, QUERY_BLOCK // 8))))
    c_blocks = max(1, math.ceil(chunks.count() / CHUNK_BLOCK))
    skip = F.col("skip_expired") if "skip_expired" in queries.columns else F.lit(False)
    status = F.col("validity_status") if "validity_status" in chunks.columns else F.lit("")
    block = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = queries.where(F.size("vector") > 0).select(
        "query_id", "vector", F.coalesce(skip, F.lit(False)).alias("skip"), block("query_id", q_blocks).alias("qb"), every(c_blocks).alias("cb")
    )
    right = chunks.where(F.size("embedding") > 0).select(
        F.col(id_column).alias("item"), "embedding", (F.coalesce(status, F.lit("")) == EXPIRED_STATUS).alias("expired"),
        block(id_column, c_blocks).alias("cb"), every(q_blocks).alias("qb"),
    )
    id_type = dict(right.dtypes)["item"]
    query_type = dict(left.dtypes)["query_id"]

    def best(qs: pd.DataFrame, cs: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"query_id": [], "item": [], "score": []})
        if qs.empty or cs.empty:
            return empty
        size = cs["embedding"].map(len)
        found = []
        for width, group in qs.groupby(qs["vector"].map(len)):
            same = cs[size == width].sort_values("item")
            if same.empty:
                continue
            a = np.stack(group["vector"].to_list()).astype(np.float64)
            b = np.stack(same["embedding"].to_list()).astype(np.float64)
            row, place, scores = block_top_k(a, group["skip"].to_numpy(bool), b, same["item"].to_numpy(), same["expired"].to_numpy(bool), k)
            found.append(pd.DataFrame({"query_id": group["query_id"].to_numpy()[row], "item": same["item"].to_numpy()[place], "score": scores}))
        return pd.concat(found) if found else empty

    blocks = left.groupBy("qb", "cb").cogroup(right.groupBy("qb", "cb")).applyInPandas(
        best, f"query_id {query_type}, item {id_type}, score double"
    )
    place = Window.partitionBy("query_id").orderBy(F.desc("score"), "item")
    return (
        blocks.withColumn("rank", F.row_number().over(place))
        .where(F.col("rank") <= k)
        .select("query_id", F.col("item").alias(id_column), "score", "rank")
    )


def smoke_search(snapshot: DataFrame, dimensions: int, k: int = 2, id_column: str = "chunk_id") -> DataFrame:
    """Search with a constant vector, to see that a snapshot answers."""
    constant = F.array_repeat(F.lit(0.5).cast("float"), dimensions)
    probe = snapshot.sparkSession.range(1).select(F.col("id").alias("query_id"), constant.alias("vector"))
    return cosine_top_k(probe, snapshot, k, id_column)


def embed_queries(queries: DataFrame, embedder: Callable[[list[str]], list[list[float]]]) -> DataFrame:
    """Adds `vector` from the query's variants, or from its normal form."""
    texts = queries.withColumn("text", query_text(F.col("query_variants"), F.col("normalized_query"))).withColumn(
        "embedding", F.lit(None).cast("array<float>")
    )
    made = embed_missing(texts.select("query_id", "text", "embedding"), embedder)
    return queries.join(made.select("query_id", F.col("embedding").alias("vector")), "query_id", "left")


