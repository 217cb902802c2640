"""Packing into optimal length buckets and token-budget batches.

A document longer than the longest sequence is cut into pieces of that length and a
rest. The histogram of piece lengths over the whole table has at most `longest` + 1
rows and goes to the driver, where dynamic programming picks the bucket bounds (at most
`buckets` of them) that need the least padding in all. A bucket with bound b takes
budget // b pieces into a batch (one at least), so no batch exceeds the token budget
once it is padded.

Batches are numbered without a global sort: pieces are dealt to shards by a hash, about
as many shards as a shard has pieces; a piece's place in its bucket is its place in its
shard plus the sizes of the shards before. Only the last batch of a bucket is not full.

Cases: a document without tokens (or with a null count) is one piece of length 0; a
missing id is dealt by its content; repeated rows are packed each; an empty table gives
no rows; other columns are left out.
"""

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexspan.llm.scratch import stored

#: Longest sequence, tokens in a padded batch, and number of buckets.
LONGEST = 2048
BUDGET = 1 << 16
BUCKETS = 16


def bounds(histogram: dict[int, int], buckets: int) -> list[int]:
    """Bucket bounds, in order, with the least padding; the last is the greatest length."""
    lengths = np.array(sorted(histogram), dtype=np.int64)
    if not len(lengths):
        return []
    counts = np.array([histogram[one] for one in lengths.tolist()], dtype=np.float64)
    many = np.concatenate([[0.0], np.cumsum(counts)])
    tokens = np.concatenate([[0.0], np.cumsum(counts * lengths)])
    # padding[i, j]: lengths i to j (j included) in one bucket.
    padding = lengths[None, :] * (many[None, 1:] - many[:-1, None]) - (tokens[None, 1:] - tokens[:-1, None])
    padding[np.tril_indices(len(lengths), -1)] = np.inf
    least, before = padding[0], []
    for _ in range(min(buckets, len(lengths)) - 1):
        # A bucket more: the last one starts at i, the others end at i - 1.
        choice = np.concatenate([[np.inf], least[:-1]])[:, None] + padding
        start = np.argmin(choice, axis=0)
        found = choice[start, np.arange(len(lengths))]
        start = np.where(found < least, start, -1)
        before.append(start)
        least = np.minimum(found, least)
    out, at = [], len(lengths) - 1
    for start in reversed(before):
        if start[at] >= 0:
            out.append(int(lengths[at]))
            at = int(start[at]) - 1
    out.append(int(lengths[at]))
    return out[::-1]


def pieces(df: DataFrame, tokens: str, doc_id: str = "doc_id", mark: str | None = None, longest: int = LONGEST) -> DataFrame:
    """doc_id, piece, start, n_tokens, spot: the pieces of each document."""
    count = F.coalesce(F.col(tokens), F.lit(0)).cast("long")
    last = F.greatest(F.lit(0).cast("long"), F.floor((count - 1) / longest))
    spot = F.xxhash64(F.col(doc_id), *([F.col(mark)] if mark else []))
    cut = df.select(F.col(doc_id).alias("doc_id"), count.alias("n"), spot.alias("spot"), F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("piece"))
    return cut.select("doc_id", "piece", (F.col("piece") * longest).alias("start"), F.least(F.lit(longest).cast("long"), F.col("n") - F.col("piece") * longest).alias("n_tokens"), F.xxhash64("spot", "piece").alias("spot"))


def pack(df: DataFrame, tokens: str = "n_tokens", doc_id: str = "doc_id", mark: str | None = None, longest: int = LONGEST, budget: int = BUDGET, buckets: int = BUCKETS) -> DataFrame:
    """doc_id, piece, start, n_tokens, bucket (its bound), batch (number in the bucket), slot.

    `mark` names a column that tells apart rows of one id, so that they are spread too.
    """
    cut = stored(pieces(df, tokens, doc_id, mark, longest), "pieces")
    histogram = {row.n_tokens: row.n for row in cut.groupBy("n_tokens").agg(F.count("*").alias("n")).collect()}
    limits = bounds(histogram, buckets)
    if not limits:
        return cut.select("doc_id", "piece", "start", "n_tokens", F.col("n_tokens").alias("bucket"), F.col("piece").alias("batch"), F.col("piece").alias("slot"))
    bucket = F.lit(limits[-1])
    for bound in reversed(limits[:-1]):
        bucket = F.when(F.col("n_tokens") <= bound, F.lit(bound)).otherwise(bucket)
    shards = int(sum(histogram.values()) ** 0.5) + 1
    dealt = cut.withColumn("bucket", bucket.cast("long")).withColumn("shard", F.pmod("spot", F.lit(shards)))
    sizes = dealt.groupBy("bucket", "shard").agg(F.count("*").alias("n"))
    ahead = Window.partitionBy("bucket").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(F.col("bucket").alias("bucket_"), F.col("shard").alias("shard_"), F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("bucket", "shard").orderBy("spot", "doc_id", "piece", "n_tokens")
    placed = dealt.withColumn("place", F.row_number().over(inside) - 1).join(offsets, (F.col("bucket") == F.col("bucket_")) & (F.col("shard") == F.col("shard_")))
    at = F.col("offset") + F.col("place")
    room = F.greatest(F.lit(1).cast("long"), F.floor(F.lit(budget) / F.greatest(F.col("bucket"), F.lit(1))))
    return placed.select("doc_id", "piece", "start", "n_tokens", "bucket", F.floor(at / room).alias("batch"), F.pmod(at, room).alias("slot"))
