"""Exact dedup by progressive refinement, with built-in functions only.

Texts are equal when they are identical after lower-casing A to Z and nothing else.
Three rounds, each of which only looks at what the round before left open:

1. lengths in bytes (lower-casing A to Z keeps them), counted;
2. of texts whose length is not theirs alone, the hash of the first PREFIX characters,
   counted together with the length;
3. of texts that share both, SHA-256 of the whole normal form. Only here is a whole text
   lower-cased and hashed.

Texts as long as COUNTED bytes or longer skip the first round, so its table has COUNTED
rows at most and may be broadcast whatever the input. The keys of round 2 and the groups
of round 3 do grow with the input: they are written tables, so Spark knows their sizes
before it plans the joins, broadcasts them while they are below its limit and shuffles
both sides otherwise (and can split a hot key then, as both sides come from a shuffle).
All counts are combined before they are shuffled, so a text that is a third of all rows
is a few rows for each task.

Cases: a null text is as an empty one; of equal texts the row of the largest id stays,
a missing id only if there is no other; of rows that repeat an id and a text one stays;
an empty table gives no rows; other columns, whatever their names, are carried along by
`deduplicate` and left out by `decide`.
"""

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexspan.llm.scratch import fresh, stored

#: Characters that round 2 hashes.
PREFIX = 64
#: Length in bytes from which a text's length is not counted.
COUNTED = 1 << 16


def normal(text: Column) -> Column:
    """`text` with A to Z in lower case; empty for null."""
    whole = F.coalesce(text, F.lit(""))
    # In ASCII texts, lower() changes just these letters, and is much faster.
    return F.when(F.octet_length(whole) == F.char_length(whole), F.lower(whole)).otherwise(F.translate(whole, ascii_uppercase, ascii_lowercase))


def decide(df: DataFrame, doc_id: str = "doc_id", text: str = "text", digest: str | None = None, carry: str | None = None) -> DataFrame:
    """Columns doc_id, keep_id, group_size, kept: a row for each row of `df`.

    `digest`, if named, is added: SHA-256 of every text's normal form, so of those too
    that the first two rounds settle. `carry` names one more column of `df` to return.
    """
    size, head, full, row, open_, mine, best = (fresh(one) for one in ("size", "head", "full", "row", "open", "mine", "best"))
    docs = df.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias(mine), *([carry] if carry else []))
    docs = docs.withColumn(size, F.octet_length(mine)).withColumn(head, F.xxhash64(normal(F.substring(mine, 1, PREFIX))))

    shared = stored(docs.where(F.col(size) < COUNTED).groupBy(size).count().where("count > 1").select(size, F.lit(True).alias(open_)), "lengths")
    left = docs.select(size, head).join(F.broadcast(shared), size, "left").where(F.col(open_) | (F.col(size) >= COUNTED))
    heads = stored(left.groupBy(size, head).count().where("count > 1").select(size, head, F.lit(True).alias(open_)), "heads")

    whole = F.sha2(normal(F.col(mine)).cast("binary"), 256)
    read = docs.join(heads, [size, head], "left").select(
        "doc_id",
        F.when(F.col(open_), whole).alias(full),
        F.monotonically_increasing_id().alias(row),
        *([whole.alias(digest)] if digest else []),
        *([carry] if carry else []),
    )
    rows = stored(read, "digests")

    groups = rows.where(F.col(full).isNotNull()).groupBy(full).agg(
        F.count("*").alias("group_size"), F.max(F.struct(F.col("doc_id"), F.col(row))).alias(best)
    )
    groups = stored(groups.where("group_size > 1").withColumnRenamed(full, head), "groups")
    open_rows = rows.where(F.col(full).isNotNull()).join(groups, F.col(full) == F.col(head), "left")
    alone = rows.where(F.col(full).isNull()).withColumns({"group_size": F.lit(None).cast("long"), best: F.lit(None).cast(groups.schema[best].dataType)})
    both = open_rows.drop(head).unionByName(alone)
    return both.select(
        "doc_id",
        F.when(F.col(best).isNull(), F.col("doc_id")).otherwise(F.col(best)["doc_id"]).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).alias("group_size"),
        F.coalesce(F.col(best)[row] == F.col(row), F.lit(True)).alias("kept"),
        *([digest] if digest else []),
        *([carry] if carry else []),
    )


def deduplicate(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of `df` that stay, with all their columns."""
    held = fresh("held")
    every = F.struct(*[F.col(f"`{name}`") for name in df.columns]).alias(held)
    found = decide(df.select(doc_id, text, every), doc_id, text, carry=held)
    return found.where("kept").select(f"{held}.*")
