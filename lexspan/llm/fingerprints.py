"""Document fingerprints by SimHash, with permuted block tables; built-in functions only.

Terms are the words of a text and its pairs of neighbouring words. A word weighs its
length less three, at most nine and never below nothing, so that the short words that
every text has say nothing; a pair weighs what its two words weigh, and two more. Every
occurrence votes with its weight for the bits that its hash has set and against the
others; a fingerprint has the bits with more votes for them than against. Two 32-bit
vote counters share a long, so a text needs 32 sums.

`near` finds, for every fingerprint, all others within a Hamming radius: of radius + 2
blocks of bits at least two agree, so a table for each pair of blocks, keyed by those
two blocks, meets every near pair; the pair is taken where its first two agreeing
blocks are the table's, hence once, and is verified exactly.

`follow` gives each document the text of the one before it in id order, by one shuffle
of the texts: ids are dealt in ranges, and the last of each range is copied to the
range that needs it.

Cases: a null text is as an empty one; a text without weighing terms has fingerprint
zero. A missing id has no place in the order: such a row has no next document (its
edited text is its first half, `near_next` is null). Rows of one id follow each other
in the order of their texts. One document alone is its own next. An empty table gives
no rows; other columns are left alone.
"""

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexspan.llm.scratch import stored

#: Ids that one range of `follow` spans, as a power of two; a range is sorted in one task.
RANGE_BITS = 8
#: Ranges (and so on upwards) of which the order is found in one task.
STEP_BITS = 12
#: Two counters of 32 bits in a long.
PACKED = 0x0000000100000001
SPACE = r"[\x20\x09-\x0D]+"


def as_hex(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def likeness(a: Column, b: Column) -> Column:
    """Share of equal bits."""
    return F.lit(1.0) - F.bit_count(a.bitwiseXOR(b)) / F.lit(64.0)


def with_fingerprint(df: DataFrame, keys: list[str], text: str = "text", out: str = "fp") -> DataFrame:
    """A row of `keys` and the fingerprint for each row of `df`; `keys` must tell rows apart.

    Where `df` is already dealt by one of `keys`, nothing is shuffled.
    """
    words = df.select(*keys, F.split(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), rf"^{SPACE}|{SPACE}$", ""), SPACE).alias("_words"))
    spots = words.select(*keys, "_words", F.posexplode("_words").alias("_at", "_word"))

    def weight(word: Column) -> Column:
        return F.greatest(F.lit(0), F.least(F.length(word), F.lit(12)) - 3)

    after = F.get("_words", F.col("_at") + 1)
    votes = spots.select(
        *keys,
        weight(F.col("_word")).cast("long").alias("_w1"),
        F.xxhash64("_word").alias("_h1"),
        F.when(after.isNull(), F.lit(0)).otherwise(weight(F.col("_word")) + weight(after) + 2).cast("long").alias("_w2"),
        F.xxhash64("_word", after).alias("_h2"),
    )
    packed = F.lit(PACKED)
    sums = [
        F.sum(
            F.col("_w1") * F.shiftright("_h1", i).bitwiseAND(packed) + F.col("_w2") * F.shiftright("_h2", i).bitwiseAND(packed)
        ).alias(f"_v{i}")
        for i in range(32)
    ]
    counted = votes.groupBy(*keys).agg(F.sum(F.col("_w1") + F.col("_w2")).alias("_all"), *sums)
    fp = F.lit(0).cast("long")
    for i in range(32):
        low, high = F.col(f"_v{i}").bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(F.col(f"_v{i}"), 32)
        fp = fp.bitwiseOR(F.when(low * 2 > F.col("_all"), F.lit(1 << i).cast("long")).otherwise(F.lit(0).cast("long")))
        top = (1 << i + 32) - ((1 << 64) if i == 31 else 0)
        fp = fp.bitwiseOR(F.when(high * 2 > F.col("_all"), F.lit(top).cast("long")).otherwise(F.lit(0).cast("long")))
    return counted.select(*keys, fp.alias(out))


def _next_above(keys: DataFrame, most: int) -> DataFrame:
    """key, above: the next greater key of a table of distinct longs from 0 to `most`, null for the last."""
    dealt = keys.select("key", F.shiftright("key", STEP_BITS).alias("deal"))
    here = dealt.withColumn("above", F.lead("key").over(Window.partitionBy("deal").orderBy("key")))
    if not most >> STEP_BITS:
        return here.select("key", "above")
    heads = dealt.groupBy("deal").agg(F.min("key").alias("head"))
    order = _next_above(heads.select(F.col("deal").alias("key")), most >> STEP_BITS)
    jump = order.join(heads.withColumnRenamed("deal", "above"), "above").select(F.col("key").alias("deal"), "head")
    return here.join(jump, "deal", "left").select("key", F.coalesce("above", "head").alias("above"))


def follow(df: DataFrame, doc_id: str = "doc_id", text: str = "text", out: str = "next_text") -> DataFrame:
    """Add `out`, the text of the next document in descending id order (after the last, the first).

    Also adds `_range` (what the rows are dealt by), `_row` (their order in it) and
    `_copy`: true for rows that only stand in for the first document of another range.
    """
    dealt = F.shiftright(F.col(doc_id), RANGE_BITS)
    tops = stored(df.where(F.col(doc_id).isNotNull()).groupBy(dealt.alias("key")).agg(F.max(doc_id).alias("top")), "ranges")
    ends = tops.agg(F.min("key").alias("least"), F.max("key").alias("most")).first()
    text_or_empty = F.coalesce(F.col(text), F.lit(""))
    # Rows without an id are dealt by their text and get no successor.
    rows = df.withColumn(text, text_or_empty).withColumns({"_range": F.coalesce(dealt, F.xxhash64(text_or_empty)), "_copy": F.lit(False)})
    if ends.least is not None:
        least = F.lit(ends.least)
        above = _next_above(tops.select((F.col("key") - least).alias("key")), ends.most - ends.least)
        lacking = above.join(tops.withColumn("key", F.col("key") - least), "key").select(F.col("top").alias("_top"), (F.coalesce("above", F.lit(0)) + least).alias("_to"))
        copies = rows.join(lacking, F.col(doc_id) == F.col("_top")).withColumns({"_range": F.col("_to"), "_copy": F.lit(True)}).drop("_top", "_to")
        rows = rows.unionByName(copies)
    # A column of its own, so that what follows sees that rows are dealt by it already.
    rows = rows.withColumn("_placed", F.col(doc_id).isNotNull())
    inside = Window.partitionBy("_range", "_placed").orderBy("_copy", F.col(doc_id).desc(), text)
    return rows.withColumns({out: F.when(F.col("_placed"), F.lead(text).over(inside)), "_row": F.row_number().over(inside)})


def near(fps: DataFrame, radius: int = 3, fp: str = "fp") -> DataFrame:
    """Pairs a < b of distinct fingerprints that differ in at most `radius` bits, each once.

    `fps` holds each fingerprint once.
    """
    count = radius + 2
    edges = [64 * k // count for k in range(count + 1)]
    masks = [(1 << b) - (1 << a) for a, b in zip(edges, edges[1:], strict=False)]
    masks = [m - (1 << 64) if m >= 1 << 63 else m for m in masks]
    tables = list(combinations(range(count), 2))

    def entries(name: str) -> DataFrame:
        keys = [
            F.struct(F.lit(t).cast("int").alias("tbl"), F.col(fp).bitwiseAND(F.lit(masks[i] | masks[j])).alias("key"))
            for t, (i, j) in enumerate(tables)
        ]
        return fps.where(F.col(fp).isNotNull()).select(F.col(fp).alias(name), F.inline(F.array(*keys)))

    left, right = entries("a"), entries("b")
    differ = F.col("a").bitwiseXOR(F.col("b"))
    first = F.lit(False)
    for t, (i, j) in enumerate(tables):
        apart = F.lit(True)
        for k in range(j):
            if k != i:
                apart = apart & (differ.bitwiseAND(F.lit(masks[k])) != 0)
        first = first | ((left.tbl == t) & apart)
    met = left.join(right, (left.tbl == right.tbl) & (left.key == right.key) & (F.col("a") < F.col("b")) & (F.bit_count(differ) <= radius) & first)
    return met.select("a", "b")


def describe(df: DataFrame, radius: int = 3, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of texts and of their edited texts, likenesses, and near documents.

    The edited text has its last floor(n/2) characters replaced by the first as many of
    the next document. `near_docs` counts the other rows whose fingerprints lie within
    `radius` bits.
    """
    both = follow(df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), "doc_id", "text")
    size = F.length("text")
    half = F.floor(size / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), size - half), F.substring(F.coalesce("next_text", F.lit("")), F.lit(1), half))
    kept = both.select("doc_id", "_range", "_row", "_placed", "_copy", F.col("text").alias("text"), edited.alias("edited"), size.cast("long").alias("n_chars"))
    keys = ["doc_id", "_range", "_row", "_placed", "_copy", "n_chars", "kind", "sha"]
    kinds = F.when(
        F.col("_copy"), F.array(F.struct(F.lit(0).alias("kind"), F.lit(None).cast("string").alias("sha"), F.col("text").alias("body")))
    ).otherwise(
        F.array(
            F.struct(F.lit(0).alias("kind"), F.lit(None).cast("string").alias("sha"), F.col("text").alias("body")),
            F.struct(F.lit(1).alias("kind"), F.sha2(F.col("edited").cast("binary"), 256).alias("sha"), F.col("edited").alias("body")),
        )
    )
    texts = kept.select("doc_id", "_range", "_row", "_placed", "_copy", "n_chars", F.inline(kinds))
    marked = with_fingerprint(texts, keys, "body")
    of = ["doc_id", "_range", "_row", "_placed", "_copy", "n_chars"]
    one = marked.groupBy(*of).agg(
        F.max("sha").alias("edited_sha256"),
        F.max(F.when(F.col("kind") == 0, F.col("fp"))).alias("fp"),
        F.max(F.when(F.col("kind") == 1, F.col("fp"))).alias("edited_fp"),
    )
    inside = Window.partitionBy("_range", "_placed").orderBy("_row")
    after = F.when(F.col("_placed"), F.lead("fp").over(inside))
    rows = stored(one.withColumn("next_fp", after).where(~F.col("_copy")).select("doc_id", "n_chars", "edited_sha256", "fp", "edited_fp", "next_fp"), "fingerprints")
    counts = stored(rows.groupBy("fp").agg(F.count("*").alias("n")), "fps")
    pairs = near(counts.select("fp"), radius)
    both_ways = pairs.select(F.col("a").alias("fp"), F.col("b").alias("other")).unionByName(pairs.select(F.col("b").alias("fp"), F.col("a").alias("other")))
    around = both_ways.join(counts.select(F.col("fp").alias("other"), "n"), "other").groupBy("fp").agg(F.sum("n").alias("around"))
    totals = stored(counts.join(around, "fp", "left").select(F.col("fp").alias("fp_"), (F.col("n") - 1 + F.coalesce("around", F.lit(0))).alias("near_docs")), "near")
    return rows.join(totals, F.col("fp") == F.col("fp_")).select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        as_hex(F.col("fp")).alias("fingerprint"),
        as_hex(F.col("edited_fp")).alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"),
        likeness(F.col("fp"), F.col("next_fp")).alias("near_next"),
        "near_docs",
    )
