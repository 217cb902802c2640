"""Near-duplicate documents by SimHash, found in a grid of segment bit counts.

A fingerprint's 64 bits are cut into 32 segments of two bits. The counts of set bits
of the segments embed the fingerprint in a grid, and the Manhattan distance of two
such points is never more than the number of differing bits. For a radius of r the
segments are cut into (r + 1) // 2 groups: if two points lie within r of each other,
then within some group they lie within 1. So each fingerprint stands in one cell of
each group's grid and looks into that cell and into the cells one step below; the step
above is what the other fingerprint looks into. What meets in a cell is checked for
the Manhattan bound and then bit by bit. Distances are exact: no link is lost.

Counts are kept in thermometer code (00, 01, 11 for 0, 1, 2), so a Manhattan distance
is the number of differing bits of two codes.

Equal fingerprints are one row here, however many documents have them; what a cell
holds is distinct fingerprints, and the join's skewed partitions can be split.

Cases: a null text is as an empty one, with fingerprint zero, which links like any
other; a missing document id takes part, but is no component's id unless it is the
only one (then null); repeated rows are documents of their own; an empty table gives
no rows; other columns are left alone.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from lexspan.llm.graph import components
from lexspan.llm.scratch import stored

SEGMENTS = 32
#: 01 in each segment.
LOW = 0x5555555555555555
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Shingles that vote at a time, so that a very long text needs no more memory than that.
AT_ONCE = 1 << 16


def _signed(value: int) -> int:
    return value - (1 << 64) if value >= 1 << 63 else value


def shingle_hashes(text: bytes, words: int = 3, seed: int = 42) -> np.ndarray:
    """Hashes of all runs of `words` words, of a shorter text's only run; none without words."""
    import xxhash

    parts = text.translate(LOWER).split()
    if not parts:
        return np.empty(0, dtype="<u8")
    width = min(words, len(parts))
    sizes = np.fromiter(map(len, parts), dtype=np.int64, count=len(parts))
    ends = np.cumsum(sizes + 1) - 1
    starts = (ends - sizes)[: len(parts) - width + 1].tolist()
    joined, digest = b" ".join(parts), xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], seed) for a, b in zip(starts, ends[width - 1 :].tolist(), strict=True)], dtype="<u8")


def voted(hashes: np.ndarray) -> int:
    """Signed 64 bits: bit i is set if it is set in over half the hashes."""
    if not len(hashes):
        return 0
    votes = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), AT_ONCE):
        some = hashes[at : at + AT_ONCE]
        votes += np.unpackbits(some.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(votes * 2 > len(hashes), bitorder="little").view("<i8")[0])


def fingerprint(text: bytes, words: int = 3, seed: int = 42) -> int:
    """The vote of the hashes of a text's shingles."""
    return voted(shingle_hashes(text, words, seed))


def fingerprints(df: DataFrame, text: str = "text", out: str = "fp", words: int = 3, seed: int = 42) -> DataFrame:
    """Add `out`, the fingerprint of each whole text as a signed long."""

    @F.arrow_udf(LongType())
    def fp_of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array((fingerprint(one.as_py() or b"", words, seed) for one in texts.cast(pa.binary())), type=pa.int64())

    return df.withColumn(out, fp_of(F.col(text)))


def as_hex(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def _code(fp: Column) -> Column:
    """Thermometer code of the segments' bit counts."""
    high = F.shiftright(fp, 1)
    low = F.lit(LOW)
    return fp.bitwiseOR(high).bitwiseAND(low).bitwiseOR(F.shiftleft(fp.bitwiseAND(high).bitwiseAND(low), 1))


def links(fps: DataFrame, radius: int = 3, fp: str = "fp") -> DataFrame:
    """Pairs a, b of distinct fingerprints, all that differ in at most `radius` bits.

    `fps` holds each fingerprint once.
    """
    groups = max(1, (radius + 1) // 2)
    group_of = [segment * groups // SEGMENTS for segment in range(SEGMENTS)]
    masks = [_signed(sum(3 << 2 * s for s in range(SEGMENTS) if group_of[s] == g)) for g in range(groups)]
    points = fps.where(F.col(fp).isNotNull()).select(F.col(fp).alias("fp"), _code(F.col(fp)).alias("code"))

    def pick(values: list[int], at: str) -> Column:
        return F.element_at(F.array(*[F.lit(v).cast("long") for v in values]), F.col(at) + 1)

    stands = points.select("*", F.explode(F.array(*[F.lit(g) for g in range(groups)])).alias("grp")).select(
        "grp", F.col("code").bitwiseAND(pick(masks, "grp")).alias("cell"), F.col("fp").alias("a"), F.col("code").alias("code_a")
    )
    one, two = F.expr("shiftleft(1L, 2 * step)"), F.expr("shiftleft(2L, 2 * step)")
    code = F.col("code")
    below = F.when(code.bitwiseAND(two) != 0, two).when(code.bitwiseAND(one) != 0, one)
    looks = (
        points.select("*", F.explode(F.sequence(F.lit(0), F.lit(SEGMENTS + groups - 1))).alias("step"))
        .withColumn("grp", F.when(F.col("step") < SEGMENTS, pick(group_of, "step").cast("int")).otherwise(F.col("step") - SEGMENTS))
        .withColumn("own", F.col("step") >= SEGMENTS)
        .withColumn("cell", F.when(F.col("own"), code).otherwise(code.bitwiseXOR(below)).bitwiseAND(pick(masks, "grp")))
        .where("cell is not null")
        .select("grp", "cell", "own", F.col("fp").alias("b"), F.col("code").alias("code_b"))
    )
    near = (
        (F.col("a") != F.col("b"))
        & (~F.col("own") | (F.col("a") < F.col("b")))
        & (F.bit_count(F.col("code_a").bitwiseXOR(F.col("code_b"))) <= radius)
        & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)
    )
    met = stands.join(looks, (stands.grp == looks.grp) & (stands.cell == looks.cell) & near)
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def group(df: DataFrame, radius: int = 3, doc_id: str = "doc_id", fp: str = "fp", out: str = "component_id", root: str | None = None) -> DataFrame:
    """Add `out`, the smallest document id that links reach from a row's fingerprint.

    `root`, if named, is added too: the component's least fingerprint, never null.

    `df` is read several times: it should be a stored table of ids and fingerprints.
    """
    fps = stored(df.groupBy(F.col(fp).alias("fp")).agg(F.min(doc_id).alias("first")), "fps")
    found = components(links(fps, radius))
    known = fps.join(found, fps.fp == found.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    labels = known.groupBy("root").agg(F.min("first").alias("label"))
    # Stored, so that the join below shuffles both sides and can split a fingerprint of many copies.
    of = stored(known.join(labels, "root").select(F.col("fp").alias("fp_"), F.col("label").alias(out), F.col("root").alias(root or "root_")), "labels")
    return df.drop(out, root or "root_").join(of, F.col(fp) == F.col("fp_")).drop("fp_", "root_")
