"""Near copies by the exact Jaccard similarity of word shingles.

A text is the set of its runs of WORDS words, as 64-bit hashes; a shorter text is one
run. Texts of the same set are one here. The fingerprints of `simhash_dedup`, of runs of
WORDS words, propose pairs first: sets of one fingerprint are compared with the least of
them, and the least ones of linked fingerprints with each other. Similar texts may
differ in more bits than the radius, so MinHash proposes what fingerprints miss: BANDS
keys of ROWS minima each, and sets that share a key are compared exactly. A pair at the
least similarity of 0.8 shares none of 72 keys of 8 minima with a chance of
(1 - 0.8^8)^72, that is 2 in a million; a more similar pair with less.

Groups are the connected components of the pairs that are similar enough. A key shared
by n sets does not need n^2 comparisons for that:

1. In each of ROUNDS rounds every key has a pivot, its least set that lies in no earlier
   pivot's component; the sets still open under the key are compared with it, and those
   in its component are done with there. A family of copies is gone after one round or
   two, at a comparison for each set and key.
2. Sets whose key still holds several components are alike in something common, such as
   a shared passage, and mostly not similar. They are joined by prefix filtering, which
   is exact: a set's runs are ordered by how frequent they are, rare ones first, and a
   similar pair must share a run among the first fifth of the longer set and the first
   ninth of the shorter one, at places that leave enough runs for the similarity. A
   passage that many sets share is frequent, so it is not in those first runs, and what
   is similar in nothing else never meets. Frequencies are counts of CELLS hashed cells,
   a table of fixed size; any order gives right results, this one gives few pairs.

Only sets of different components are paired, and what is left out lies in one component
anyway, so the components are those of all proposed pairs and more.

Cases: a null text is as an empty one; texts without words are alike. A set is named by
a 128-bit hash of its sorted runs. A missing id comes after all others; of rows that
repeat an id and a text one stays. An empty table gives no rows. Other columns, of any
type and name, are carried along.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from lexspan.llm.graph import components
from lexspan.llm.scratch import fresh, stored
from lexspan.llm.simhash_dedup import links as fingerprint_links
from lexspan.llm.simhash_dedup import shingle_hashes, voted

WORDS = 5
#: Least similarity of near copies, as a fraction.
LEAST = (4, 5)
BANDS, ROWS = 72, 8
#: Bits in which linked fingerprints may differ.
RADIUS = 3
#: Runs hashed at a time, so that a block of minima stays in the processor's cache.
AT_ONCE = 1 << 9
#: Rounds of pivots, and cells of the frequency table (8 MB).
ROUNDS = 3
CELLS = 1 << 20
SKETCH = "struct<name:string,size:bigint,fp:bigint,keys:array<bigint>>"
_DRAW = np.random.default_rng(42)
_TIMES = _DRAW.integers(0, 1 << 31, BANDS * ROWS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_FLIP = _DRAW.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32)
_FOLD = _DRAW.integers(0, 1 << 63, ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_set(text: bytes, words: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of the runs of words."""
    return np.unique(shingle_hashes(text, words))


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """One key for each band, from the minima of its rows."""
    least = np.full(BANDS * ROWS, 0xFFFFFFFF, dtype=np.uint32)
    short = (hashes ^ (hashes >> np.uint64(32))).astype(np.uint32)
    for at in range(0, len(short), AT_ONCE):
        np.minimum(least, ((short[at : at + AT_ONCE, None] ^ _FLIP) * _TIMES).min(axis=0), out=least)
    mixed = (least.reshape(BANDS, ROWS).astype(np.uint64) + np.uint64(1)) * _FOLD[:ROWS]
    mixed ^= mixed >> np.uint64(29)
    return mixed.sum(axis=1, dtype=np.uint64) * _FOLD[0] + np.arange(BANDS, dtype=np.uint64)


def sketches(df: DataFrame, text: str = "text", out: str = "sketch", words: int = WORDS) -> DataFrame:
    """Add `out`: the name and the size of a text's set, its fingerprint and its band keys."""
    import xxhash

    digest = xxhash.xxh3_128_hexdigest

    @F.arrow_udf(SKETCH)
    def sketch_of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            names, sizes, fps, keys = [], [], [], [np.empty(0, dtype=np.int64)]
            for one in texts.cast(pa.binary()):
                every = shingle_hashes(one.as_py() or b"", words)
                hashes = np.unique(every)
                fps.append(voted(every))
                names.append(digest(hashes.tobytes(), 42))
                sizes.append(len(hashes))
                keys.append(band_keys(hashes).view(np.int64))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(names) + 1, dtype=np.int32) * BANDS), pa.array(np.concatenate(keys)))
            yield pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(sizes, pa.int64()), pa.array(fps, pa.int64()), lists], names=["name", "size", "fp", "keys"])

    return df.withColumn(out, sketch_of(F.col(text)))


def with_sets(df: DataFrame, text: str = "text", out: str = "runs", words: int = WORDS) -> DataFrame:
    """Add `out`, the set of each text."""

    @F.arrow_udf(ArrayType(LongType()))
    def set_of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array([shingle_set(one.as_py() or b"", words).view(np.int64) for one in texts.cast(pa.binary())], type=pa.list_(pa.int64()))

    return df.withColumn(out, set_of(F.col(text)))


def _sizes_allow(a: Column, b: Column) -> Column:
    """The similarity is at most the smaller size over the larger."""
    return F.least(a, b) * LEAST[1] >= F.greatest(a, b) * LEAST[0]


def _similar(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs a, b whose sets have the least similarity."""

    def named(end: str) -> DataFrame:
        return sets.select(F.col("name").alias(f"name_{end}"), F.col("runs").alias(f"runs_{end}"))

    both = pairs.join(named("a"), F.col("a") == F.col("name_a")).join(named("b"), F.col("b") == F.col("name_b"))
    size_a, size_b = F.size("runs_a"), F.size("runs_b")
    shared = F.size(F.array_intersect("runs_a", "runs_b"))
    over, under = LEAST
    return both.where(shared * under >= (size_a + size_b - shared) * over).select("a", "b")


def fingerprint_pairs(named: DataFrame) -> DataFrame:
    """Pairs a < b of names that fingerprints propose, from a table of name and sketch."""
    tags = stored(named.select("name", F.col("sketch")["size"].alias("size"), F.col("sketch")["fp"].alias("fp")).distinct(), "tags")
    heads = stored(tags.groupBy("fp").agg(F.min("name").alias("head"), F.min_by("size", "name").alias("head_size")), "heads")

    def of(end: str) -> DataFrame:
        return heads.select(F.col("fp").alias(f"fp_{end}"), F.col("head").alias(f"head_{end}"), F.col("head_size").alias(f"size_{end}"))

    stars = tags.join(of("a"), F.col("fp") == F.col("fp_a")).select(F.col("head_a"), F.col("size_a"), F.col("name").alias("head_b"), F.col("size").alias("size_b"))
    linked = fingerprint_links(heads.select("fp"), RADIUS).join(of("a"), F.col("a") == F.col("fp_a")).join(of("b"), F.col("b") == F.col("fp_b"))
    both = stars.unionByName(linked.select(*stars.columns)).where("head_a <> head_b").where(_sizes_allow(F.col("size_a"), F.col("size_b")))
    return both.select(F.least("head_a", "head_b").alias("a"), F.greatest("head_a", "head_b").alias("b")).distinct()


def _of_several(rows: DataFrame, key: str, value: Column) -> DataFrame:
    """key_: the keys under which `value` differs."""
    met = rows.groupBy(F.col(key).alias("key_")).agg(F.min(value).alias("low"), F.max(value).alias("high"))
    return met.where("low < high").select("key_")


def _placed(rows: DataFrame, parts: DataFrame) -> DataFrame:
    """Add `part`, the component of the row's name; itself if it has no link."""
    return rows.join(parts, F.col("name") == F.col("node"), "left").withColumn("part", F.coalesce("root", "name")).drop("node", "root")


def frequencies(sets: DataFrame) -> np.ndarray:
    """How many runs fall into each cell, over all sets."""
    cells = sets.select(F.explode("runs").alias("run")).groupBy(F.pmod("run", F.lit(CELLS)).cast("int").alias("cell")).count()
    found = cells.toArrow()  # CELLS rows at most
    counts = np.zeros(CELLS, dtype=np.int64)
    counts[found.column("cell").to_numpy()] = found.column("count").to_numpy()
    return counts


def prefix(runs: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The runs, rare ones first, that a similar set must share one of: a fifth and one."""
    over, under = LEAST[1], LEAST[0]
    order = np.lexsort((runs, counts[runs % CELLS]))
    return runs[order[: len(runs) - -(-len(runs) * under // over) + 1]]


def joined_by_prefix(sets: DataFrame) -> DataFrame:
    """Pairs a, b of different parts that may be similar. `sets` is a stored table of name, part, runs."""
    shared = sets.sparkSession.sparkContext.broadcast(frequencies(sets))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            firsts = [prefix(np.asarray(one.values), shared.value) for one in batch.column(2)]
            sizes = np.array([len(one.values) for one in batch.column(2)], dtype=np.int64)
            lengths = np.array([len(one) for one in firsts], dtype=np.int64)
            of = np.repeat(np.arange(len(firsts)), lengths)
            at = np.arange(len(of)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([np.empty(0, np.int64), *firsts])), pa.array(at), batch.column(0).take(pa.array(of)), pa.array(sizes[of]), batch.column(1).take(pa.array(of))],
                names=["run", "at", "name", "size", "part"],
            )

    rows = stored(sets.select("name", "part", "runs").mapInArrow(emit, "run long, at long, name string, size long, part string"), "prefixes")
    over, under = LEAST

    def least_shared(a: Column, b: Column) -> Column:
        return (a + b) * over / F.lit(over + under)

    def side(end: str) -> DataFrame:
        return rows.select("run", *[F.col(name).alias(f"{name}_{end}") for name in ("at", "name", "size", "part")])

    size_a, size_b = F.col("size_a"), F.col("size_b")
    short = side("a").where(size_a - F.col("at_a") >= least_shared(size_a, size_a))
    long = side("b").withColumnRenamed("run", "run_b")
    rest = F.least(size_a - F.col("at_a"), size_b - F.col("at_b"))
    may = (F.struct("size_a", "name_a") < F.struct("size_b", "name_b")) & (F.col("part_a") != F.col("part_b"))
    may &= _sizes_allow(size_a, size_b) & (rest >= least_shared(size_a, size_b))
    return short.join(long, (F.col("run") == F.col("run_b")) & may).select(F.col("name_a").alias("a"), F.col("name_b").alias("b")).distinct()


def group(docs: DataFrame, marked: DataFrame, text: str = "text", mark: str = "mark", sketch: str = "sketch", root: str = "root") -> DataFrame:
    """Add `name` and `root` to the rows of `marked`: the text's set and the least one of its group.

    `marked` is a stored table with `mark` and `sketch`, in which a mark stands for one
    text; `docs` has `mark` and `text`.
    """
    named = marked.withColumn("name", F.col(sketch)["name"])
    # Names and their keys once, however many documents have the same set.
    names = stored(named.groupBy("name").agg(F.min(mark).alias("mark"), F.first(sketch).alias("sketch")), "names")
    spots = names.select("name", F.col("sketch")["size"].alias("size"), F.explode(F.col("sketch")["keys"]).alias("key"))
    several = stored(_of_several(spots, "key", F.col("name")), "keys")
    shared = stored(spots.join(several, F.col("key") == F.col("key_")).select("name", "size", "key"), "shared")
    proposed = stored(fingerprint_pairs(named.select("name", F.col(sketch).alias("sketch"))), "proposed")
    compared_names = shared.select("name").union(proposed.select("a")).union(proposed.select("b")).distinct()
    wanted = compared_names.join(names.select(F.col("name").alias("name_"), "mark"), F.col("name") == F.col("name_")).select("name", F.col("mark").alias("mark_"))
    texts = docs.select(F.col(mark).alias("mark"), F.col(text).alias("text")).join(wanted, F.col("mark") == F.col("mark_")).dropDuplicates(["name"])
    sets = stored(with_sets(texts.select("name", "text")).select("name", "runs"), "sets")

    links, parts, left = stored(_similar(proposed, sets), "near"), None, shared
    for at in range(ROUNDS):
        pivots = left.groupBy("key").agg(F.min("name").alias("pivot"), F.max("name").alias("last"), F.min_by("size", "name").alias("pivot_size"))
        pivots = stored(pivots.where("pivot < last").withColumnRenamed("key", "key_"), "pivots")
        compared = stored(left.join(pivots, F.col("key") == F.col("key_")).select("name", "size", "key", "pivot", "pivot_size"), "compared")
        pairs = compared.where("name <> pivot").where(_sizes_allow(F.col("size"), F.col("pivot_size"))).select(F.col("pivot").alias("a"), F.col("name").alias("b")).distinct()
        if at == 0:
            pairs = pairs.join(proposed, ["a", "b"], "left_anti")
        found = stored(_similar(pairs, sets), "stars")
        links = stored(links.unionByName(found), "links")
        parts = stored(components(links), "parts")
        pivot_parts = pivots.select("key_", "pivot").join(parts, F.col("pivot") == F.col("node"), "left").select(F.col("key_"), F.coalesce("root", "pivot").alias("pivot_part"))
        apart = _placed(compared.select("name", "size", "key"), parts).join(stored(pivot_parts, "pivots"), F.col("key") == F.col("key_"))
        left = stored(apart.where("part <> pivot_part").select("name", "size", "key"), "left")
    placed = stored(_placed(shared, parts), "placed")
    mixed = stored(_of_several(placed, "key", F.col("part")), "mixed")
    open_ = placed.join(mixed, F.col("key") == F.col("key_")).select(F.col("name").alias("name_"), "part").distinct()
    more = stored(_similar(joined_by_prefix(stored(sets.join(open_, F.col("name") == F.col("name_")).select("name", "part", "runs"), "open")), sets), "across")
    whole = components(links.unionByName(more))
    # Stored, so that the join below shuffles both sides and can split a set of many copies.
    of = stored(names.select("name").join(whole, F.col("name") == F.col("node"), "left").select(F.col("name").alias("name_"), F.coalesce("root", "name").alias(root)), "roots")
    return named.join(of, F.col("name") == F.col("name_")).drop("name_")


def deduplicate(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each group of near copies, that of the smallest id, with all its columns."""
    mark, id_, mark_ = fresh("mark"), fresh("id"), fresh("mark")
    stamp = F.xxhash64(doc_id, text)
    texts = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), stamp.alias("mark"))
    marked = stored(sketches(texts).select("doc_id", "mark", "sketch"), "sketches")
    grouped = stored(group(texts, marked).select("doc_id", "mark", "name", "root"), "groups")
    # The smallest id (a missing one last), then any of its rows.
    rank = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "name", "mark")
    first = stored(grouped.groupBy(F.col("root").alias("root_")).agg(F.min(rank).alias("first")), "firsts")
    losers = grouped.join(first, F.col("root") == F.col("root_")).where(~(rank == F.col("first"))).select(F.col("doc_id").alias(id_), F.col("mark").alias(mark_)).distinct()
    kept = docs.withColumn(mark, stamp).join(losers, F.col(doc_id).eqNullSafe(F.col(id_)) & (F.col(mark) == F.col(mark_)), "left_anti")
    if not marked.groupBy("doc_id", "mark").count().where("count > 1").isEmpty():
        kept = kept.dropDuplicates([doc_id, mark])
    return kept.select(*docs.columns)
