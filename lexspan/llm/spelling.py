"""Spelling variants by Bloom-guided neighbourhoods.

Words are counted per document in Arrow batches (a document's distinct runs, so its
repeated ones cost nothing) and added up in a shuffle, each task's counts combined first.

Two words are near if one inserted, deleted or replaced code point turns one into the
other. Every word of the vocabulary generates its deletions and replacements; an
insertion is the other word's deletion. Each edit is probed against a blocked Bloom
filter of the words of its length: one 64-bit block, BITS bits in it. Only edits that
the filter lets through become rows, and those are shuffled to an exact join with the
vocabulary, which removes the false ones. An edit's hash follows from its word's hash
by arithmetic, so edits that the filter stops are never spelled out.

Filters are broadcast. One holds WORDS_PER_FILTER words at most, 32 bits each: 32 MB. A
larger vocabulary is cut by hash into as many filters, probed one after another, each
by all words; no edit is dropped, and no broadcast is larger.

A word has a bounded number of near words (its length times the letters in use), so no
key of the joins grows with the input. Forms grow five times from step to step, so the
chain from a word to its root is short; roots are found by doubling steps.

Cases: a null text has no words; a missing id is written as `null` where ids are hashed;
very long texts are cut into runs one at a time; words of equal counts go by code-point
order; repeated rows count again; an empty table gives no rows; other columns are not
read.
"""

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexspan.llm.scratch import stored

RUN = re.compile("[a-zÀ-ÿ]+")
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: One run in so many loses a code point.
EDITED = 199
LENGTH, OCCURRENCES, TIMES = 6, 5, 5
#: Characters from which a text is cut one run at a time, and words a task counts before it passes them on.
LONG_TEXT, HELD = 1 << 20, 1 << 17
#: Filters: bits set for a word, words for each 64-bit block, words in a filter.
BITS, LOAD, WORDS_PER_FILTER = 6, 2, 1 << 23
#: Edits probed at a time.
AT_ONCE = 1 << 19
_DRAW = np.random.default_rng(7)
#: A random number for each letter of the first 256 code points, and powers of an odd number and of its inverse.
_LETTER = _DRAW.integers(1, 1 << 63, 256, dtype=np.uint64)
_STEP = int(_DRAW.integers(1 << 62, 1 << 63)) | 1
_BACK = np.uint64(pow(_STEP, -1, 1 << 64))


# Words ------------------------------------------------------------------------------
def runs_of(text: str) -> Counter:
    """Runs of letters of a text, only A to Z in lower case, and how often they occur."""
    lowered = text.lower() if text.isascii() else text.encode().translate(LOWER).decode()
    return Counter(RUN.findall(lowered) if len(lowered) < LONG_TEXT else (m.group() for m in RUN.finditer(lowered)))


def edited(run: str, before: int) -> str:
    """The run, or the run without a code point; `before` is the crc32 of what precedes it."""
    h = zlib.crc32(run.encode(), before)
    if h % EDITED:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def words(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, occurrences: int = OCCURRENCES) -> DataFrame:
    """Columns word, n: the vocabulary."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, int] = {}

        def out() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_pydict({"word": pa.array(list(held), pa.string()), "n": pa.array(list(held.values()), pa.int64())})
            held.clear()
            return batch

        for batch in batches:
            for one, whole in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                before = zlib.crc32(f"{'null' if one is None else one}:".encode())
                for run, times in runs_of(whole.as_py() or "").items():
                    if len(run) >= length:
                        word = edited(run, before)
                        if len(word) >= length:
                            held[word] = held.get(word, 0) + times
                if len(held) >= HELD:
                    yield out()
        yield out()

    counted = docs.select(F.col(doc_id).cast("string"), F.col(text).cast("string")).mapInArrow(count, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= occurrences)


# Filters ----------------------------------------------------------------------------
def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def _powers(length: int) -> np.ndarray:
    return np.array([pow(_STEP, i, 1 << 64) for i in range(length)], dtype=np.uint64)


def letters(some: list[str]) -> np.ndarray:
    """Words of one length as rows of code points."""
    return np.frombuffer("".join(some).encode("latin-1"), dtype=np.uint8).reshape(len(some), -1)


def hashes(codes: np.ndarray) -> np.ndarray:
    """Of each word: the sum of its letters' numbers times the powers of the step."""
    return (_LETTER[codes] * _powers(codes.shape[1])).sum(axis=1, dtype=np.uint64)


def _bits(mixed: np.ndarray) -> np.ndarray:
    """The bits of a word within its block."""
    mask = np.zeros(len(mixed), dtype=np.uint64)
    for k in range(BITS):
        mask |= np.uint64(1) << ((mixed >> np.uint64(6 * k)) & np.uint64(63))
    return mask


def _block(mixed: np.ndarray, blocks: int) -> np.ndarray:
    return (mixed >> np.uint64(37)) % np.uint64(blocks)


def _slice(mixed: np.ndarray, slices: int) -> np.ndarray:
    return (mixed * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)) % np.uint64(slices)


def by_length(some: list[str]) -> dict[int, np.ndarray]:
    """Places of the words of each length."""
    sizes = np.array([len(one) for one in some])
    return {int(size): np.flatnonzero(sizes == size) for size in np.unique(sizes)}


def build(vocabulary: DataFrame, sizes: dict[int, int], part: int, slices: int) -> dict[int, np.ndarray]:
    """The filter of one slice: its blocks for each length, or-ed together in a shuffle."""
    blocks = {length: -(-count // (LOAD * slices)) for length, count in sizes.items()}

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            some = batch.column(0).to_pylist()
            for length, places in by_length(some).items():
                mixed = _mixed(hashes(letters([some[i] for i in places])))
                mixed = mixed[_slice(mixed, slices) == part]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(mixed), length)), pa.array(_block(mixed, blocks[length]).astype(np.int64)), pa.array(_bits(mixed).view(np.int64))],
                    names=["length", "block", "bits"],
                )

    rows = vocabulary.select("word").mapInArrow(place, "length long, block long, bits long").groupBy("length", "block").agg(F.bit_or("bits").alias("bits"))
    filters = {length: np.zeros(count, dtype=np.int64) for length, count in blocks.items()}
    # As many rows as the filter has blocks, at most.
    found = rows.toArrow()
    length, block, bits = (found.column(k).to_numpy() for k in range(3))
    for one, its in filters.items():
        mine = length == one
        its[block[mine]] = bits[mine]
    return {one: its.view(np.uint64) for one, its in filters.items()}


def passing(filters: dict[int, np.ndarray], length: int, edits: np.ndarray, part: int, slices: int) -> np.ndarray:
    """Places of the hashes that the filter of `length` lets through."""
    blocks = filters.get(length)
    if blocks is None:
        return np.empty(0, dtype=np.int64)
    flat = _mixed(edits.ravel())
    places = np.arange(len(flat)) if slices == 1 else np.flatnonzero(_slice(flat, slices) == part)
    flat = flat if slices == 1 else flat[places]
    mask = _bits(flat)
    return places[(blocks[_block(flat, len(blocks))] & mask) == mask]


def neighbours(some: list[str], filters: dict[int, np.ndarray], used: np.ndarray, part: int = 0, slices: int = 1) -> Iterator[tuple[str, str]]:
    """(word, edit) for every deletion and replacement that the filters let through."""
    for length, places in by_length(some).items():
        step = max(1, AT_ONCE // (length * len(used)))
        for at in range(0, len(places), step):
            mine = [some[i] for i in places[at : at + step]]
            codes = letters(mine)
            powers = _powers(length)
            terms = _LETTER[codes] * powers
            whole = terms.sum(axis=1, dtype=np.uint64)
            upto = np.cumsum(terms, axis=1, dtype=np.uint64)
            shorter = upto - terms + (whole[:, None] - upto) * _BACK
            for place in passing(filters, length - 1, shorter, part, slices).tolist():
                row, k = divmod(place, length)
                # Of a letter that stands several times in a row, the first is deleted.
                if k == 0 or codes[row, k] != codes[row, k - 1]:
                    yield mine[row], mine[row][:k] + mine[row][k + 1 :]
            rest = whole[:, None] - terms
            replaced = rest[:, :, None] + (_LETTER[used][None, :] * powers[:, None])[None, :, :]
            for place in passing(filters, length, replaced, part, slices).tolist():
                row, k = divmod(place, length * len(used))
                k, letter = divmod(k, len(used))
                if used[letter] != codes[row, k]:
                    yield mine[row], mine[row][:k] + chr(used[letter]) + mine[row][k + 1 :]


# Groups -----------------------------------------------------------------------------
def near(vocabulary: DataFrame) -> DataFrame:
    """Columns word, other, other_n: all near words, in both directions. `vocabulary` is a stored table of word, n."""
    spark = vocabulary.sparkSession
    sizes = {row.size: row["count"] for row in vocabulary.groupBy(F.length("word").alias("size")).count().collect()}
    used = np.array(sorted(ord(row.letter) for row in vocabulary.select(F.explode(F.split("word", "")).alias("letter")).where("letter <> ''").distinct().collect()), dtype=np.uint8)
    slices = max(1, -(-sum(sizes.values()) // WORDS_PER_FILTER))
    found = None
    for part in range(slices):
        shared = spark.sparkContext.broadcast(build(vocabulary, sizes, part, slices))

        def probe(batches: Iterator[pa.RecordBatch], shared=shared, part=part) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                pairs = list(neighbours(batch.column(0).to_pylist(), shared.value, used, part, slices))
                yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in pairs], pa.string()), pa.array([b for _, b in pairs], pa.string())], names=["word", "other"])

        # Dealt anew: probing is the work, and the vocabulary may lie in a few files.
        rows = stored(vocabulary.select("word").repartition("word").mapInArrow(probe, "word string, other string"), "edits")
        found = rows if found is None else found.unionByName(rows)
        shared.unpersist()
    if found is None:
        return spark.createDataFrame([], "word string, other string, other_n long")
    target = vocabulary.select(F.col("word").alias("other_"), F.col("n").alias("other_n"))
    met = found.join(target, F.col("other") == F.col("other_")).drop("other_")
    longer = met.where(F.length("word") > F.length("other")).select(F.col("other").alias("word"), F.col("word").alias("other"))
    source = vocabulary.select(F.col("word").alias("other_"), F.col("n").alias("other_n"))
    return met.unionByName(longer.join(source, F.col("other") == F.col("other_")).drop("other_"))


def roots(forms: DataFrame) -> DataFrame:
    """Columns word, root of the words that have a form: the last form of the chain. `forms` has word, form."""
    chain = stored(forms.select("word", F.col("form").alias("root")), "chain")
    while True:
        on = chain.select(F.col("word").alias("at"), F.col("root").alias("next"))
        further = stored(chain.join(on, F.col("root") == F.col("at"), "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "chain")
        if further.where("moved").isEmpty():
            return further.select("word", "root")
        chain = further.select("word", "root")


def group(vocabulary: DataFrame, times: int = TIMES) -> DataFrame:
    """Columns word, form, root, n, n_near, form_n: a row for each word of a table of word, n."""
    vocabulary = stored(vocabulary.select("word", "n"), "vocabulary")
    best = F.min(F.struct((-F.col("other_n")).alias("less"), F.col("other").alias("other")))
    of = near(vocabulary).groupBy(F.col("word").alias("word_")).agg(F.count("*").alias("n_near"), best.alias("best"))
    form_n = -F.col("best.less")
    picked = vocabulary.join(of, F.col("word") == F.col("word_"), "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
        F.when(form_n >= F.col("n") * times, F.col("best.other")).alias("form"),
        F.when(form_n >= F.col("n") * times, form_n).alias("form_n"),
    )
    picked = stored(picked, "forms")
    last = roots(picked.where("form is not null")).withColumnRenamed("word", "word_")
    return picked.join(last, F.col("word") == F.col("word_"), "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
