"""Language identification with bit-sliced Bloom filters of character n-grams.

One Bloom filter is kept for each language, all with the same hash functions, and they
are stored side by side: a slot holds a word with one bit for each language. The AND of
an n-gram's slots is the set of all languages whose filter has it. Over a text the bits
are counted for each language; with N n-grams and a filter that errs with probability
f, N f of the hits are expected by chance, so (hits - N f) / (1 - f) are the language's
own. The language with most of them is the answer; its share of all is the score.

A filter gets the n-grams that are frequent in its language, and nowhere four times as
frequent. They are counted over a bounded sample of labelled texts of each language.

Cases: a null text, or one without a letter, is `und` with score 0; one whose n-grams
no filter has gets the first language by name with score 0; ties go to the first by
name; texts of any length are read whole, a piece at a time; training rows without text
or language are left out; without any training rows every answer is `und`. An empty
table gives no rows; columns named like the results are replaced.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexspan.llm.scratch import fresh, stored

UNDETERMINED = "und"
#: Labelled texts of one language that are counted, about; a hash of the id picks them.
SAMPLE = 4_000
#: Least share of a language's n-grams that one must have to enter its filter, which so
#: holds 10,000 at most.
LEAST = 1e-4
SIZES = (2, 3, 4)
#: Slots of the filters, and slots that an n-gram sets.
SLOTS_BITS = 16
HASHES = 4
#: Characters hashed at a time.
PIECE = 1 << 20


def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)


_ALPHA: list[np.ndarray] = []


def gram_hashes(text: str) -> Iterator[np.ndarray]:
    """64-bit hashes of the n-grams of a text, letters in lower case, all else as one mark."""
    if not _ALPHA:
        _ALPHA.append(_letters())
    tail = np.zeros(0, dtype=np.uint64)
    for at in range(0, max(len(text), 1), PIECE):
        # A mark before the first letter and behind the last; what the last piece ended with goes before this one.
        piece = " " * (at == 0) + text[at : at + PIECE].lower() + " " * (at + PIECE >= len(text))
        codes = np.concatenate([tail, np.frombuffer(piece.encode("utf-32-le", "replace"), dtype="<u4").astype(np.uint64)])
        inside = _ALPHA[0][codes.astype(np.int64)]
        codes[~inside] = 0
        before, all_codes, all_inside = len(tail), codes, inside
        tail = codes[-(max(SIZES) - 1) :]
        for size in SIZES:
            # Only n-grams that end in this piece.
            start = max(0, before - size + 1)
            codes, inside = all_codes[start:], all_inside[start:]
            count = len(codes) - size + 1
            if count <= 0:
                continue
            mixed = np.full(count, size, dtype=np.uint64)
            whole = np.zeros(count, dtype=np.int8)
            for k in range(size):
                mixed = (mixed * np.uint64(0x100000001B3)) ^ codes[k : k + count]
                mixed *= np.uint64(0x9E3779B97F4A7C15)
                whole += inside[k : k + count]
            # Letters only, or with one mark at an end: never across two words.
            ends = inside[:count].astype(np.int8) + inside[size - 1 : size - 1 + count]
            kept = (whole == size) | ((whole == size - 1) & (ends == 1))
            mixed = mixed[kept]
            mixed ^= mixed >> np.uint64(31)
            mixed *= np.uint64(0xBF58476D1CE4E5B9)
            yield mixed ^ (mixed >> np.uint64(29))


def slots_of(hashes: np.ndarray) -> list[np.ndarray]:
    mask = np.uint64((1 << SLOTS_BITS) - 1)
    return [(hashes >> np.uint64(k * SLOTS_BITS)) & mask for k in range(HASHES)]


@dataclass
class Filters:
    """Languages in order of name, and the slots: one 64-bit word for each 64 languages."""

    languages: list[str]
    slots: np.ndarray

    @classmethod
    def build(cls, grams: dict[str, np.ndarray]) -> "Filters":
        languages = sorted(grams)
        slots = np.zeros((-(-max(len(languages), 1) // 64), 1 << SLOTS_BITS), dtype=np.uint64)
        for i, language in enumerate(languages):
            for where in slots_of(grams[language]):
                slots[i // 64, where.astype(np.int64)] |= np.uint64(1 << i % 64)
        return cls(languages, slots)

    def chance(self) -> np.ndarray:
        """Of each filter, the probability that it has an n-gram that was never put in."""
        full = [np.count_nonzero(self.slots[i // 64] >> np.uint64(i % 64) & np.uint64(1)) for i in range(len(self.languages))]
        return (np.array(full, dtype=np.float64) / self.slots.shape[1]) ** HASHES

    def judge(self, text: str | None, chance: np.ndarray) -> tuple[str, float]:
        return self.weigh(text, chance)[:2]

    def weigh(self, text: str | None, chance: np.ndarray) -> tuple[str, float, float, float]:
        """Language, its share of all hits, its hits per n-gram, and its lead over the second (0 to 1)."""
        hits, count = np.zeros(len(self.languages), dtype=np.int64), 0
        for hashes in gram_hashes(text or ""):
            count += len(hashes)
            places = [where.astype(np.int64) for where in slots_of(hashes)]
            for word in range(len(self.slots)):
                found = self.slots[word][places[0]]
                for where in places[1:]:
                    found &= self.slots[word][where]
                for i in range(word * 64, min(len(self.languages), word * 64 + 64)):
                    hits[i] += np.count_nonzero(found & np.uint64(1 << i % 64))
        if not count or not self.languages:
            return UNDETERMINED, 0.0, 0.0, 0.0
        own = np.maximum(hits - count * chance, 0) / (1 - np.minimum(chance, 0.999))
        best = int(np.argmax(own))
        if own[best] <= 0:
            return self.languages[best], 0.0, 0.0, 0.0
        second = max(np.delete(own, best), default=0.0)
        return self.languages[best], float(own[best] / own.sum()), float(min(own[best] / count, 1.0)), float((own[best] - second) / own[best])


def train(df: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> Filters:
    """Filters learnt from the rows of `df` that have a text and a language."""
    labelled = df.where(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(F.col(doc_id).alias("id"), F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"))
    # One row for each language.
    sizes = {row.lang: row.n for row in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    share = F.lit(0)
    for language, n in sizes.items():
        share = F.when(F.col("lang") == language, F.lit(min(1 << 20, SAMPLE * (1 << 20) // n + 1))).otherwise(share)
    spot = F.pmod(F.xxhash64(F.col("id").cast("string"), F.lit("langid")), F.lit(1 << 20))
    picked = labelled.where(spot < share).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                some = batch.slice(at, 512)
                hashes: dict[str, list] = {}
                for language, one in zip(some.column(0).to_pylist(), some.column(1), strict=True):
                    hashes.setdefault(language, []).extend(gram_hashes(one.as_py()))
                for language, lists in hashes.items():
                    values, times = np.unique(np.concatenate(lists), return_counts=True)
                    yield pa.RecordBatch.from_pydict({"lang": [language] * len(values), "gram": pa.array(values.view(np.int64)), "n": pa.array(times.astype(np.int64))})

    counts = stored(picked.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")), "grams")
    total = F.lit(1)
    for row in counts.groupBy("lang").agg(F.sum("n").alias("n")).collect():
        total = F.when(F.col("lang") == row.lang, F.lit(row.n)).otherwise(total)
    rates = counts.withColumn("rate", F.col("n") / total).where(F.col("rate") >= LEAST / 4)
    strong = rates.withColumn("most", F.max("rate").over(Window.partitionBy("gram"))).where((F.col("rate") >= LEAST) & (F.col("rate") * 4 >= F.col("most")))
    # At most 1 / LEAST rows for each language.
    rows = strong.select("lang", "gram").collect()
    grams: dict[str, list[int]] = {language: [] for language in sizes}
    for row in rows:
        grams[row.lang].append(row.gram)
    return Filters.build({language: np.array(values, dtype=np.int64).view(np.uint64) for language, values in grams.items()})


def predict(df: DataFrame, filters: Filters, text: str = "text", out: str = "lang_pred", score: str = "score",
            rate: str | None = None, lead: str | None = None) -> DataFrame:
    """Add the language of each whole text and its score; nothing but the text is read.

    On request also its hits per n-gram, corrected for chance (`rate`), and by what part of
    them the second language has less (`lead`); neither hangs on the number of languages.
    """
    shared = df.sparkSession.sparkContext.broadcast(filters)  # half a MB for each 64 languages

    @F.arrow_udf("struct<lang: string, score: double, rate: double, lead: double>")
    def judged(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known = shared.value
        chance = known.chance()
        for texts in batches:
            found = [known.weigh(one.as_py(), chance) for one in texts]
            kinds = (pa.string(), pa.float64(), pa.float64(), pa.float64())
            columns = [pa.array([row[i] for row in found], kind) for i, kind in enumerate(kinds)]
            yield pa.StructArray.from_arrays(columns, names=["lang", "score", "rate", "lead"])

    told = fresh("judged")
    wanted = {out: "lang", score: "score", rate: "rate", lead: "lead"}
    return df.withColumn(told, judged(F.col(text))).withColumns(
        {name: F.col(f"{told}.{part}") for name, part in wanted.items() if name}).drop(told)
