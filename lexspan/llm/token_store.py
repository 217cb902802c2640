"""Token-id files: bit-plane shuffling with zstandard, written and read in parallel.

A file holds the ids of consecutive documents. Its ids are cut into blocks of a fixed
number of ids; each block is transposed into planes (one for each byte or for each bit
of an id), and every plane is compressed by itself: planes of high bits are nearly
constant and shrink to nothing. A footer holds the chunk index (place, ids and plane
sizes of each block) and the documents' ids and lengths, so a reader can fetch any
block by itself.

Documents are dealt to tasks by ranges of their id, and a task closes a file and opens
the next one when it holds ROLL ids or ROLL_DOCS documents, so the files, in the order
of their part and turn, hold all documents in ascending order and none grows with the
input. A task names its files anew at each attempt, and only files that the manifest
lists are read: a lost executor leaves at most files that nobody reads. A reader fetches
the footer and then one block after another by their places, never a whole file.

Cases: a null text has no ids but the end id; a missing document id sorts first;
repeated rows are documents of their own (equal ids by a hash of the text); an empty
table gives no file and no rows; other columns are not stored.
"""

import io
import json
import re
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexspan.llm.byte_bpe import NARROW, narrow

MAGIC = b"LXPLANE1"
#: Ids in a block; a block is what a reader fetches and unpacks at once.
BLOCK = 1 << 16
#: Pre-tokens of which a worker remembers the ids, twice at most.
REMEMBERED = 500_000
LONGEST_REMEMBERED = 48
#: Fresh pre-tokens encoded in one text.
TOGETHER = 256
#: Ids and documents after which a file is closed.
ROLL, ROLL_DOCS = 1 << 26, 1 << 20


# Planes -----------------------------------------------------------------------------
def to_planes(ids: np.ndarray, kind: str = "byte") -> list[bytes]:
    """The planes of one block of ids, lowest first; planes above the highest set are left out."""
    ids = np.ascontiguousarray(ids, dtype="<u4")
    bits = int(ids.max()).bit_length() if len(ids) else 0
    if kind == "byte":
        return [ids.view(np.uint8).reshape(-1, 4)[:, k].tobytes() for k in range((bits + 7) // 8)]
    return [np.packbits((ids >> k & 1).astype(np.uint8)).tobytes() for k in range(bits)]


def from_planes(planes: list[bytes], count: int, kind: str = "byte") -> np.ndarray:
    """The ids of one block."""
    ids = np.zeros(count, dtype="<u4")
    for k, plane in enumerate(planes):
        raw = np.frombuffer(plane, dtype=np.uint8)
        if kind == "byte":
            ids |= raw.astype("<u4") << np.uint32(8 * k)
        else:
            ids |= np.unpackbits(raw, count=count).astype("<u4") << np.uint32(k)
    return ids


class FileWriter:
    """Writes one file, a block at a time."""

    def __init__(self, sink, kind: str = "byte", block: int = BLOCK, level: int = 1):
        import zstandard

        self.sink, self.kind, self.block = sink, kind, block
        self.pack = zstandard.ZstdCompressor(level=level).compress
        self.waiting: list[np.ndarray] = []
        self.held = self.ids = 0
        self.at = len(MAGIC)
        self.index: list[list] = []
        self.docs: list[int | None] = []
        self.counts: list[int] = []
        sink.write(MAGIC)

    def add(self, doc_ids: list[int | None], counts: list[int], ids: np.ndarray) -> None:
        """Append documents, of which `ids` are the ids one after another."""
        self.docs += doc_ids
        self.counts += counts
        self.ids += len(ids)
        self.waiting.append(ids)
        self.held += len(ids)
        if self.held >= self.block:
            whole = np.concatenate(self.waiting)
            full = len(whole) // self.block * self.block
            for at in range(0, full, self.block):
                self._chunk(whole[at : at + self.block])
            self.waiting, self.held = [whole[full:].copy()], len(whole) - full

    def _chunk(self, ids: np.ndarray) -> None:
        planes = [self.pack(plane) for plane in to_planes(ids, self.kind)]
        self.index.append([self.at, len(ids), [len(plane) for plane in planes]])
        for plane in planes:
            self.sink.write(plane)
            self.at += len(plane)

    def close(self) -> None:
        if self.held:
            self._chunk(np.concatenate(self.waiting))
        missing = [i for i, one in enumerate(self.docs) if one is None]
        docs = self.pack(np.array([one or 0 for one in self.docs], dtype="<i8").tobytes())
        counts = self.pack(np.array(self.counts, dtype="<u4").tobytes())
        footer = self.pack(json.dumps({"kind": self.kind, "block": self.block, "chunks": self.index, "docs": len(docs), "counts": len(counts), "missing": missing}).encode())
        self.sink.write(docs + counts + footer + struct.pack("<I", len(footer)) + MAGIC)


def open_ranged(source) -> tuple[dict, list[int | None], np.ndarray]:
    """Footer, document ids and counts of an open file, read from its end."""
    import zstandard

    unpack = zstandard.ZstdDecompressor().decompress
    source.seek(0)
    first = source.read(len(MAGIC))
    size = source.seek(0, 2)
    tail = len(MAGIC) + 4
    if first != MAGIC or size < len(MAGIC) + tail:
        raise ValueError("not a whole token file")
    source.seek(size - tail)
    last = source.read(tail)
    if last[4:] != MAGIC:
        raise ValueError("not a whole token file")
    length = struct.unpack("<I", last[:4])[0]
    source.seek(size - tail - length)
    footer = json.loads(unpack(source.read(length)))
    source.seek(size - tail - length - footer["counts"] - footer["docs"])
    docs: list = np.frombuffer(unpack(source.read(footer["docs"])), dtype="<i8").tolist()
    counts = np.frombuffer(unpack(source.read(footer["counts"])), dtype="<u4")
    for i in footer["missing"]:
        docs[i] = None
    return footer, docs, counts


def read_ranged(source, footer: dict, k: int) -> np.ndarray:
    """The ids of block `k` of an open file, found by the chunk index."""
    import zstandard

    unpack = zstandard.ZstdDecompressor().decompress
    at, count, sizes = footer["chunks"][k]
    source.seek(at)
    return from_planes([unpack(source.read(size)) for size in sizes], count, footer["kind"])


def open_file(data: bytes) -> tuple[dict, list[int | None], np.ndarray]:
    """Footer, document ids and counts of a file's bytes."""
    return open_ranged(io.BytesIO(data))


def read_chunk(data: bytes, footer: dict, k: int) -> np.ndarray:
    """The ids of block `k` of a file's bytes."""
    return read_ranged(io.BytesIO(data), footer, k)


# Tokenizing -------------------------------------------------------------------------
class Pieces(dict):
    """Packed ids by stretch between white space, as the tokenizer gives them, in two bounded generations.

    Only for tokenizers that normalise to lower case, split by a pattern and drop white
    space; `split_pattern` knows them. No pre-token reaches across white space and the
    pattern looks at nothing beside its match, so texts of Latin letters, which need no
    other normalisation, are cut at white space, and each stretch is cut into pre-tokens
    and encoded once. Fresh pre-tokens are encoded many in one text; where each begins
    is told by the suffix of its last token. Any other text, and one with a special token
    where these count, goes to the tokenizer whole.
    """

    def __init__(self, tokenizer, pattern: str, suffix: str | None = None, special: tuple[str, ...] = (), limit: int = REMEMBERED):
        super().__init__()
        self.tokenizer, self.limit, self.older = tokenizer, limit, {}
        self.split = re.compile(narrow(pattern)).findall
        # str.split() takes four control characters for white space that the pattern doesn't.
        self.odd = re.compile(f"[\x1c-\x1f{chr(NARROW)}-\U0010ffff]").search
        self.special = tuple(one.lower() for one in special)
        # Whether a stretch of letters is always one pre-token.
        every = "".join(c for c in map(chr, range(NARROW)) if c.isalpha())
        self.letters = self.split(every) == [every]
        self.last = None
        if suffix:
            self.last = np.zeros(max(tokenizer.get_vocab().values()) + 1, dtype=bool)
            self.last[[at for token, at in tokenizer.get_vocab().items() if token.endswith(suffix)]] = True

    def __missing__(self, stretch: str) -> bytes:
        return self._keep(stretch, self.older[stretch] if stretch in self.older else self._whole(stretch))

    def _keep(self, stretch: str, packed: bytes) -> bytes:
        if len(stretch) <= LONGEST_REMEMBERED:
            if len(self) >= self.limit:
                self.older = dict(self)
                self.clear()
            self[stretch] = packed
        return packed

    def beyond(self, text: str) -> bool:
        """Whether a text, in lower case, goes to the tokenizer whole."""
        return self.odd(text) is not None or any(one in text for one in self.special)

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _encoded(self, pieces: list[str]) -> list[bytes]:
        if self.last is not None:
            joined = [" ".join(pieces[at : at + TOGETHER]) for at in range(0, len(pieces), TOGETHER)]
            found = self.tokenizer.encode_batch_fast(joined, add_special_tokens=False)
            ids = np.concatenate([np.array(one.ids, dtype="<u4") for one in found]) if found else np.empty(0, "<u4")
            ends = (np.flatnonzero(self.last[ids]) + 1) * 4
            if len(ends) == len(pieces):
                raw, ends = ids.tobytes(), ends.tolist()
                return [raw[a:b] for a, b in zip([0, *ends], ends)]
        return [array("I", one.ids).tobytes() for one in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]

    def _learn(self, fresh: list[str]) -> dict[str, bytes]:
        cut = {stretch: self.split(stretch) for stretch in fresh if not (self.letters and stretch.isalpha())}
        words = fresh if not cut else [one for one in fresh if one not in cut]
        pieces = words + [one for one in set().union(*cut.values()).difference(words) if one not in self and one not in self.older]
        got = dict(zip(pieces, self._encoded(pieces), strict=True))
        for stretch, own in cut.items():
            if stretch not in got:
                got[stretch] = b"".join([got.get(one) or self[one] for one in own])
        if len(self) + len(got) > self.limit:
            for stretch, packed in got.items():
                self._keep(stretch, packed)
        else:
            self.update({stretch: packed for stretch, packed in got.items() if len(stretch) <= LONGEST_REMEMBERED})
        return got

    def ids(self, texts: list[str]) -> list[bytes]:
        lowered = [text.lower() for text in texts]
        parts = [None if self.beyond(text) else text.split() for text in lowered]
        fresh = [one for one in set().union(*filter(None, parts)) if one not in self and one not in self.older]
        got = self._learn(fresh) if fresh else {}
        known = self.__getitem__
        if len(got) > self.limit // 2:
            known = lambda one: got.get(one) or self[one]  # noqa: E731  the generations may have turned over
        return [self._whole(text) if own is None else b"".join(map(known, own)) for text, own in zip(texts, parts, strict=True)]


def split_pattern(tokenizer_json: str) -> str | None:
    """The pattern of a tokenizer that lower-cases, splits by it and drops what lies between."""
    whole = json.loads(tokenizer_json)
    steps = [one.get("type") for one in (whole.get("normalizer") or {}).get("normalizers", [])]
    first = ((whole.get("pre_tokenizer") or {}).get("pretokenizers") or [{}])[0]
    if steps != ["NFC", "Replace", "Lowercase"] or first.get("type") != "Split" or first.get("behavior") != "Removed" or not first.get("invert"):
        return None
    pattern = (first.get("pattern") or {}).get("Regex", "")
    return pattern if r"[^\s" in pattern and narrow(pattern) else None


_READY: dict = {}


def _tokenizer(tokenizer_json: str, special: bool):
    """A function from texts to their packed ids, built once in a worker."""
    key = hash((tokenizer_json, special))
    if key not in _READY:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark deals out the cores
        from tokenizers import Tokenizer

        own, pattern, described = Tokenizer.from_str(tokenizer_json), split_pattern(tokenizer_json), json.loads(tokenizer_json)
        own.encode_special_tokens = not special
        added = tuple(one["content"] for one in described.get("added_tokens") or [] if special or not one.get("special"))
        if pattern is not None:
            _READY[key] = Pieces(own, pattern, described["model"].get("end_of_word_suffix"), added).ids
        else:
            _READY[key] = lambda texts: [array("I", one.ids).tobytes() for one in own.encode_batch_fast(texts, add_special_tokens=False)]
    return _READY[key]


# Spark ------------------------------------------------------------------------------
def write(df: DataFrame, folder: str, tokenizer_json: str, end_id: int, doc_id: str = "doc_id", text: str = "text", kind: str = "byte", special_tokens: bool = False) -> DataFrame:
    """Encode whole texts and write them in ascending document order; returns the manifest.

    `folder` is a place that all executors share. The manifest has a row for each file:
    part, turn, path, docs, ids. A special token's string in a text is ordinary text, or
    that token if `special_tokens` says so, as the library does unless told otherwise.
    """
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast(tokenizer_json)  # fixed by the tokenizer, a few MB
    ordered = (
        df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
        .withColumn("mark", F.xxhash64("text"))
        .repartitionByRange("doc_id", "mark")
        .sortWithinPartitions("doc_id", "mark")
    )
    roll, roll_docs = ROLL, ROLL_DOCS

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = _tokenizer(shared.value, special_tokens), np.array([end_id], dtype="<u4").tobytes()
        part, turn, path, sink, writer = TaskContext.get().partitionId(), 0, "", None, None

        def closed() -> pa.RecordBatch:
            writer.close()
            sink.close()
            numbers = {"part": part, "turn": turn, "docs": len(writer.docs), "ids": writer.ids}
            return pa.RecordBatch.from_pydict({name: pa.array([value], pa.int64()) for name, value in numbers.items()} | {"path": [path]})

        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                if writer is None:
                    path = f"{folder}/part-{part:06d}-{turn:04d}-{uuid.uuid4().hex}.planes"
                    system, place = fs.FileSystem.from_uri(path)
                    system.create_dir(place.rsplit("/", 1)[0], recursive=True)
                    sink = system.open_output_stream(place)
                    writer = FileWriter(sink, kind)
                some = batch.slice(at, 500)
                packed = [one + end for one in encode([text or "" for text in some.column(1).to_pylist()])]
                writer.add(some.column(0).to_pylist(), [len(one) // 4 for one in packed], np.frombuffer(b"".join(packed), dtype="<u4"))
                if writer.ids >= roll or len(writer.docs) >= roll_docs:
                    yield closed()
                    writer, turn = None, turn + 1
        if writer is not None:
            yield closed()

    manifest = ordered.mapInArrow(store, "part long, turn long, docs long, ids long, path string")
    manifest.write.mode("overwrite").parquet(f"{folder}/manifest")
    return spark.read.parquet(f"{folder}/manifest")


def read(spark: SparkSession, folder: str) -> DataFrame:
    """Documents of a folder: doc_id, start (ids before it), n_tokens, ids (packed, 32 bits each, low byte first)."""
    # One row for each file, of which there are as many as the writer had tasks, or ids / ROLL.
    files = sorted(tuple(row) for row in spark.read.parquet(f"{folder}/manifest").select("part", "turn", "path", "ids").collect())
    schema = "doc_id long, start long, n_tokens long, ids binary"
    if not files:
        return spark.createDataFrame([], schema)
    rows, before = [], 0
    for _, _, path, ids in files:
        rows.append((path, before))
        before += ids

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(*(column.to_pylist() for column in batch.columns), strict=True):
                system, place = fs.FileSystem.from_uri(path)
                with system.open_input_file(place) as source:
                    yield from _documents(source, start)

    return spark.createDataFrame(rows, "path string, start long").repartition(len(rows)).mapInArrow(load, schema)


def _documents(source, start: int) -> Iterator[pa.RecordBatch]:
    """The documents of an open file, some blocks at a time; `start` is the ids before the file."""
    footer, docs, counts = open_ranged(source)
    at, k, held = 0, 0, np.zeros(0, dtype="<u4")
    while at < len(docs):
        upto, need = at, 0
        while upto < len(docs) and (need < BLOCK or upto == at):
            need += int(counts[upto])
            upto += 1
        more, have = [held], len(held)
        while have < need:
            more.append(read_ranged(source, footer, k))
            have += len(more[-1])
            k += 1
        whole = np.concatenate(more)
        sizes = counts[at:upto].astype(np.int64)
        ends = np.cumsum(sizes)
        some = whole[:need]
        yield pa.RecordBatch.from_pydict({
            "doc_id": pa.array(docs[at:upto], pa.int64()),
            "start": pa.array(start + ends - sizes, pa.int64()),
            "n_tokens": pa.array(sizes, pa.int64()),
            "ids": pa.array([some[e - n : e].tobytes() for e, n in zip(ends.tolist(), sizes.tolist(), strict=True)], pa.binary()),
        })
        held, start, at = whole[need:], start + need, upto


def checksum(ids: bytes) -> int:
    """Unsigned crc32 of packed ids, for checks outside Spark."""
    return zlib.crc32(ids) & 0xFFFFFFFF
