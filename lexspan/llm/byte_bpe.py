"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

A pre-token starts as a linked list of single bytes. Every neighbouring pair whose
joined bytes are a token has that token's rank; the position of its left node lies
in the bucket of that rank. A bitmap of two levels says which buckets hold anything:
words of 256 buckets, and one word of those words. So two find-first-set steps give
the lowest rank, whatever the length of the pre-token. An entry whose pair has changed meanwhile is stale and is
skipped when it comes up. Within a bucket the leftmost position comes first, which is
the order that byte-pair merging asks for.

Cases: a null text encodes to no ids, as an empty one does; null ids decode to null;
an id outside the vocabulary decodes to U+FFFD. A column that has the name of the
output is replaced. Rows are independent, so repeated rows, missing ids and extra
columns need no care, and nothing is shuffled.
"""

import base64
import re
from array import array
from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType

#: Pre-tokens of which a worker remembers the ids: this many recent ones, twice at most.
REMEMBERED = 250_000
#: Longer pre-tokens (in characters) are rare and not worth remembering.
LONGEST_REMEMBERED = 48
#: Texts whose characters all lie below this one (Latin letters) take the quicker engine.
NARROW = 0x250
UNKNOWN = "�".encode()


def read_ranks(data: bytes) -> dict[bytes, int]:
    """Ranks of a file with lines of a base64 token, a blank and its rank."""
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, data.splitlines()) if token}


class Merger:
    """Merges one pre-token at a time; the queue's words are empty between calls."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        words = (max(ranks.values(), default=0) >> 8) + 1
        self.leaf = [0] * words
        self.bits = tuple(1 << i for i in range(max(256, words)))

    def ids(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        rank_of, leaf, bits = self.ranks.get, self.leaf, self.bits
        size, top, buckets = len(piece), 0, {}
        after = list(range(1, size + 1))
        before = list(range(-1, size - 1))
        pair = [rank_of(piece[i : i + 2]) for i in range(size - 1)]
        pair.append(None)
        for at, rank in enumerate(pair):
            if rank is None:
                continue
            if rank in buckets:
                buckets[rank].append(at)
            else:
                buckets[rank] = [at]
                leaf[rank >> 8] |= bits[rank & 255]
                top |= bits[rank >> 8]
        while top:
            high = (top & -top).bit_length() - 1
            word = leaf[high]
            low = word & -word
            rank = high << 8 | low.bit_length() - 1
            bucket = buckets[rank]
            if len(bucket) > 1:
                at = heappop(bucket)
            else:
                at = bucket[0]
                del buckets[rank]
                leaf[high] = word = word ^ low
                if not word:
                    top ^= bits[high]
            if pair[at] != rank:
                continue
            gone = after[at]
            after[at] = end = after[gone]
            pair[gone] = None
            if end < size:
                before[end] = at
                pair[at] = fresh = rank_of(piece[at : after[end]])
                if fresh is not None:
                    if fresh in buckets:
                        heappush(buckets[fresh], at)
                    else:
                        buckets[fresh] = [at]
                        leaf[fresh >> 8] |= bits[fresh & 255]
                        top |= bits[fresh >> 8]
            else:
                pair[at] = None
            if at:
                at = before[at]
                pair[at] = fresh = rank_of(piece[at:end])
                if fresh is not None:
                    if fresh in buckets:
                        heappush(buckets[fresh], at)
                    else:
                        buckets[fresh] = [at]
                        leaf[fresh >> 8] |= bits[fresh & 255]
                        top |= bits[fresh >> 8]
        out, at = [], 0
        while at < size:
            end = after[at]
            out.append(self.ranks[piece[at:end]])
            at = end
        return out


class Remembered(dict):
    """Packed ids by pre-token, kept in two generations so that memory stays bounded."""

    def __init__(self, ranks: dict[bytes, int], limit: int = REMEMBERED):
        super().__init__()
        self.merger, self.limit, self.older = Merger(ranks), limit, {}

    def __missing__(self, piece: str) -> bytes:
        packed = self.older.get(piece)
        if packed is None:
            packed = array("i", self.merger.ids(piece.encode())).tobytes()
        if len(piece) <= LONGEST_REMEMBERED:
            if len(self) >= self.limit:
                self.older = dict(self)
                self.clear()
            self[piece] = packed
        return packed


def narrow(pattern: str) -> str | None:
    """`pattern` with its Unicode classes spelled out for texts below U+0250, else None.

    The standard library's engine then gives the same matches in half the time.
    """
    import regex

    def members(name: str) -> str:
        inside = [c for c in range(NARROW) if regex.fullmatch(name, chr(c))]
        return "".join(f"\\u{c:04x}" for c in inside)

    out, depth = [], 0
    for part in re.findall(r"\\p\{\w+\}|\\.|.", pattern, re.DOTALL):
        if part in ("[", "]"):
            depth += 1 if part == "[" else -1
            out.append(part)
        elif part == "\\S":
            if depth:
                return None
            out.append(f"[^{members(chr(92) + 's')}]")
        elif part == "\\s" or part.startswith("\\p{"):
            out.append(members(part) if depth else f"[{members(part)}]")
        elif part.startswith("\\"):
            return None
        else:
            out.append(part)
    return "".join(out)


def splitter(pattern: str):
    """A function from a text to its pre-tokens."""
    import regex

    wide = regex.compile(pattern).findall
    plain = narrow(pattern)
    if plain is None:
        return wide
    quick, beyond = re.compile(plain).findall, re.compile(f"[^\0-{chr(NARROW - 1)}]").search
    return lambda text: wide(text) if beyond(text) else quick(text)


_READY: dict = {}


def _tables(shared, kind: str):
    """What a worker builds once from the shared bytes of a vocabulary file."""
    key = (kind, hash(shared.value))
    if key not in _READY:
        ranks = read_ranks(shared.value)
        _READY[key] = Remembered(ranks) if kind == "encode" else {rank: token for token, rank in ranks.items()}
    return _READY[key]


def _share(spark, ranks_file: bytes):
    """The vocabulary file, whose size the tokenizer fixes (under 1 MB), for every worker."""
    return spark.sparkContext.broadcast(ranks_file)


def encode(df: DataFrame, ranks_file: bytes, pattern: str, text: str = "text", out: str = "ids") -> DataFrame:
    """Add `out`, the ids of each whole text; each match of `pattern` is merged by itself."""
    shared = _share(df.sparkSession, ranks_file)

    @F.arrow_udf(ArrayType(IntegerType()))
    def ids_of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        pieces, known = splitter(pattern), _tables(shared, "encode").__getitem__
        for texts in batches:
            packed = [b"".join(map(known, pieces(one.as_py() or ""))) for one in texts]
            offsets = np.zeros(len(packed) + 1, dtype=np.int64)
            np.cumsum([len(one) // 4 for one in packed], out=offsets[1:])
            yield pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(np.frombuffer(b"".join(packed), dtype="<i4")))

    return df.withColumn(out, ids_of(F.col(text)))


def decode(df: DataFrame, ranks_file: bytes, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Add `out`, the bytes of each list of ids."""
    shared = _share(df.sparkSession, ranks_file)

    @F.arrow_udf(BinaryType())
    def bytes_of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        token = _tables(shared, "decode")
        for lists in batches:
            yield pa.array((None if one.values is None else _joined(one.values, token) for one in lists), type=pa.binary())

    return df.withColumn(out, bytes_of(F.col(ids)))


def _joined(ids: pa.Array, token: dict[int, bytes]) -> bytes:
    known = ids.to_numpy(zero_copy_only=False).tolist()
    try:
        return b"".join(map(token.__getitem__, known))
    except KeyError:
        return b"".join([token.get(one, UNKNOWN) for one in known])
