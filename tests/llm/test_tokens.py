"""Byte-level BPE and token files against the libraries, on odd texts and table shapes."""

import io
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import regex
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lexspan.llm import byte_bpe, token_store
from lexspan.llm.scratch import fresh_folder

RANKS_FILE = open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb").read()
WORDS_FILE = open(public_tokenizers.path("word_bpe_49k.json")).read()
RANKS = byte_bpe.read_ranks(RANKS_FILE)
LIBRARY = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
BITS = ["a", "B", "aa", " ", "  ", "the", "É", "e", "́", "Σ", "ß", "日", "\U0001f600", "1", "٣", "\n", "\t", "\x1c", "\x85", "\xa0", "'s", "<|endoftext|>", "İ"]
TEXTS = ["", None, "a" * 5000, "word " * 3000, "Ünïcode — text\n\n  x"] + ["".join(random.Random(seed).choices(BITS, k=seed % 40)) for seed in range(300)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i if i != 7 else None, text, "kept") for i, text in enumerate(TEXTS)], "doc_id long, text string, ids string")


def test_merges_are_those_of_the_library():
    pieces = regex.compile(public_tokenizers.PATTERN).findall
    merger, split = byte_bpe.Merger(RANKS), byte_bpe.splitter(public_tokenizers.PATTERN)
    for text in filter(None, TEXTS):
        assert split(text) == pieces(text)
        assert [one for piece in split(text) for one in merger.ids(piece.encode())] == LIBRARY.encode_ordinary(text)


def test_a_lower_rank_may_appear_later():
    ranks = {b"a": 0, b"b": 1, b"c": 2, b"d": 3, b"cd": 6, b"ab": 5, b"abcd": 4}
    assert byte_bpe.Merger(ranks).ids(b"abcdab") == [4, 5]
    assert byte_bpe.Merger({b"a": 0, b"aa": 1, b"aaa": 2}).ids(b"aaaaa") == [1, 2]


def test_memory_of_pieces_is_bounded():
    known = byte_bpe.Remembered(RANKS, limit=3)
    for piece in ("one", "two", "three", "four", "one", "five"):
        assert np.frombuffer(known[piece], "<i4").tolist() == LIBRARY.encode_ordinary(piece)
        assert len(known) <= 3 and len(known.older) <= 3


def test_encode_and_decode(spark, docs):
    both = byte_bpe.decode(byte_bpe.encode(docs, RANKS_FILE, public_tokenizers.PATTERN), RANKS_FILE)
    assert both.columns == ["doc_id", "text", "ids", "decoded"]
    for row in both.collect():
        assert row.ids == LIBRARY.encode_ordinary(row.text or "")
        assert bytes(row.decoded) == (row.text or "").encode()
    assert byte_bpe.encode(docs.limit(0), RANKS_FILE, public_tokenizers.PATTERN).count() == 0
    odd = spark.createDataFrame([(None,), ([0, 99999999],)], "ids array<int>")
    first = {rank: token for token, rank in RANKS.items()}[0]
    assert [row.decoded and bytes(row.decoded) for row in byte_bpe.decode(odd, RANKS_FILE).collect()] == [None, first + byte_bpe.UNKNOWN]


@pytest.mark.parametrize("kind", ["byte", "bit"])
def test_files_give_back_every_block(kind):
    ids = np.random.default_rng(1).integers(0, 1 << 20, 1000).astype("<u4")
    sink = io.BytesIO()
    writer = token_store.FileWriter(sink, kind, block=64)
    writer.add([None, 5], [0, 300], ids[:300])
    writer.add([9], [700], ids[300:])
    writer.close()
    data = sink.getvalue()
    footer, docs, counts = token_store.open_file(data)
    assert docs == [None, 5, 9] and counts.tolist() == [0, 300, 700]
    assert (np.concatenate([token_store.read_chunk(data, footer, k) for k in range(len(footer["chunks"]))]) == ids).all()
    assert (token_store.read_chunk(data, footer, 7) == ids[448:512]).all()
    with pytest.raises(ValueError):
        token_store.open_file(data[:-1])


def test_store_round_trip(spark, docs):
    tokenizer = Tokenizer.from_str(WORDS_FILE)
    tokenizer.encode_special_tokens = True
    twice = docs.unionByName(docs.where("doc_id = 3")).repartition(5)
    folder = fresh_folder(spark, "tokens")
    token_store.write(twice, folder, WORDS_FILE, end_id=1)
    rows = sorted(token_store.read(spark, folder).withColumn("crc", F.crc32("ids")).collect(), key=lambda row: row.start)
    assert [row.doc_id for row in rows] == [None, *sorted([i for i in range(len(TEXTS)) if i != 7] + [3])]
    start = 0
    for row in rows:
        ids = tokenizer.encode(TEXTS[7 if row.doc_id is None else row.doc_id] or "", add_special_tokens=False).ids + [1]
        packed = np.array(ids, dtype="<u4").tobytes()
        assert row.start == start and row.n_tokens == len(ids) and bytes(row.ids) == packed and row.crc == zlib.crc32(packed)
        start += len(ids)


def test_empty_table_stores_nothing(spark, docs):
    folder = fresh_folder(spark, "tokens")
    token_store.write(docs.limit(0), folder, WORDS_FILE, end_id=1)
    assert token_store.read(spark, folder).count() == 0
