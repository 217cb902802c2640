"""Token files: several files a task, ranged reads, and special tokens as the library takes them."""

import io
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lexspan.llm import token_store
from lexspan.llm.scratch import fresh_folder

WORDS_FILE = open(public_tokenizers.path("word_bpe_49k.json")).read()
BITS = ["a", "B", "don't", "'s", "x's!", "Wörld", " ", "  ", "\n", "\x1d", "\x85", "\xa0", "42", "é1", "...", "<|startoftext|>", "<|ENDOFTEXT|>", "日", "́", "İ", "a" * 60]


def texts(seed, count):
    pick = random.Random(seed)
    return ["", None] + ["".join(pick.choices(BITS[: 15 if pick.random() < 0.5 else None], k=pick.randrange(60))) for _ in range(count)]


@pytest.mark.parametrize("special", [True, False])
def test_files_roll_and_hold_what_the_library_gives(spark, monkeypatch, special):
    monkeypatch.setattr(token_store, "ROLL", 2000)
    some = texts(1, 1200)
    docs = spark.createDataFrame(list(enumerate(some)), "doc_id long, text string").repartition(3)
    folder = fresh_folder(spark, "tokens")
    files = token_store.write(docs, folder, WORDS_FILE, end_id=1, special_tokens=special).collect()
    assert max(row.turn for row in files) >= 1
    library = Tokenizer.from_str(WORDS_FILE)
    library.encode_special_tokens = not special
    start = 0
    rows = sorted(token_store.read(spark, folder).withColumn("crc", F.crc32("ids")).collect(), key=lambda row: row.start)
    assert [row.doc_id for row in rows] == list(range(len(some)))
    for row in rows:
        ids = library.encode(some[row.doc_id] or "", add_special_tokens=False).ids + [1]
        assert (row.start, row.n_tokens, row.crc) == (start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes()))
        start += len(ids)


def test_memory_of_stretches_is_bounded():
    library = Tokenizer.from_str(WORDS_FILE)
    known = token_store.Pieces(library, token_store.split_pattern(WORDS_FILE), "</w>", ("<|startoftext|>",), limit=5)
    for text in filter(None, texts(2, 200)):
        assert np.frombuffer(known.ids([text])[0], "<u4").tolist() == library.encode(text, add_special_tokens=False).ids
        assert len(known) <= 5 and len(known.older) <= 5


def test_a_block_is_read_without_the_rest():
    class Counting(io.BytesIO):
        fetched = 0

        def read(self, size=-1):
            got = super().read(size)
            self.fetched += len(got)
            return got

    ids = np.random.default_rng(2).integers(0, 1 << 24, 100_000).astype("<u4")
    sink = io.BytesIO()
    writer = token_store.FileWriter(sink, "byte", block=1000)
    writer.add([1], [len(ids)], ids)
    writer.close()
    source = Counting(sink.getvalue())
    footer, _, _ = token_store.open_ranged(source)
    assert (token_store.read_ranged(source, footer, 57) == ids[57_000:58_000]).all()
    assert source.fetched < len(sink.getvalue()) / 20
    for broken in (b"", sink.getvalue()[1:], sink.getvalue()[:-3]):
        with pytest.raises(ValueError):
            token_store.open_file(broken)
