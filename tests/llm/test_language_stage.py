"""The language stage: texts of languages that were not learnt go; pieces of long texts count once."""

import random

import numpy as np

import corpus_pipeline
from lexspan.llm import langid

SF = "/root/testdata/sf0.001"


def test_pieces_give_the_grams_of_the_whole(monkeypatch):
    draw = random.Random(1)
    text = "".join(draw.choice("abcdé  .\nÜ") for _ in range(997))
    whole = np.sort(np.concatenate(list(langid.gram_hashes(text))))
    for piece in (1, 2, 3, 7, 100, 996, 997):
        monkeypatch.setattr(langid, "PIECE", piece)
        assert np.array_equal(np.sort(np.concatenate(list(langid.gram_hashes(text)))), whole)
    assert sum(len(h) for h in langid.gram_hashes("")) == 0


def test_hits_by_filters_and_by_exact_sets_agree(spark):
    """Language, share, rate and lead from filters, corrected for chance, against exact sets."""
    draw = random.Random(2)
    grams = {f"l{i}": np.unique(np.array([draw.getrandbits(63) for _ in range(3000)], dtype=np.uint64)) for i in range(3)}
    filters = langid.Filters.build(grams)
    chance = filters.chance()
    texts = {n: np.array([draw.choice(list(grams["l1"])) if draw.random() < 0.6 else draw.getrandbits(63) for _ in range(n)], dtype=np.uint64) for n in (2000, 20000)}
    original = langid.gram_hashes
    for n, hashes in texts.items():
        langid.gram_hashes = lambda text, hashes=hashes: iter([hashes])
        try:
            lang, share, rate, lead = filters.weigh("any", chance)
        finally:
            langid.gram_hashes = original
        exact = {name: int(np.isin(hashes, known).sum()) for name, known in grams.items()}
        assert lang == max(exact, key=exact.get) == "l1"
        assert abs(rate - exact["l1"] / n) < 0.01 and abs(share - 1) < 0.02 and abs(lead - 1) < 0.02


def test_unlearnt_languages_go_and_clean_documents_stay(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    strange = ["Minä olen opiskelija ja asun Helsingissä koska työ on siellä hyvin mielenkiintoista",
               "Toto je český text, který popisuje život ve městě a na venkově během zimy", "Это русский текст о жизни в городе и деревне", "1234 5678", None]
    extra = spark.createDataFrame([(10**9 + i, t) for i, t in enumerate(strange)], "doc_id long, text string")
    both = docs.unionByName(extra, allowMissingColumns=True)
    kept = {r.doc_id for r in corpus_pipeline.language_stage(spark, both, SF).select("doc_id").collect()}
    clean = {r.doc_id for r in docs.where("text rlike '[A-Za-z]{3}'").select("doc_id").collect()}
    assert clean <= kept and not any(i >= 10**9 for i in kept)
