"""Needles of one word stand beside the term, and only the best k of a question leave a task (F22, F24)."""

from pyspark.sql import functions as F

from lexspan.operators import lexical as lx


def test_single_words_and_long_needles(spark):
    chunks = spark.createDataFrame([("c1", "alpha beta gamma"), ("c2", "beta delta"), ("c3", "alpha epsilon"), ("c4", "x zeta"), ("c5", "eta"), ("c6", "theta")], "chunk_id string, text string")
    index = lx.build_index(chunks)
    none = F.array().cast("array<string>")
    asked = spark.createDataFrame([("q1", "alpha beta", ["alpha", "beta", "x", "omega"], ["alpha beta", "beta delta"])],
                                  "query_id string, normalized_query string, keywords array<string>, key_phrases array<string>").withColumns({
        "query_variants": none, "scenario_terms": none, "citation_targets": none})
    terms = lx.text_terms(asked, index).where("n = 0").collect()
    assert len(terms) == len({t.token for t in terms})  # one row of a word, however many needles it is
    assert {t.token: t.weight for t in terms}["alpha"] == 0.5
    found = {r.chunk_id: (r.phrase_score, r.bm25 > 0) for r in lx.text_matches(asked, index).collect()}
    assert found == {"c1": (0.5 + 0.5 + 3.0, True), "c2": (0.5 + 3.0, True), "c3": (0.5, True), "c4": (0.5, False)}
