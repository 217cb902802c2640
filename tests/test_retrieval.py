import numpy as np
from pyspark.sql import functions as F

from lexspan.operators import analysis as an
from lexspan.operators import lexical as lx
from lexspan.operators import ranking as rk
from lexspan.operators import temporal as tp
from lexspan.operators import vectors as vc


def analysed(spark, *texts):
    rows = an.analyse(spark.createDataFrame(list(enumerate(texts)), "query_id long, raw_query string"))
    return {r["query_id"]: r for r in rows.collect()}


def test_routes(spark):
    got = analysed(
        spark, "Hôm nay thời tiết thế nào?", "Điều 117 quy định gì?", "Án lệ số 43/2021/AL nói gì?",
        "Từ đủ 14 tuổi đến dưới 16 tuổi có chịu trách nhiệm hình sự?", "Tôi chỉ biết hợp đồng bị tranh chấp, có thể kết luận ngay không?",
        "Dang ky the chap co hieu luc doi khang voi nguoi thu ba khong?", "Nghị định 99/2022/NĐ-CP có hiệu lực khi nào năm 2022?",
        "Nếu lái xe say xỉn gây thương tật thì sao?")
    assert [got[i]["request_type"] for i in range(8)] == [
        "out_of_scope", "citation_lookup", "case_law_question", "validity_question", "scenario_application",
        "scenario_application", "validity_question", "scenario_application"]
    assert got[1]["citation_targets"] == ["Điều 117"]
    assert got[2]["citation_targets"] == ["Án lệ số 43/2021/AL"]
    assert got[3]["citation_targets"] == ["Bộ luật Hình sự, Điều 12"]
    assert got[4]["insufficient_facts"] and got[4]["missing_fact_hints"][0] == "chủ thể"
    assert "Khoản 2 Điều 319" in got[5]["citation_targets"]
    assert got[6]["citation_targets"] == ["Nghị định 99/2022/NĐ-CP, Điều 6"] and got[6]["year_hint"] == "2022"
    assert got[7]["citation_targets"] == ["Bộ luật Hình sự, Điều 260", "Bộ luật Dân sự, Điều 590"]
    assert got[1]["query_variants"][0] == "Điều 117 quy định gì?"


def test_resolved_documents_and_clause_constraints(spark):
    registry = spark.createDataFrame(
        [("blds", "91/2015/QH13", "Bộ luật Dân sự 2015", ["BLDS", "dân sự"])], "doc_id string, official_number string, document_title string, aliases array<string>")
    query = spark.createDataFrame([(1, "Khoản 1 Điều 117 BLDS", "Khoản 1 Điều 117 BLDS", [])], "query_id int, raw_query string, normalized_query string, citation_targets array<string>")
    row = an.exact_constraints(query, an.alias_terms(registry))
    assert row.first()["c_docs"] == ["blds"] and row.first()["c_clauses"] == ["1"]
    chunks = spark.createDataFrame(
        [("a", "blds", "bo_luat", "117", "1", "Điều 117, Khoản 1"), ("b", "blds", "bo_luat", "117", "2", "Điều 117, Khoản 2")],
        "chunk_id string, doc_id string, doc_type string, article_no string, clause_no string, citation string")
    kept = chunks.crossJoin(row).where(an.satisfies("c_"))
    assert [r["chunk_id"] for r in kept.collect()] == ["a"]


def test_lone_chunks_always_compete(spark):
    rows = [(f"c{i:03d}", "alpha common words", None, None, None) for i in range(40)]
    rows += [("z1", "other", "Hiệu lực thi hành", None, None), ("z2", "other", "Hiệu lực", None, "2001"), ("z3", "quite", None, "7", None)]
    chunks = spark.createDataFrame(rows, "chunk_id string, text string, article_title string, clause_no string, effective_to string").withColumns(
        {c: F.lit(None).cast("string") for c in ("validity_status", "effective_from", "effective_on", "doc_type", "document_role", "citation", "article_no")})
    asked = spark.createDataFrame(
        [("q", "validity_question", "alpha", [], ["alpha"], [], [], [], ["7"], [], None, None, False)],
        "query_id string, request_type string, normalized_query string, query_variants array<string>, keywords array<string>, key_phrases array<string>, "
        "scenario_terms array<string>, citation_targets array<string>, c_clauses array<string>, c_articles array<string>, year_hint string, q_year int, historical boolean")
    for k in (1, 3, 32, 60):
        got = [(r["chunk_id"], r["rank"]) for r in lx.lexical_top(asked, chunks, lx.build_index(chunks), F.lit(2026), k).orderBy("rank").collect()]
        want = ["z3", "z1", *[f"c{i:03d}" for i in range(40)]]
        assert got == [(c, i + 1) for i, c in enumerate(want[:k])]


def test_bm25_against_the_formula(spark):
    texts = ["một hai ba", "hai ba bốn", "ba bốn năm sáu", "bảy tám", "chín"]
    chunks = spark.createDataFrame([(f"c{i}", t) for i, t in enumerate(texts)], "chunk_id string, text string")
    query = spark.createDataFrame([("q", "hai bảy", [], [], [])], "query_id string, normalized_query string, query_variants array<string>, keywords array<string>, key_phrases array<string>")
    index = lx.build_index(chunks)
    got = {r["chunk_id"]: r["bm25"] for r in lx.bm25(query, index).collect()}
    sets = {r["chunk_id"]: {t for t in r["tokens"] if len(t) >= 2} for r in index.collect()}
    mean = np.mean([len(s) for s in sets.values()])
    df = {}
    for s in sets.values():
        for t in s:
            df[t] = df.get(t, 0) + 1
    idf = {t: np.log(5 - n + 0.5) - np.log(n + 0.5) for t, n in df.items()}
    floor = 0.25 * np.mean(list(idf.values()))
    for name, tokens in sets.items():
        want = sum((idf[t] if idf[t] >= 0 else floor) * 2.5 / (1 + 1.5 * (0.25 + 0.75 * len(tokens) / mean)) for t in {"hai", "bảy", "bay"} & tokens)
        assert abs(got.get(name, 0.0) - want) < 1e-9


def test_cosine_blocks_agree_with_one_matrix(spark, monkeypatch):
    rng = np.random.default_rng(3)
    a, b = rng.normal(size=(7, 5)), rng.normal(size=(40, 5))
    queries = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(a)], "query_id int, vector array<double>")
    chunks = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(b)], "chunk_id int, embedding array<double>")
    monkeypatch.setattr(vc, "QUERY_BLOCK", 3)
    monkeypatch.setattr(vc, "CHUNK_BLOCK", 11)
    got = {(r["query_id"], r["rank"]): r["chunk_id"] for r in vc.cosine_top_k(queries, chunks, 4).collect()}
    scores = (a @ b.T) / np.outer(np.linalg.norm(a, axis=1), np.linalg.norm(b, axis=1))
    for q in range(7):
        assert [got[q, i + 1] for i in range(4)] == list(np.argsort(-scores[q])[:4])


def test_replacement_beats_expired_text(spark):
    schema = ("query_id string, chunk_id string, doc_id string, number string, title string, document_role string, validity_status string, "
              "effective_from string, effective_on string, effective_to string, replaced_documents array<string>, "
              "related_documents array<struct<relation_type:string,target_doc:string>>, final double, rank int, q_year int, historical boolean")
    rows = [("q", "old", "d1", "10/2010/NĐ-CP", "t", "x", "het_hieu_luc", None, None, None, [], [], 9.0, 1, None, False),
            ("q", "new", "d2", "99/2022/NĐ-CP", "t", "x", "dang_co_hieu_luc", "2022-01-01", None, None, ["10/2010/NĐ-CP"], [], 1.0, 2, None, False)]
    out = tp.resolve_conflicts(spark.createDataFrame(rows, schema), F.lit(2026)).collect()
    assert [(r["chunk_id"], r["rank"], r["conflict_detected"]) for r in out] == [("new", 1, True)]


def test_fusion_ignores_input_order(spark):
    rows = [("q", f"c{i}", s, s, float((i * 7) % 5)) for i in range(9) for s in ("vector", "metadata")]
    schema = "query_id string, chunk_id string, source string, kind string, score double"
    fused = [
        {r["chunk_id"]: round(r["hybrid"], 12) for r in rk.fuse(rk.merge_scores(spark.createDataFrame(x, schema))).collect()}
        for x in (rows, rows[::-1])]
    assert fused[0] == fused[1]


def test_frequent_keys_are_salted(spark):
    postings = spark.range(500).select(F.concat(F.lit("c"), "id").alias("chunk_id"), F.when(F.col("id") % 5 > 0, "hot").otherwise(F.concat(F.lit("t"), F.col("id") % 7)).alias("token"))
    terms = spark.createDataFrame([("q1", "hot"), ("q2", "hot"), ("q2", "t3"), ("q3", "none")], "query_id string, token string")
    frequent = postings.groupBy("token").agg(F.count("*").alias("df"))
    joined = lx.salted_join(postings, terms, ["token"], frequent, rows=30)
    assert sorted(map(tuple, joined.select("query_id", "chunk_id", "token").collect())) == sorted(map(tuple, postings.join(terms, "token").select("query_id", "chunk_id", "token").collect()))


def test_names_are_found_by_their_rarest_part(spark):
    texts = spark.createDataFrame([(1, "theo nghi dinh 99/2022 va bo luat dan su"), (2, "nghi dinh 100/2022"), (3, "bl"), (4, "")], "k int, text string")
    names = spark.createDataFrame([("a", "nghi dinh 99/2022"), ("b", "nghi dinh 100/2022"), ("c", "bo luat dan su"), ("d", "bl"), ("e", ""), ("f", "dinh 99"), ("a", "bo luat")], "doc_id string, term string")
    got = {r["k"]: r["doc_ids"] for r in an.resolve_documents(texts, names, "k").collect()}
    assert got == {1: ["a", "c", "f"], 2: ["b"], 3: ["d"]}
