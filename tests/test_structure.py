from pyspark.sql import functions as F

from lexspan.operators import chunking as ck
from lexspan.operators import metadata as md
from lexspan.operators import structure as st
from lexspan.plans import ingest

TEXT = """CHÍNH PHỦ | CỘNG HÒA XÃ HỘI
NGHỊ ĐỊNH
Về thử nghiệm
Căn cứ Luật Tổ chức;
Chương II
QUY ĐỊNH CHUNG
Điều 1. Phạm vi điều chỉnh
Nghị định này quy định
về hợp đồng.
Mục 1. Chung
Điều 12. Quyền
1. Khoản một
a) Điểm a
tiếp theo.
Đoạn sau.
2. Khoản hai theo khoản 2 Điều 5 Bộ luật này.
Điều 13. Hiệu lực thi hành
Nghị định này có hiệu lực thi hành từ ngày 15 tháng 3 năm 2021. Thay thế Nghị định số 10/2010/NĐ-CP.
| Nơi nhận: Văn phòng
TM. CHÍNH PHỦ
Phụ lục I
Mẫu số 01
TÊN MẪU
"""


def parsed(spark, text=TEXT, kind="nghi_dinh"):
    docs = spark.createDataFrame([("d1", kind, text)], "doc_id string, doc_type string, text string")
    lines = st.parse_lines(docs, ("doc_type",))
    outlined = st.outline(lines)
    return docs, lines, outlined, st.units(outlined)


def test_units_of_a_decree(spark):
    _, lines, outlined, units = parsed(spark)
    rows = {(r["unit"], r["article_no"], r["clause_no"], r["point_id"]): r for r in units.collect()}
    assert rows["article", "1", None, None]["text"] == "Nghị định này quy định về hợp đồng."
    assert rows["article", "1", None, None]["section_no"] is None
    assert rows["article", "12", None, None]["section_no"] == "1"
    assert rows["article", "12", None, None]["chapter_title"] == "QUY ĐỊNH CHUNG"
    assert rows["point", "12", "1", "a"]["text"] == "Điểm a tiếp theo.\nĐoạn sau."
    assert rows["clause", "12", "2", None]["text"].startswith("Khoản hai")
    assert not any("Nơi nhận" in r["text"] or "TM." in r["text"] for r in rows.values())
    basis = [r["line"] for r in st.legal_basis(lines).collect()]
    assert basis == ["Căn cứ Luật Tổ chức;"]
    assert st.region_text(lines, "appendix").first()["text"].startswith("Phụ lục I")


def test_nodes_and_validity(spark):
    docs, _, outlined, units = parsed(spark)
    titled = docs.select("doc_id", F.lit("Nghị định X").alias("title"))
    nodes = {r["node_id"]: r for r in md.nodes(titled, outlined, units).collect()}
    assert {r["node_type"] for r in nodes.values()} == {"document", "chuong", "muc", "dieu", "khoan", "diem"}
    assert nodes["d1_khoan_12_1"]["parent_id"].endswith("_dieu_12")
    valid = md.validity(docs.select("doc_id", F.lit(None).cast("date").alias("effective_on")), md.article_bodies(units)).first()
    assert str(valid["effective_from"]) == "2021-03-15"
    assert valid["replaced_documents"] == ["Nghị định số 10/2010/NĐ-CP"]


def test_empty_text_has_no_units(spark):
    *_, units = parsed(spark, "")
    assert units.count() == 0


def test_page_locations_skip_blank_pages(spark):
    pages = spark.createDataFrame(
        [("d", 1, "mở đầu"), ("d", 2, " \n"), ("d", 3, "Điều 1. A\nnội dung"), ("d", 4, "tiếp\nĐiều 2. B")],
        "doc_id string, page int, text string")
    rows = {r["article_no"]: (r["page_start"], r["page_end"]) for r in st.locate_articles(pages).collect()}
    assert rows == {"1": (3, 4), "2": (4, 4)}


def test_pages_to_chunks(spark):
    pages = spark.createDataFrame([("d1", i, part) for i, part in enumerate(TEXT.split("Mục 1"), 1)], "doc_id string, page int, text string")
    docs = ingest.documents_from_pages(pages, spark.createDataFrame([("d1", "nghi_dinh")], "doc_id string, doc_type string"))
    tables = ingest.statutes(docs, pages)
    chunks = {r["chunk_id"]: r for r in ingest.chunk_table(tables).collect()}
    assert "d1_dieu_1_intro" in chunks
    clause = chunks["d1_dieu_12_khoan_1"]
    assert clause["parent_chunk_id"] == "d1_dieu_12_intro" and "Điểm a) Điểm a" in clause["text"]
    assert clause["legal_role"] == "rights_obligations"


def test_duplicate_chunks_fail_their_document(spark):
    rows = spark.createDataFrame([("a", "a1"), ("a", "a1"), ("b", "b1")], "doc_id string, chunk_id string")
    good, failed = ck.reject_duplicates(rows)
    assert [r["doc_id"] for r in good.collect()] == ["b"]
    assert failed.first()["sample"] == ["a1"]


def test_spans_lie_on_the_pages_of_their_offsets(spark):
    """Against the joined text itself: long pages over several buckets, blank pages, empty and overlong spans."""
    import random

    pick = random.Random(6)
    pages = []
    for doc in range(4):
        for page in range(1, 30):
            text = "" if page % 5 == 0 else " \n" if page % 7 == 0 else "x" * pick.choice([1, 80, 4095, 4096, 9000])
            pages.append((doc, page, text))
    whole, spans = {}, []
    for doc in range(4):
        kept = [(p, t) for d, p, t in pages if d == doc and t.strip()]
        whole[doc] = [p for p, t in kept for _ in range(len(t) + 1)]
        for n in range(200):
            start = pick.randrange(len(whole[doc]))
            spans.append((doc, n, start, min(len(whole[doc]), start + pick.choice([0, 1, 50, 20_000]))))
        spans.append((doc, 999, len(whole[doc]) + 5, len(whole[doc]) + 9))
    found = st.locate_spans(
        spark.createDataFrame(spans, "doc_id int, n int, start long, end long"), spark.createDataFrame(pages, "doc_id int, page int, text string").repartition(3))
    got = {(row.doc_id, row.n): (row.page_start, row.page_end) for row in found.collect()}
    want = {(d, n): (whole[d][a], whole[d][max(a, b - 1)]) for d, n, a, b in spans if n != 999}
    assert got == want
