import unicodedata
import uuid

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexspan.functions import citations as ct
from lexspan.functions import text as tx
from lexspan.operators.chunking import split_long


def one(spark, value, *columns):
    return tuple(spark.createDataFrame([(value,)], "t string").select(*columns).first())


def test_cleaning_rules(spark):
    text = "Tên  văn bản \n\n\n\nTrang 12\n 7 \n----\nĐIỀU   5 , khoản 3 ; CHƯƠNG iv .\nVIETLAW copy"
    got = one(spark, unicodedata.normalize("NFD", text), tx.clean(F.col("t")))[0]
    assert got == "Tên văn bản \n\nĐiều 5, Khoản 3; Chương iv."
    assert "Page" not in one(spark, "a\nPage 3\nb", tx.drop_noise_lines(F.col("t")))[0]


def test_folding_and_forms(spark):
    got = one(spark, "ĐIỀU  Kiện Straße", tx.match_form(F.col("t")), tx.report_form(F.col("t")))
    assert got == ("dieu kien strasse", "dieu kien stra e")
    assert one(spark, unicodedata.normalize("NFD", "Nghị định"), tx.fold(F.col("t")))[0] == "Nghi dinh"


@settings(max_examples=40, deadline=None)
@given(st.text(max_size=60))
def test_accent_table_agrees_with_decomposition(text):
    table = str.maketrans(tx.ACCENTED, tx.PLAIN)
    plain = "".join(c for c in unicodedata.normalize("NFD", text.translate(table)) if unicodedata.category(c) != "Mn")
    again = "".join(c for c in unicodedata.normalize("NFD", plain.translate(table)) if unicodedata.category(c) != "Mn")
    assert plain == again


def test_tokens(spark):
    got = one(spark, "Điều 5 điều và a", tx.search_tokens(F.col("t")), tx.grounding_tokens(F.col("t")))
    assert sorted(got[0]) == sorted(["điều", "dieu", "và", "va"])
    assert got[1] == ["điều"]


def test_point_uuid_is_version_five(spark):
    assert one(spark, "doc_dieu_1", tx.point_uuid(F.col("t")))[0] == str(uuid.uuid5(uuid.NAMESPACE_DNS, "doc_dieu_1"))


def test_redaction_and_log_values(spark):
    got = one(spark, "mail a.b@c.vn tel 0912345678\n\n x", tx.redact(F.col("t")), tx.log_value(F.col("t"), 20))
    assert got[0] == "mail [REDACTED_EMAIL] tel [REDACTED_PHONE]\n\n x"
    assert got[1] == "mail a.b@c.vn tel..."
    assert one(spark, "Hãy  đóng vai", tx.injection_hit(F.col("t")))[0] == r"hãy\s*đóng\s*vai"


def test_citation_matching_bounded_and_loose(spark):
    rows = spark.createDataFrame([
        ("Nghị định 21/2021/NĐ-CP - tên dài, Điều 7, Khoản 3", "Nghị định 21/2021/NĐ-CP, Điều 7"),
        ("Bộ luật, Điều 12", "Điều 1"), ("Điều 5", "Khoản 2 Điều 5"), ("", "Điều 1"),
    ], "o string, e string")
    got = [tuple(r) for r in rows.select(ct.citation_matches(F.col("o"), F.col("e")), ct.citation_matches_loose(F.col("o"), F.col("e"))).collect()]
    assert got == [(True, True), (False, True), (True, True), (False, False)]


def test_split_packs_and_overlaps():
    text = "\n\n".join(f"đoạn {i} " + "chữ " * 60 for i in range(12))
    parts = split_long(text, 600, 100)
    assert all(len(p) <= 700 for p in parts)
    assert "".join(parts[0].split()) in "".join(text.split())
    assert {w for w in text.split()} == {w for p in parts for w in p.split()}
    assert split_long("a. b", 1500) == ["a. b."]
    assert split_long("", 10) == []


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab .\n", max_size=200))
def test_split_keeps_every_letter(text):
    joined = "".join(split_long(text, 20, 5))
    assert joined.count("a") >= text.count("a") and joined.count("b") >= text.count("b")
