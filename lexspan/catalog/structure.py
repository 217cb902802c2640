"""Structure of statute-shaped texts derived from `documents`."""

from pyspark.sql import functions as F

from lexspan.catalog.corpus import LEGAL_SQL, legal_texts
from lexspan.catalog.registry import query, table
from lexspan.operators import structure as st


def _lines(spark, folder):
    return st.parse_lines(legal_texts(spark, folder), ("doc_type",))


def _units(spark, folder):
    return st.units(st.outline(_lines(spark, folder)))


@query("structure_rejoined_lines", LEGAL_SQL + """
, body_lines as (select doc_id, count(*) + count(*) filter (j % 30 = 0) + count(*) filter (j % 15 = 0) as n,
    sum(length(piece)) as c from body group by doc_id)
select d.doc_id, n + 4 + 1 + 2 as lines from docs d join body_lines using (doc_id)""")
def rejoined_lines(spark, folder):
    lines = st.rejoin_wrapped(st.text_lines(legal_texts(spark, folder).repartition(F.col("doc_id"))))
    return lines.groupBy("doc_id").agg(F.count("*").alias("lines"))


@query("structure_regions", LEGAL_SQL + """
select doc_id, 'appendix' as region, 2 as lines from docs
union all select doc_id, 'signature', 1 from docs
union all select doc_id, 'preamble', 4 from docs
union all select doc_id, 'body', count(*) + count(*) filter (j % 30 = 0) + count(*) filter (j % 15 = 0) from body group by doc_id""")
def regions(spark, folder):
    return _lines(spark, folder).groupBy("doc_id", "region").agg(F.count("*").alias("lines"))


@query("structure_appendix_text", LEGAL_SQL + "select doc_id, 'Phụ lục I' || chr(10) || 'Form list ' || doc_id as text from docs")
def appendix_text(spark, folder):
    return st.region_text(_lines(spark, folder), "appendix")


@query("structure_signature_text", LEGAL_SQL + "select doc_id, 'Nơi nhận: Archive.' as text from docs")
def signature_text(spark, folder):
    return st.region_text(_lines(spark, folder), "signature")


@query("structure_preamble_text", LEGAL_SQL + """
select doc_id, md5('Số: ' || doc_id || '/2019/NĐ-CP' || chr(10) || 'Hà Nội, ngày 05 tháng ' || lpad(cast(doc_id % 12 + 1 as varchar), 2, '0')
  || ' năm 2019' || chr(10) || 'Căn cứ ' || parts[1] || ';' || chr(10) || 'Theo đề nghị '
  || array_to_string(string_split(parts[1], ' ')[1:2], ' ') || ';') as digest from docs""")
def preamble_text(spark, folder):
    return st.region_text(_lines(spark, folder), "preamble").select("doc_id", F.md5("text").alias("digest"))


@query("structure_legal_basis", LEGAL_SQL + """
select doc_id, 'basis' as kind, 'Căn cứ ' || parts[1] || ';' as line from docs
union all select doc_id, 'proposal', 'Theo đề nghị ' || array_to_string(string_split(parts[1], ' ')[1:2], ' ') || ';'
from docs where doc_type = 'thong_tu'""")
def legal_basis(spark, folder):
    return st.legal_basis(_lines(spark, folder)).select("doc_id", "kind", "line")


@query("structure_articles", LEGAL_SQL + """
, heads as (select doc_id, j, string_split(piece, ' ')[1] as first from body)
select a.doc_id, cast(a.article_no as varchar) as article_no, a.piece as article_title,
  cast(a.chapter_no as varchar) as chapter_no, 'Part of ' || c.first as chapter_title,
  cast(a.section_no as varchar) as section_no, 'Group ' || s.first as section_title, '' as text
from art a join heads c on c.doc_id = a.doc_id and c.j = (a.chapter_no - 1) * 30
join heads s on s.doc_id = a.doc_id and s.j = (a.chapter_no - 1) * 30 + (a.section_no - 1) * 15
where a.j % 5 = 0""")
def articles(spark, folder):
    rows = _units(spark, folder).where(F.col("unit") == "article")
    return rows.select("doc_id", "article_no", "article_title", "chapter_no", "chapter_title", "section_no",
                       "section_title", "text")


@query("structure_clauses_points", LEGAL_SQL + """
select doc_id, 'clause' as unit, cast(article_no as varchar) as article_no, cast(j % 5 as varchar) as clause_no,
  null as point_id, piece as text from art where j % 5 in (1, 2)
union all
select p.doc_id, 'point', cast(p.article_no as varchar), '2', 'a',
  p.piece || coalesce(chr(10) || 'Also ' || q.piece, '') from art p left join art q on q.doc_id = p.doc_id and q.j = p.j + 1
where p.j % 5 = 3""")
def clauses_points(spark, folder):
    rows = _units(spark, folder).where(F.col("unit") != "article")
    return rows.select("doc_id", "unit", "article_no", "clause_no", "point_id", "text")


@query("structure_ordered_articles", LEGAL_SQL + """
select doc_id, cast(article_no as varchar) as article_no, cast(article_no as bigint) as place from art where j % 5 = 0""")
def ordered_articles(spark, folder):
    return st.ordered_articles(_units(spark, folder)).select("doc_id", "article_no", F.col("place").cast("long").alias("place"))


# Forms: the appendix holds a listing and, per form, a name line and its text.
FORMS_SQL = r"""
with k as (select doc_id, trim(regexp_replace(lower(text), '[^a-z]+', ' ', 'g')) as flat from documents),
f as (select doc_id, length(flat) + 28 < 300 as short, 'FORM NAME' || chr(10) || 'First line.' || chr(10) || flat || '.' || chr(10) || 'End.' as form from k)
select doc_id, 0 as form_no, 'Chung' as form_code, 'Danh mục / Quy định chung' as form_name,
  md5('Phụ lục I ' || chr(10) || 'Mẫu số 09 Short entry.' || case when short then chr(10) || 'Mẫu số 01 ' || form else '' end) as digest from f
union all select doc_id, 1, 'Phụ lục I - Mẫu số 01', 'FORM NAME', md5(form) from f where not short"""


@query("structure_appendix_forms", FORMS_SQL)
def appendix_forms(spark, folder):
    flat = F.trim(F.regexp_replace(F.lower("text"), "[^a-z]+", " "))
    docs = table(spark, folder, "documents").select("doc_id", F.concat(
        F.lit("Phụ lục I\nMẫu số 09\nShort entry.\nMẫu số 01\nFORM NAME\nFirst line.\n"), flat, F.lit(".\nEnd.")
    ).alias("text"))
    return st.appendix_forms(st.parse_lines(docs)).select(
        "doc_id", "form_no", "form_code", "form_name", F.md5("content").alias("digest"))


MARKED_SQL = """
with m as (select o_orderkey, '(được sửa đổi bởi khoản ' || (o_custkey % 9) || ' Điều ' || (o_orderkey % 40) || ' Nghị định 91/2015/NĐ-CP) '
  || case when o_orderkey % 3 = 0 then '(bãi bỏ theo Điều ' || (o_custkey % 40) || ' Luật số 5) ' else '' end as text from orders)
"""


def marked(spark, folder):
    orders = table(spark, folder, "orders")
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    return orders.select("o_orderkey", F.concat(
        F.lit("(được sửa đổi bởi khoản "), cust % 9, F.lit(" Điều "), key % 40, F.lit(" Nghị định 91/2015/NĐ-CP) "),
        F.when(key % 3 == 0, F.concat(F.lit("(bãi bỏ theo Điều "), cust % 40, F.lit(" Luật số 5) "))).otherwise(""),
    ).alias("text"))


@query("structure_amendment_marks", """
select o_orderkey, 0 as mark_no, false as repealed, 'sửa đổi bởi khoản ' || (o_custkey % 9) || ' Điều ' || (o_orderkey % 40) || ' Nghị định 91/2015/NĐ-CP' as note from orders
union all select o_orderkey, 1, true, 'bãi bỏ bởi Điều ' || (o_custkey % 40) || ' Luật số 5' from orders where o_orderkey % 3 = 0""")
def amendment_marks(spark, folder):
    return st.amendments(marked(spark, folder), ["o_orderkey"])


@query("structure_cross_references", """
select o_orderkey, 0 as ref_no, cast(o_custkey % 9 as varchar) as clause_no, cast(o_orderkey % 40 as varchar) as article_no, 'Nghị định 91/2015/NĐ-CP' as document from orders
union all select o_orderkey, 1, null, cast(o_custkey % 40 as varchar), 'Luật số 5' from orders where o_orderkey % 3 = 0""")
def cross_references(spark, folder):
    return st.cross_references(marked(spark, folder), ["o_orderkey"])


@query("structure_decree_relations", """
select o_orderkey, 0 as rel_no, case when o_custkey % 2 = 0 then 'sửa đổi' else 'hướng dẫn thi hành' end as relation_type,
  'Nghị định' as target_type, (o_custkey % 90) || '/2014/NĐ-CP' as target_doc from orders""")
def decree_relations(spark, folder):
    orders = table(spark, folder, "orders").select("o_orderkey", F.concat(
        F.lit("NGHỊ ĐỊNH "), F.when(F.col("o_custkey") % 2 == 0, "Sửa đổi một số điều của").otherwise("hướng dẫn thi hành"),
        F.lit(" Nghị định "), "o_orderpriority", F.lit(" số "), F.col("o_custkey") % 90, F.lit("/2014/NĐ-CP"),
    ).alias("text"))
    return st.decree_relations(orders, ["o_orderkey"])


@query("structure_guided_articles", """
select o_orderkey, 0 as rel_no, 'huong_dan_ap_dung' as relation_type,
  case when o_orderkey % 2 = 0 then cast(o_custkey % 9 as varchar) end as target_clause,
  cast(o_orderkey % 600 as varchar) as target_article, 'Bộ luật Dân sự' as target_doc from orders""")
def guided_articles(spark, folder):
    orders = table(spark, folder, "orders").select("o_orderkey", F.concat(
        F.lit("Nghị quyết hướng dẫn áp dụng "),
        F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("khoản "), F.col("o_custkey") % 9, F.lit(" "))).otherwise(""),
        F.lit("Điều "), F.col("o_orderkey") % 600, F.lit(" của Bộ luật Dân sự, "), "o_orderstatus",
    ).alias("text"))
    return st.guided_articles(orders, ["o_orderkey"])


@query("structure_article_checks", LEGAL_SQL + """
select doc_id, doc_type, max(article_no) as articles, max(article_no) as last_article, false as lost_articles,
  doc_type = 'bo_luat' and max(article_no) < 100 as short_code, false as empty_decree from art group by doc_id, doc_type""")
def article_checks(spark, folder):
    docs = legal_texts(spark, folder)
    return st.article_checks(docs, _units(spark, folder))


@query("structure_official_number", LEGAL_SQL + "select doc_id, doc_id || '/2019/NĐ-CP' as number from docs")
def official_number(spark, folder):
    return legal_texts(spark, folder).select("doc_id", st.official_number(F.col("text")).alias("number"))


@query("structure_issued_on", LEGAL_SQL + """
select doc_id, '2019-' || lpad(cast(doc_id % 12 + 1 as varchar), 2, '0') || '-05' as issued_on from docs""")
def issued_on(spark, folder):
    return legal_texts(spark, folder).select("doc_id", st.issued_on(F.col("text")).cast("string").alias("issued_on"))


DATED = """
with d as (select o_orderkey, o_orderkey % 31 + 1 as dd, o_custkey % 12 + 1 as mm, 2000 + o_custkey % 30 as yy, o_orderkey % 6 as k from orders)
"""


def _dated(spark, folder):
    orders = table(spark, folder, "orders")
    day, month, year = F.col("o_orderkey") % 31 + 1, F.col("o_custkey") % 12 + 1, 2000 + F.col("o_custkey") % 30
    spelled = F.concat(day, F.lit(" tháng "), month, F.lit(" năm "), year)
    phrases = ("có hiệu lực thi hành từ ngày ", "CÓ HIỆU LỰC thi hành kể từ ngày ", "có hiệu lực kể từ ngày ", "có hiệu lực từ ngày ")
    text = F.when(F.col("o_orderkey") % 6 == 4, F.concat(
        F.lit("Bắt đầu có hiệu lực từ ngày "), day, F.lit("/"), month, F.lit("-"), year))
    for i, phrase in enumerate(phrases):
        text = text.when(F.col("o_orderkey") % 6 == i, F.concat(F.lit("Luật này " + phrase), spelled))
    return orders.select("o_orderkey", text.otherwise(F.lit("không rõ")).alias("text"))


@query("structure_effective_on", DATED + """
select o_orderkey, cast(case when k < 5 then try_cast(yy || '-' || lpad(cast(mm as varchar), 2, '0') || '-' || lpad(cast(dd as varchar), 2, '0') as date) end as varchar) as effective_on from d""")
def effective_on(spark, folder):
    return _dated(spark, folder).select("o_orderkey", st.effective_on(F.col("text")).cast("string").alias("effective_on"))


@query("structure_title_guess", """
select o_orderkey, case when o_orderkey % 3 = 0 then 'NGHỊ ĐỊNH Về ' || o_orderpriority when o_orderkey % 3 = 1 then 'NGHỊ ĐỊNH' else 'BỘ | Độc lập' end as title from orders""")
def title_guess(spark, folder):
    orders = table(spark, folder, "orders")
    text = F.concat(
        F.lit("BỘ | Độc lập\n\n"),
        F.when(F.col("o_orderkey") % 3 == 2, "").otherwise("NGHỊ ĐỊNH\n"),
        F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("Về  "), "o_orderpriority", F.lit("\n"))).otherwise(""),
        F.lit("Căn cứ luật\nĐiều 1. "), "o_orderstatus")
    return orders.select("o_orderkey", st.title_guess(text).alias("title"))


@query("structure_issuer_guess", """
select o_orderkey, case o_orderkey % 5 when 0 then 'QUỐC HỘI' when 1 then 'CHÍNH PHỦ'
  when 2 then 'BỘ TÀI CHÍNH' || o_custkey when 3 then 'ỦY BAN THƯỜNG VỤ QUỐC HỘI' else 'TÒA ÁN' end as issuer from orders""")
def issuer_guess(spark, folder):
    orders = table(spark, folder, "orders")
    k = F.col("o_orderkey") % 5
    kind = F.element_at(F.array(*[F.lit(t) for t in ("bo_luat", "nghi_dinh", "thong_tu", "nghi_quyet", "an_le")]), (k + 1).cast("int"))
    text = (
        F.when(k == 2, F.concat(F.lit("BỘ TÀI CHÍNH"), "o_custkey", F.lit("__ Số: 1 | CỘNG HÒA\nABC")))
        .when(k == 3, F.lit("ỦY BAN THƯỜNG VỤ | x"))
        .otherwise(F.lit("dòng thường\nCỘNG HÒA XÃ HỘI\nTÒA ÁN__\nKHÁC"))
    )
    return orders.select("o_orderkey", st.issuer_guess(text, kind).alias("issuer"))


PRECEDENT_WORDS = "trim(regexp_replace(lower(text), '[^a-z]+', ' ', 'g'))"


def precedent_texts(spark, folder):
    """Precedent-shaped text per document, in the layout of published precedents."""
    flat = F.trim(F.regexp_replace(F.lower("text"), "[^a-z]+", " "))
    docs = table(spark, folder, "documents").select("doc_id", flat.alias("flat"), "source")
    key = F.col("doc_id").cast("string")
    text = F.concat(
        F.lit("ÁN LỆ SỐ "), key, F.lit("/2021/AL\nVề việc "), F.col("flat"),
        F.lit("\nĐược Hội đồng Thẩm phán Tòa án nhân dân tối cao thông qua và công bố theo Quyết định ngày 31 tháng 12 năm 2021"),
        F.lit("\nNguồn án lệ:\nBản án số "), key, F.lit(" của Tòa án nhân dân cấp cao"),
        F.lit("\nVị trí nội dung án lệ:\nĐoạn 2\nKhái quát nội dung của án lệ:\n- Tình huống án lệ:\n"), F.col("flat"),
        F.lit("\n- Giải pháp pháp lý:\nphải "), F.col("flat"),
        F.lit("\nQuy định của pháp luật liên quan đến án lệ:\n- Điều 117 Bộ luật;\n- Khoản 2 Điều "), key,
        F.lit("\ncủa Luật;\n- ghi chú\nTừ khóa của án lệ:\n“hợp đồng”; “"), "source", F.lit("”;\nNỘI DUNG VỤ ÁN:\n"), "flat",
        F.lit("\nNHẬN ĐỊNH CỦA TÒA ÁN:\nx\nNỘI DUNG ÁN LỆ\n“[2] "), F.substring("flat", 1, 100), F.lit("\nhết.”\n12"),
    )
    return docs.select("doc_id", text.alias("text"))


@query("structure_precedent_sections", f"""
with d as (select doc_id, source, {PRECEDENT_WORDS} as flat from documents)
select doc_id, doc_id || '/2021/AL' as number, trim('Về việc ' || flat) as title,
  'Bản án số ' || doc_id || ' của Tòa án nhân dân cấp cao' as source_note,
  'Được Hội đồng Thẩm phán Tòa án nhân dân tối cao thông qua và công bố theo Quyết định ngày 31 tháng 12 năm 2021' as court,
  '2021-12-31' as published_on, 'Đoạn 2' as location_note, trim(flat) as issue,
  trim(regexp_replace('phải ' || flat, ' +', ' ', 'g')) as holding, md5(trim(flat)) as facts, trim('“[2] ' || substr(flat, 1, 100)) || ' hết.”' as reasoning,
  'Điều 117 Bộ luật|Khoản 2 Điều ' || doc_id || ' của Luật' as related, 'hợp đồng|' || source as keywords from d where flat <> ''""")
def precedent_sections(spark, folder):
    texts = precedent_texts(spark, folder)
    rows = st.parse_precedents(texts).where(F.col("facts") != "")
    return rows.select(
        "doc_id", "number", "title", "source_note", "court", F.col("published_on").cast("string").alias("published_on"),
        "location_note", "issue", "holding", F.md5("facts").alias("facts"), "reasoning",
        F.array_join("related_provisions", "|").alias("related"), F.array_join("keywords", "|").alias("keywords"))


# Pages: each document's pieces are laid on pages of twelve lines.
PAGES_SQL = LEGAL_SQL + """
, pl as (select doc_id, j, article_no, j // 12 + 1 as page, j % 12 as slot from art)
"""


def legal_pages(spark, folder):
    """`doc_id, page, text`: body pieces by page, every fifth one an article heading.

    Built per document inside one row; blank pages are put between text pages.
    """
    from lexspan.catalog.corpus import pieces

    docs = table(spark, folder, "documents").select("doc_id", pieces(F.col("text")).alias("parts")).where(F.size("parts") > 1)
    body = F.transform(F.slice("parts", 2, F.size("parts")), lambda p, j: F.when(
        j % 5 == 0, F.concat(F.lit("Điều "), (j / 5).cast("int") + 1, F.lit(". "), p)).otherwise(p))
    n = F.ceil((F.size("parts") - 1) / 12).cast("int")
    rows = docs.select("doc_id", body.alias("body"), n.alias("n")).select(
        "doc_id", F.explode(F.sequence(F.lit(1), "n")).alias("page"), "body")
    texts = rows.select("doc_id", "page", F.array_join(F.slice("body", (F.col("page") - 1) * 12 + 1, F.lit(12)), "\n").alias("text"))
    return texts.select("doc_id", F.explode(F.array(
        F.struct((F.col("page") * 2 - 1).alias("page"), F.col("text").alias("text")),
        F.struct((F.col("page") * 2).alias("page"), F.lit("  \n ").alias("text")),
    )).alias("p")).select("doc_id", "p.page", "p.text")


@query("structure_article_pages", PAGES_SQL + """
, m as (select doc_id, max(j) as last_j from pl group by doc_id)
select doc_id, cast(article_no as varchar) as article_no, min(page) * 2 - 1 as page_start,
  case when max(j) = max(last_j) then min(page) else max(page) end * 2 - 1 as page_end, 'article_span' as locator_confidence
from pl join m using (doc_id) group by doc_id, article_no""")
def article_pages(spark, folder):
    return st.locate_articles(legal_pages(spark, folder)).withColumns({
        "page_start": F.col("page_start").cast("long"), "page_end": F.col("page_end").cast("long")})


@query("structure_section_pages", PAGES_SQL + """
, s as (select doc_id, j, page, piece from pl join body using (doc_id, j) where j % 12 = 1)
, probe as (select doc_id, j, piece from s)
select p.doc_id, 'piece_' || p.j as section, min(q.page) * 2 - 1 as page, 'section_text' as locator_confidence
from probe p join (select pl.doc_id, page, string_agg(case when pl.j % 5 = 0 then 'Điều ' || article_no || '. ' else '' end || piece, chr(10) order by pl.j) as t
  from pl join body using (doc_id, j) group by pl.doc_id, page) q on q.doc_id = p.doc_id and contains(q.t, p.piece) group by p.doc_id, p.j""")
def section_pages(spark, folder):
    from lexspan.catalog.corpus import pieces

    docs = table(spark, folder, "documents").select("doc_id", pieces(F.col("text")).alias("parts")).where(F.size("parts") > 1)
    probes = docs.select("doc_id", F.posexplode(F.slice("parts", 2, F.size("parts"))).alias("j", "section_text")).where(F.col("j") % 12 == 1)
    sections = probes.select("doc_id", F.concat(F.lit("piece_"), "j").alias("section"), "section_text")
    found = st.locate_sections(sections, legal_pages(spark, folder))
    return found.withColumn("page", F.col("page").cast("long"))
