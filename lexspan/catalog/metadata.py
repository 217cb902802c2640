"""Metadata queries over derived statutes, orders and documents."""

from pyspark.sql import functions as F

from lexspan.catalog.corpus import LEGAL_SQL, legal_texts
from lexspan.catalog.registry import query, table
from lexspan.catalog.structure import PRECEDENT_WORDS, precedent_texts
from lexspan.operators import metadata as md
from lexspan.operators import structure as st


def _parts(spark, folder):
    lines = st.parse_lines(legal_texts(spark, folder), ("doc_type",))
    outlined = st.outline(lines)
    return outlined, st.units(outlined)


@query("metadata_nodes", LEGAL_SQL + """
, hd as (select doc_id, j, string_split(piece, ' ')[1] as first from body)
, n as (select a.*, 'Chương ' || chapter_no || ': Part of ' || c.first as cl, 'Mục ' || section_no || ': Group ' || s.first as sl,
   'Title ' || a.doc_id as t, h.piece as art_title
  from art a join hd c on c.doc_id = a.doc_id and c.j = (chapter_no - 1) * 30
  join hd s on s.doc_id = a.doc_id and s.j = (chapter_no - 1) * 30 + (section_no - 1) * 15
  join body h on h.doc_id = a.doc_id and h.j = (article_no - 1) * 5)
select cast(doc_id as varchar) || '_document' as node_id, 'document' as node_type, null as parent_id, '' as ancestors, md5('Title ' || doc_id) as path from docs
union all select doc_id || '_chuong_' || chapter_no, 'chuong', doc_id || '_document', doc_id || '_document', md5(t || '>' || cl) from n where j % 30 = 0
union all select doc_id || '_muc_' || chapter_no || '_' || section_no, 'muc', doc_id || '_chuong_' || chapter_no, doc_id || '_document>' || doc_id || '_chuong_' || chapter_no, md5(t || '>' || cl || '>' || sl) from n where j % 15 = 0
union all select doc_id || '_dieu_' || article_no, 'dieu', doc_id || '_muc_' || chapter_no || '_' || section_no,
  doc_id || '_document>' || doc_id || '_chuong_' || chapter_no || '>' || doc_id || '_muc_' || chapter_no || '_' || section_no,
  md5(t || '>' || cl || '>' || sl || '>Điều ' || article_no || ': ' || art_title) from n where j % 5 = 0
union all select doc_id || '_khoan_' || article_no || '_' || (j % 5), 'khoan', doc_id || '_dieu_' || article_no,
  doc_id || '_document>' || doc_id || '_chuong_' || chapter_no || '>' || doc_id || '_muc_' || chapter_no || '_' || section_no || '>' || doc_id || '_dieu_' || article_no,
  md5(t || '>' || cl || '>' || sl || '>Điều ' || article_no || ': ' || art_title || '>Khoản ' || (j % 5)) from n where j % 5 in (1, 2)
union all select doc_id || '_diem_' || article_no || '_2_a', 'diem', doc_id || '_khoan_' || article_no || '_2',
  doc_id || '_document>' || doc_id || '_chuong_' || chapter_no || '>' || doc_id || '_muc_' || chapter_no || '_' || section_no || '>' || doc_id || '_dieu_' || article_no || '>' || doc_id || '_khoan_' || article_no || '_2',
  md5(t || '>' || cl || '>' || sl || '>Điều ' || article_no || ': ' || art_title || '>Khoản 2>Điểm a') from n where j % 5 = 3""")
def nodes(spark, folder):
    units = st.units(_parts(spark, folder)[0], heads=True)
    docs = legal_texts(spark, folder).select("doc_id", F.concat(F.lit("Title "), "doc_id").alias("title"))
    rows = md.nodes(docs, None, units)
    return rows.select("node_id", "node_type", "parent_id", F.array_join("ancestor_ids", ">").alias("ancestors"),
                       F.md5(F.array_join("path", ">")).alias("path"))


@query("metadata_unit_statistics", LEGAL_SQL + r"""
, u as (select doc_id, article_no, 'article' as unit, null as clause_no, '' as t from art where j % 5 = 0
  union all select doc_id, article_no, 'clause', j % 5, piece from art where j % 5 in (1, 2)
  union all select p.doc_id, p.article_no, 'point', 2, p.piece || coalesce(chr(10) || 'Also ' || q.piece, '')
    from art p left join art q on q.doc_id = p.doc_id and q.j = p.j + 1 where p.j % 5 = 3)
select doc_id, cast(article_no as varchar) as article_no, unit, cast(clause_no as varchar) as clause_no,
  len(regexp_extract_all(t, '\S+')) as words, length(t) as chars from u""")
def unit_statistics(spark, folder):
    from lexspan.functions import text as tx

    units = _parts(spark, folder)[1]
    return units.select("doc_id", "article_no", "unit", "clause_no", tx.word_count(F.col("text")).alias("words"),
                        tx.char_count(F.col("text")).alias("chars"))


ROLE_WORDS = [n for _, needles in md.LEGAL_ROLES for n in needles]
TAG_WORDS = [n for _, needles in md.DOMAIN_TAGS for n in needles]


def _worded(spark, folder):
    """Order comments with role and domain words picked by key."""
    orders = table(spark, folder, "orders")
    pick = lambda words, key: F.element_at(F.array(*[F.lit(w) for w in words]), (key % len(words) + 1).cast("int"))
    return orders.select(
        "o_orderkey",
        F.when(F.col("o_orderkey") % 4 == 0, "").otherwise(F.upper(pick(ROLE_WORDS, F.col("o_orderkey")))).alias("title"),
        F.concat("o_orderpriority", F.lit(" "), pick(TAG_WORDS, F.col("o_custkey")), F.lit(" x "),
                 F.when(F.col("o_custkey") % 3 == 0, "").otherwise(pick(TAG_WORDS, F.col("o_orderkey")))).alias("text"),
    )


def _list_sql(words):
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


WORDED = f"""
with w as (select o_orderkey,
  case when o_orderkey % 4 = 0 then '' else upper({_list_sql(ROLE_WORDS)}[o_orderkey % {len(ROLE_WORDS)} + 1]) end as title,
  o_orderpriority || ' ' || {_list_sql(TAG_WORDS)}[o_custkey % {len(TAG_WORDS)} + 1] || ' x '
   || case when o_custkey % 3 = 0 then '' else {_list_sql(TAG_WORDS)}[o_orderkey % {len(TAG_WORDS)} + 1] end as text from orders)
"""
ROLE_CASE = "case " + " ".join(
    f"when {' or '.join(f'contains(h, {chr(39)}{n}{chr(39)})' for n in needles)} then '{role}'" for role, needles in md.LEGAL_ROLES
) + f" else '{md.DEFAULT_ROLE}' end"
TAG_LIST = "[" + ", ".join(
    f"case when {' or '.join(f'contains(h, {chr(39)}{n}{chr(39)})' for n in needles)} then '{tag}' end" for tag, needles in md.DOMAIN_TAGS
) + "]"


@query("metadata_legal_roles", WORDED + f", h as (select o_orderkey, lower(title || ' ' || text) as h from w) select o_orderkey, {ROLE_CASE} as legal_role from h")
def legal_roles(spark, folder):
    return _worded(spark, folder).select("o_orderkey", md.legal_role(F.col("title"), F.col("text")).alias("legal_role"))


@query("metadata_domain_tags", WORDED + f"""
, h as (select o_orderkey, lower(text) as h from w), t as (select o_orderkey, [x for x in {TAG_LIST} if x is not null] as tags from h)
select o_orderkey, case when len(tags) = 0 then '{md.DEFAULT_TAG}' else array_to_string(tags, '|') end as tags from t""")
def domain_tags(spark, folder):
    return _worded(spark, folder).select("o_orderkey", F.array_join(md.domain_tags(F.col("text")), "|").alias("tags"))


@query("metadata_citations", """
with d as (select o_orderkey, ['bo_luat','nghi_dinh','thong_tu','nghi_quyet','an_le','khac'][o_orderkey % 6 + 1] as doc_type,
  o_custkey || '/2020/QH' as number, o_orderkey % 3 as k from orders),
n as (select *, case k when 0 then 'Bộ luật Dân sự' when 1 then 'Văn bản mới' else
  case doc_type when 'bo_luat' then 'Bộ luật' when 'nghi_dinh' then 'Nghị định' when 'nghi_quyet' then 'Nghị quyết' when 'thong_tu' then 'Thông tư' when 'an_le' then 'Án lệ' else doc_type end end as name from d)
select o_orderkey, name || ' (' || number || ')' as citation,
  case doc_type when 'bo_luat' then 'Bộ luật' when 'nghi_dinh' then 'Nghị định' when 'nghi_quyet' then 'Nghị quyết' when 'thong_tu' then 'Thông tư' when 'an_le' then 'Án lệ' else doc_type end || ' số ' || number as citation_short,
  case doc_type when 'bo_luat' then 'statute_code' when 'nghi_dinh' then 'implementation_guidance' when 'nghi_quyet' then 'judicial_guidance' when 'thong_tu' then 'administrative_guidance' when 'an_le' then 'case_law' else 'legal_document' end as document_role,
  name || ', Điều ' || (o_orderkey % 40) || case when o_orderkey % 2 = 0 then ', Khoản 3' else '' end || case when o_orderkey % 4 = 0 then ', Điểm b' else '' end as unit_citation from n""")
def citations(spark, folder):
    key = F.col("o_orderkey")
    kinds = F.array(*[F.lit(t) for t in ("bo_luat", "nghi_dinh", "thong_tu", "nghi_quyet", "an_le", "khac")])
    docs = table(spark, folder, "orders").select(
        "o_orderkey", F.element_at(kinds, (key % 6 + 1).cast("int")).alias("doc_type"),
        F.concat("o_custkey", F.lit("/2020/QH")).alias("number"),
        F.when(key % 3 == 0, "BỘ LUẬT  DÂN SỰ").when(key % 3 == 1, " Văn bản  mới ").alias("title"),
        (key % 40).cast("string").alias("article_no"), F.when(key % 2 == 0, "3").alias("clause_no"),
        F.when(key % 4 == 0, "b").alias("point_id"))
    out = md.document_citations(docs).withColumn("unit_citation", md.unit_citation(F.col("title"), F.col("doc_type")))
    return out.select("o_orderkey", "citation", "citation_short", "document_role", "unit_citation")


@query("metadata_document_fields", f"""
with d as (select doc_id, {PRECEDENT_WORDS} as flat from documents)
select doc_id, case when doc_id % 3 = 0 then 'Tòa án nhân dân tối cao' when doc_id % 3 = 1 then 'Tòa án nhân dân cấp cao tại Hà Nội' else 'Bộ Tư pháp' end as issuer from d""")
def document_fields(spark, folder):
    key = F.col("doc_id")
    docs = table(spark, folder, "documents").select(
        "doc_id", F.when(key % 3 == 2, "thong_tu").otherwise("an_le").alias("doc_type"),
        F.when(key % 3 == 2, "Bộ Tư pháp").alias("issuer"),
        F.when(key % 3 == 0, "Được Hội đồng Thẩm phán Tòa án nhân dân tối cao thông qua").otherwise("không rõ").alias("court"),
        F.when(key % 3 == 1, "Quyết định của Tòa án nhân dân cấp cao tại Hà Nội, ngày 1").alias("source_note"))
    return md.document_metadata(docs).select("doc_id", "issuer")


@query("metadata_references", """
with r as (select o_orderkey, o_custkey, o_orderkey % 4 as k from orders)
select o_orderkey, 1 as ref_no, 'article' as ref_type, 'Điều ' || (o_custkey % 99) || ', Khoản 2' as ref_text, 'Điều ' || (o_custkey % 99) || ', Khoản 2' as normalized_ref from r where k < 2
union all select o_orderkey, 2, 'document', 'Bộ luật Dân sự năm 2015', 'Bộ luật Dân sự năm 2015' from r where k < 2
union all select o_orderkey, 3, 'document', 'Nghị định số ' || (o_custkey % 99) || '/2021/NĐ-CP', 'Nghị định số ' || (o_custkey % 99) || '/2021/NĐ-CP' from r where k < 2
union all select o_orderkey, 1, 'raw', 'không dẫn chiếu ' || o_custkey, 'không dẫn chiếu ' || o_custkey from r where k >= 2""")
def references(spark, folder):
    cust = F.col("o_custkey")
    rows = table(spark, folder, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 4 < 2, F.array(
        F.concat(F.lit("theo Điều "), cust % 99, F.lit(", Khoản 2 Bộ luật Dân sự năm 2015; Nghị định này; Luật ABC")),
        F.concat(F.lit("theo Điều "), cust % 99, F.lit(", Khoản 2 và Nghị định số "), cust % 99, F.lit("/2021/NĐ-CP.")),
    )).otherwise(F.array(F.concat(F.lit(" không dẫn chiếu "), cust), F.concat(F.lit("KHÔNG dẫn chiếu "), cust)))
        .alias("texts"))
    return md.references(rows, ["o_orderkey"], "texts")


EFFECT_SQL = """
with a as (select l_orderkey as doc_id, l_linenumber as n, l_partkey, l_quantity, l_returnflag from lineitem),
e as (select doc_id, n, l_partkey, l_returnflag = 'A' as eff, l_returnflag = 'N' as tr, cast(l_quantity as bigint) % 28 + 1 as dd from a),
d as (select doc_id, min(cast('2020-03-' || lpad(cast(dd as varchar), 2, '0') as varchar)) filter (eff and rn = 1) as eff_date, list_sort(list(distinct 'Nghị định số ' || l_partkey || '/2011/NĐ-CP') filter (eff and l_partkey % 2 = 0)) as repl,
  list(n) filter (tr) as trs from (select *, row_number() over (partition by doc_id, eff order by n, l_partkey * 100 + dd) as rn from e) group by doc_id)
select doc_id, eff_date as effective_from, coalesce(array_to_string(repl, '|'), '') as replaced, least(3, coalesce(len(trs), 0)) as transitions,
  case when coalesce(len(repl), 0) > 0 then 'co_hieu_luc_va_thay_the_van_ban_khac' when eff_date is not null then 'co_ngay_hieu_luc' else 'chua_xac_dinh' end as validity_status,
  case when eff_date is not null then 'parsed_effective_clause' else 'not_found_in_parsed_text' end as validity_basis,
  case when eff_date is not null then 'medium' else 'low' end as validity_confidence from d"""


@query("metadata_validity", EFFECT_SQL)
def validity(spark, folder):
    line = table(spark, folder, "lineitem")
    day = F.col("l_quantity").cast("long") % 28 + 1
    bodies = line.select(
        F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").cast("string").alias("article_no"),
        (F.col("l_partkey") * 100 + day).alias("article_at"),
        F.when(F.col("l_returnflag") == "A", "Hiệu lực thi hành").when(F.col("l_returnflag") == "N", "Quy định chuyển tiếp")
        .otherwise("Khác").alias("article_title"),
        F.concat(F.lit("Văn bản này có hiệu lực kể từ ngày "), day, F.lit(" tháng 3 năm 2020"),
                 F.when(F.col("l_partkey") % 2 == 0, F.concat(F.lit(". Thay thế Nghị định số "), "l_partkey", F.lit("/2011/NĐ-CP")))
                 .otherwise("")).alias("body"))
    docs = line.select(F.col("l_orderkey").alias("doc_id"), F.lit(None).cast("date").alias("effective_on")).distinct()
    out = md.validity(docs, bodies)
    return out.select("doc_id", F.col("effective_from").cast("string").alias("effective_from"),
                      F.array_join("replaced_documents", "|").alias("replaced"),
                      F.size("transition_notes").cast("long").alias("transitions"), "validity_status", "validity_basis",
                      "validity_confidence")


@query("metadata_validity_note", """
select o_orderkey, case when o_orderkey % 4 = 0 then 'het_hieu_luc' when o_custkey % 2 = 0 then 'co_ngay_hieu_luc'
 when o_custkey % 3 = 0 then 'co_thong_tin_sua_doi_bo_sung' else 'chua_xac_dinh' end as note from orders""")
def validity_note(spark, folder):
    status = F.when(F.col("o_orderkey") % 4 == 0, "het_hieu_luc").otherwise("chua_xac_dinh")
    dated = F.when(F.col("o_custkey") % 2 == 0, F.col("o_orderdate"))
    return table(spark, folder, "orders").select(
        "o_orderkey", md.validity_note(status, dated, F.col("o_custkey") % 3 == 0).alias("note"))


@query("metadata_relations", """
select o_orderkey as doc_id, coalesce(case when o_orderkey % 3 <> 0 then 'sua_doi' end, 'related') as relation_type,
  case when o_orderkey % 2 = 0 then 'doc ' || o_custkey when o_orderkey % 5 = 0 then 'no ' || o_custkey end as target_doc,
  case when o_custkey % 2 = 0 then 'n' || o_orderstatus end as note_part,
  nullif(concat_ws(' | ', case when o_custkey % 2 = 0 then 'n' || o_orderstatus end, case when o_custkey % 3 = 0 then 'Luật' end), '') as note,
  'parsed_text' as relation_source
from orders where o_orderkey % 3 <> 0 or o_orderkey % 2 = 0 or o_orderkey % 5 = 0""".replace(
    "  case when o_custkey % 2 = 0 then 'n' || o_orderstatus end as note_part,\n", ""))
def relations(spark, folder):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    rows = table(spark, folder, "orders").select(
        k.alias("doc_id"), F.when(k % 3 != 0, "sua_doi").alias("relation_type"),
        F.when(k % 2 == 0, F.concat(F.lit("doc "), c)).alias("target_doc"),
        F.when(k % 5 == 0, F.concat(F.lit("no "), c)).alias("target_number"),
        F.when(c % 2 == 0, F.concat(F.lit("n"), "o_orderstatus")).alias("note"),
        F.when(c % 3 == 0, "Luật").alias("target_type"))
    return md.normal_relations(rows).select("doc_id", "relation_type", "target_doc", "note", "relation_source")


@query("metadata_validity_override", """
with o as (select o_orderkey, o_orderkey % 2 = 0 and o_custkey % 3 > 0 and o_orderkey % 5 > 0 and o_custkey % 2 = 0 as gate, o_custkey from orders)
select o_orderkey, case when gate then 'dang_co_hieu_luc' else 'co_ngay_hieu_luc' end as validity_status,
  case when gate and o_custkey % 7 > 0 then '2021-05-01' else '2020-01-01' end as effective_from,
  case when gate then 'High' else 'medium' end as validity_confidence from o""")
def validity_override(spark, folder):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    rows = table(spark, folder, "orders").select(
        "o_orderkey", F.lit("co_ngay_hieu_luc").alias("validity_status"), F.lit("2020-01-01").alias("effective_from"),
        F.lit("medium").alias("validity_confidence"),
        F.when(k % 2 == 0, "official_verified").otherwise("local_checksum_only").alias("src_source_verification_status"),
        F.when(c % 3 > 0, "csdl_quoc_gia_vbpl ").otherwise("khac").alias("src_source_of_validity"),
        F.when(k % 5 > 0, F.lit("2026-01-01")).alias("src_validity_checked_at"),
        F.lit("dang_co_hieu_luc").alias("src_validity_status"),
        F.when(c % 2 == 0, "High").otherwise("low").alias("src_validity_confidence"),
        F.when(c % 7 > 0, F.lit("2021-05-01")).alias("src_effective_from"))
    return md.override_validity(rows).select("o_orderkey", "validity_status", "effective_from", "validity_confidence")


@query("metadata_precedents", f"""
with d as (select doc_id, source, {PRECEDENT_WORDS} as flat from documents)
select doc_id, 'Án lệ số ' || doc_id || '/2021/AL' as citation, 'hop_dong' as tags,
  md5(case when length(trim(flat)) <= 400 then trim(flat) else rtrim(substr(trim(flat), 1, 397)) || '...' end) as facts_digest,
  'hợp đồng|' || source as keywords from d where flat <> ''""")
def precedents(spark, folder):
    rows = st.parse_precedents(precedent_texts(spark, folder)).where(F.col("facts") != "")
    # In one pass over the parsed texts.
    worded = md.keyword_metadata(rows, tuple(c for c in rows.columns if c not in ("doc_id", "keywords")))
    meta = md.precedent_metadata(worded, ("keywords",))
    return meta.select("doc_id", "citation", F.array_join("legal_domain_tags", "|").alias("tags"),
                       F.md5("case_law_schema.facts_summary").alias("facts_digest"), F.array_join("keywords", "|").alias("keywords"))
