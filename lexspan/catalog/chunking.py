"""Chunks of documents and of derived statutes and precedents."""

from pyspark.sql import functions as F

from lexspan.catalog.corpus import LEGAL_SQL, legal_texts
from lexspan.catalog.registry import query, table
from lexspan.catalog.structure import PRECEDENT_WORDS, precedent_texts
from lexspan.operators import chunking as ck
from lexspan.operators import structure as st
from lexspan.session import materialize

HEAD_SQL = LEGAL_SQL + """
, hd as (select doc_id, j, string_split(piece, ' ')[1] as first from body),
ca as (select a.*, c.first as chapter_word, h.piece as article_title from art a
  join hd c on c.doc_id = a.doc_id and c.j = (chapter_no - 1) * 30 join body h on h.doc_id = a.doc_id and h.j = (article_no - 1) * 5),
clause as (select c.doc_id, c.chapter_no, c.chapter_word, c.article_no, c.article_title, c.j % 5 as k,
  'Chương ' || c.chapter_no || ' (Part of ' || c.chapter_word || ') - Điều ' || c.article_no || ' (' || c.article_title || ') - Khoản ' || (c.j % 5) || '. ' || c.piece
  || case when c.j % 5 = 2 then coalesce(chr(10) || '  Điểm a) ' || p.piece || coalesce(chr(10) || 'Also ' || q.piece, ''), '') else '' end as text
  from ca c left join body p on p.doc_id = c.doc_id and p.j = c.j + 1 left join body q on q.doc_id = c.doc_id and q.j = c.j + 2 where c.j % 5 in (1, 2))
"""


def _units(spark, folder):
    return st.units(st.outline(st.parse_lines(legal_texts(spark, folder), ("doc_type",))))


@query("chunking_recursive_split")
def recursive_split(spark, folder):
    docs = table(spark, folder, "documents")
    parts = docs.select("doc_id", F.posexplode(ck.parts_of(F.col("text"))).alias("part_no", "part"))
    return parts.select("doc_id", "part_no", F.length("part").alias("chars"), F.md5("part").alias("digest"))


@query("chunking_split_properties", """
select doc_id, true as within_size, true as in_order, true as whole from documents where text is not null and regexp_matches(text, '[^\\s]')""")
def split_properties(spark, folder):
    """Of every text: no part is longer than the size and the last gap, parts stand in it in order, and no word is missing."""
    docs = table(spark, folder, "documents").where("text rlike '[^\\\\s]'")
    parts = docs.withColumn("parts", ck.parts_of(F.col("text")))
    bare = lambda c: F.regexp_replace(c, r"[.]+$", "")
    words = lambda c: F.array_distinct(F.transform(F.split(F.trim(F.regexp_replace(c, r"\s+", " ")), " "), bare))
    # Each part must stand in what follows the start of the part before it.
    step = lambda left, part: F.when(F.contains(left, bare(part)), F.substring(left, F.instr(left, bare(part)), F.length(left)))
    in_order = F.aggregate("parts", F.col("text"), step).isNotNull()
    return parts.select(
        "doc_id",
        F.forall("parts", lambda part: F.length(part) <= ck.CHUNK_SIZE + 2).alias("within_size"),
        in_order.alias("in_order"),
        (F.size(F.array_except(words(F.col("text")), words(F.array_join("parts", " ")))) == 0).alias("whole"),
    )


@query("chunking_clauses", HEAD_SQL + """
select doc_id || '_dieu_' || article_no || '_khoan_' || k as chunk_id, cast(doc_id as varchar) as doc_id, md5(text) as digest,
 doc_id || '_khoan_' || article_no || '_' || k as node_id, doc_id || '_dieu_' || article_no as parent_id,
 doc_id || '_dieu_' || article_no || '_intro' as parent_chunk_id, 'Chuong ' || chapter_no || ': Part of ' || chapter_word || ' - Dieu ' || article_no || '. ' || article_title as parent_context,
 1 as chunk_part, 1 as chunk_parts from clause""")
def clauses(spark, folder):
    return ck.clause_chunks(_units(spark, folder)).select(
        "chunk_id", "doc_id", F.md5("text").alias("digest"), "node_id", "parent_id", "parent_chunk_id", "parent_context",
        "chunk_part", "chunk_parts")


@query("chunking_article_intros", LEGAL_SQL + """
select doc_id || '_dieu_' || article_no || '_intro' as chunk_id, 'Điều ' || article_no || '. ' || piece || chr(10) || 'Intro ' || article_no as text from art where j % 5 = 0 and article_no % 2 = 0""")
def article_intros(spark, folder):
    units = _units(spark, folder).withColumn("text", F.when(
        (F.col("unit") == "article") & (F.col("article_no").cast("int") % 2 == 0), F.concat(F.lit("Intro "), "article_no"))
        .otherwise(F.col("text")))
    return ck.article_chunks(units).select("chunk_id", "text")


@query("chunking_appendix", LEGAL_SQL + """
select doc_id || '_phuluc_1_p1' as chunk_id, 'Danh mục / Quy định chung' || chr(10) || 'Phụ lục I Form list ' || doc_id as text, 'appendix_form' as legal_role from docs""")
def appendix(spark, folder):
    forms = st.appendix_forms(st.parse_lines(legal_texts(spark, folder)))
    return ck.appendix_chunks(forms.withColumn("form_no", F.col("form_no") + 1)).select("chunk_id", "text", "legal_role")


@query("chunking_precedents", f"""
with d as (select doc_id, {PRECEDENT_WORDS} as flat from documents)
select doc_id || '_tinh_huong' as chunk_id, 'case_issue' as legal_role, md5(trim(flat)) as digest from d where flat <> ''
union all select doc_id || '_giai_phap', 'case_holding', md5(trim(regexp_replace('phải ' || flat, ' +', ' ', 'g'))) from d where flat <> ''
union all select doc_id || '_trich_dan_p1', 'case_reasoning', md5(trim('“[2] ' || substr(flat, 1, 100)) || ' hết.”') from d where flat <> ''""")
def precedents(spark, folder):
    rows = ck.precedent_chunks(st.parse_precedents(precedent_texts(spark, folder)).where(F.col("facts") != ""))
    kept = rows.where(~F.col("legal_role").isin("case_facts", "case_summary"))
    return kept.select("chunk_id", "legal_role", F.md5("text").alias("digest"))


@query("chunking_merged_metadata", """
select o_orderkey, case when o_orderkey % 2 = 0 then 'n' || o_custkey else c_mktsegment end as tag, c_name as title from orders join customer on c_custkey = o_custkey""")
def merged_metadata(spark, folder):
    orders = table(spark, folder, "orders")
    chunks = orders.select("o_orderkey", F.col("o_custkey").cast("string").alias("doc_id"), F.col("o_orderkey").cast("string").alias("node_id"))
    docs = table(spark, folder, "customer").select(
        F.col("c_custkey").alias("doc_id"), F.col("c_mktsegment").alias("tag"), F.col("c_name").alias("title"))
    nodes = orders.select(F.col("o_orderkey").cast("string").alias("node_id"),
                          F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("n"), "o_custkey")).alias("tag"))
    return ck.merge_metadata(chunks, docs, nodes).select("o_orderkey", "tag", "title")


@query("chunking_duplicate_guard", """
with d as (select l_orderkey as doc_id, l_orderkey || '_' || l_linenumber as chunk_id, count(*) as n from lineitem group by 1, 2 having count(*) > 1)
select doc_id, count(*) as duplicates, array_to_string(list_sort(list(chunk_id))[1:10], '|') as sample from d group by doc_id""")
def duplicate_guard(spark, folder):
    chunks = table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("doc_id"), F.concat_ws("_", "l_orderkey", "l_linenumber").alias("chunk_id"))
    failed = ck.reject_duplicates(chunks)[1]
    return failed.select("doc_id", "duplicates", F.array_join("sample", "|").alias("sample"))


@query("chunking_all_kinds", HEAD_SQL + """
select 'khoan' as node_type, count(*) as nodes from clause union all select 'phu_luc', count(*) from docs
union all select 'case_section', 5 * count(*) from documents where trim(regexp_replace(lower(text), '[^a-z]+', ' ', 'g')) <> ''""")
def all_kinds(spark, folder):
    # Parsed once: forms and units read the same lines, articles and clauses the same units.
    lines = materialize(st.parse_lines(legal_texts(spark, folder), ("doc_type",)))
    forms = st.appendix_forms(lines)
    units = materialize(st.units(st.outline(lines)))
    cases = st.parse_precedents(precedent_texts(spark, folder)).where(F.col("facts") != "")
    rows = ck.chunk_documents(units, forms.withColumn("form_no", F.col("form_no") + 1), cases)
    return rows.groupBy("node_type").agg(F.countDistinct("node_id").alias("nodes"))
