"""Statute-shaped texts derived from `documents`, in Spark and in SQL.

Each document's own words are cut into pieces of eight and laid out as a
preamble, chapters, sections, articles, clauses, points, a signature block and
an appendix. The SQL side keeps the pieces as rows, so it states what a parse
must return without parsing anything.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexspan.catalog.registry import table
from lexspan.functions.text import let

PIECE = 8
TYPES = ("bo_luat", "nghi_dinh", "thong_tu", "nghi_quyet", "an_le")
ISSUED, EFFECTIVE = "2010-01-01", "2012-01-01"


def pieces(text: Column) -> Column:
    words = F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))
    return let(words, lambda w: F.when(
        F.size(w) > 0,
        F.transform(
            F.sequence(F.lit(0), F.ceil(F.size(w) / PIECE).cast("int") - 1),
            lambda i: F.array_join(F.slice(w, i * PIECE + 1, F.lit(PIECE)), " "),
        ),
    ).otherwise(F.array().cast("array<string>")))


def _line(piece: Column, j: Column) -> Column:
    """Layout of body piece `j` (0-based); a clause wraps after its first word."""
    chapter = (j / 30).cast("int") + 1
    section = ((j % 30) / 15).cast("int") + 1
    article = (j / 5).cast("int") + 1
    first = F.substring_index(piece, " ", 1)
    rest = F.substring(piece, F.length(first) + 2, F.length(piece))
    head = F.concat(
        F.when(j % 30 == 0, F.concat(F.lit("Chương "), chapter, F.lit(". Part of "), first, F.lit("\n"))).otherwise(""),
        F.when(j % 15 == 0, F.concat(F.lit("Mục "), section, F.lit(". Group "), first, F.lit("\n"))).otherwise(""),
    )
    body = (
        F.when(j % 5 == 0, F.concat(F.lit("Điều "), article, F.lit(". "), piece))
        .when((j % 5 == 1) | (j % 5 == 2), F.concat(j % 5, F.lit(". "), first, F.when(rest != "", F.concat(F.lit("\n  "), rest)).otherwise("")))
        .when(j % 5 == 3, F.concat(F.lit("a) "), piece))
        .otherwise(F.concat(F.lit("Also "), piece))
    )
    return F.concat(head, body)


def legal_texts(spark: SparkSession, folder: str) -> DataFrame:
    """`doc_id, doc_type, text, n_pieces` for every document."""
    docs = table(spark, folder, "documents")
    key = F.col("doc_id").cast("string")
    kind = F.element_at(F.array(*[F.lit(t) for t in TYPES]), (F.col("doc_id") % 5 + 1).cast("int"))
    parts = F.col("parts")
    body = F.transform(F.slice(parts, 2, F.size(parts)), _line)
    month = F.lpad((F.col("doc_id") % 12 + 1).cast("string"), 2, "0")
    text = F.concat_ws(
        "\n",
        F.concat(F.lit("Số: "), key, F.lit("/2019/NĐ-CP")),
        F.concat(F.lit("Hà Nội, ngày 05 tháng "), month, F.lit(" năm 2019")),
        F.concat(F.lit("Căn cứ "), F.get(parts, 0), F.lit(";")),
        F.concat(F.lit("Theo đề nghị "), F.substring_index(F.get(parts, 0), " ", 2), F.lit(";")),
        F.array_join(body, "\n"),
        F.lit("Nơi nhận: Archive."),
        F.concat(F.lit("Phụ lục I\nForm list "), key),
    )
    return docs.select("doc_id", kind.alias("doc_type"), pieces(F.col("text")).alias("parts")).where(
        F.size(parts) > 1
    ).select("doc_id", "doc_type", text.alias("text"), F.size(parts).cast("long").alias("n_pieces"))


LEGAL_SQL = rf"""
with w as (select doc_id, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+') as words from documents),
p as (select doc_id, [array_to_string(words[i * {PIECE} + 1 : i * {PIECE} + {PIECE}], ' ')
        for i in range(cast(ceil(len(words) / {PIECE}.0) as bigint))] as parts from w),
docs as (select doc_id, parts, len(parts) as n_pieces, ['bo_luat','nghi_dinh','thong_tu','nghi_quyet','an_le'][doc_id % 5 + 1] as doc_type
         from p where len(parts) > 1),
body as (select doc_id, doc_type, unnest(parts[2:]) as piece, unnest(range(len(parts) - 1)) as j from docs),
art as (select *, j // 30 + 1 as chapter_no, (j % 30) // 15 + 1 as section_no, j // 5 + 1 as article_no from body)
"""


# ---- chunks and questions -----------------------------------------------------
# Four documents make one parent document; fields follow from the numbers.
ROLES = ("definition", "principle", "scope", "rights_obligations", "condition_exception", "rule")


def chunk_rows(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    k = F.col("doc_id")
    d = F.floor(k / 4).cast("long")
    pick = lambda items, i: F.element_at(F.array(*[F.lit(x) for x in items]), (i % len(items) + 1).cast("int"))
    kind = pick(TYPES, d)
    article = k % 4 + 1
    clause = F.when(k % 4 > 0, (k % 3 + 1).cast("string"))
    head = lambda kind_: pick(("Luật Hiệu lực thi hành", "Luật Thế chấp tài sản", "Luật Giao dịch giả tạo", "Quy tắc chung"), kind_)
    return docs.select(
        F.concat(F.lit("c"), F.lpad(k.cast("string"), 8, "0")).alias("chunk_id"),
        F.concat(F.lit("d"), d).alias("doc_id"), "text", kind.alias("doc_type"),
        F.when(kind == "an_le", "case_law").when(kind == "bo_luat", "statute_code").otherwise("guidance").alias("document_role"),
        F.concat(d, F.lit("/2019/NĐ-CP")).alias("number"), F.concat(F.lit("Văn bản "), "source").alias("title"),
        article.cast("string").alias("article_no"), head(k).alias("article_title"), F.col("lang").alias("chapter_title"),
        clause.alias("clause_no"), F.lit(None).cast("string").alias("part_kind"),
        F.concat(F.lit("Văn bản "), "source", F.lit(", Điều "), article, F.coalesce(F.concat(F.lit(", Khoản "), clause), F.lit(""))).alias("citation"),
        pick(ROLES, k).alias("legal_role"),
        pick(("het_hieu_luc", "dang_co_hieu_luc", "co_ngay_hieu_luc", "chua_xac_dinh", "dang_co_hieu_luc"), d).alias("validity_status"),
        F.when(d % 3 > 0, F.concat(2000 + d % 28, F.lit("-01-01"))).alias("effective_from"),
        F.when(d % 6 == 0, F.concat(2010 + d % 20, F.lit("-12-31"))).alias("effective_to"),
        F.lit(None).cast("string").alias("effective_on"),
        F.concat(F.lit("n"), k).alias("node_id"), F.when(k % 4 == 0, "dieu").otherwise("khoan").alias("node_type"),
        F.when(k % 4 > 0, F.concat(F.lit("n"), k - k % 4)).alias("parent_id"),
        F.concat(F.lit("c"), F.lpad((k - k % 4).cast("string"), 8, "0")).alias("parent_chunk_id"),
        F.when(k % 5 == 0, F.array(F.concat(d + 1, F.lit("/2019/NĐ-CP")))).otherwise(F.array().cast("array<string>")).alias("replaced_documents"),
        F.when(k % 3 == 0, F.array(F.struct(F.lit("sua_doi").alias("relation_type"), F.concat(d + 2, F.lit("/2019/NĐ-CP")).alias("target_doc"))))
        .otherwise(F.array().cast("array<struct<relation_type:string,target_doc:string>>")).alias("related_documents"),
        F.when(k % 9 == 0, F.array(F.concat(F.lit("note "), k))).otherwise(F.array().cast("array<string>")).alias("transition_notes"),
    )


CHUNKS_SQL = """
ch as (select doc_id as k, 'c' || lpad(cast(doc_id as varchar), 8, '0') as chunk_id, 'd' || (doc_id // 4) as doc_id, text, source, lang,
 ['bo_luat','nghi_dinh','thong_tu','nghi_quyet','an_le'][(doc_id // 4) % 5 + 1] as doc_type,
 case (doc_id // 4) % 5 when 4 then 'case_law' when 0 then 'statute_code' else 'guidance' end as document_role,
 (doc_id // 4) || '/2019/NĐ-CP' as number, 'Văn bản ' || source as title, cast(doc_id % 4 + 1 as varchar) as article_no,
 ['Luật Hiệu lực thi hành','Luật Thế chấp tài sản','Luật Giao dịch giả tạo','Quy tắc chung'][doc_id % 4 + 1] as article_title, lang as chapter_title,
 case when doc_id % 4 > 0 then cast(doc_id % 3 + 1 as varchar) end as clause_no,
 'Văn bản ' || source || ', Điều ' || (doc_id % 4 + 1) || case when doc_id % 4 > 0 then ', Khoản ' || (doc_id % 3 + 1) else '' end as citation,
 ['definition','principle','scope','rights_obligations','condition_exception','rule'][doc_id % 6 + 1] as legal_role,
 ['het_hieu_luc','dang_co_hieu_luc','co_ngay_hieu_luc','chua_xac_dinh','dang_co_hieu_luc'][(doc_id // 4) % 5 + 1] as validity_status,
 case when (doc_id // 4) % 3 > 0 then 2000 + (doc_id // 4) % 28 end as start_year, case when (doc_id // 4) % 6 = 0 then 2010 + (doc_id // 4) % 20 end as end_year
 from documents)
"""


def question_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Intents made from the benchmark texts, one of each request type in turn."""
    items = table(spark, folder, "benchmark")
    k = F.col("item_id")
    kinds = ("citation_lookup", "validity_question", "case_law_question", "scenario_application", "general_legal_question")
    words = F.filter(F.split(F.lower("text"), r"[^\p{L}]+"), lambda w: F.length(w) > 2)
    empty = F.array().cast("array<string>")
    return items.select(
        F.concat(F.lit("q"), F.lpad(k.cast("string"), 6, "0")).alias("query_id"), F.col("text").alias("raw_query"),
        F.trim(F.regexp_replace("text", r"\s+", " ")).alias("normalized_query"),
        F.element_at(F.array(*[F.lit(x) for x in kinds]), (k % 5 + 1).cast("int")).alias("request_type"),
        F.when(k % 4 == 3, (2005 + k % 20).cast("string")).alias("year_hint"),
        F.array_distinct(words).alias("keywords"),
        F.array(F.array_join(F.slice(words, 1, 2), " "), F.when(k % 3 == 0, "giả tạo").otherwise("hiệu lực")).alias("key_phrases"),
        F.when(k % 5 == 3, F.array(F.array_join(F.slice(words, 3, 2), " "))).otherwise(empty).alias("scenario_terms"),
        F.when(k % 3 == 1, F.array(F.concat(F.lit("Văn bản src"), k % 20, F.lit(", Điều "), k % 4 + 1))).otherwise(empty).alias("citation_targets"),
        F.array(F.trim(F.regexp_replace("text", r"\s+", " "))).alias("query_variants"),
        F.array(*[F.lit(x) for x in ("bo_luat", "nghi_quyet", "nghi_dinh", "an_le")]).alias("source_priority"),
        F.when(k % 2 == 0, F.array(F.lit("nghi_dinh"))).otherwise(empty).alias("source_preference"),
        F.when(k % 6 == 0, F.array(F.lit("rule"))).otherwise(empty).alias("legal_roles"),
        (k % 10 == 8).alias("insufficient_facts"),
        F.when(k % 4 == 3, (2005 + k % 20).cast("int")).alias("q_year"), (k % 4 == 3).alias("historical"),
        F.when(k % 3 == 1, F.array((k % 4 + 1).cast("string"))).otherwise(empty).alias("c_articles"),
        empty.alias("c_clauses"), empty.alias("c_docs"), empty.alias("c_types"),
    )


QUESTIONS_SQL = r"""
qs as (select item_id as k, 'q' || lpad(cast(item_id as varchar), 6, '0') as query_id, trim(regexp_replace(text, '\s+', ' ', 'g')) as normalized_query,
 ['citation_lookup','validity_question','case_law_question','scenario_application','general_legal_question'][item_id % 5 + 1] as request_type,
 case when item_id % 4 = 3 then 2005 + item_id % 20 end as q_year, item_id % 4 = 3 as historical,
 [w for w in string_split_regex(lower(text), '[^\p{L}]+') if length(w) > 2] as words from benchmark),
qq as (select *, words as kw, [array_to_string(words[1:2], ' '), case when k % 3 = 0 then 'giả tạo' else 'hiệu lực' end] as key_phrases,
 case when k % 5 = 3 then [array_to_string(words[3:4], ' ')] else []::varchar[] end as scenario_terms,
 case when k % 3 = 1 then ['Văn bản src' || (k % 20) || ', Điều ' || (k % 4 + 1)] else []::varchar[] end as citation_targets from qs)
"""
TODAY = 2026
