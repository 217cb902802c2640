"""Inventories and validators over whole tables."""

from pyspark.sql import functions as F

from lexspan.catalog.corpus import LEGAL_SQL, legal_texts
from lexspan.catalog.registry import query, table
from lexspan.catalog.structure import PRECEDENT_WORDS, precedent_texts
from lexspan.operators import hashtree as ht
from lexspan.operators import integrity as ig
from lexspan.operators import structure as st


@query("integrity_inventory", """
with r as (select case when l_suppkey % 17 = 0 then null else l_orderkey || '_' || l_linenumber end as id from lineitem),
c as (select id, count(*) as n from r where id is not null group by id)
select (select sum(n) from c)::bigint as row_count, (select count(*) from c) as unique_ids,
 (select count(*) from c where n > 1) as duplicate_ids, (select count(*) from r where id is null) as invalid_records""")
def inventory(spark, folder):
    rows = table(spark, folder, "lineitem").select(
        F.when(F.col("l_suppkey") % 17 != 0, F.concat_ws("_", "l_orderkey", "l_linenumber")).alias("chunk_id"))
    return ig.inventory(rows)


@query("integrity_id_digest", """
with d as (select distinct l_orderkey || '_' || l_linenumber as item from lineitem),
b as (select substr(sha256(item), 1, 2) as bucket, sha256(string_agg(item, chr(10) order by item)) as digest from d group by 1),
c as (select substr(bucket, 1, 1) as bucket, sha256(string_agg(bucket || ':' || digest, chr(10) order by bucket)) as digest from b group by 1)
select sha256(string_agg(bucket || ':' || digest, chr(10) order by bucket)) as digest from c""")
def id_digest(spark, folder):
    rows = table(spark, folder, "lineitem").select(F.concat_ws("_", "l_orderkey", "l_linenumber").alias("id"))
    return ig.id_digest(rows, "id")


@query("integrity_duplicate_ids", """
select l_orderkey || '_' || l_linenumber as chunk_id, count(*) as n from lineitem group by 1 having count(*) > 1""")
def duplicate_ids(spark, folder):
    return ig.duplicate_ids(table(spark, folder, "lineitem").select(F.concat_ws("_", "l_orderkey", "l_linenumber").alias("chunk_id")))


@query("integrity_set_difference", """
select coalesce(d.doc_id, l.doc_id) as doc_id, case when l.doc_id is null then 'missing' else 'orphan' end as side
from documents d full join (select case when doc_id % 3 = 0 then -1 - doc_id else doc_id end as doc_id from labels) l on l.doc_id = d.doc_id
where l.doc_id is null or d.doc_id is null""")
def set_difference(spark, folder):
    labels = table(spark, folder, "labels").select(
        F.when(F.col("doc_id") % 3 == 0, -1 - F.col("doc_id")).otherwise(F.col("doc_id")).alias("doc_id"))
    return ig.set_difference(table(spark, folder, "documents"), labels, "doc_id")


@query("integrity_consistency", """
select (select count(distinct o_orderkey) from orders) as left_ids, (select count(distinct l_orderkey) from lineitem) as right_ids,
 (select count(*) from orders where o_orderkey not in (select l_orderkey from lineitem)) as missing,
 (select count(distinct l_orderkey) from lineitem where l_orderkey not in (select o_orderkey from orders)) as orphan,
 (select count(*) from (select l_orderkey from lineitem group by 1 having count(*) > 1)) as duplicates,
 false as is_consistent""")
def consistency(spark, folder):
    orders = table(spark, folder, "orders").select(F.col("o_orderkey").alias("k"))
    return ig.consistency(orders, table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("k")), "k")


@query("integrity_snapshot_consistency", """
select count(*) as left_ids, count(*) as right_ids, 0 as missing, 0 as orphan, 0 as duplicates, true as is_consistent from embeddings""")
def snapshot_consistency(spark, folder):
    from lexspan.catalog.sources import _folder
    from lexspan.sources import tables as tb

    root = _folder(spark)
    vectors = table(spark, folder, "embeddings")
    tb.publish_snapshot(vectors, root)
    return ig.consistency(vectors, tb.read_snapshot(spark, root), "vec_id")


@query("integrity_file_fingerprints")
def file_fingerprints(spark, folder):
    return ig.file_fingerprints(spark, folder).select(F.element_at(F.split("path", "/"), -1).alias("path"), "sha256")


@query("integrity_parsed_documents", LEGAL_SQL + """
, a as (select doc_id, article_no from art where j % 5 = 0 and not (article_no % 7 = 3)),
c as (select doc_id, count(*) as found, max(article_no) - min(article_no) + 1 - count(*) as missing from a group by doc_id),
lastj as (select doc_id, max(j) as mj from body group by doc_id)
select doc_id, 'unknown_number' as issue, null as detail from docs where doc_id % 4 = 0
union all select doc_id, 'no_issuer', null from docs where doc_id % 3 = 0
union all select doc_id, 'article_count_differs', cast(found as varchar) from c join (select doc_id, count(*) filter (j % 5 = 0) as n from body group by doc_id) t using (doc_id) where n <> found
union all select doc_id, 'missing_articles', cast(missing as varchar) from c where missing > 0
union all select a.doc_id, 'hollow_articles', '1' from a join lastj l using (doc_id) where l.mj = (a.article_no - 1) * 5""")
def parsed_documents(spark, folder):
    docs = legal_texts(spark, folder)
    units = st.units(st.outline(st.parse_lines(docs, ("doc_type",))))
    clauses = units.where(F.col("unit") == "clause").groupBy("doc_id", "article_at").agg(
        F.count("*").alias("clauses"), F.max_by("text", "clause_at").alias("last_clause"))
    articles = units.where((F.col("unit") == "article") & (F.col("article_no").cast("int") % 7 != 3)).join(
        clauses, ["doc_id", "article_at"], "left").select(
        "doc_id", "article_no", "article_title", "article_at", "text", F.coalesce("clauses", F.lit(0)).alias("clauses"),
        F.coalesce("last_clause", "text").alias("tail_text"))
    declared = ((F.col("n_pieces") - 1 + 4) / 5).cast("long")
    parents = docs.select(
        "doc_id", F.when(F.col("doc_id") % 4 != 0, "1/2019").otherwise("unknown").alias("number"), F.lit("Title").alias("title"),
        F.lit("2019-01-05").cast("date").alias("issued_on"), F.when(F.col("doc_id") % 3 != 0, "QUỐC HỘI").alias("issuer"),
        declared.alias("declared_articles"))
    return ig.parsed_document_issues(parents, articles)


@query("integrity_number_gaps", LEGAL_SQL + """
, a as (select doc_id, article_no as no, lead(article_no) over (partition by doc_id order by article_no) as nx from art where j % 5 = 0 and not (article_no % 7 = 3))
select doc_id, no + 1 as first_missing, nx - 1 as last_missing from a where nx - no > 1""")
def number_gaps(spark, folder):
    units = st.units(st.outline(st.parse_lines(legal_texts(spark, folder), ("doc_type",))))
    return ig.number_gaps(units.where((F.col("unit") == "article") & (F.col("article_no").cast("int") % 7 != 3)))


@query("integrity_parsed_precedents", f"""
with d as (select doc_id, source, {PRECEDENT_WORDS} as flat from documents)
select doc_id, 'no_facts' as issue from d where flat = ''
union all select doc_id, 'truncated_provision' from d
union all select doc_id, 'short_keyword' from d where length(source) < 3""")
def parsed_precedents(spark, folder):
    return ig.parsed_precedent_issues(st.parse_precedents(precedent_texts(spark, folder)))


@query("integrity_cleaned_text", r"""
with f as (select doc_id, 'text' as field, text from documents union all select doc_id, 'title', replace(text, '.', ' . Trang 12') from documents)
select doc_id, field, 'double_blank' as issue from f where contains(text, '  ')
union all select doc_id, field, 'page_label' from f where regexp_matches(text, 'trang\s+\d+', 'i')
union all select doc_id, field, 'english_page_label' from f where regexp_matches(text, 'page\s+\d+', 'i')
union all select doc_id, field, 'blank_before_punctuation' from f where regexp_matches(text, '\s+[.,;:]')""")
def cleaned_text(spark, folder):
    docs = table(spark, folder, "documents").withColumn(
        "title", F.replace(F.col("text"), F.lit("."), F.lit(" . Trang 12")))
    return ig.cleaned_text_issues(ig.text_fields(docs, ["doc_id"], ["text", "title"]), ["doc_id"])


@query("integrity_metadata_checks", """
select case when l_linenumber % 2 = 0 then 'dieu' else 'document' end as node_type,
 sum(case when l_suppkey % 19 = 0 then 0 else (case when l_returnflag <> 'A' then 1 else 0 end) + (case when l_linestatus <> 'F' then 1 else 0 end) + 1
   + (case when l_linenumber % 2 = 0 and l_partkey % 5 > 0 then 1 else 0 end) end)::bigint as passed,
 sum(case when l_suppkey % 19 = 0 then 1 else (case when l_returnflag = 'A' then 1 else 0 end) + (case when l_linestatus = 'F' then 1 else 0 end)
   + (case when l_linenumber % 2 = 0 and l_partkey % 5 = 0 then 1 else 0 end) end)::bigint as failed from lineitem group by 1""")
def metadata_checks(spark, folder):
    rows = table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("doc_id"), F.when(F.col("l_linenumber") % 2 == 0, "dieu").otherwise("document").alias("node_type"),
        (F.col("l_suppkey") % 19 != 0).alias("has_metadata"), F.when(F.col("l_returnflag") != "A", "c").alias("citation"),
        F.when(F.col("l_linestatus") != "F", "rule").alias("legal_role"), F.lit("n").alias("node_id"),
        F.when(F.col("l_partkey") % 5 > 0, 1).alias("words"))
    return ig.metadata_checks(rows).groupBy("node_type").agg(F.sum("passed").alias("passed"), F.sum("failed").alias("failed"))


@query("integrity_document_metadata_checks", """
select o_orderkey as doc_id, 3 + (case when o_orderkey % 2 = 0 then 1 else 0 end) + (case when o_custkey % 3 > 0 or o_orderkey % 5 = 0 then 1 else 0 end) as passed,
 2 - (case when o_orderkey % 2 = 0 then 1 else 0 end) - (case when o_custkey % 3 > 0 or o_orderkey % 5 = 0 then 1 else 0 end) as failed,
 case when o_custkey % 2 = 0 then 2 else 0 end as warnings from orders""")
def document_metadata_checks(spark, folder):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    x = F.when(c % 2 != 0, "x")
    docs = table(spark, folder, "orders").select(
        k.alias("doc_id"), F.lit("1").alias("number"), F.when(k % 2 == 0, "c").alias("citation"), F.lit("v").alias("validity_status"),
        F.array().alias("related_documents"), F.when(c % 3 > 0, "bo_luat").otherwise("an_le").alias("doc_type"),
        F.when(k % 5 == 0, F.array(F.lit("k"))).alias("keywords"), F.lit("s").alias("source_verification_status"),
        x.alias("source_checksum_sha256"), F.lit("s").alias("source_of_validity"), x.alias("validity_basis"), F.lit("h").alias("validity_confidence"))
    return ig.document_metadata_checks(docs)


@query("integrity_chunk_checks", """
with c as (select source as doc_type, case when doc_id % 13 = 0 then 'missing' when doc_id % 7 = 0 then 'nocit' when doc_id % 5 = 0 then 'norole' end as failure, length(text) as n from documents)
select doc_type, count(*) filter (failure is null) as passed, count(failure) as failed, count(*) filter (failure is null and n > 2500) as warnings from c group by 1""")
def chunk_checks(spark, folder):
    k = F.col("doc_id")
    chunks = table(spark, folder, "documents").select(
        F.when(k % 13 != 0, k.cast("string")).alias("chunk_id"), "doc_id", "text", F.lit("n").alias("number"), F.col("source").alias("doc_type"),
        F.when(k % 7 != 0, "c").alias("citation"), F.when(k % 5 != 0, "r").alias("legal_role"))
    return ig.chunk_check_counts(chunks)


@query("integrity_vector_checks", """
select count(*) filter (label < 8) as passed, count(*) filter (label >= 8) as failed, count(*) filter (label < 2) as wrong_size from embeddings""")
def vector_checks(spark, folder):
    vectors = table(spark, folder, "embeddings").withColumn(
        "embedding", F.when(F.col("label") < 2, F.slice("embedding", 1, 10)).when(F.col("label") < 8, F.col("embedding")))
    return ig.vector_checks(vectors, 64)


@query("integrity_snapshot_health", "select count(*) as points, count(*) as readable, 0 as wrong_size, 'ok' as status from embeddings")
def snapshot_health(spark, folder):
    return ig.snapshot_health(table(spark, folder, "embeddings").withColumn("text", F.lit("x")), 64)


def _tree_sql(depths: int = 6) -> str:
    """The digest of a canonical tree of `p` (item, path), stated level by level."""
    out = [f"n{depths} as (select substr(path, 1, {depths}) as prefix, sha256(string_agg(item, chr(10) order by item)) as digest from p group by 1)"]
    for d in range(depths - 1, -1, -1):
        out.append(f"""k{d} as (select substr(path, 1, {d}) as prefix, count(*) as n from p group by 1),
n{d} as (select substr(path, 1, {d}) as prefix, sha256(string_agg(item, chr(10) order by item)) as digest from p where substr(path, 1, {d}) in (select prefix from k{d} where n <= {ht.CAPACITY}) group by 1
 union all select substr(prefix, 1, {d}), sha256(string_agg(prefix || ':' || digest, chr(10) order by prefix)) from n{d + 1} where substr(prefix, 1, {d}) in (select prefix from k{d} where n > {ht.CAPACITY}) group by 1)""")
    return ",\n".join(out)


@query("integrity_tree_digest", "with p as (select item, sha256(item) as path from (select distinct l_orderkey || '_' || l_linenumber as item from lineitem)),\n" + _tree_sql() + "\nselect digest from n0")
def tree_digest(spark, folder):
    """Digest of the ids by a tree whose depth follows from a fixed leaf size."""
    rows = table(spark, folder, "lineitem").select(F.concat_ws("_", "l_orderkey", "l_linenumber").alias("id"))
    return ht.build(rows, "id").root()


@query("integrity_tree_difference", """
select coalesce(d.id, l.id) as id, case when l.id is null then 'missing' else 'orphan' end as side
from (select distinct cast(doc_id as varchar) as id from documents) d
full join (select distinct cast(case when doc_id % 3 = 0 then -1 - doc_id else doc_id end as varchar) as id from labels) l on l.id = d.id
where l.id is null or d.id is null""")
def tree_difference(spark, folder):
    """Ids on one side only, from two stored trees."""
    labels = table(spark, folder, "labels").select(F.when(F.col("doc_id") % 3 == 0, -1 - F.col("doc_id")).otherwise(F.col("doc_id")).alias("id"))
    only, _ = ht.difference(ht.build(table(spark, folder, "documents"), "doc_id"), ht.build(labels, "id"))
    return only.select(F.col("item").alias("id"), "side")
