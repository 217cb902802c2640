"""Registry queries: parts are the registry, line items the documents to check."""

from pyspark.sql import functions as F

from lexspan.catalog.registry import query, table
from lexspan.operators import governance as gv

REGISTRY_SQL = """
with reg as (select p_partkey as idx, case when p_partkey % 11 = 0 then null when p_partkey % 13 = 0 then 'd' || (p_partkey - 1) else 'd' || p_partkey end as doc_id,
  'f/' || (p_partkey % 1500) as source_file, case when p_partkey % 3 > 0 then sha256(p_name || p_partkey) end as source_checksum_sha256,
  p_brand as source_name, case when p_partkey % 7 > 0 then 'https://x/' || p_partkey end as source_url,
  case when p_size % 5 > 0 then '2026-07-28' end as source_verified_at,
  case when p_partkey % 2 = 0 then 'official_verified' else 'local_checksum_only' end as source_verification_status,
  case when p_size % 3 > 0 then 'csdl_quoc_gia_vbpl' when p_size % 2 = 0 then 'x' end as source_of_validity, 'dang_co_hieu_luc' as validity_status,
  'registry' as validity_basis, case when p_partkey % 5 > 0 then 'HIGH' else 'low' end as validity_confidence, '2026-07-01' as validity_checked_at,
  case when p_size % 4 > 0 then '2017-01-01' end as effective_from, cast(null as varchar) as effective_to, cast(null as varchar) as repeal_reason from part),
src_ok as (select idx, source_checksum_sha256 is not null and source_url is not null and source_verified_at is not null as ok,
  source_verification_status = 'official_verified' and coalesce(source_of_validity, '') = 'csdl_quoc_gia_vbpl' and validity_confidence = 'HIGH' as valid from reg),
items as (select l_orderkey, l_linenumber, l_partkey, l_suppkey, case when l_suppkey % 3 = 0 then 'd' || l_partkey else 'none' end as doc_id,
  case when l_suppkey % 3 = 1 then 'f/' || l_partkey else '' end as source_file,
  case when l_suppkey % 3 = 2 or l_suppkey % 2 = 0 then sha256(p_name || p_partkey) else 'zz' end as source_checksum_sha256,
  'local_checksum_only' as source_verification_status, cast(null as varchar) as validity_status, cast(null as varchar) as effective_from
  from lineitem join part on p_partkey = l_partkey),
m as (select i.*, least((select min(idx) from reg r where r.doc_id = i.doc_id), (select min(idx) from reg r where r.source_file = i.source_file),
  (select min(idx) from reg r where r.source_checksum_sha256 = i.source_checksum_sha256)) as entry from items i),
s as (select m.*, r.source_name as rn, r.source_verification_status as rs, r.validity_status as rv, r.effective_from as rf, o.ok, o.valid,
  case when entry is null then 'not_found' when r.source_checksum_sha256 is not null and r.source_checksum_sha256 <> m.source_checksum_sha256 then 'checksum_mismatch'
   when r.source_verification_status = 'official_verified' and not o.ok then 'incomplete_official_evidence' else 'matched' end as status
  from m left join reg r on r.idx = m.entry left join src_ok o on o.idx = m.entry)
"""


def registry_of(spark, folder):
    part = table(spark, folder, "part")
    k, size = F.col("p_partkey"), F.col("p_size")
    none = F.lit(None).cast("string")
    return part.select(
        k.alias("idx"),
        F.when(k % 11 == 0, none).when(k % 13 == 0, F.concat(F.lit("d"), k - 1)).otherwise(F.concat(F.lit("d"), k)).alias("doc_id"),
        F.concat(F.lit("f/"), k % 1500).alias("source_file"),
        F.when(k % 3 > 0, F.sha2(F.concat("p_name", k.cast("string")), 256)).alias("source_checksum_sha256"),
        F.col("p_brand").alias("source_name"),
        F.when(k % 7 > 0, F.concat(F.lit("https://x/"), k)).alias("source_url"),
        F.when(size % 5 > 0, F.lit("2026-07-28")).alias("source_verified_at"),
        F.when(k % 2 == 0, "official_verified").otherwise("local_checksum_only").alias("source_verification_status"),
        F.when(size % 3 > 0, "csdl_quoc_gia_vbpl").when(size % 2 == 0, "x").alias("source_of_validity"),
        F.lit("dang_co_hieu_luc").alias("validity_status"), F.lit("registry").alias("validity_basis"),
        F.when(k % 5 > 0, "HIGH").otherwise("low").alias("validity_confidence"),
        F.lit("2026-07-01").alias("validity_checked_at"),
        F.when(size % 4 > 0, "2017-01-01").alias("effective_from"),
        none.alias("effective_to"), none.alias("repeal_reason"),
    )


def items_of(spark, folder):
    line, part = table(spark, folder, "lineitem"), table(spark, folder, "part").select("p_partkey", "p_name")
    s = F.col("l_suppkey")
    return line.join(part, F.col("l_partkey") == F.col("p_partkey")).select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        F.when(s % 3 == 0, F.concat(F.lit("d"), "l_partkey")).otherwise("none").alias("doc_id"),
        F.when(s % 3 == 1, F.concat(F.lit("f/"), "l_partkey")).otherwise("").alias("source_file"),
        F.when((s % 3 == 2) | (s % 2 == 0), F.sha2(F.concat("p_name", F.col("p_partkey").cast("string")), 256))
        .otherwise("zz").alias("source_checksum_sha256"),
        F.lit("local_checksum_only").alias("source_verification_status"),
    )


KEYS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


@query("governance_first_match", REGISTRY_SQL + "select l_orderkey, l_linenumber, l_partkey, l_suppkey, entry as entry_idx from m")
def first_match(spark, folder):
    return gv.first_match(items_of(spark, folder), registry_of(spark, folder)).select(*KEYS, "entry_idx")


@query("governance_match_status", REGISTRY_SQL + "select status as source_registry_status, count(*) as n from s group by status")
def match_status(spark, folder):
    rows = gv.apply_registry(items_of(spark, folder), registry_of(spark, folder))
    return rows.groupBy("source_registry_status").agg(F.count("*").alias("n"))


@query("governance_overlay", REGISTRY_SQL + """
select l_orderkey, l_linenumber, l_partkey, l_suppkey, case when status = 'matched' then rn end as source_name,
 case when status = 'matched' then rs else source_verification_status end as source_verification_status,
 case when status = 'matched' and valid then rv end as validity_status, case when status = 'matched' and valid then rf end as effective_from from s""")
def overlay(spark, folder):
    rows = gv.apply_registry(items_of(spark, folder), registry_of(spark, folder))
    return rows.select(*KEYS, "source_name", "source_verification_status", "validity_status", "effective_from")


@query("governance_audit", REGISTRY_SQL + """
select idx, doc_id, 'missing_doc_id' as code from reg where doc_id is null
union all select idx, doc_id, 'duplicate_doc_id' from reg r where exists (select 1 from reg q where q.doc_id = r.doc_id and q.idx < r.idx)
union all select idx, doc_id, 'incomplete_official_source' from reg join src_ok using (idx) where source_verification_status = 'official_verified' and not ok
union all select idx, doc_id, 'incomplete_official_validity' from reg join src_ok using (idx) where source_verification_status = 'official_verified' and not valid""")
def audit(spark, folder):
    return gv.audit_registry(registry_of(spark, folder))


@query("governance_registry_gate", REGISTRY_SQL + """
, issues as (select 'missing_doc_id' as code from reg where doc_id is null
union all select 'duplicate_doc_id' from reg r where exists (select 1 from reg q where q.doc_id = r.doc_id and q.idx < r.idx)
union all select 'incomplete_official_source' from reg join src_ok using (idx) where source_verification_status = 'official_verified' and not ok
union all select 'incomplete_official_validity' from reg join src_ok using (idx) where source_verification_status = 'official_verified' and not valid
union all select 'empty_source_registry' from (select count(*) as c from reg) where c = 0)
select code, count(*) as n from issues group by code""")
def registry_gate(spark, folder):
    return gv.registry_gate(registry_of(spark, folder)).groupBy("code").agg(F.count("*").alias("n"))


@query("governance_review_queue", REGISTRY_SQL + """
select doc_id, status as source_registry_status, count(*) as n from s
where not (status = 'matched' and rs = 'official_verified') group by 1, 2""")
def review_queue(spark, folder):
    rows = gv.review_queue(gv.apply_registry(items_of(spark, folder), registry_of(spark, folder)))
    return rows.groupBy("doc_id", "source_registry_status").agg(F.count("*").alias("n"))


@query("governance_provenance", """
select 'doc_' || doc_id as doc_id, source || '/doc_' || doc_id || '.TXT' as source_file, 'txt' as source_format,
  sha256(text) as source_checksum_sha256, 'local_checksum_only' as source_verification_status from documents""")
def provenance(spark, folder):
    docs = table(spark, folder, "documents")
    files = docs.select(
        F.concat(F.lit("file:/data/raw/"), "source", F.lit("/doc_"), "doc_id", F.lit(".TXT")).alias("path"),
        F.encode("text", "UTF-8").alias("content"))
    return gv.provenance(files, "/data/raw").drop("source_url", "source_verified_at")


@query("governance_enrich_candidates", REGISTRY_SQL + """
, c as (select doc_id, case when l_suppkey % 4 = 0 then null else source_registry_status end as source_registry_status from (select *, status as source_registry_status from s))
select source_registry_status, count(*) as n from c group by 1""")
def enrich_candidates(spark, folder):
    none = F.lit(None).cast("string")
    hide = F.col("l_suppkey") % 4 == 0
    items = items_of(spark, folder).withColumn("source_file", F.when(hide, none).otherwise(F.col("source_file"))).withColumn(
        "source_checksum_sha256", F.when(hide, none).otherwise(F.col("source_checksum_sha256")))
    rows = gv.enrich_candidates(items, registry_of(spark, folder))
    return rows.groupBy("source_registry_status").agg(F.count("*").alias("n"))
