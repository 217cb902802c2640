"""Source and sink queries: what is written is read back."""

import uuid

from pyspark.sql import functions as F

from lexspan.catalog.registry import query, table
from lexspan.operators import evaluation as ev
from lexspan.session import materialize, scratch_dir
from lexspan.sources import tables as tb


def _folder(spark):
    return f"{scratch_dir(spark)}/lexspan-{uuid.uuid4().hex}"


@query("sources_raw_text", r"""
with p as (select page_id // 4 as doc_id, page_id as page, case when page_id % 7 = 0 then '  ' else regexp_replace(html, '<[^>]*>', ' ', 'g') end as text from pages)
select doc_id, md5(string_agg(text, chr(10) order by page)) as digest from p where trim(regexp_replace(text, '\s', '', 'g')) <> '' group by doc_id""")
def raw_text(spark, folder):
    pages = table(spark, folder, "pages").select(
        (F.col("page_id") / 4).cast("long").alias("doc_id"), F.col("page_id").alias("page"),
        F.when(F.col("page_id") % 7 == 0, "  ").otherwise(F.regexp_replace("html", "<[^>]*>", " ")).alias("text"))
    return tb.raw_text(pages).select("doc_id", F.md5("text").alias("digest"))


@query("sources_typed_walk", """
with d as (select doc_id, ['bo_luat','nghi_dinh','thong_tu','nghi_quyet','an_le','khac'][doc_id % 6 + 1] as doc_type from documents)
select case when doc_type = 'khac' then 'rejected' else 'kept' end as part, doc_type, count(*) as n from d group by 1, 2""")
def typed_walk(spark, folder):
    kinds = F.array(*[F.lit(t) for t in (*tb.DOCUMENT_TYPES[:2], "thong_tu", "nghi_quyet", "an_le", "khac")])
    docs = table(spark, folder, "documents").withColumn("doc_type", F.element_at(kinds, (F.col("doc_id") % 6 + 1).cast("int")))
    kept, rejected = tb.typed(docs)
    count = lambda df, part: df.groupBy("doc_type").agg(F.count("*").alias("n")).select(F.lit(part).alias("part"), "doc_type", "n")
    return count(kept, "kept").unionByName(count(rejected, "rejected"))


@query("sources_error_isolation", """
select case when length(text) < 50 then 'short_text' when lang not in ('en', 'fr') then 'unsupported_language'
 when try_cast(substr(source, 4) as int) > 17 then 'bad_source' else 'success' end as outcome, count(*) as n from documents group by 1""")
def error_isolation(spark, folder):
    docs = table(spark, folder, "documents")
    checked = tb.with_error(docs, {
        "short_text": F.length("text") >= 50,
        "unsupported_language": F.col("lang").isin("en", "fr"),
        "bad_source": F.substring("source", 4, 9).try_cast("int") <= 17,
    })
    return tb.run_stats(checked)


@query("sources_json_artifacts", """
select 'unreadable' as reason, count(*) as n from documents where doc_id % 9 = 0
union all select 'missing chunk_id', count(*) from documents where doc_id % 9 <> 0 and doc_id % 4 = 0
union all select 'usable', count(*) from documents where doc_id % 9 <> 0 and doc_id % 4 <> 0""")
def json_artifacts(spark, folder):
    path = _folder(spark)
    docs = table(spark, folder, "documents")
    record = F.to_json(F.struct(F.when(F.col("doc_id") % 4 != 0, F.col("doc_id").cast("string")).alias("chunk_id"), "text"))
    docs.select(F.when(F.col("doc_id") % 9 == 0, F.substring(record, F.lit(1), F.least(F.lit(30), F.length(record) - 1))).otherwise(record).alias("value")).write.text(path)
    rows = tb.read_json_lists(spark, path, "chunk_id string, text string", lists=False)
    bad = tb.invalid_records(rows).groupBy("reason").agg(F.count("*").alias("n"))
    good = rows.where(F.col(tb.CORRUPT).isNull() & F.col("chunk_id").isNotNull()).agg(F.count("*").alias("n"))
    return bad.unionByName(good.select(F.lit("usable").alias("reason"), "n"))


@query("sources_upsert", """
select c_custkey, case when c_custkey % 3 = 0 then 'NEW' else c_mktsegment end as c_mktsegment from customer
union all select c_custkey + 1000000000, 'ADDED' from customer where c_custkey % 10 = 0""")
def upsert(spark, folder):
    current = table(spark, folder, "customer").select("c_custkey", "c_mktsegment")
    changed = current.where(F.col("c_custkey") % 3 == 0).withColumn("c_mktsegment", F.lit("NEW"))
    added = current.where(F.col("c_custkey") % 10 == 0).select(
        (F.col("c_custkey") + 1000000000).alias("c_custkey"), F.lit("ADDED").alias("c_mktsegment"))
    # Each change comes three times, the middle one last.
    changes = changed.unionByName(added)
    every = changes.withColumn("seq", F.lit(2)).unionByName(changes.withColumns({"c_mktsegment": F.lit("ZZZ"), "seq": F.lit(1)}))
    every = every.unionByName(changes.withColumns({"c_mktsegment": F.lit("AAA"), "seq": F.lit(0)}))
    return tb.upsert(current, every, ["c_custkey"], "seq").select("c_custkey", "c_mktsegment")


@query("sources_replace_by_key", """
select l_orderkey, l_linenumber, l_partkey, l_quantity from lineitem where l_orderkey not in (select o_orderkey from orders where o_custkey % 5 = 0)
union all select o_orderkey, 99, -1, o_totalprice from orders where o_custkey % 10 = 0""")
def replace_by_key(spark, folder):
    line = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    orders = table(spark, folder, "orders")
    touched = orders.where(F.col("o_custkey") % 5 == 0).select(F.col("o_orderkey").alias("l_orderkey"))
    changes = orders.where(F.col("o_custkey") % 10 == 0).select(
        F.col("o_orderkey").alias("l_orderkey"), F.lit(99).alias("l_linenumber"), F.lit(-1).cast("long").alias("l_partkey"),
        F.col("o_totalprice").alias("l_quantity"))
    return tb.replace_by_key(line, changes, "l_orderkey", touched)


@query("sources_points", """
select vec_id, label, case when vec_id % 6 = 0 then 0 else 64 end as size from embeddings where vec_id % 6 <> 0 and label % 2 = 0
union all select vec_id, label, 64 from embeddings where label % 2 = 1 and label >= 0""")
def points(spark, folder):
    vectors = table(spark, folder, "embeddings").select(
        F.col("vec_id"), F.col("label"), F.concat(F.lit("c"), "vec_id").alias("chunk_id"),
        F.concat(F.lit("d"), "label").alias("doc_id"), F.lit("t").alias("text"), "embedding")
    current = tb.points(vectors)[0]
    fresh = vectors.where(F.col("label") % 2 == 0).withColumn(
        "embedding", F.when(F.col("vec_id") % 6 != 0, F.col("embedding")))
    return tb.replace_points(current, fresh).select("vec_id", "label", F.size("embedding").alias("size"))


@query("sources_snapshot", "select vec_id, label, len(embedding) as size from embeddings")
def snapshot(spark, folder):
    root = _folder(spark)
    vectors = table(spark, folder, "embeddings")
    tb.publish_snapshot(vectors.where(F.col("label") < 5), root)
    tb.publish_snapshot(vectors, root, expected_rows=vectors.count())
    return tb.read_snapshot(spark, root).select("vec_id", "label", F.size("embedding").cast("long").alias("size"))


@query("sources_manifest", """
select 'embed' as stage, 'input' as side, 'documents' as path, count(*) as rows, 64 as digest_size, true as same_in_any_order from documents
union all select 'embed', 'output', 'embeddings', count(*), 64, true from embeddings""")
def manifest(spark, folder):
    def side(name):
        rows = table(spark, folder, name)
        digest, again = tb.content_digest(rows), tb.content_digest(rows.repartition(7))
        return rows.agg(F.count("*").alias("rows")).select(F.lit(name if digest == again else "differs").alias("path"), "rows", F.lit(digest).alias("digest"))

    path = tb.write_manifest(tb.manifest("embed", side("documents"), side("embeddings")), _folder(spark), _folder(spark))
    read = spark.read.schema("stage string, side string, path string, rows long, digest string").json(path)
    return read.select("stage", "side", "path", "rows", F.length("digest").alias("digest_size"), (F.col("path") != "differs").alias("same_in_any_order"))


@query("sources_table_copy", """
select 'region' as "table", count(*) as rows from region union all select 'nation', count(*) from nation
union all select 'customer', count(*) from customer union all select 'orders', count(*) from orders""")
def table_copy(spark, folder):
    frames = {name: table(spark, folder, name) for name in ("region", "nation", "customer", "orders")}
    return tb.write_copies(spark, frames, _folder(spark)).select("table", "rows")


REPORT_SQL = """
with m as (select event_type, user_id, avg(value) / 100 as v, count(*) as n from events group by 1, 2),
r as (select event_type as dataset_name, count(*) as total_cases, avg(case when v >= 0.25 then 1.0 else 0.0 end) as pass_rate, avg(v) as average_score from m group by 1)
select dataset_name, '# Evaluation Report: ' || dataset_name as line from r
union all select dataset_name, '' from r union all select dataset_name, '' from r union all select dataset_name, '' from r
union all select dataset_name, '## Aggregate Metrics' from r union all select dataset_name, '## Case Results' from r
union all select dataset_name, '- Total cases: ' || total_cases from r
union all select dataset_name, format('- Pass rate: {:.2f}%', pass_rate * 100) from r
union all select dataset_name, format('- Average score: {:.3f}', average_score) from r
union all select dataset_name, format('- mrr: {:.3f}', average_score) from r
union all select event_type, '' from m
union all select event_type, '### u' || user_id || case when v >= 0.25 then ' [PASS]' else ' [FAIL]' end from m
union all select event_type, '- Query: q' || user_id from m
union all select event_type, format('- Score: {:.3f}', v) from m
union all select event_type, '- Notes:' from m where n % 2 = 0
union all select event_type, '  - even' from m where n % 2 = 0"""


@query("sources_report_markdown", REPORT_SQL)
def report_markdown(spark, folder):
    # A mean of doubles depends on the order of the additions: it is that of the events here, whatever the tasks.
    means = materialize(ev.ordered_means(table(spark, folder, "events"), ("event_type", "user_id"), "value", ("event_id", "ts", "value")))
    cases = means.withColumn("score", F.col("mean") / 100).select(
        F.col("event_type").alias("dataset_name"), F.col("user_id").alias("case_no"), F.concat(F.lit("u"), "user_id").alias("case_id"),
        F.concat(F.lit("q"), "user_id").alias("query"), "score", F.coalesce(F.col("score") >= 0.25, F.lit(False)).alias("passed"),
        F.when(F.col("n") % 2 == 0, F.array(F.lit("even"))).otherwise(F.array().cast("array<string>")).alias("notes"))
    reports = cases.groupBy("dataset_name").agg(
        F.count("*").alias("total_cases"), F.avg(F.col("passed").cast("double")).alias("pass_rate"),
        F.avg("score").alias("average_score"))
    metrics = reports.select("dataset_name", F.lit("mrr").alias("metric"), F.col("average_score").alias("value"))
    return tb.report_lines(reports, metrics, cases).select("dataset_name", "line")


@query("sources_registry_file", """
select row_number() over (partition by p_partkey // 100 order by p_partkey) - 1 as idx, 'd' || p_partkey as doc_id, p_brand as aliases from part""")
def registry_file(spark, folder):
    """A registry file for each hundred parts, every other one a bare list."""
    path = _folder(spark)
    entry = F.struct("p_partkey", F.concat(F.lit("d"), "p_partkey").alias("doc_id"), F.array("p_brand").alias("aliases"))
    lists = table(spark, folder, "part").groupBy(F.floor(F.col("p_partkey") / 100).alias("g")).agg(F.sort_array(F.collect_list(entry)).alias("documents"))
    value = F.when(F.col("g") % 2 == 0, F.to_json("documents")).otherwise(F.to_json(F.struct("documents")))
    lists.select(value.alias("value")).write.option("maxRecordsPerFile", 1).text(path)
    rows = tb.read_registry(spark, path, "doc_id string, aliases array<string>")
    return rows.select(F.col("idx").cast("long").alias("idx"), "doc_id", F.array_join("aliases", "|").alias("aliases"))


@query("sources_evaluation_set", """
select event_type || user_id // 100 as dataset_name, row_number() over (partition by event_type, user_id // 100 order by user_id) - 1 as case_no, 'u' || user_id as case_id, 'q' || user_id as query
from (select distinct event_type, user_id from events) l""")
def evaluation_set(spark, folder):
    """A file for each set of up to a hundred users, with a byte-order mark, cases in order."""
    path = _folder(spark)
    cases = table(spark, folder, "events").select("event_type", "user_id").distinct()
    case = F.struct("user_id", F.concat(F.lit("u"), "user_id").alias("case_id"), F.concat(F.lit("q"), "user_id").alias("query"))
    name = F.concat("event_type", F.floor(F.col("user_id") / 100).cast("string")).alias("dataset_name")
    sets = cases.groupBy(name).agg(F.sort_array(F.collect_list(case)).alias("cases"))
    lines = sets.select(F.concat(F.lit("\ufeff"), F.to_json(F.struct("dataset_name", "cases"))).alias("value"))
    lines.write.option("maxRecordsPerFile", 1).text(path)
    rows = tb.read_eval_set(spark, path, "case_id string, query string")
    return rows.select("dataset_name", F.col("case_no").cast("long").alias("case_no"), "case_id", "query")


@query("sources_report_json", """
with m as (select event_type, user_id, round(avg(value), 6) as v from events group by 1, 2)
select event_type as dataset_name, 'case' as part, 'u' || user_id as id, v as score from m
union all select event_type, 'summary', cast(count(*) as varchar), round(avg(v), 6) from m group by 1""")
def report_json(spark, folder):
    cases = table(spark, folder, "events").groupBy(F.col("event_type").alias("dataset_name"), "user_id").agg(F.round(F.avg("value"), 6).alias("score")).select(
        "dataset_name", F.col("user_id").alias("case_no"), F.concat(F.lit("u"), "user_id").alias("case_id"), F.concat(F.lit("q"), "user_id").alias("query"),
        "score", (F.col("score") >= 25).alias("passed"), F.array().cast("array<string>").alias("notes"))
    reports = cases.groupBy("dataset_name").agg(
        F.count("*").alias("total_cases"), F.avg(F.col("passed").cast("double")).alias("pass_rate"), F.avg("score").alias("average_score"))
    metrics = reports.select("dataset_name", F.lit("mrr").alias("metric"), F.round("average_score", 6).alias("value"))
    path = _folder(spark)
    tb.report_json(reports, metrics, cases).write.parquet(path)
    parsed = spark.read.parquet(path).withColumn("j", F.from_json("json", "case_id string, total_cases long, score double, metrics map<string,double>"))
    return parsed.select("dataset_name", "part", F.coalesce("j.case_id", F.col("j.total_cases").cast("string")).alias("id"), F.coalesce("j.score", F.col("j.metrics")["mrr"]).alias("score"))
