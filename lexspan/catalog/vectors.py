"""Vector queries over `embeddings` and `documents`."""

from pyspark.sql import functions as F

from lexspan.catalog.corpus import TODAY
from lexspan.catalog.registry import ORACLES, query, table
from lexspan.operators import balls as bl
from lexspan.operators import temporal as tp
from lexspan.operators import vectors as vc

COSINE = "round(list_cosine_similarity(cast(a.embedding as double[]), cast(b.embedding as double[])), 9)"


@query("vectors_reuse", """
select vec_id, case when vec_id % 3 = 0 or label = 4 or vec_id % 7 = 0 then 0 else 64 end as size from embeddings""")
def reuse(spark, folder):
    old = table(spark, folder, "embeddings").select(
        F.col("vec_id").alias("chunk_id"), F.concat(F.lit("t"), F.when(F.col("vec_id") % 3 == 0, "old").otherwise("")).alias("text"),
        F.when(F.col("label") != 4, F.col("embedding")).alias("embedding"))
    chunks = table(spark, folder, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.lit("t").alias("text"))
    rows = vc.reuse_embeddings(chunks, old.where(F.col("chunk_id") % 7 != 0))
    return rows.select(F.col("chunk_id").alias("vec_id"), F.coalesce(F.size("embedding"), F.lit(0)).alias("size"))


@query("vectors_embed_missing", """
select count(*) as expected, count(*) as embedded, true as complete from documents where text <> ''""")
def embed_missing(spark, folder):
    docs = table(spark, folder, "documents").select(
        F.col("doc_id").alias("chunk_id"), "text", F.lit(None).cast("array<float>").alias("embedding"))
    return vc.completeness(vc.embed_missing(docs, vc.hashing_embedder()))


@query("vectors_completeness", """
select count(*) filter (vec_id % 11 > 0) as expected, count(*) filter (vec_id % 11 > 0 and label < 7) as embedded, false as complete from embeddings""")
def completeness(spark, folder):
    rows = table(spark, folder, "embeddings").select(
        F.when(F.col("vec_id") % 11 > 0, "x").otherwise("").alias("text"), F.when(F.col("label") < 7, F.col("embedding")).alias("embedding"))
    return vc.completeness(rows)


@query("vectors_cosine_top_k", f"""
with s as (select a.vec_id as query_id, b.vec_id, {COSINE} as score from embeddings a, embeddings b where not (a.label % 2 = 0 and b.label = 3)),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s)
select query_id, vec_id, round(score, 6) as score, rank from r where rank <= 10""")
def cosine_top_k(spark, folder):
    vectors = table(spark, folder, "embeddings")
    queries = vectors.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"), (F.col("label") % 2 == 0).alias("skip_expired"))
    chunks = vectors.withColumn("validity_status", F.when(F.col("label") == 3, "het_hieu_luc"))
    return vc.cosine_top_k(queries, chunks, 10, "vec_id").withColumn("score", F.round("score", 6)).withColumn("rank", F.col("rank").cast("long"))


@query("vectors_top_k_then_filter", f"""
with s as (select a.vec_id as query_id, b.vec_id, b.label, {COSINE} as score from embeddings a, embeddings b),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s)
select query_id, vec_id, rank from r where rank <= 16 and label <> 5""")
def top_k_then_filter(spark, folder):
    """The time filter runs after the cut, so a query may keep fewer than k."""
    vectors = table(spark, folder, "embeddings")
    queries = vectors.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    hits = vc.cosine_top_k(queries, vectors, 16, "vec_id")
    current = vectors.where(F.col("label") != 5).select("vec_id")
    return hits.join(current, "vec_id").select("query_id", "vec_id", F.col("rank").cast("long").alias("rank"))


@query("vectors_smoke_search", """
with s as (select vec_id, round(list_cosine_similarity(cast(embedding as double[]), [0.5::double for x in range(64)]), 9) as score from embeddings),
r as (select *, row_number() over (order by score desc, vec_id) as rank from s)
select vec_id, round(score, 6) as score, rank from r where rank <= 2""")
def smoke_search(spark, folder):
    rows = vc.smoke_search(table(spark, folder, "embeddings"), 64, 2, "vec_id")
    return rows.select("vec_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query("vectors_query_text", """
select conv_id, turn, case when turn % 3 = 0 then text else text || ' ; ' || role end as query_text from conversations""")
def query_text(spark, folder):
    turns = table(spark, folder, "conversations")
    variants = F.when(F.col("turn") % 3 == 0, F.array().cast("array<string>")).otherwise(F.array("text", "role"))
    return turns.select("conv_id", "turn", vc.query_text(variants, F.col("text")).alias("query_text"))


@query("vectors_ball_top_k", ORACLES["vectors_cosine_top_k"])
def ball_top_k(spark, folder):
    """The same rows as `vectors_cosine_top_k`, over a stored ball partition."""
    vectors = table(spark, folder, "embeddings")
    queries = vectors.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"), (F.col("label") % 2 == 0).alias("skip_expired"))
    chunks = vectors.withColumn("validity_status", F.when(F.col("label") == 3, "het_hieu_luc"))
    hits, _ = bl.search(queries, bl.build(chunks, "vec_id"), 10)
    return hits.select("query_id", "vec_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query("vectors_top_k_in_time", f"""
with v as (select *, case label % 4 when 0 then 'het_hieu_luc' when 1 then 'dang_co_hieu_luc' else 'chua_xac_dinh' end as status,
  case when vec_id % 3 > 0 then 2000 + vec_id % 30 end as start_year, case when vec_id % 4 = 0 then 2012 + vec_id % 18 end as end_year from embeddings),
s as (select a.vec_id as query_id, case when a.vec_id % 2 = 0 then 2005 + a.vec_id % 20 end as q_year, a.vec_id % 7 = 0 as historical,
  b.vec_id, b.status, b.start_year, b.end_year, {COSINE} as score from embeddings a, v b),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s)
select query_id, vec_id, rank from r where rank <= 16
  and (historical or not (status = 'het_hieu_luc' or (coalesce(start_year, 0) <= coalesce(q_year, {TODAY}) and coalesce(end_year, 9999) < coalesce(q_year, {TODAY}))))
  and (q_year is null or (coalesce(end_year, 9999) >= q_year and coalesce(start_year, 0) <= q_year))""")
def top_k_in_time(spark, folder):
    """Validity is looked at after the cut, as of the question's year, so a query may keep fewer than k."""
    vectors, id_ = table(spark, folder, "embeddings"), F.col("vec_id")
    status = F.element_at(F.array(*[F.lit(s) for s in ("het_hieu_luc", "dang_co_hieu_luc", "chua_xac_dinh", "chua_xac_dinh")]), F.col("label") % 4 + 1)
    year = lambda test, value, day: F.when(test, F.concat(value.cast("string"), F.lit(day)))
    times = vectors.select(
        "vec_id", status.alias("validity_status"), year(id_ % 3 > 0, 2000 + id_ % 30, "-01-01").alias("effective_from"),
        F.lit(None).cast("string").alias("effective_on"), year(id_ % 4 == 0, 2012 + id_ % 18, "-12-31").alias("effective_to"))
    asked_year = F.when(id_ % 2 == 0, (2005 + id_ % 20).cast("int"))
    queries = vectors.select(
        id_.alias("query_id"), F.col("embedding").alias("vector"), asked_year.alias("q_year"), asked_year.cast("string").alias("year_hint"), (id_ % 7 == 0).alias("historical"))
    hits, _ = bl.search(queries, bl.build(vectors, "vec_id"), 16)
    dated = hits.join(times, "vec_id").join(queries.drop("vector"), "query_id")
    current = (tp.state(F.col("q_year"), F.lit(TODAY)) != "expired") | F.col("historical")
    return dated.where(current & tp.within_year_hint()).select("query_id", "vec_id", F.col("rank").cast("long").alias("rank"))
