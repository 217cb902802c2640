"""Questions to evidence over a chunk table, as one lazy plan per stage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexspan.operators import analysis as an
from lexspan.operators import lexical as lx
from lexspan.operators import ranking as rk
from lexspan.operators import temporal as tp
from lexspan.operators import vectors as vc
from lexspan.session import materialize

QUERY_FIELDS = (
    "raw_query", "normalized_query", "request_type", "year_hint", "q_year", "historical", "citation_targets", "key_phrases",
    "keywords", "scenario_terms", "source_priority", "insufficient_facts", "c_articles", "c_clauses", "c_docs", "c_types",
)


def prepare(questions: DataFrame, terms: DataFrame | None = None) -> DataFrame:
    """Questions (`query_id, raw_query`) to intents with constraints and time."""
    asked = an.exact_constraints(an.analyse(questions), terms)
    return asked.withColumns({"q_year": an.query_year(), "historical": an.wants_history()})


def retrieve(queries: DataFrame, chunks: DataFrame, index: DataFrame, targets: DataFrame, today_year: Column) -> DataFrame:
    """Routed retrievers, fallback, anchors and fusion: one row per candidate.

    `queries` with a `vector` column also use vector search over `chunks.embedding`.
    """
    routed = rk.routed(queries)
    lexical = lx.lexical_top(routed.where("use_lexical"), chunks, index, today_year)
    metadata = materialize(rk.metadata_top(routed.where("use_metadata"), chunks, today_year))
    frames = [
        rk.long_scores(lexical, "lexical", ["lexical", "bm25"]), rk.long_scores(metadata, "metadata", ["metadata"]),
    ]
    if "vector" in queries.columns and "embedding" in chunks.columns:
        skip = ~F.col("request_type").isin("validity_question", "case_law_question")
        probes = routed.where("request_type <> 'out_of_scope'").select("query_id", "vector", skip.alias("skip_expired"))
        hits = vc.cosine_top_k(probes, chunks, rk.TOP).withColumnRenamed("score", "vector")
        # The time filter follows the cut, so fewer than k may stay.
        times = chunks.select("chunk_id", "validity_status", "effective_from", "effective_on", "effective_to")
        dated = hits.join(times, "chunk_id").join(routed.select("query_id", "q_year", "historical", "year_hint", "use_vector"), "query_id")
        current = (tp.state(F.col("q_year"), today_year) != "expired") | F.col("historical")
        kept = materialize(dated.where(current & tp.within_year_hint()))
        frames.append(rk.long_scores(kept.where("use_vector"), "vector", ["vector"]))
        frames.append(rk.vector_fallback(routed, rk.union_all(frames), kept.where("not use_vector").select("query_id", "chunk_id", "vector", "rank")))
    inside = targets.where(F.col("request_type") != "out_of_scope")
    frames.append(rk.long_scores(rk.explicit_anchors(inside, chunks), "exact_target", ["metadata", "exact_target"]))
    return materialize(rk.merge_scores(rk.union_all(frames)))


def with_fields(pairs: DataFrame, queries: DataFrame, chunks: DataFrame) -> DataFrame:
    """Candidates with the fields of their chunk and question."""
    fields = [c for c in chunks.columns if c not in pairs.columns or c == "chunk_id"]
    asked = queries.select("query_id", *[c for c in QUERY_FIELDS if c in queries.columns])
    return pairs.join(chunks.select(*[c for c in fields if c != "embedding"]), "chunk_id").join(asked, "query_id")


def rank(pairs: DataFrame, queries: DataFrame, chunks: DataFrame, targets: DataFrame, today_year: Column,
         k: int = rk.CANDIDATES, features: bool = True) -> DataFrame:
    """Filters, fusion, two reranks with one-hop expansion, and the final order."""
    rerank = rk.feature_rerank if features else rk.deterministic_rerank
    rows = with_fields(pairs, queries, chunks)
    rows = materialize(rows)
    kept = rk.filter_exact_precedents(rk.filter_exact_lookups(rows, targets))
    scores = kept.select(*pairs.columns)
    fused = materialize(rk.fuse(scores))
    order = [F.desc(F.round("hybrid", 9)), F.col("chunk_id")]
    first = rk.top_by(fused, ["query_id"], order, rk.FIRST_CAP).drop("rank")
    initial = materialize(rk.diversify(rerank(with_fields(first, queries, chunks)), max(k, rk.MIN_FIRST)))
    more = rk.expand(initial, chunks)
    sources = fused.join(more, ["query_id", "chunk_id"], "full_outer") if "cross_ref" not in fused.columns else fused.drop("cross_ref").join(
        more, ["query_id", "chunk_id"], "full_outer")
    both = sources.withColumns({
        "hybrid": F.coalesce("hybrid", "cross_ref", F.lit(0.0)),
        "sources": F.when(F.col("cross_ref").isNotNull(), an.union(F.coalesce("sources", an.strings()), an.strings(("cross_ref",)))).otherwise(F.col("sources")),
    })
    final = rk.top_by(both, ["query_id"], order, rk.FINAL_CAP).drop("rank")
    ranked = materialize(rk.diversify(rerank(with_fields(final, queries, chunks)), k))
    ranked = tp.resolve_conflicts(ranked, today_year)
    ranked = rk.promote_precedent(rk.cover_targets(rk.cover_sources(ranked), targets))
    return rk.display(rk.attach_parents(ranked, chunks))


def search(questions: DataFrame, chunks: DataFrame, index: DataFrame, today_year: Column, terms: DataFrame | None = None,
           k: int = rk.CANDIDATES) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Questions to (intents, ranked candidates, evidence)."""
    queries = materialize(prepare(questions, terms))
    targets = materialize(an.target_constraints(queries, terms))
    ranked = materialize(rank(retrieve(queries, chunks, index, targets, today_year), queries, chunks, targets, today_year, k))
    return queries, ranked, rk.evidence(ranked)
