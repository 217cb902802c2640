"""Pages to documents, units and chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexspan.operators import chunking as ck
from lexspan.operators import cleaning as cl
from lexspan.operators import governance as gv
from lexspan.operators import metadata as md
from lexspan.operators import structure as st
from lexspan.sources import tables as tb


def documents_from_pages(pages: DataFrame, types: DataFrame) -> DataFrame:
    """Raw documents with the fields guessed from their text.

    `pages`: doc_id, page, text. `types`: doc_id, doc_type and provenance.
    """
    raw, kind = F.col("text"), F.col("doc_type")
    return tb.raw_text(pages).join(types, "doc_id").withColumns({
        "number": st.official_number(raw), "title": st.title_guess(raw), "issued_on": st.issued_on(raw),
        "effective_on": st.effective_on(raw), "issuer": st.issuer_guess(raw, kind),
    })


def statutes(docs: DataFrame, pages: DataFrame | None = None) -> dict[str, DataFrame]:
    """Statutes (`doc_id, doc_type, text, title, number, effective_on`) to their tables."""
    statute = docs.where(F.col("doc_type") != "an_le")
    lines = st.parse_lines(statute, ("doc_type",))
    outlined = st.outline(lines)
    units = cl.clean_fields(st.units(outlined), ["article_title", "text"])
    if pages is not None:
        units = st.attach_locations(units, pages)
    titles = cl.clean_fields(statute.select("doc_id", "doc_type", "title", "number", "effective_on"), ["title"])
    validity = md.validity(titles, md.article_bodies(units))
    forms = cl.clean_fields(st.appendix_forms(lines), ["form_name", "content"])
    return {
        "lines": lines, "units": units, "nodes": md.nodes(titles, outlined, units), "forms": forms,
        "documents": md.document_citations(validity), "basis": st.legal_basis(lines),
    }


def precedents(docs: DataFrame) -> DataFrame:
    return cl.clean_precedents(st.parse_precedents(docs.where(F.col("doc_type") == "an_le").select("doc_id", "text")))


def chunk_table(tables: dict[str, DataFrame], cases: DataFrame | None = None, registry: DataFrame | None = None,
                provenance: DataFrame | None = None) -> DataFrame:
    """Chunks with document metadata, roles and citations; official fields on top."""
    forms = tables["forms"].withColumn("form_no", F.row_number().over(
        st.Window.partitionBy("doc_id").orderBy("form_no")))
    chunks = ck.chunk_documents(tables["units"], forms, cases)
    doc = tables["documents"].select(
        "doc_id", "doc_type", "title", "number", "document_role", F.col("effective_from").cast("string").alias("effective_from"),
        F.col("effective_to").cast("string").alias("effective_to"), "validity_status", "validity_basis", "validity_confidence",
        "source_of_validity", "replaced_documents", "transition_notes")
    rows = chunks.join(doc.withColumn("doc_id", F.col("doc_id").cast("string")), "doc_id", "left")
    role = md.legal_role(F.coalesce("article_title", F.lit("")), F.col("text"))
    point = rows.withColumn("point_id", F.lit(None).cast("string"))
    named = point.withColumns({
        "citation": F.coalesce(md.unit_citation(F.col("title"), F.col("doc_type")), F.col("title")),
        "legal_role": F.coalesce("legal_role", role), "legal_domain_tags": md.domain_tags(F.concat_ws(" ", "article_title", "text")),
    })
    sound, _ = ck.reject_duplicates(named)
    if registry is None or provenance is None:
        return sound
    with_source = sound.join(provenance, "doc_id", "left")
    return gv.enrich_candidates(with_source, registry)
