"""Chunks of statutes, appendices and precedents."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from functools import reduce
from itertools import accumulate

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexspan.functions import text as tx

# ---- fixed values ---------------------------------------------------------
CHUNK_SIZE, CHUNK_OVERLAP = 1500, 200
SEPARATORS = ("\n\n", "\n", ". ", " ", "")
# section column, id part, section name, unit type, role, split long text?
PRECEDENT_PARTS = (
    ("issue", "tinh_huong", "tinh_huong_phap_ly", "an_le_tinh_huong", "case_issue", False),
    ("summary", "khai_quat", "khai_quat_noi_dung", "an_le_khai_quat", "case_summary", False),
    ("holding", "giai_phap", "giai_phap_phap_ly", "an_le_giai_phap", "case_holding", False),
    ("reasoning", "trich_dan", "an_le_trich_dan", "an_le_trich_dan", "case_reasoning", True),
    ("facts", "vu_an", "noi_dung_vu_an", "an_le_vu_an", "case_facts", True),
)
# ---------------------------------------------------------------------------


def _spans(text: str, separator: str) -> list[tuple[int, int]]:
    """Where the pieces between separators lie; single characters without a separator."""
    if not separator:
        return [(i, i + 1) for i in range(len(text))]
    stops = [m.start() for m in re.finditer(re.escape(separator), text)]
    return list(zip([0, *(at + len(separator) for at in stops)], [*stops, len(text)], strict=True))


def _packs(widths: list[int], gap: int, size: int, overlap: int) -> list[tuple[int, int]]:
    """Ranges of pieces, none wider than `size`, that share a part.

    With `reach[i]` the width of all pieces before i, a gap after each, the pieces a to
    b - 1 are `reach[b] - reach[a] - gap` wide, so both ends are found by bisection. A
    piece still fits if it does so before its gap is counted. The next part starts at
    the first piece from which the tail is within the overlap and leaves room.
    """
    reach = [0, *accumulate(width + gap for width in widths)]
    out, a = [], 0
    while a < len(widths):
        b = max(a + 1, bisect_right(reach, size + reach[a] + 2 * gap) - 1)
        out.append((a, b))
        if b >= len(widths):
            break
        room = min(overlap, size - widths[b])
        a = max(a + 1, bisect_left(reach, reach[b] - gap - room, a, b + 1))
        # A tail of no width stays, though there may be no room.
        if a == b and widths[b - 1] == 0:
            a = b - 1
    return out


def split_long(text: str, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP, separators=SEPARATORS) -> list[str]:
    """Parts of a text, cut at the coarsest separator present and packed up to `size`.

    Neighbouring parts share whole pieces of up to `overlap` characters. A piece that is
    too long by itself ends a part and is cut by the finer separators. The sentence
    separator leaves a full stop on every piece, the last one too. Parts are trimmed,
    empty ones left out.
    """
    if not text:
        return []
    level = next(i for i, one in enumerate(separators) if one in text)
    separator, finer = separators[level], separators[level + 1 :]
    stop = "." if separator == ". " else ""
    spans = _spans(text, separator)
    widths = [end - start + len(stop) for start, end in spans]
    too_long = [i for i, width in enumerate(widths) if width > size and finer]
    out: list[str] = []
    begin, blank = 0, []
    for stop_at in [*too_long, len(spans)]:
        # An empty piece just before a piece that was cut by itself leads the next run.
        run = [*blank, *range(begin, stop_at)]
        for a, b in _packs([widths[i] for i in run], len(separator), size, overlap):
            own = run[max(a, len(blank)) : b]
            part = (text[spans[own[0]][0] : spans[own[-1]][1]] + stop).strip() if own else ""
            if part:
                out.append(part)
        if stop_at < len(spans):
            start, end = spans[stop_at]
            out += split_long(text[start:end] + stop, size, overlap, finer)
            blank = run[-1:] if run and widths[run[-1]] == 0 else []
            begin = stop_at + 1
    return out


def split_texts(size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP):
    @F.pandas_udf(T.ArrayType(T.StringType()))
    def cut(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else split_long(t, size, overlap))

    return cut


def parts_of(text: Column, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP, always: bool = True) -> Column:
    """Parts of a text; only texts that may need a cut travel to Python.

    `always=False` keeps a text within `size` untouched. Otherwise a text that
    fits and holds no separator comes back as it is, trimmed.
    """
    needs = F.length(text) > size
    cut = split_texts(size, overlap)(F.when(needs | F.lit(always), text))
    return F.coalesce(cut, F.array(text))


def clause_texts(unit_rows: DataFrame) -> DataFrame:
    """Clauses with their points inlined: adds `points_text`."""
    point = F.when(
        F.col("unit") == "point",
        F.struct("point_at", F.concat(F.lit("  Điểm "), "point_id", F.lit(") "), "text").alias("line")),
    )
    keys = [
        "doc_id", "chapter_no", "chapter_title", "section_no", "article_no", "article_title", "article_at",
        "clause_at", "clause_no",
    ]
    return (
        unit_rows.where(F.col("clause_at").isNotNull())
        .groupBy(*keys)
        .agg(
            F.max(F.when(F.col("unit") == "clause", F.col("text"))).alias("text"),
            F.sort_array(F.collect_list(point)).alias("points"),
        )
        .withColumn("points", F.transform("points", lambda p: p["line"]))
    )


def _filled(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit("")) != ""


def article_context() -> Column:
    chapter = F.when(_filled("chapter_title"), F.concat(F.lit("Chuong "), "chapter_no", F.lit(": "), "chapter_title"))
    article = F.trim(F.concat(F.lit("Dieu "), "article_no", F.lit(". "), F.coalesce("article_title", F.lit(""))))
    return F.concat_ws(" - ", chapter, article)


def _article_id() -> Column:
    return F.concat_ws("_", "doc_id", F.lit("dieu"), "article_no")


def _document_id() -> Column:
    return F.concat_ws("_", "doc_id", F.lit("document"))


def article_chunks(unit_rows: DataFrame) -> DataFrame:
    """One chunk per article that has text of its own."""
    rows = unit_rows.where((F.col("unit") == "article") & (F.trim("text") != ""))
    heading = F.concat(F.lit("Điều "), "article_no", F.lit(". "), F.coalesce("article_title", F.lit("")))
    return rows.select(
        F.concat_ws("_", _article_id(), F.lit("intro")).alias("chunk_id"), F.col("doc_id").cast("string").alias("doc_id"),
        tx.strip(F.concat_ws("\n", heading, "text")).alias("text"),
        _article_id().alias("node_id"), F.lit("dieu").alias("node_type"), _document_id().alias("parent_id"),
        F.lit(None).cast("string").alias("parent_chunk_id"), F.array(_document_id()).alias("ancestor_ids"),
        "article_no", "article_title", "chapter_title", F.lit(None).cast("string").alias("clause_no"),
        article_context().alias("parent_context"), F.lit(1).alias("chunk_part"), F.lit(1).alias("chunk_parts"),
    )


def clause_chunks(unit_rows: DataFrame, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> DataFrame:
    """One chunk per clause with chapter and article in front; long ones in parts."""
    chapter = F.when(
        _filled("chapter_title"),
        F.concat(F.lit("Chương "), "chapter_no", F.lit(" ("), "chapter_title", F.lit(") - ")),
    ).otherwise("")
    article = F.concat(
        F.lit("Điều "), "article_no",
        F.when(_filled("article_title"), F.concat(F.lit(" ("), "article_title", F.lit(")"))).otherwise(""), F.lit(" - "),
    )
    first = F.concat(chapter, article, F.lit("Khoản "), "clause_no", F.lit(". "), "text")
    whole = clause_texts(unit_rows).withColumn("full", tx.strip(F.array_join(F.concat(F.array(first), "points"), "\n")))
    parts = whole.withColumn("parts", parts_of(F.col("full"), size, overlap, always=False))
    rows = parts.select("*", F.posexplode("parts").alias("pos", "part"))
    base = F.concat_ws("_", _article_id(), F.lit("khoan"), "clause_no")
    return rows.select(
        F.when(F.size("parts") > 1, F.concat(base, F.lit("_p"), F.col("pos") + 1))
        .when(F.length("full") > size, F.concat(base, F.lit("_p1"))).otherwise(base).alias("chunk_id"),
        F.col("doc_id").cast("string").alias("doc_id"), F.col("part").alias("text"),
        tx.node_key(F.col("doc_id"), "khoan", F.col("article_no"), F.col("clause_no")).alias("node_id"),
        F.lit("khoan").alias("node_type"), _article_id().alias("parent_id"),
        F.concat_ws("_", _article_id(), F.lit("intro")).alias("parent_chunk_id"),
        F.array(_document_id(), _article_id()).alias("ancestor_ids"), "article_no", "article_title", "chapter_title",
        "clause_no", article_context().alias("parent_context"), (F.col("pos") + 1).alias("chunk_part"),
        F.size("parts").alias("chunk_parts"),
    )


def appendix_chunks(forms: DataFrame, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> DataFrame:
    """Appendix forms (`doc_id, form_no` from 1, `form_code, form_name, content`) in parts."""
    text = tx.strip(F.concat_ws("\n", F.coalesce("form_name", F.lit("")), F.coalesce("content", F.lit(""))))
    rows = forms.withColumn("full", text).where(F.col("full") != "").withColumn("parts", parts_of(F.col("full"), size, overlap))
    node = F.concat_ws("_", "doc_id", F.lit("phuluc"), "form_no")
    return rows.select("*", F.posexplode("parts").alias("pos", "part")).select(
        F.concat(node, F.lit("_p"), F.col("pos") + 1).alias("chunk_id"), F.col("doc_id").cast("string").alias("doc_id"),
        F.col("part").alias("text"), node.alias("node_id"), F.lit("phu_luc").alias("node_type"),
        _document_id().alias("parent_id"), F.array(_document_id()).alias("ancestor_ids"),
        F.lit("phu_luc").alias("legal_unit_type"), F.lit("appendix_form").alias("legal_role"), "form_code",
        (F.col("pos") + 1).alias("chunk_part"), F.size("parts").alias("chunk_parts"),
    )


def precedent_parts(precedents: DataFrame, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> DataFrame:
    """A row for each section that is not empty, its text and its parts in order: issue, summary and holding whole, reasoning and facts cut."""
    sections = F.array(*[
        F.struct(
            tx.strip(F.col(column)).alias("text"), F.lit(tail).alias("tail"), F.lit(name).alias("section"),
            F.lit(unit).alias("unit"), F.lit(role).alias("role"), F.lit(cut).alias("cut"),
        )
        for column, tail, name, unit, role, cut in PRECEDENT_PARTS
    ])
    rows = precedents.select("doc_id", F.explode(sections).alias("s")).select("doc_id", "s.*").where(F.coalesce("text", F.lit("")) != "")
    cut = split_texts(size, overlap)(F.when(F.col("cut"), F.col("text")))
    return rows.withColumn("parts", F.coalesce(cut, F.array("text")))


def precedent_chunks(precedents: DataFrame, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> DataFrame:
    """Issue, summary and holding whole; reasoning and facts in parts."""
    rows = precedent_parts(precedents, size, overlap)
    base = F.concat_ws("_", "doc_id", "tail")
    return rows.select("*", F.posexplode("parts").alias("pos", "part")).select(
        F.when(F.col("cut"), F.concat(base, F.lit("_p"), F.col("pos") + 1)).otherwise(base).alias("chunk_id"),
        F.col("doc_id").cast("string").alias("doc_id"), F.col("part").alias("text"),
        F.concat_ws("_", "doc_id", F.lit("case"), tx.section_slug(F.col("section"))).alias("node_id"),
        F.lit("case_section").alias("node_type"), _document_id().alias("parent_id"),
        F.array(_document_id()).alias("ancestor_ids"), F.col("unit").alias("legal_unit_type"),
        F.col("role").alias("legal_role"), F.col("section").alias("part_kind"),
    )


def merge_metadata(chunks: DataFrame, documents: DataFrame, nodes: DataFrame) -> DataFrame:
    """Document fields under node fields: a node value wins where it is set.

    Both sides share column names; `documents` joins on `doc_id`, `nodes` on
    `node_id`.
    """
    doc_cols = [c for c in documents.columns if c != "doc_id"]
    node_cols = [c for c in nodes.columns if c not in ("node_id", "doc_id")]
    d = documents.select(F.col("doc_id").cast("string").alias("doc_id"), *[F.col(c).alias(f"_d_{c}") for c in doc_cols])
    n = nodes.select("node_id", *[F.col(c).alias(f"_n_{c}") for c in node_cols])
    joined = chunks.join(d, "doc_id", "left").join(n, "node_id", "left")
    names = [c for c in dict.fromkeys([*doc_cols, *node_cols]) if c not in ("node_id", "doc_id")]
    values = {}
    for name in names:
        layers = [
            F.col(f"_n_{name}") if name in node_cols else None,
            F.col(name) if name in chunks.columns else None,
            F.col(f"_d_{name}") if name in doc_cols else None,
        ]
        values[name] = F.coalesce(*[layer for layer in layers if layer is not None])
    return joined.withColumns(values).drop(*[f"_d_{c}" for c in doc_cols], *[f"_n_{c}" for c in node_cols])


def duplicate_chunks(chunks: DataFrame) -> DataFrame:
    """Chunk ids produced more than once within a document."""
    return chunks.groupBy("doc_id", "chunk_id").agg(F.count("*").alias("n")).where("n > 1")


def reject_duplicates(chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Chunks of sound documents, and the documents that fail with up to ten ids."""
    twice = duplicate_chunks(chunks)
    failed = twice.groupBy("doc_id").agg(
        F.count("*").alias("duplicates"), F.slice(F.sort_array(F.collect_set("chunk_id")), 1, 10).alias("sample")
    )
    return chunks.join(twice.select("doc_id").distinct(), "doc_id", "left_anti"), failed


def chunk_documents(unit_rows: DataFrame, forms: DataFrame | None, precedents: DataFrame | None) -> DataFrame:
    """Chunks of every document kind in one table."""
    frames = [article_chunks(unit_rows), clause_chunks(unit_rows)]
    if forms is not None:
        frames.append(appendix_chunks(forms))
    if precedents is not None:
        frames.append(precedent_chunks(precedents))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
