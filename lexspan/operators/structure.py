"""Structural parsing of statute texts over a line table.

A document is exploded to lines; headings are flagged by pattern and carried
down with windows. Everything is partitioned by `doc_id`, so one shuffle of the
documents (none when they are stored bucketed by `doc_id`) serves every step.
"""

from __future__ import annotations

import operator
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexspan.functions import text as tx

# ---- fixed values: heading and marker patterns ------------------------------
ORDINAL_WORDS = r"nhất|hai|ba|tư|bốn|năm|sáu|bảy|tám|chín|mười[a-z\s]*"
PART = rf"(?iuU)^\s*Phần\s+(?:thứ\s+)?([IVXLCDM]+|\d+|{ORDINAL_WORDS})\.?\s*(.*)$"
CHAPTER = rf"(?iuU)^\s*Chương\s+([IVXLCDM]+|\d+|{ORDINAL_WORDS})\.?[ \t]*(.*)$"
SECTION = r"(?iuU)^\s*Mục\s+(\d+|[IVXLCDM]+)\.?\s*(.*)$"
ARTICLE = r"(?iuU)^\s*(?:Điều|Ðiều|Diều|Điêù|Điểu)\s+(\d+)[.:]?\s*(.*)$"
CLAUSE = r"(?U)^\s*(\d{1,3})\.\s+(.*)$"
POINT = r"(?U)^\s*([a-zđ])[\)\.]\s+(.*)$"
APPENDIX = r"(?iuU)^\s*(?:Phụ\s+lục\b|Mẫu\s+số\b)"
FOOTER = (
    r"(?iuU)^\s*(?:Nơi nhận\s*:|TM\.|KT\.|CHỦ TỊCH\b|PHÓ THỦ TƯỚNG\b|BỘ TRƯỞNG\b|THỨ TRƯỞNG\b)"
)
RECIPIENT_AT_START = r"(?iuU)^\s*\|?\s*Nơi\s+nhận\s*:"
RECIPIENT_IN_TABLE = r"(?iuU)\|\s*Nơi\s+nhận\s*:"
FOOTER_TAIL = 2500
TITLE_LIMIT = 200
FORM_MARKER = (
    r"(?iuU)^(Mẫu\s+số[\s:]*[\w\-\.]+(?:\s*/\s*Form\s+No\.?[\s:]*[\w\-\.]+)?|Phụ\s+lục[\s:]*[IVX0-9A-Z]+)\b(.*)$"
)
APPENDIX_NUMBER = r"(?iuU)^(Phụ\s+lục[\s:]*[IVX0-9A-Z]+)"
FORM_NUMBER = r"(?iuU)Mẫu\s+số\s+([0-9]+[A-Za-z0-9.-]*)"
FORM_MIN_LINES, FORM_MIN_CHARS, FORM_NAME_LIMIT = 3, 300, 150
CROSS_REFERENCE = (
    r"(?:khoản\s+(\d+)\s+)?[Đđ]iều\s+(\d+)"
    r"(?:\s+(?:của\s+)?(Bộ luật này|Luật này|Nghị định này|"
    r"(?:Bộ luật|Luật|Nghị định|Thông tư)\s+(?:số\s+)?[\d/\-A-ZĐ]+))?"
)
AMENDMENT = (
    r"(?iu)\((?:được\s+)?(sửa đổi|bổ sung|bãi bỏ|thay thế)\s+(?:bởi|theo)\s+"
    r"(?:khoản\s+(\d+)\s+)?[Đđ]iều\s+(\d+)\s+([^\)]+)\)"
)
DECREE_RELATION = (
    r"(?iu)(Sửa đổi|Bổ sung|Bãi bỏ|Hướng dẫn thi hành)\s+(?:một số điều của\s+)?"
    r"(Nghị định|Luật|Bộ luật)\s+(?:(.*?)\s+)?(?:số\s+)?([\d]+/[\d]+/[A-ZĐ\-\d]+)"
)
GUIDED_ARTICLE = (
    r"[Hh]ướng dẫn\s+(?:áp dụng\s+)?(?:khoản\s+(\d+)\s+)?[Đđ]iều\s+(\d+)\s+"
    r"(?:của\s+)?(Bộ luật Dân sự|Bộ luật [^\d\n,]+)"
)
LOST_ARTICLES, CODE_MIN_ARTICLES = 10, 100
# ---------------------------------------------------------------------------

HEADINGS = {"part": PART, "chapter": CHAPTER, "section": SECTION, "article": ARTICLE}
LEVEL = {"part": 1, "chapter": 2, "section": 3, "article": 4}


def _doc(*order: str):
    return Window.partitionBy("doc_id").orderBy(*order)


def _doc_all():
    return Window.partitionBy("doc_id")


def _running(*order: str):
    return _doc(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def text_lines(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per physical line: `doc_id, line_no, line` plus carried columns."""
    unified = F.regexp_replace(F.regexp_replace("text", "\r\n", "\n"), "\r", "\n")
    return docs.select(
        "doc_id", *keep, F.posexplode(F.split(unified, "\n")).alias("line_no", "line")
    )


def is_marker(line: Column) -> Column:
    test = F.lit(False)
    for pattern in (ARTICLE, CHAPTER, SECTION, PART, CLAUSE, POINT):
        test = test | line.rlike(pattern)
    return test


def _starts_upper(line: Column) -> Column:
    return line.rlike(r"^[\p{Lu}\p{Lt}]")


def rejoin_wrapped(lines: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Put a wrapped line back on the one before it.

    Only the neighbour above matters: a line continues it when it starts
    without an upper-case letter, is no marker, and the neighbour is not empty
    and does not end in `. : ;`.
    """
    order = _doc("line_no")
    stripped = lines.withColumn("line", tx.strip(F.col("line")))
    above = F.lag("line").over(order)
    continues = (
        above.isNotNull() & (above != "") & ~above.rlike(r"[.:;]$")
        & (F.col("line") != "") & ~_starts_upper(F.col("line")) & ~is_marker(F.col("line"))
    )
    grouped = stripped.withColumn("_new", F.when(continues, 0).otherwise(1)).withColumn(
        "row_no", F.sum("_new").over(_running("line_no"))
    )
    joined = F.array_join(
        F.transform(F.sort_array(F.collect_list(F.struct("line_no", "line"))), lambda r: r["line"]), " "
    )
    return grouped.groupBy("doc_id", *keep, "row_no").agg(
        F.min("line_no").alias("line_no"), joined.alias("line")
    ).drop("row_no")


def mark_regions(lines: DataFrame) -> DataFrame:
    """Label every line: preamble, body, signature or appendix.

    A footer inside a table row cuts that row; the part before it stays.
    """
    whole = _doc_all()
    df = lines.withColumn("_app", F.min(F.when(F.col("line").rlike(APPENDIX), F.col("line_no"))).over(whole))
    in_main = F.col("_app").isNull() | (F.col("line_no") < F.col("_app"))
    df = df.withColumn("_main", in_main)
    width = F.when(F.col("_main"), F.length("line") + 1).otherwise(0)
    df = df.withColumn("_start", F.sum(width).over(_running("line_no")) - width)
    # The appendix starts after the final line break, which still counts as main text.
    df = df.withColumn(
        "_total", F.sum(width).over(whole) - F.when(F.col("_app").isNull(), 1).otherwise(0)
    )
    tail = F.greatest(F.lit(0), F.col("_total") - FOOTER_TAIL)
    # The tail may begin inside a line; what is left of that line counts as a line.
    inside = F.greatest(tail - F.col("_start"), F.lit(0)).cast("int")
    tail_part = F.substring(F.col("line"), inside + 1, F.length("line"))
    footer_at = F.when(
        F.col("_main") & (F.col("_start") + F.length("line") >= tail) & tail_part.rlike(FOOTER),
        F.col("_start") + inside,
    )
    table_at = F.when(
        F.col("_main") & F.col("line").rlike(RECIPIENT_IN_TABLE),
        F.col("_start") + F.length(F.regexp_extract("line", r"(?iuU)^(.*?)\|\s*Nơi\s+nhận\s*:", 1)),
    )
    line_at = F.when(F.col("_main") & F.col("line").rlike(RECIPIENT_AT_START), F.col("_start"))
    df = df.withColumn("_cut", F.min(F.least(footer_at, line_at, table_at)).over(whole))
    kept = F.col("_cut").isNull() | (F.col("_start") < F.col("_cut"))
    visible = F.when(
        F.col("_main") & F.col("_cut").isNotNull() & kept,
        F.substring(F.col("line"), 1, (F.col("_cut") - F.col("_start")).cast("int")),
    ).otherwise(F.col("line"))
    df = df.withColumn("line", visible)
    heading = F.col("line").rlike(PART) | F.col("line").rlike(CHAPTER) | F.col("line").rlike(ARTICLE)
    df = df.withColumn(
        "_body", F.min(F.when(F.col("_main") & kept & heading, F.col("line_no"))).over(whole)
    )
    region = (
        F.when(~F.col("_main"), "appendix")
        .when(~kept, "signature")
        .when(F.col("_body").isNull() | (F.col("line_no") < F.col("_body")), "preamble")
        .otherwise("body")
    )
    return df.withColumn("region", region).drop("_app", "_main", "_start", "_total", "_cut", "_body")


def parse_lines(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Documents to labelled lines; the single entry point for the steps below."""
    parted = docs.repartition(F.col("doc_id"))
    return mark_regions(rejoin_wrapped(text_lines(parted, keep), keep))


def region_text(lines: DataFrame, region: str) -> DataFrame:
    """Text of one region per document."""
    return (
        lines.where(F.col("region") == region)
        .groupBy("doc_id")
        .agg(
            tx.strip(
                F.array_join(
                    F.transform(
                        F.sort_array(F.collect_list(F.struct("line_no", "line"))), lambda r: r["line"]
                    ),
                    "\n",
                )
            ).alias("text")
        )
    )


def legal_basis(lines: DataFrame) -> DataFrame:
    """Basis lines of the preamble in order; circulars also keep proposal lines.

    Needs a carried `doc_type` column.
    """
    low = F.lower(tx.strip(F.col("line")))
    proposal = (F.col("doc_type") == "thong_tu") & low.startswith("theo đề nghị")
    kind = F.when(low.startswith("căn cứ"), "basis").when(proposal, "proposal")
    return (
        lines.where(F.col("region") == "preamble")
        .withColumn("kind", kind)
        .where(F.col("kind").isNotNull())
        .select("doc_id", "line_no", "kind", tx.strip(F.col("line")).alias("line"))
    )


def outline(lines: DataFrame) -> DataFrame:
    """Body lines with their part, chapter, section, article, clause and point."""
    df = lines.where((F.col("region") == "body") & (tx.strip(F.col("line")) != "")).withColumn(
        "line", tx.strip(F.col("line"))
    )
    order = _doc("line_no")
    kind = F.lit(None).cast("string")
    rest = F.lit(None).cast("string")
    for name, pattern in reversed(HEADINGS.items()):
        hit = F.col("line").rlike(pattern)
        kind = F.when(hit, F.lit(name)).otherwise(kind)
        rest = F.when(hit, F.regexp_extract("line", pattern, 2)).otherwise(rest)
    df = df.withColumn("kind", kind).withColumn("rest", tx.strip(rest))
    # A heading without a title takes the next line; parts, sections and
    # articles consume it, a chapter only borrows it.
    level = F.lit(0)
    for name, value in LEVEL.items():
        level = F.when(F.col("kind") == name, F.lit(value)).otherwise(level)
    df = df.withColumn("level", level)
    above_kind, above_rest, above_level = (F.lag(c).over(order) for c in ("kind", "rest", "level"))
    consumed = (
        above_kind.isin("part", "section", "article") & (above_rest == "")
        & ((F.col("level") == 0) | (F.col("level") >= above_level))
    )
    next_line = F.lead("line").over(order)
    next_level = F.lead("level").over(order)
    df = df.withColumn("consumed", F.coalesce(consumed, F.lit(False))).withColumn(
        "_next", F.when((next_level == 0) | (next_level >= F.col("level")), next_line)
    )
    df = df.withColumn("kind", F.when(F.col("consumed"), F.lit(None)).otherwise(F.col("kind")))
    low_next = F.lower(F.col("_next"))
    borrowed = F.when(
        (F.col("kind") == "chapter") & (low_next.startswith("mục") | low_next.startswith("điều")), F.lit(None)
    ).otherwise(F.col("_next"))
    title = F.when(F.col("rest") != "", F.col("rest")).otherwise(borrowed)
    title = F.when((F.col("kind") != "article") & (F.length(title) > TITLE_LIMIT), F.lit(None)).otherwise(title)
    df = df.withColumn("_title", title)

    down = _running("line_no")
    above = F.lit(0)
    for name, pattern in HEADINGS.items():
        here = F.when(
            F.col("kind") == name,
            F.struct(
                F.upper(F.regexp_extract("line", pattern, 1)).alias("number"),
                F.col("_title").alias("title"),
                F.col("line_no").alias("at"),
            ),
        )
        df = df.withColumn(f"_{name}", F.last(here, ignorenulls=True).over(down))
        # A heading of a higher level closes the lower one.
        df = df.withColumn(
            f"_{name}", F.when(F.coalesce(F.col(f"_{name}.at"), F.lit(-1)) >= above, F.col(f"_{name}"))
        )
        above = F.greatest(above, F.coalesce(F.col(f"_{name}.at"), F.lit(-1)))
    columns = {}
    for name in HEADINGS:
        columns[f"{name}_no"] = F.trim(F.col(f"_{name}.number"))
        columns[f"{name}_title"] = F.col(f"_{name}.title")
        columns[f"{name}_at"] = F.col(f"_{name}.at")
    df = df.withColumns(columns).drop("_part", "_chapter", "_section", "_article", "_next", "_title")

    article = Window.partitionBy("doc_id", "article_at").orderBy("line_no").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    plain = F.col("kind").isNull() & ~F.col("consumed") & F.col("article_at").isNotNull()
    is_clause = plain & F.col("line").rlike(CLAUSE)
    df = df.withColumn("clause_at", F.last(F.when(is_clause, F.col("line_no")), ignorenulls=True).over(article))
    is_point = plain & ~is_clause & F.col("line").rlike(POINT) & F.col("clause_at").isNotNull()
    point_at = F.last(F.when(is_point, F.col("line_no")), ignorenulls=True).over(article)
    df = df.withColumn("point_at", point_at)
    df = df.withColumn("point_at", F.when(F.col("point_at") > F.col("clause_at"), F.col("point_at")))
    # Text ahead of the first chapter of a part that has chapters, or of the
    # first part, belongs to no unit.
    has_part = F.max(F.col("part_at").isNotNull()).over(_doc_all())
    has_chapter = F.max(F.col("chapter_at").isNotNull()).over(Window.partitionBy("doc_id", "part_at"))
    stray = (has_part & F.col("part_at").isNull()) | (has_chapter & F.col("chapter_at").isNull())
    return df.withColumn("stray", stray).withColumn(
        "role",
        F.when(F.col("kind").isNotNull(), F.col("kind"))
        .when(F.col("consumed"), "title")
        .when(is_clause, "clause")
        .when(is_point, "point")
        .when(F.col("article_at").isNull(), "loose")
        .otherwise("text"),
    )


UNIT_KEYS = (
    "doc_id", "part_no", "part_title", "chapter_no", "chapter_title", "chapter_at",
    "section_no", "section_title", "section_at", "article_no", "article_title", "article_at",
)


def _joined(lines: Column) -> Column:
    return tx.strip(
        F.array_join(F.transform(F.sort_array(F.collect_list(lines)), lambda r: r["line"]), "\n")
    )


def units(outlined: DataFrame, heads: bool = False) -> DataFrame:
    """Articles, clauses and points with their full text, one row each.

    With `heads`, chapters and sections too, a row for each heading: they come out of the same pass.
    """
    head = F.when(F.col("role").isin("chapter", "section"), F.col("role"))
    wanted = F.col("article_at").isNotNull()
    body = outlined.where((wanted | head.isNotNull() if heads else wanted) & ~F.col("stray"))
    text = (
        F.when(F.col("role") == "clause", F.regexp_extract("line", CLAUSE, 2))
        .when(F.col("role") == "point", F.regexp_extract("line", POINT, 2))
        .when(F.col("role") == "text", F.col("line"))
    )
    number = (
        F.when(F.col("role") == "clause", F.regexp_extract("line", CLAUSE, 1))
        .when(F.col("role") == "point", F.regexp_extract("line", POINT, 1))
    )
    own = F.when(F.col("role").isin("clause", "point"), number)
    rows = body.withColumn("_text", text).withColumn("_own", own)
    keys = [*UNIT_KEYS, "clause_at", "point_at"]
    if heads:
        # A heading closes what is below it, so it lies in no article.
        rows, keys = rows.withColumn("_head", head), [*keys, "_head"]
    grouped = rows.groupBy(*keys).agg(
        _joined(F.when(F.col("_text").isNotNull(), F.struct("line_no", F.col("_text").alias("line")))).alias("text"),
        F.min_by("_own", F.when(F.col("_own").isNotNull(), F.col("line_no"))).alias("own_no"),
        F.min("line_no").alias("first_line"),
    )
    kind = (
        F.when(F.col("point_at").isNotNull(), "point")
        .when(F.col("clause_at").isNotNull(), "clause")
        .otherwise("article")
    )
    labelled = grouped.withColumn("unit", F.coalesce(F.col("_head"), kind)).drop("_head") if heads else grouped.withColumn("unit", kind)
    within = Window.partitionBy("doc_id", "article_at", "clause_at")
    clause_no = F.max(F.when(F.col("unit") == "clause", F.col("own_no"))).over(within)
    return labelled.withColumn("clause_no", F.when(F.col("clause_at").isNotNull(), clause_no)).withColumn(
        "point_id", F.when(F.col("unit") == "point", F.col("own_no"))
    ).drop("own_no")


def article_order(column: str = "article_no") -> Column:
    """Sort key: leading number of the article, others last."""
    number = F.regexp_extract(column, r"^(\d+)", 1)
    return F.when(number != "", number.cast("long")).otherwise(F.lit(999999))


def ordered_articles(unit_rows: DataFrame) -> DataFrame:
    """Articles of each document in numeric order, ties by position."""
    place = Window.partitionBy("doc_id").orderBy(article_order(), "article_at")
    return unit_rows.where(F.col("unit") == "article").withColumn("place", F.row_number().over(place))


def _groups(column: str, pattern: str, count: int) -> Column:
    """All matches as an array of group arrays."""
    parts = [F.regexp_extract_all(column, F.lit(pattern), F.lit(i)) for i in range(1, count + 1)]
    return F.arrays_zip(*[p.alias(f"g{i}") for i, p in enumerate(parts, 1)])


def amendments(texts: DataFrame, keys: list[str]) -> DataFrame:
    """Amendment and repeal marks in brackets, one row per mark."""
    rows = texts.select(*keys, F.posexplode(_groups("text", AMENDMENT, 4)).alias("mark_no", "m"))
    clause = F.when(F.col("m.g2") != "", F.concat(F.lit("khoản "), F.col("m.g2"), F.lit(" "))).otherwise("")
    return rows.select(
        *keys, "mark_no",
        F.lower(F.col("m.g1")).contains("bãi bỏ").alias("repealed"),
        F.concat("m.g1", F.lit(" bởi "), clause, F.lit("Điều "), "m.g3", F.lit(" "), tx.strip(F.col("m.g4"))).alias("note"),
    )


def cross_references(texts: DataFrame, keys: list[str]) -> DataFrame:
    rows = texts.select(*keys, F.posexplode(_groups("text", CROSS_REFERENCE, 3)).alias("ref_no", "m"))
    return rows.select(
        *keys, "ref_no",
        F.nullif(F.col("m.g1"), F.lit("")).alias("clause_no"),
        F.col("m.g2").alias("article_no"),
        F.when(F.col("m.g3") == "", F.lit("văn bản hiện tại")).otherwise(F.col("m.g3")).alias("document"),
    )


def decree_relations(texts: DataFrame, keys: list[str]) -> DataFrame:
    rows = texts.select(*keys, F.posexplode(_groups("text", DECREE_RELATION, 4)).alias("rel_no", "m"))
    return rows.select(
        *keys, "rel_no", F.lower(F.col("m.g1")).alias("relation_type"),
        F.col("m.g2").alias("target_type"), F.col("m.g4").alias("target_doc"),
    )


def guided_articles(texts: DataFrame, keys: list[str]) -> DataFrame:
    rows = texts.select(*keys, F.posexplode(_groups("text", GUIDED_ARTICLE, 3)).alias("rel_no", "m"))
    return rows.select(
        *keys, "rel_no", F.lit("huong_dan_ap_dung").alias("relation_type"),
        F.nullif(F.col("m.g1"), F.lit("")).alias("target_clause"), F.col("m.g2").alias("target_article"),
        tx.strip(F.col("m.g3")).alias("target_doc"),
    )


def appendix_forms(lines: DataFrame) -> DataFrame:
    """Forms of the appendix; short pieces are gathered into one general entry."""
    rows = lines.where(F.col("region") == "appendix")
    is_mark = F.col("line").rlike(FORM_MARKER)
    rows = rows.withColumn("piece", F.sum(F.when(is_mark, 1).otherwise(0)).over(_running("line_no")))
    raw = tx.strip(F.when(is_mark, F.regexp_extract("line", FORM_MARKER, 1)))
    number = F.regexp_extract(tx.collapse(raw), FORM_NUMBER, 1)
    mark = F.when(number != "", F.concat(F.lit("Mẫu số "), number)).otherwise(raw)
    rows = rows.withColumn("mark", mark).withColumn(
        "line", F.when(is_mark, F.regexp_extract("line", FORM_MARKER, 2)).otherwise(F.col("line"))
    )
    pieces = rows.groupBy("doc_id", "piece").agg(
        _joined(F.struct("line_no", "line")).alias("content"), F.max("mark").alias("mark")
    )
    order = _doc("piece").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    in_mark = F.when(F.col("mark").rlike(APPENDIX_NUMBER), F.col("mark"))
    in_intro = F.when(
        F.col("piece") == 0, F.nullif(F.regexp_extract(F.substring("content", 1, 200), APPENDIX_NUMBER, 1), F.lit(""))
    )
    pieces = pieces.withColumn(
        "current", F.coalesce(F.last(F.coalesce(in_mark, in_intro), ignorenulls=True).over(order), F.lit("Phụ lục"))
    )
    short = (F.size(F.split("content", "\n")) <= FORM_MIN_LINES) | (F.length("content") < FORM_MIN_CHARS)
    pieces = pieces.withColumn("general", (F.col("piece") == 0) | short)
    general = (
        pieces.where(F.col("general"))
        .withColumn("line", F.when(F.col("piece") == 0, F.col("content")).otherwise(F.concat_ws(" ", "mark", "content")))
        .groupBy("doc_id")
        .agg(_joined(F.struct(F.col("piece").alias("line_no"), "line")).alias("content"))
        .where(F.col("content") != "")
        .select(
            "doc_id", F.lit(0).alias("form_no"), F.lit("Chung").alias("form_code"),
            F.lit("Danh mục / Quy định chung").alias("form_name"), "content",
        )
    )
    filled = F.filter(F.transform(F.split("content", "\n"), lambda x: tx.strip(x)), lambda x: x != "")
    official = lambda x: ~F.upper(x).contains("CỘNG H") & ~F.upper(x).contains("ĐỘC LẬP")
    upper = F.filter(filled, lambda x: (F.upper(x) == x) & x.rlike(r"\p{Lu}") & official(x))
    name = F.coalesce(F.get(upper, 0), F.get(F.filter(filled, official), 0), F.lit(""))
    name = F.when(
        F.length(name) > FORM_NAME_LIMIT, F.concat(F.substring(name, 1, FORM_NAME_LIMIT - 3), F.lit("..."))
    ).otherwise(name)
    prefixed = (
        F.col("current").contains("Phụ lục") & (F.lower("current") != "phụ lục") & F.col("mark").contains("Mẫu")
    )
    forms = pieces.where(~F.col("general")).select(
        "doc_id", "piece",
        F.when(prefixed, F.concat_ws(" - ", "current", "mark")).otherwise(F.col("mark")).alias("form_code"),
        name.alias("form_name"), "content",
    )
    numbered = forms.withColumn("form_no", F.row_number().over(_doc("piece"))).select(
        "doc_id", "form_no", "form_code", "form_name", "content"
    )
    return general.unionByName(numbered)


def article_checks(docs: DataFrame, unit_rows: DataFrame) -> DataFrame:
    """Counts per document and the three warnings on lost articles."""
    counted = (
        unit_rows.where(F.col("unit") == "article")
        .groupBy("doc_id")
        .agg(F.count("*").alias("articles"), F.max_by("article_no", F.struct(article_order(), "article_at")).alias("last"))
    )
    last = F.regexp_extract("last", r"^(\d+)", 1).try_cast("long")
    joined = docs.select("doc_id", "doc_type").join(counted, "doc_id", "left")
    found = F.coalesce("articles", F.lit(0))
    return joined.select(
        "doc_id", "doc_type", found.alias("articles"), last.alias("last_article"),
        F.coalesce(last - F.col("articles") > LOST_ARTICLES, F.lit(False)).alias("lost_articles"),
        ((F.col("doc_type") == "bo_luat") & (found < CODE_MIN_ARTICLES)).alias("short_code"),
        ((F.col("doc_type") == "nghi_dinh") & (found == 0)).alias("empty_decree"),
    )


# ---- provenance guesses on raw text -----------------------------------------
# fixed values
OFFICIAL_NUMBER = (
    r"(?:(?:Luật|Bộ luật|Nghị định|Thông tư|Nghị quyết|Quyết định|Chỉ thị|Pháp lệnh|Lệnh)\s+)?"
    r"[Ss]ố[:\s]*([\d]+[a-zA-Z]?/\d{4}/[A-ZĐ0-9\-]+)"
)
SPELLED_DATE = r"(\d{1,2})\s+tháng\s+(\d{1,2})\s+năm\s+(\d{4})"
ADOPTED_ON = r"(?iu)thông qua\s+ngày\s+" + SPELLED_DATE
SIGNED_ON = r"ngày\s+" + SPELLED_DATE
EFFECTIVE_FROM = (
    r"(?iu)có hiệu lực thi hành từ ngày\s+" + SPELLED_DATE,
    r"(?iu)có hiệu lực thi hành kể từ ngày\s+" + SPELLED_DATE,
    r"(?iu)có hiệu lực kể từ ngày\s+" + SPELLED_DATE,
    r"(?iu)có hiệu lực từ ngày\s+" + SPELLED_DATE,
    r"(?iu)bắt đầu có hiệu lực(?: thi hành)?\s+từ ngày\s+(\d{1,2})[-/](\d{1,2})[-/](\d{4})",
)
TITLE_STOPS = ("căn cứ", "theo đề nghị", "chính phủ ban hành", "quốc hội ban hành", "ủy ban")
LETTERHEAD = ("|", "Độc lập", "CỘNG HÒA")
ISSUER_BY_TYPE = {"bo_luat": "QUỐC HỘI", "nghi_dinh": "CHÍNH PHỦ"}
RESOLUTION_ISSUERS = (
    ("QUỐC HỘI", "QUỐC HỘI"),
    ("HỘI ĐỒNG THẨM PHÁN", "HỘI ĐỒNG THẨM PHÁN TÒA ÁN NHÂN DÂN TỐI CAO"),
    ("ỦY BAN THƯỜNG VỤ", "ỦY BAN THƯỜNG VỤ QUỐC HỘI"),
    ("CHÍNH PHỦ", "CHÍNH PHỦ"),
)
NATIONAL_NAME = "CỘNG HÒA XÃ HỘI CHỦ NGHĨA VIỆT NAM"


def _some(value: Column) -> Column:
    return F.nullif(value, F.lit(""))


def spelled_date(text: Column, pattern: str) -> Column:
    """First match of a day-month-year pattern as a date; impossible dates are null."""
    day, month, year = (F.regexp_extract(text, pattern, i) for i in (1, 2, 3))
    iso = F.concat_ws("-", year, F.lpad(month, 2, "0"), F.lpad(day, 2, "0"))
    return F.when(year != "", F.try_to_date(iso, "yyyy-MM-dd"))


def official_number(raw: Column) -> Column:
    at = F.locate("Căn cứ", raw)
    zone = F.when(at > 0, F.substring(raw, F.lit(1), at - 1)).otherwise(F.substring(raw, 1, 1500))
    return F.coalesce(
        _some(F.regexp_extract(zone, OFFICIAL_NUMBER, 1)),
        _some(F.regexp_extract(raw, OFFICIAL_NUMBER, 1)),
        F.lit("unknown"),
    )


def issued_on(raw: Column) -> Column:
    """The adoption phrase decides whenever it occurs, even with an impossible date."""
    return F.when(raw.rlike(ADOPTED_ON), spelled_date(raw, ADOPTED_ON)).otherwise(
        spelled_date(F.substring(raw, 1, 800), SIGNED_ON)
    )


def effective_on(raw: Column) -> Column:
    return F.coalesce(*[spelled_date(raw, p) for p in EFFECTIVE_FROM])


def _has_any(text: Column, needles) -> Column:
    test = F.lit(False)
    for needle in needles:
        test = test | F.contains(text, F.lit(needle))
    return test


def title_guess(raw: Column) -> Column:
    """First one or two lines after the letterhead, up to a stop phrase."""
    lines = F.filter(F.transform(F.split(raw, "\n"), tx.strip), lambda x: x != "")

    def pick(lines: Column) -> Column:
        marked = F.transform(F.slice(lines, 1, 5), lambda x, i: F.when(_has_any(x, LETTERHEAD), i + 1).otherwise(0))
        window = F.slice(lines, F.coalesce(F.array_max(marked), F.lit(0)) + 1, F.lit(2))
        stops = lambda x: F.lower(x).rlike("^(?:" + "|".join(TITLE_STOPS) + ")")
        first = F.get(window, 0)
        second = F.get(window, 1)
        taken = (
            F.when(first.isNull() | stops(first), F.array().cast("array<string>"))
            .when(second.isNull() | stops(second), F.array(first))
            .otherwise(F.array(first, second))
        )
        joined = F.when(F.size(taken) > 0, F.array_join(taken, " "))
        return tx.collapse(F.coalesce(joined, F.get(lines, 0), F.lit("unknown")))

    return tx.let(lines, pick)


def issuer_guess(raw: Column, doc_type: Column) -> Column:
    head = F.substring(raw, 1, 500)
    by_type = F.coalesce(*[F.when(doc_type == k, F.lit(v)) for k, v in ISSUER_BY_TYPE.items()])
    by_header = F.coalesce(*[
        F.when((doc_type == "nghi_quyet") & F.contains(head, F.lit(k)), F.lit(v)) for k, v in RESOLUTION_ISSUERS
    ])

    def candidate(line: Column) -> Column:
        left = F.regexp_replace(F.get(F.split(line, r"\|"), 0), "_+", "")
        left = tx.strip(F.regexp_replace(left, "[Ss]ố:.*", ""))
        table_name = F.when((left != "") & (left != NATIONAL_NAME), left)
        upper = (
            line.rlike(r"[\p{Lu}\p{Lt}]") & (F.upper(line) == line)
            & ~F.contains(line, F.lit("CỘNG HÒA")) & ~F.contains(line, F.lit("ĐỘC LẬP")) & ~F.contains(line, F.lit("SỐ:"))
        )
        plain_name = F.when(upper, _some(tx.strip(F.regexp_replace(line, "_+", ""))))
        return F.when(F.contains(line, F.lit("|")), table_name).otherwise(plain_name)

    lines = F.transform(F.slice(F.split(F.substring(raw, 1, 1000), "\n"), 1, 10), lambda x: candidate(tx.strip(x)))
    return F.coalesce(by_type, by_header, F.get(F.filter(lines, lambda x: x.isNotNull()), 0))


# ---- precedents -------------------------------------------------------------
# fixed values: section patterns of a precedent, searched case-insensitively.
PRECEDENT_NUMBER = r"(?iu)Án lệ\s+số\s+([\d]+/\d{4}/AL)"

def _until(*stops: str) -> str:
    """Group of the text up to the first line break that one of `stops` follows; all that
    lies between is read once and never given back, so a long section costs one pass."""
    return rf"((?:[^\n]++|\n(?!{'|'.join(stops)}))*+)(?=\n)"


FACTS_END = (r"\s*NHẬN ĐỊNH CỦA", r"\s*NỘI DUNG ÁN LỆ")
PRECEDENT_SECTIONS = {
    "source_note": r"Nguồn án lệ[:\s]*\n?" + _until(r"\s*Vị trí nội dung", r"\s*Khái quát nội dung", r"\s*-?\s*Tình huống", r"\n"),
    "court": (
        r"((?:được\s+)?(?:Hội đồng Thẩm phán|Toà án|Tòa án).*?(?:thông qua|xét xử)"
        + _until(r"\s*Nguồn án lệ", r"\s*Vị trí", r"\s*Khái quát", r"\n").replace("(", "(?:", 1) + ")"
    ),
    "location_note": r"Vị trí nội dung án lệ[:\s]*\n?" + _until(r"\s*Khái quát", r"\s*-?\s*Tình huống", r"\n"),
    "summary": r"Khái quát nội dung(?:\s+của)?(?:\s+án lệ)?[:\s]*\n?" + _until(r"\s*-?\s*Tình huống", r"\s*Giải pháp", r"\n"),
    "summary_alt": r"Khái quát nội dung(?:\s+của)?(?:\s+án lệ)?[:\s]*\n?" + _until(r"\s*Quy định", r"\s*Từ kh", r"\s*NỘI DUNG", r"\n"),
    # What parts heading and facts ends before the next heading, so that empty facts are empty.
    "facts": rf"NỘI DUNG VỤ (?:ÁN|VIỆC)(?:[:\s&&[^\n]]|\n(?!{'|'.join(FACTS_END)}))*+" + _until(*FACTS_END),
    "issue": r"Tình huống (?:pháp lý|án lệ)[:\s]*\n?" + _until(r"\s*-?\s*Giải pháp"),
    "holding": r"Giải pháp pháp lý[:\s]*\n?" + _until(r"\s*Quy định", r"\s*Từ kh[oó]a", r"\s*NỘI DUNG VỤ (?:ÁN|VIỆC)"),
    "provisions": r"Quy định của pháp luật(?: có)? liên quan[^\n:]*:[:\s]*\n?" + _until(r"\s*Từ kh(?:óa|oá)", r"\s*NỘI DUNG"),
    "keyword_text": (
        r"Từ kh(?:óa|oá)(?:\s+của\s+án lệ)?[:\s]*\n?" + _until(r"\s*NỘI DUNG VỤ (?:ÁN|VIỆC)", r"\s*NỘI DUNG ÁN LỆ", r"\n")
    ),
}
REASONING = r"(?ius)(?:^|\n)NỘI DUNG ÁN LỆ[:\s]*(?:\n|$)(.*)$"
PUBLISHED_ON = r"(?ius)công bố.*?ngày\s+" + SPELLED_DATE
FOOTNOTE_WORDS = "Án lệ này do "
FOOTNOTE_LINE = rf"(?m)^\s*\d+\s+{FOOTNOTE_WORDS}.*$"
#: Where a line ends to ^ and $.
LINE_ENDS = ("\n", "\r", "\x85", "\u2028", "\u2029")
PAGE_BREAK = r"(?:\n|^)\s*\d+\s*\n\s*\n"
NUMBER_LINE = r"(?m)^\s*\d+\s*$"
PROVISION = r"(?iu)điều\s+\d+|khoản\s+\d+"
# ---------------------------------------------------------------------------


def _without_page_marks(text: Column) -> Column:
    """Footnotes, page breaks and page numbers removed; `text` should be a plain column, it is read more than once.

    A text without a digit holds none, and one of a single line only if it is a number or has a footnote.
    """
    footnote = F.contains(text, F.lit(FOOTNOTE_WORDS))
    out = F.when(footnote, F.regexp_replace(text, FOOTNOTE_LINE, "")).otherwise(text)
    for pattern, by in ((PAGE_BREAK, "\n"), (NUMBER_LINE, "")):
        out = F.regexp_replace(out, pattern, by)
    lines = reduce(operator.or_, [F.contains(text, F.lit(end)) for end in LINE_ENDS])
    return F.when(footnote | lines, F.when(text.rlike(r"\d"), out).otherwise(text)).otherwise(F.regexp_replace(text, r"^\s*\d+\s*$", ""))


def flat_section(text: Column) -> Column:
    """A section on one line; `text` should be a plain column, it is read more than once."""
    joined = F.regexp_replace(_without_page_marks(text), r"(?U)\s*\n\s*", " ")
    lines = F.when(F.contains(text, F.lit("\n")), joined).otherwise(_without_page_marks(text))
    return tx.strip(F.regexp_replace(lines, r"(?U)\s{2,}", " "))


def _once(df: DataFrame, **values: Column) -> DataFrame:
    """Columns worked out once for each row: a filter on them is not moved below a generator,
    where it would repeat the work."""
    kept = [c for c in df.columns if c not in values]
    return df.select(*kept, F.inline(F.array(F.struct(*[v.alias(n) for n, v in values.items()]))))


def _bullets(section: Column) -> Column:
    """Bullet items, each with the lines that follow it."""
    lines = F.filter(F.transform(F.split(section, "\n"), tx.strip), lambda x: x != "")
    empty = F.array().cast("array<string>")

    def add(done: Column, line: Column) -> Column:
        head = F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))
        longer = F.concat(F.element_at(done, -1), F.lit(" "), line)
        return F.when(
            line.startswith("-"), F.concat(done, F.array(tx.strip(F.regexp_replace(line, "^-+", ""))))
        ).when(F.size(done) > 0, F.concat(head, F.array(longer))).otherwise(F.array(line))

    return F.aggregate(lines, empty, add)


def parse_precedents(docs: DataFrame) -> DataFrame:
    """Precedent texts (`doc_id, text`) to their named sections."""
    unified = F.when(F.contains("text", F.lit("\r")), F.regexp_replace(F.regexp_replace("text", "\r\n", "\n"), "\r", "\n")).otherwise(F.col("text"))
    cleaned = tx.strip(F.regexp_replace(_without_page_marks(F.col("text")), r"\n{3,}", "\n\n"))
    base = _once(docs.withColumn("text", tx.nfc(unified)), text=cleaned)
    found = base.withColumns({
        **{name: tx.strip(F.regexp_extract("text", "(?ius)" + pattern, 1)) for name, pattern in PRECEDENT_SECTIONS.items()},
        "_number": F.regexp_extract("text", r"(?iu)(Án lệ\s+số\s+[\d]+/\d{4}/AL)", 1),
        "_source_at": F.regexp_instr("text", F.lit("(?ius)" + PRECEDENT_SECTIONS["source_note"])),
        "_reasoning": F.regexp_extract("text", REASONING, 1),
    })
    found = found.withColumns({name: _some(F.col(name)) for name in PRECEDENT_SECTIONS})
    # What a pattern found stands nowhere earlier, where it would have been found too.
    found = found.withColumns({"_number_at": F.when(F.col("_number") != "", F.instr("text", F.col("_number"))).otherwise(0), "_court_at": F.instr("text", F.col("court"))})
    number_at = F.col("_number_at")
    start = number_at + F.length("_number")
    after = lambda at: F.when(F.col(at) > start, F.col(at))
    end = F.coalesce(F.least(after("_court_at"), after("_source_at")), F.length("text") + 1)
    title = F.substring(F.col("text"), start, (end - start).cast("int"))
    title = tx.collapse(F.regexp_replace(tx.strip(title), r"^\d+\s*\n", ""))
    title = F.when(number_at > 0, tx.strip(F.regexp_replace(title, r"^[.\-:]+", ""))).otherwise("")
    bullets = F.transform(
        _bullets(F.col("provisions")), lambda b: flat_section(tx.strip(F.regexp_replace(b, ";+$", "")))
    )
    word_text = tx.collapse(F.regexp_replace("keyword_text", r"(?m)^\s*\d+.*$", ""))
    words = F.transform(
        F.split(word_text, ";"), lambda w: flat_section(F.regexp_replace(w, '^[ “”".]+|[ “”".]+$', ""))
    )
    found = _once(
        found.withColumn("summary", F.coalesce("summary", "summary_alt")),
        number=F.coalesce(_some(F.regexp_extract("_number", PRECEDENT_NUMBER, 1)), F.lit("unknown")),
        title=title,
        published_on=spelled_date(F.col("court"), PUBLISHED_ON),
        source_note=flat_section(F.col("source_note")),
        court=flat_section(F.col("court")),
        location_note=flat_section(F.col("location_note")),
        summary=flat_section(F.col("summary")),
        **{name: F.coalesce(flat_section(F.col(name)), F.lit("")) for name in ("facts", "issue", "holding")},
        related_provisions=F.coalesce(F.filter(bullets, lambda b: (b != "") & b.rlike(PROVISION)), F.array().cast("array<string>")),
        keywords=F.coalesce(F.filter(words, lambda w: w != ""), F.array().cast("array<string>")),
        reasoning=F.coalesce(flat_section(F.col("_reasoning")), F.lit("")),
    )
    return found.select(
        "doc_id", "number", "title", "source_note", "court", "published_on", "location_note", "summary", "facts", "issue",
        "holding", "related_provisions", "keywords", "reasoning")


# ---- page locations ---------------------------------------------------------
ARTICLE_HEADING_LINE = r"(?iuU)^[ \t]*Điều[ \t]+(\d+)([A-Za-z]*)\b"


def locate_articles(pages: DataFrame) -> DataFrame:
    """Start and end page of every article number, from `doc_id, page, text`.

    Blank pages take part neither in the text nor in the offsets. The span ends
    on the page that holds the last character before the next heading.
    """
    kept = pages.where(tx.strip(F.col("text")) != "").repartition(F.col("doc_id"))
    lines = kept.select("doc_id", "page", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    heading = lines.withColumn("article_no", _some(F.regexp_extract("line", ARTICLE_HEADING_LINE, 1))).withColumn(
        "suffix", F.regexp_extract("line", ARTICLE_HEADING_LINE, 2)
    )
    order = Window.partitionBy("doc_id").orderBy("page", "line_no")
    # The line before the next heading, hence its page, is where the span ends.
    with_previous = heading.withColumn("page_before", F.lag("page").over(order))
    heads = with_previous.where(F.col("article_no").isNotNull())
    by_head = Window.partitionBy("doc_id").orderBy("page", "line_no")
    spans = heads.withColumn("next_page", F.lead("page_before").over(by_head))
    first = Window.partitionBy("doc_id", "article_no").orderBy("page", "line_no")
    return (
        spans.where(F.col("suffix") == "")
        .withColumn("_n", F.row_number().over(first))
        .where(F.col("_n") == 1)
        .select(
            "doc_id", "article_no", F.col("page").alias("page_start"),
            F.greatest("page", F.coalesce("next_page", "page")).alias("page_end"),
            F.lit("article_span").alias("locator_confidence"),
        )
    )


def document_span(pages: DataFrame) -> DataFrame:
    kept = pages.where(tx.strip(F.col("text")) != "")
    return kept.groupBy("doc_id").agg(
        F.min("page").alias("page_start"), F.max("page").alias("page_end"),
        F.lit("document_span").alias("locator_confidence"),
    )


def attach_locations(unit_rows: DataFrame, pages: DataFrame) -> DataFrame:
    """Article spans on every unit; units of unlocated articles get the document span."""
    spans = locate_articles(pages)
    whole = document_span(pages).select(
        "doc_id", F.col("page_start").alias("_s"), F.col("page_end").alias("_e"), F.col("locator_confidence").alias("_c")
    )
    return (
        unit_rows.join(spans, ["doc_id", "article_no"], "left")
        .join(whole, "doc_id", "left")
        .withColumns({
            "page_start": F.coalesce("page_start", "_s"),
            "page_end": F.coalesce("page_end", "_e"),
            "locator_confidence": F.coalesce("locator_confidence", "_c"),
        })
        .drop("_s", "_e", "_c")
    )


def locate_sections(sections: DataFrame, pages: DataFrame) -> DataFrame:
    """Page of each precedent section by its first words, over page texts.

    A match starting on one page may run over to the next, so each page is
    compared together with the head of the page after it.
    """
    kept = pages.where(tx.strip(F.col("text")) != "")
    order = Window.partitionBy("doc_id").orderBy("page")
    joined = kept.withColumn(
        "seen", F.concat_ws("\n", "text", F.substring(F.lead("text").over(order), 1, 400))
    ).withColumn("size", F.length("text"))
    probe = tx.strip(F.col("section_text"))
    rows = sections.where(probe != "").withColumn("probe", F.substring(probe, 1, 160)).withColumn(
        "loose", tx.collapse(F.substring(probe, 1, 120))
    )
    at = rows.join(joined.select("doc_id", "page", "seen", "size"), "doc_id")
    at = at.withColumn("pos", F.position("probe", "seen"))
    hit = (F.col("pos") > 0) & (F.col("pos") <= F.col("size") + 1)
    loose_hit = (F.length("loose") >= 20) & F.contains(tx.collapse(F.lower("seen")), F.lower("loose"))
    best = at.groupBy("doc_id", "section").agg(
        F.min(F.when(hit, F.col("page"))).alias("direct"), F.min(F.when(loose_hit, F.col("page"))).alias("wrapped")
    )
    return best.select(
        "doc_id", "section", F.coalesce("direct", "wrapped").alias("page"),
    ).where(F.col("page").isNotNull()).withColumn("locator_confidence", F.lit("section_text"))


# ---- page locations by offsets ------------------------------------------------
#: Characters in a bucket of offsets: a page and a span meet where they share one.
OFFSET_BUCKET = 4096


def page_extents(pages: DataFrame) -> DataFrame:
    """`doc_id, page, low, high`: where each page lies in its document's joined text.

    Blank pages take part neither in the text nor in the offsets; a page's line break
    belongs to it.
    """
    kept = pages.where(tx.strip(F.col("text")) != "").select("doc_id", "page", (F.length("text") + 1).alias("size"))
    upto = F.sum("size").over(Window.partitionBy("doc_id").orderBy("page"))
    return kept.select("doc_id", "page", (upto - F.col("size")).alias("low"), upto.alias("high"))


def locate_spans(spans: DataFrame, pages: DataFrame) -> DataFrame:
    """Add `page_start, page_end` to spans (`doc_id, start, end`: offsets from 0, the end not included).

    A join of intervals: prefix sums of page lengths give each page its extent, and both
    sides meet by document and bucket of offsets, so that a document of many pages is
    many small groups. An empty span lies on the page of its start; spans beyond the
    text are left out.
    """
    width = F.lit(OFFSET_BUCKET)
    cut = page_extents(pages).withColumn("bucket", F.explode(F.sequence(F.floor(F.col("low") / width), F.floor((F.col("high") - 1) / width))))

    def at(rows: DataFrame, place: Column, out: str) -> DataFrame:
        side = cut.select(F.col("doc_id").alias("_doc"), F.col("page").alias(out), "low", "high", "bucket")
        probed = rows.withColumn("_at", place)
        inside = (F.col("_at") >= F.col("low")) & (F.col("_at") < F.col("high"))
        met = probed.join(side, (F.col("doc_id") == F.col("_doc")) & (F.floor(F.col("_at") / width) == F.col("bucket")) & inside)
        return met.drop("_doc", "_at", "low", "high", "bucket")

    return at(at(spans, F.col("start"), "page_start"), F.greatest(F.col("start"), F.col("end") - 1), "page_end")
