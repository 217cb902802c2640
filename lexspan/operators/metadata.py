"""Metadata of documents and their units: hierarchy, roles, tags, references, validity."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexspan.functions import text as tx
from lexspan.operators import structure as st

# ---- fixed values ---------------------------------------------------------
DISPLAY_TYPE = {
    "bo_luat": "Bộ luật", "nghi_dinh": "Nghị định", "nghi_quyet": "Nghị quyết",
    "thong_tu": "Thông tư", "an_le": "Án lệ",
}
DOCUMENT_ROLE = {
    "bo_luat": "statute_code", "nghi_dinh": "implementation_guidance", "nghi_quyet": "judicial_guidance",
    "thong_tu": "administrative_guidance", "an_le": "case_law",
}
LEGAL_ROLES = (
    ("definition", ("giải thích từ ngữ", "khái niệm", "định nghĩa")),
    ("principle", ("nguyên tắc",)),
    ("scope", ("phạm vi điều chỉnh", "đối tượng áp dụng")),
    ("rights_obligations", ("quyền", "nghĩa vụ")),
    ("condition_exception", ("trừ trường hợp", "trường hợp", "điều kiện")),
    ("legal_effect", ("xử lý", "hậu quả")),
)
DEFAULT_ROLE = "rule"
DOMAIN_TAGS = (
    ("dan_su", ("dân sự", "giao dịch dân sự", "quan hệ dân sự")),
    ("hop_dong", ("hợp đồng",)),
    ("bao_dam", ("bảo đảm", "thế chấp", "cầm cố", "đặt cọc")),
    ("tai_san", ("tài sản", "sở hữu", "quyền sở hữu")),
    ("thua_ke", ("thừa kế", "di chúc", "di sản")),
    ("to_tung", ("tố tụng", "khởi kiện", "tranh chấp")),
    ("an_le", ("án lệ",)),
    ("hinh_su", ("hình sự", "tội phạm", "truy cứu trách nhiệm hình sự", "phạt tù")),
    ("dat_dai", ("đất đai", "thửa đất", "quyền sử dụng đất", "sổ đỏ", "nhà ở")),
    ("lao_dong", ("lao động", "người lao động", "hợp đồng lao động", "lương", "sa thải")),
    ("doanh_nghiep", ("doanh nghiệp", "công ty", "cổ phần", "đầu tư", "phá sản")),
    ("thue", ("thuế", "đóng thuế", "khai thuế", "thuế thu nhập")),
)
DEFAULT_TAG = "phap_luat_viet_nam"
COURTS = (
    r"Tòa án nhân dân tối cao",
    r"Tòa án nhân dân cấp cao(?: tại [^.;,\n]+)?",
    r"Tòa án nhân dân [^.;,\n]+",
    r"Hội đồng Thẩm phán Tòa án nhân dân tối cao",
)
UPPER_LETTERS = (
    "A-ZĂÂĐÊÔƠƯÁÀẢÃẠẮẰẲẴẶẤẦẨẪẬÉÈẺẼẸẾỀỂỄỆÍÌỈĨỊÓÒỎÕỌỐỒỔỖỘỚỜỞỠỢÚÙỦŨỤỨỪỬỮỰÝỲỶỸỴ"
)
DOCUMENT_REFERENCE = (
    r"(?iu)(Bộ luật Dân sự(?: năm \d{4})?|Bộ luật Tố tụng dân sự(?: năm \d{4})?|"
    rf"Luật(?: sửa đổi, bổ sung một số điều của)? [{UPPER_LETTERS}][^;,\n]{{4,}}|"
    r"Nghị định(?: số)?|Nghị quyết(?: số)?|Thông tư(?: số)?)"
    r"(?:\s+số)?\s*(\d+[A-ZĐa-zđ\-]?/\d{4}/[A-ZĐ0-9\-]+)?"
)
ARTICLE_REFERENCE = (
    r"(?:Điều|điều)\s+(\d+[A-Za-z]*)(?:\s*,\s*(?:Khoản|khoản)\s+(\d+))?(?:\s*,\s*(?:Điểm|điểm)\s+([a-zđ]))?"
)
SELF_REFERENCES = r"^(?:luật này|bộ luật này|nghị định này|nghị quyết này|thông tư này)"
NAMED_DOCUMENT = rf"^(?:Bộ luật|Luật|Nghị định|Nghị quyết|Thông tư)\s+[{UPPER_LETTERS}]"
NAMED_CODE = r"(?iu)^(?:Bộ luật Dân sự|Bộ luật Tố tụng dân sự)(?: năm \d{4})?$"
EFFECT_DATES = (
    r"(?iu)có hiệu lực(?: thi hành)?(?: kể)? từ ngày\s+" + st.SPELLED_DATE,
    r"(?iu)có hiệu lực(?: thi hành)?(?: kể)? từ ngày\s+(\d{1,2})[-/](\d{1,2})[-/](\d{4})",
)
OFFICIAL_VALIDITY_SOURCES = (
    "official_registry", "csdl_quoc_gia_vbpl", "cong_bao_chinh_phu", "csdl_an_le_tandtc",
)
VALIDITY_FIELDS = (
    "validity_status", "effective_from", "effective_to", "repeal_reason", "source_of_validity",
    "validity_basis", "validity_confidence", "validity_checked_at",
)
# ---------------------------------------------------------------------------


def lookup(column: Column, values: dict[str, str], default: Column | None = None) -> Column:
    out = default if default is not None else column
    for key, value in values.items():
        out = F.when(column == key, F.lit(value)).otherwise(out)
    return out


def has_any(text: Column, needles) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(n)) for n in needles])


def legal_role(title: Column, text: Column) -> Column:
    haystack = F.lower(F.concat_ws(" ", F.coalesce(title, F.lit("")), F.coalesce(text, F.lit(""))))
    rule = F.lit(DEFAULT_ROLE)
    for role, needles in reversed(LEGAL_ROLES):
        rule = F.when(has_any(haystack, needles), F.lit(role)).otherwise(rule)
    return rule


def domain_tags(text: Column) -> Column:
    low = F.lower(F.coalesce(text, F.lit("")))
    tags = F.array_compact(F.array(*[F.when(has_any(low, needles), F.lit(tag)) for tag, needles in DOMAIN_TAGS]))
    return F.when(F.size(tags) > 0, tags).otherwise(F.array(F.lit(DEFAULT_TAG)))


def canonical_title(title: Column, doc_type: Column) -> Column:
    flat = tx.collapse(title)
    spelled = F.initcap(F.lower(flat))
    for wrong, right in (
        ("Dân Sự", "Dân sự"), ("Nghị Định", "Nghị định"), ("Nghị Quyết", "Nghị quyết"),
        ("Thông Tư", "Thông tư"), ("Bộ Luật", "Bộ luật"),
    ):
        spelled = F.replace(spelled, F.lit(wrong), F.lit(right))
    shouted = flat.rlike(r"[\p{Lu}]") & (F.upper(flat) == flat)
    name = F.when(shouted, spelled).otherwise(flat)
    return F.when(F.coalesce(title, F.lit("")) == "", lookup(doc_type, DISPLAY_TYPE)).otherwise(name)


def document_citations(docs: DataFrame) -> DataFrame:
    """Adds `citation`, `citation_short` and `document_role`."""
    name = canonical_title(F.col("title"), F.col("doc_type"))
    return docs.withColumns({
        "citation": F.concat(name, F.lit(" ("), "number", F.lit(")")),
        "citation_short": F.concat(lookup(F.col("doc_type"), DISPLAY_TYPE), F.lit(" số "), "number"),
        "document_role": lookup(F.col("doc_type"), DOCUMENT_ROLE, F.lit("legal_document")),
    })


def unit_citation(title: Column, doc_type: Column) -> Column:
    """Citation of a unit from its `article_no`, `clause_no` and `point_id`."""
    part = lambda word, c: F.when(F.coalesce(F.col(c), F.lit("")) != "", F.concat(F.lit(word), F.col(c)))
    return F.when(
        F.col("article_no").isNotNull(),
        F.concat_ws(
            ", ", canonical_title(title, doc_type), part("Điều ", "article_no"),
            part("Khoản ", "clause_no"), part("Điểm ", "point_id"),
        ),
    )


def document_metadata(docs: DataFrame) -> DataFrame:
    """Document-level fields; a precedent's issuer is the court named in it."""

    def court(text: Column) -> Column:
        hits = [st._some(F.regexp_extract(text, f"({p})", 1)) for p in COURTS]
        return F.trim(F.coalesce(*hits))

    issuer = F.coalesce(court(F.col("court")), court(F.col("source_note")), F.col("court"))
    return docs.withColumn("issuer", F.when(F.col("doc_type") == "an_le", issuer).otherwise(F.col("issuer")))


def nodes(docs: DataFrame, outlined: DataFrame | None, unit_rows: DataFrame) -> DataFrame:
    """The document tree as a flat table with ids, parents, ancestors and path.

    `docs` has `doc_id, title`. Depth is fixed, so there is no recursion: all levels are
    one projection over columns carried by the unit rows, which are read once. Without
    `outlined` the unit rows have the headings too (`structure.units(outlined, heads=True)`).
    """
    doc, unit = F.col("doc_id"), F.col("unit")
    key = lambda kind, *parts: tx.node_key(doc, kind, *[F.col(p) for p in parts])
    doc_key = key("document")
    chapter_key = F.when(F.col("chapter_at").isNotNull(), key("chuong", "chapter_no"))
    section_key = F.when(F.col("section_at").isNotNull(), key("muc", "chapter_no", "section_no"))
    article_key = key("dieu", "article_no")
    clause_key = key("khoan", "article_no", "clause_no")
    point_key = key("diem", "article_no", "clause_no", "point_id")
    label = lambda word, no, title: F.concat(
        F.lit(word), F.col(no), F.lit(": "), F.coalesce(F.col(title), F.lit("None"))
    )
    chapter_label = F.when(F.col("chapter_at").isNotNull(), label("Chương ", "chapter_no", "chapter_title"))
    section_label = F.when(F.col("section_at").isNotNull(), label("Mục ", "section_no", "section_title"))
    article_label = F.trim(F.concat(F.lit("Điều "), "article_no", F.lit(": "), F.coalesce("article_title", F.lit(""))))
    clause_label = F.concat(F.lit("Khoản "), "clause_no")
    point_label = F.concat(F.lit("Điểm "), "point_id")
    levels = ("chapter", "section", "article", "clause", "point")
    keys = (chapter_key, section_key, article_key, clause_key, point_key)
    labels = (chapter_label, section_label, article_label, clause_label, point_label)
    kinds = ("chuong", "muc", "dieu", "khoan", "diem")
    by_unit = lambda values: F.coalesce(*[F.when(unit == u, v) for u, v in zip(levels, values)])
    # Keys and labels of a row's own level and of those above it, made once.
    own = {"_key": doc_key} | {f"_key{i}": F.when(unit.isin(*levels[i:]), k) for i, k in enumerate(keys)}
    above = F.array_compact(F.array("_key", *[F.when(unit.isin(*levels[i + 1:]), F.col(f"_key{i}")) for i in range(len(keys) - 1)]))
    path = F.array_compact(F.array(F.col("doc_title"), *[F.when(unit.isin(*levels[i:]), v) for i, v in enumerate(labels)]))
    none = F.lit(None).cast("string")

    titled = docs.select("doc_id", F.col("title").alias("doc_title"))
    rows = unit_rows
    if outlined is not None:
        heads = outlined.where(F.col("role").isin("chapter", "section") & ~F.col("stray")).withColumn("unit", F.col("role"))
        columns = ["doc_id", "unit", *[f"{level}_{part}" for level in levels[:3] for part in ("no", "title", "at")]]
        rows = rows.unionByName(heads.select(*columns), allowMissingColumns=True)
    tree = rows.where(unit.isin(*levels)).join(titled, "doc_id").withColumns(own).withColumn("_above", above).select(
        "doc_id", by_unit([F.col(f"_key{i}") for i in range(len(keys))]).alias("node_id"), by_unit([F.lit(k) for k in kinds]).alias("node_type"),
        F.try_element_at("_above", F.lit(-1)).alias("parent_id"), F.col("_above").alias("ancestor_ids"), path.alias("path"),
        by_unit([F.col(c).cast("string") for c in ("chapter_no", "section_no", "article_no", "clause_no", "point_id")]).alias("number"),
        by_unit([F.col(f"{level}_title").cast("string") for level in levels[:3]]).alias("title"),
    )
    root = titled.select(
        "doc_id", doc_key.alias("node_id"), F.lit("document").alias("node_type"), none.alias("parent_id"),
        F.array().cast("array<string>").alias("ancestor_ids"), F.array(F.col("doc_title")).alias("path"),
        none.alias("number"), none.alias("title"),
    )
    return root.unionByName(tree)


def keyword_metadata(precedents: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    return precedents.where(F.size("keywords") > 0).select("doc_id", "keywords", *keep)


def _references_of(text: Column) -> Column:
    """References of one text, in order, as an array of structs."""
    groups = lambda pattern, n: F.arrays_zip(*[
        F.regexp_extract_all(text, F.lit(pattern), F.lit(i)).alias(f"g{i}") for i in range(n + 1)
    ])
    some = lambda word, c: F.when(c != "", F.concat(F.lit(word), c))

    def article(m: Column) -> Column:
        raw = tx.strip(m["g0"])
        return F.struct(
            F.lit("article").alias("ref_type"), raw.alias("ref_text"),
            F.concat_ws(", ", some("Điều ", m["g1"]), some("Khoản ", m["g2"]), some("Điểm ", m["g3"])).alias("normalized_ref"),
            F.concat(F.lit("article::"), raw).alias("key"),
        )

    def document(m: Column) -> Column:
        raw = F.regexp_replace(m["g0"], r"^[ ;,.]+|[ ;,.]+$", "")
        return F.struct(
            F.lit("document").alias("ref_type"), raw.alias("ref_text"),
            F.concat_ws(" ", tx.collapse(m["g1"]), F.nullif(m["g2"], F.lit(""))).alias("normalized_ref"),
            F.concat(F.lit("doc::"), F.lower(raw)).alias("key"),
        )

    def usable(ref: Column) -> Column:
        raw = ref["ref_text"]
        low = F.lower(raw)
        likely = F.contains(low, F.lit(" số ")) | raw.rlike(NAMED_DOCUMENT) | raw.rlike(NAMED_CODE)
        return (
            (F.length(raw) >= 8)
            & ~(low.startswith("luật ") & (F.regexp_count(raw, F.lit(r"\S+")) < 3))
            & ~low.rlike(SELF_REFERENCES) & likely
        )

    articles, documents = groups(ARTICLE_REFERENCE, 3), groups(DOCUMENT_REFERENCE, 2)
    plain = tx.strip(text)
    raw_ref = F.array(F.struct(
        F.lit("raw").alias("ref_type"), plain.alias("ref_text"), plain.alias("normalized_ref"),
        F.concat(F.lit("raw::"), F.lower(plain)).alias("key"),
    ))
    found = F.concat(F.transform(articles, article), F.filter(F.transform(documents, document), usable))
    return F.when(
        (F.size(articles) > 0) | (F.size(documents) > 0), found
    ).otherwise(raw_ref)


def references(df: DataFrame, keys: list[str], texts: str) -> DataFrame:
    """References in an array of texts: one row each, first of equal keys kept.

    Returns `keys, ref_no, ref_type, ref_text, normalized_ref`.
    """
    used = df.select(*keys, F.posexplode(F.filter(F.col(texts), lambda t: t.isNotNull() & (t != ""))).alias("text_no", "t"))
    rows = used.select(*keys, "text_no", F.posexplode(_references_of(F.col("t"))).alias("pos", "r"))
    first = rows.groupBy(*keys, F.col("r.key").alias("key")).agg(
        F.min(F.struct("text_no", "pos", "r.ref_type", "r.ref_text", "r.normalized_ref")).alias("m")
    )
    place = Window.partitionBy(*keys).orderBy("m.text_no", "m.pos")
    return first.select(
        *keys, F.row_number().over(place).alias("ref_no"), "m.ref_type", "m.ref_text", "m.normalized_ref"
    )


def effect_date(text: Column) -> Column:
    return F.coalesce(*[st.spelled_date(text, p) for p in EFFECT_DATES])


def article_bodies(unit_rows: DataFrame) -> DataFrame:
    """Each article with its own text and that of its clauses, one string."""
    piece = F.when(F.col("unit").isin("article", "clause") & (F.col("text") != ""), F.struct("first_line", "text"))
    return unit_rows.groupBy("doc_id", "article_no", "article_title", "article_at").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(piece)), lambda p: p["text"]), "\n").alias("body")
    )


def validity(docs: DataFrame, bodies: DataFrame) -> DataFrame:
    """Validity of each document from its effect and transition articles.

    `docs` has `doc_id, effective_on`.
    """
    title = F.lower(F.coalesce("article_title", F.lit("")))
    marked = bodies.withColumns({
        "in_effect": title.contains("hiệu lực") | title.contains("điều khoản thi hành"),
        "transition": title.contains("chuyển tiếp"),
        "place": F.struct(st.article_order().alias("a"), F.col("article_at").alias("b")),
    }).where(F.col("in_effect") | F.col("transition"))
    low = F.lower("body")
    ends = F.col("in_effect") & (low.contains("hết hiệu lực") | low.contains("thay thế"))
    refs = references(
        marked.where(ends).withColumn("texts", F.array("body")), ["doc_id", "article_at"], "texts"
    ).where(F.col("ref_type") == "document")
    replaced = refs.groupBy("doc_id").agg(F.sort_array(F.collect_set("normalized_ref")).alias("replaced_documents"))
    dated = F.when(F.col("in_effect"), effect_date(F.col("body")))
    per_doc = marked.groupBy("doc_id").agg(
        F.min_by(dated, F.when(dated.isNotNull(), F.col("place"))).alias("clause_date"),
        F.slice(F.transform(
            F.sort_array(F.collect_list(F.when(F.col("transition"), F.struct("place", tx.strip(F.col("body")).alias("t"))))),
            lambda n: n["t"]), 1, 3).alias("transition_notes"),
    )
    joined = docs.join(per_doc, "doc_id", "left").join(replaced, "doc_id", "left")
    start = F.coalesce("effective_on", "clause_date")
    none = F.array().cast("array<string>")
    replaced_list = F.coalesce("replaced_documents", none)
    return joined.withColumns({
        "effective_from": start,
        "replaced_documents": replaced_list,
        "transition_notes": F.coalesce("transition_notes", none),
        "validity_status": F.when(F.size(replaced_list) > 0, "co_hieu_luc_va_thay_the_van_ban_khac")
        .when(start.isNotNull(), "co_ngay_hieu_luc").otherwise("chua_xac_dinh"),
        "validity_basis": F.when(start.isNotNull(), "parsed_effective_clause").otherwise("not_found_in_parsed_text"),
        "validity_confidence": F.when(start.isNotNull(), "medium").otherwise("low"),
        "source_of_validity": F.lit("unverified_parsed_text"),
        "effective_to": F.lit(None).cast("date"),
        "validity_checked_at": F.lit(None).cast("date"),
        "repeal_reason": F.lit(None).cast("string"),
    }).drop("clause_date")


def replacement_relations(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.explode("replaced_documents").alias("target_doc")).select(
        "doc_id", F.lit("replaces_or_terminates").alias("relation_type"), "target_doc",
        F.lit("parsed_effective_clause").alias("relation_source"),
    )


def validity_note(status: Column, effective_on: Column, has_relations: Column) -> Column:
    return (
        F.when(status != "chua_xac_dinh", status)
        .when(effective_on.isNotNull(), "co_ngay_hieu_luc")
        .when(has_relations, "co_thong_tin_sua_doi_bo_sung")
        .otherwise("chua_xac_dinh")
    )


def normal_relations(relations: DataFrame) -> DataFrame:
    """One shape for relations from any source; rows without target and type go."""
    cols = set(relations.columns)
    get = lambda c: F.nullif(F.col(c), F.lit("")) if c in cols else F.lit(None).cast("string")
    target = F.coalesce(get("target_doc"), get("target_number"), get("target_text"))
    note = F.concat_ws(" | ", get("note"), get("target_type"))
    return relations.where(target.isNotNull() | get("relation_type").isNotNull()).select(
        "doc_id", F.coalesce(get("relation_type"), F.lit("related")).alias("relation_type"),
        target.alias("target_doc"), get("target_article").alias("target_article"),
        get("target_clause").alias("target_clause"), F.nullif(note, F.lit("")).alias("note"),
        F.coalesce(get("relation_source"), F.lit("parsed_text")).alias("relation_source"),
    )


def override_validity(df: DataFrame, prefix: str = "src_") -> DataFrame:
    """Official validity fields (`src_*`) replace parsed ones when four gates hold."""
    s = lambda c: F.col(prefix + c)
    gate = F.coalesce(
        (s("source_verification_status") == "official_verified")
        & F.trim(s("source_of_validity")).isin(*OFFICIAL_VALIDITY_SOURCES)
        & s("validity_checked_at").isNotNull() & (F.coalesce(s("validity_status"), F.lit("")) != "")
        & (F.lower(F.trim(s("validity_confidence"))) == "high"),
        F.lit(False),
    )
    return df.withColumns({
        c: F.when(gate, F.coalesce(s(c), F.col(c))).otherwise(F.col(c)) for c in VALIDITY_FIELDS if c in df.columns
    })


def precedent_metadata(precedents: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Citation, tags and the facts/issue/holding/reasoning summary of precedents; `keep`: columns carried along."""
    joined = F.concat_ws(" ", "title", "issue", "holding", F.array_join("keywords", " "))
    return precedents.select(
        "doc_id",
        F.concat(F.lit("Án lệ số "), "number").alias("citation"),
        F.col("number").alias("citation_short"),
        F.lit("case_law").alias("document_role"),
        domain_tags(joined).alias("legal_domain_tags"),
        F.lit("an_le_da_cong_bo").alias("validity_status"),
        F.col("published_on").alias("effective_from"),
        F.lit("case_law_publication_date_parsed").alias("validity_basis"),
        F.when(
            F.coalesce("source_note", F.lit("")) != "",
            F.array(F.struct(
                F.lit("case_law_source").alias("relation_type"), F.col("source_note").alias("target_doc"),
                F.lit("parsed_case_law_source").alias("relation_source"),
            )),
        ).alias("related_documents"),
        F.struct(
            tx.truncate(F.col("facts"), 400).alias("facts_summary"), F.col("issue").alias("legal_issue"),
            F.col("holding"), tx.truncate(F.col("reasoning"), 400).alias("reasoning_excerpt"),
        ).alias("case_law_schema"),
        *keep,
    )
