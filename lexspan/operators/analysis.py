"""Question analysis: ordered rules as data, compiled to Column expressions.

A condition is written as alternatives of term lists: `a + b | c` holds when
both `a` and `b`, or `c`, occur in the folded question; a tuple of terms holds when
one of them does.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexspan.functions import text as tx
from lexspan.operators.names import names_in
from lexspan.session import fits, materialize

# ---- fixed values ---------------------------------------------------------
SOURCE_ORDER = ("bo_luat", "nghi_quyet", "nghi_dinh", "an_le")
CIVIL, CRIMINAL = "Bộ luật Dân sự", "Bộ luật Hình sự"
DECREE_21, DECREE_99 = "Nghị định 21/2021/NĐ-CP", "Nghị định 99/2022/NĐ-CP"
OUT_OF_SCOPE = (
    "thoi tiet", "hom nay", "thue thu nhap", "thue gia tri gia tang", "tinh thue", "ban co phan", "lach luat",
    "tron thue", "nguoi lao dong", "sa thai", "ly hon", "nuoi con", "khieu nai quyet dinh xu phat hanh chinh",
    "xu phat hanh chinh",
)
# (request type, condition, targets, key phrases, scenario terms); first hit wins.
ROUTES = (
    ("out_of_scope", OUT_OF_SCOPE, (), (), ()),
    ("case_law_question", "an le", "precedents", ("án lệ", "hợp đồng thế chấp", "quyền định đoạt"), ()),
    ("validity_question", "nghi dinh + hieu luc", "documents", ("hiệu lực", "ngày hiệu lực", "thi hành"), ()),
    ("validity_question", "hieu luc + dieu kien + hop dong | hieu luc + giao dich dan su", ("Điều 117",),
     ("điều kiện có hiệu lực", "giao dịch dân sự", "hợp đồng"), ()),
    ("validity_question", "tu du 14 + duoi 16 + hinh su", ("Điều 12",),
     ("tuổi chịu trách nhiệm hình sự", "người từ đủ 14 tuổi", "dưới 16 tuổi"), ()),
    ("scenario_application", "an trom | trom cap", ("Điều 173",),
     ("trộm cắp tài sản", "giá trị tài sản", "hình phạt"), ("trộm cắp", "xe máy", "giá trị tài sản")),
    ("scenario_application", "lai xe | say xin | thuong tat", (f"{CRIMINAL}, Điều 260", f"{CIVIL}, Điều 590"),
     ("vi phạm quy định về tham gia giao thông", "bồi thường thiệt hại", "sức khỏe bị xâm phạm"),
     ("lái xe", "say xỉn", "thương tật", "bồi thường")),
    ("scenario_application", "neu + the chap", (), ("thế chấp", "quyền định đoạt", "hiệu lực giao dịch"), ()),
    ("citation_lookup", "giao dich dan su vo hieu do gia tao | vo hieu do gia tao | gia tao", ("Điều 124",),
     ("giao dịch dân sự vô hiệu do giả tạo", "giả tạo", "che giấu", "trốn tránh nghĩa vụ"), ()),
    ("validity_question", "dieu kien co hieu luc cua giao dich | dieu kien co hieu luc giao dich", ("Điều 117",),
     ("điều kiện có hiệu lực", "chủ thể", "tự nguyện", "mục đích", "nội dung", "hình thức"), ()),
    ("validity_question", "hieu luc doi khang | doi khang voi nguoi thu ba | dang ky bien phap bao dam", ("Điều 319",),
     ("hiệu lực đối kháng", "người thứ ba", "đăng ký", "thế chấp"), ()),
    ("validity_question", "the chap + hieu luc", ("Điều 319",), ("thế chấp", "hiệu lực", "công chứng", "chứng thực"), ()),
)
FALLBACK_VALIDITY = (
    "hieu luc", "het hieu luc", "thay the", "con ap dung", "bi bai bo",
)
FALLBACK_SCENARIO = (
    "neu ", "truong hop", "tinh huong", "co duoc", "phai lam gi", "xay ra",
)
MISSING_FACTS = (
    "chi noi", "chi biet", "chi co", "chi dua vao", "chi nghe noi", "khong giu loi", "khong cung cap",
    "thieu thong tin", "chua ro", "khong ro", "khong biet", "can bo sung", "co the ket luan ngay khong",
    "chua du tinh tiet",
)
LEGAL_FACTS = (
    "hop dong", "giao dich", "vo hieu", "boi thuong", "tranh chap", "quyen", "nghia vu", "hinh su", "thuong tat",
    "hanh vi", "thoi diem", "giay to", "chu the",
)
TRAFFIC = (
    "lai xe", "say xin", "thuong tat", "tai nan giao thong",
)
MISSING_HINTS = ("chủ thể", "tự nguyện", "mục đích", "nội dung")
THIRD_PARTY = "doi khang + nguoi thu ba + dang ky | doi khang + nguoi thu ba + the chap"
# Topics with their governing authority. mode: add or replace targets; a topic
# of the first group ends the search, one of the second is tried only after it.
# (type, condition, targets, phrases, mode); type "~x" yields to missing facts.
TOPICS_FIRST = (
    ("validity_question", "tu du 14 + duoi 16 + hinh su | tu du 14 + duoi 16 + trach nhiem", (f"{CRIMINAL}, Điều 12",),
     ("trách nhiệm hình sự", "người từ đủ 14 tuổi", "dưới 16 tuổi"), "replace"),
    ("~validity_question", "the chap + hieu luc + bo luat dan su + doi khang | the chap + hieu luc + bo luat dan su + nguoi thu ba",
     (f"{CIVIL}, Điều 319, Khoản 2",), ("thế chấp", "hiệu lực", "đối kháng", "người thứ ba"), "replace"),
    ("~validity_question", "the chap + hieu luc + bo luat dan su", (f"{CIVIL}, Điều 319",),
     ("thế chấp", "hiệu lực", "đối kháng", "người thứ ba"), "replace"),
    ("validity_question",
     "nghi dinh 21/2021/nd-cp + hieu luc | nghi dinh 21/2021/nd-cp + thoi diem | nghi dinh 21/2021/nd-cp + hien nay"
     " | nghi dinh 21/2021/nd-cp + moi hon | nghi dinh 21/2021/nd-cp + thay the",
     "decree21", ("hiệu lực", "thời điểm", "văn bản mới hơn", "thay thế"), "replace"),
    ("decree99", "nghi dinh 99/2022/nd-cp", "decree99", ("đăng ký", "biện pháp bảo đảm", "thời điểm", "hiệu lực"), "replace"),
    ("~validity_question", "dang ky + bien phap bao dam + doi khang | dang ky + bien phap bao dam + doi voi nguoi thu ba",
     (f"{CIVIL}, Điều 319, Khoản 2", f"{DECREE_99}, Điều 6"), ("đăng ký", "biện pháp bảo đảm", "đối kháng", "người thứ ba"), "replace"),
    ("citation_lookup", "bien phap bao dam + phai dang ky | bien phap bao dam + truong hop", (f"{DECREE_99}, Điều 4",),
     ("đăng ký", "biện pháp bảo đảm", "quyền sử dụng đất"), "replace"),
    ("validity_question", "bien phap bao dam + hieu luc + thoi diem", (f"{DECREE_99}, Điều 6",),
     ("hiệu lực", "đăng ký", "thời điểm"), "replace"),
    ("scenario_application", "dang ky + the chap + quyen su dung dat", (f"{CIVIL}, Điều 319", DECREE_99),
     ("thế chấp", "đăng ký", "đối kháng", "quyền sử dụng đất"), "add"),
    ("scenario_application", "danh du + nhan pham | danh du + uy tin", (f"{CIVIL}, Điều 34",),
     ("danh dự", "nhân phẩm", "uy tín", "cải chính", "bồi thường"), "add"),
    ("validity_question", "hop dong theo mau | dieu khoan mau", (f"{CIVIL}, Điều 405",),
     ("hợp đồng theo mẫu", "điều khoản", "bên kia"), "add"),
    ("scenario_application", "hoan canh thay doi co ban", (f"{CIVIL}, Điều 420",),
     ("hoàn cảnh thay đổi cơ bản", "đàm phán", "Tòa án", "chấm dứt"), "add"),
    ("validity_question", "nguon + bo luat dan su + chinh thuc | nguon + bo luat dan su + xac minh | nguon + bo luat dan su + official",
     (CIVIL,), ("nguồn chính thức", "xác minh", "hiệu lực"), "add"),
)
TOPICS_THEN = (
    ("case_law_question", "an le so 43/2021/al", ("Án lệ số 43/2021/AL",), (), "add"),
    ("scenario_application", "thanh toan + the chap + ngan hang + cap so | thanh toan + the chap + ngan hang + so do",
     ("Án lệ số 43/2021/AL",), ("thế chấp", "thanh toán", "cấp sổ", "ngân hàng"), "add"),
    ("citation_lookup", "nguyen tac co ban + binh dang | nguyen tac co ban + thien chi", (f"{CIVIL}, Điều 3",), (), "add"),
    ("citation_lookup", "tap quan + quan he dan su", (f"{CIVIL}, Điều 5",), (), "add"),
    ("citation_lookup", "quyen dan su + co so", (f"{CIVIL}, Điều 8",), (), "add"),
    ("citation_lookup", "bien phap bao ve + quyen dan su", (f"{CIVIL}, Điều 11",), (), "add"),
    ("validity_question", "thiet hai + boi thuong + quyen dan su", (f"{CIVIL}, Điều 13",), (), "add"),
    ("validity_question", "nang luc phap luat dan su + ca nhan", (f"{CIVIL}, Điều 16",), (), "add"),
    ("scenario_application", "nguoi chua thanh nien | tu du 14 + duoi 16", (f"{CIVIL}, Điều 21",), (), "add"),
    ("scenario_application", "hinh anh + nguoi khac", (f"{CIVIL}, Điều 32",), (), "add"),
    ("citation_lookup", "hop dong la gi | hop dong + noi dung + thoa thuan", (f"{CIVIL}, Điều 385", f"{CIVIL}, Điều 398"), (), "add"),
    ("validity_question", "lap bang van ban | cong chung + chung thuc", (f"{CIVIL}, Điều 119", f"{CIVIL}, Điều 129"), (), "add"),
    ("validity_question", "don phuong cham dut", (f"{CIVIL}, Điều 428",), (), "add"),
    ("citation_lookup", "thoi hieu khoi kien + hop dong", (f"{CIVIL}, Điều 429",), (), "add"),
    ("scenario_application", "hu hong tai san + boi thuong", (f"{CIVIL}, Điều 589",), (), "add"),
    ("scenario_application", "suc khoe + boi thuong", (f"{CIVIL}, Điều 590",), (), "add"),
    ("scenario_application", "chet + boi thuong", (f"{CIVIL}, Điều 591",), (), "add"),
    ("citation_lookup", "mo thua ke", (f"{CIVIL}, Điều 611",), (), "add"),
    ("citation_lookup", "truy doi + bao dam", (f"{DECREE_21}, Điều 7",), (), "add"),
    ("citation_lookup", "quyen su dung dat + bao dam", (f"{DECREE_21}, Điều 10",), (), "add"),
    ("scenario_application", "tang gia tri + tai san the chap", (f"{DECREE_21}, Điều 20",), (), "add"),
    ("citation_lookup", "yeu cau dang ky + cung cap thong tin", (f"{DECREE_99}, Điều 8",), (), "add"),
    ("scenario_application", "bo luat dan su + nghi dinh 21 + the chap", (f"{CIVIL}, Điều 317", f"{DECREE_21}, Điều 10"), (), "add"),
)
DECREE_99_VALIDITY = "hieu luc | thay the | het hieu luc | con ap dung | hien nay | moi hon | doi chieu"
DECREE_99_ARTICLES = (("truong hop | phai dang ky", "4"), ("hieu luc | thoi diem | thay the", "6"), ("cung cap thong tin | yeu cau dang ky", "8"))
LATE_SCENARIO = (
    "neu ", "tinh huong", "xay ra", "muon ", "tu y ", "nguoi lam ", "nguoi chua thanh nien", "giao dich cua",
)
LATE_VALIDITY = (
    "hieu luc", "cong chung", "chung thuc", "bat dau va cham dut", "don phuong cham dut",
)
LATE_LOOKUP = (
    "theo quy dinh", "can cu nao", "quyen", "quy dinh", "nhu the nao", "truong hop nao",
)
SCENARIO_TERMS = (
    ("thanh toán", ("thanh toán", "trả tiền", "chưa trả", "đã trả")),
    ("ngân hàng", ("ngân hàng", "tổ chức tín dụng")),
    ("sổ đỏ", ("sổ đỏ", "giấy chứng nhận", "cấp sổ")),
    ("bên mua", ("bên mua", "người mua")),
    ("bên bán", ("bên bán", "người bán")),
    ("người thứ ba", ("người thứ ba", "bên thứ ba")),
    ("quyền định đoạt", ("quyền định đoạt", "định đoạt")),
    ("đăng ký", ("đăng ký",)),
    ("công chứng", ("công chứng",)),
    ("chứng thực", ("chứng thực",)),
    ("hợp đồng", ("hợp đồng", "giao dịch")),
    ("thế chấp", ("thế chấp",)),
    ("tài sản", ("tài sản", "nhà", "đất")),
)
DOMAIN_PHRASES = (
    "bang van ban", "cong chung", "chung thuc", "hinh thuc", "the chap", "quyen su dung dat", "bao dam nghia vu",
    "boi thuong", "tai san", "nguoi chua thanh nien", "don phuong cham dut", "thoi hieu khoi kien",
)
STOP_WORDS = ("là gì", "như thế nào", "có được", "không", "tại", "quy định", "nào")
ARTICLE_MENTION = r"(?iuU)((?:khoản\s+\d+\s+)?điều\s+\d+[a-z]?)"
ARTICLE_MENTION_PLAIN = r"((?:khoan\s+\d+\s+)?dieu\s+\d+[a-z]?)"
DOCUMENT_MENTION = (
    r"(?iu)((?:nghị định|thông tư|nghị quyết|quyết định)\s+(?:số\s+)?\d+(?:/\d{4}/[A-ZĐ\-]+)?"
    r"|(?:bộ luật|luật)\s+[A-Za-zÀ-ỹĐđ\s]+?(?:năm\s+)?\d{4})"
)
SOURCE_PHRASES = (
    ("bo_luat", "bo luat | luat"), ("nghi_dinh", "nghi dinh"), ("nghi_quyet", "nghi quyet"),
    ("thong_tu", "thong tu"), ("an_le", "an le"),
)
AUTHORITY_WORDS = (
    "bo luat ", "luat ", "nghi dinh ", "nghi quyet ", "thong tu ", "quyet dinh ", "an le ",
)
YEAR = r"\b(19\d{2}|20\d{2})\b"
HISTORY_TERMS = (
    "het hieu luc", "thay the", "van ban cu", "truoc khi", "tai thoi diem", "lich su",
)
ARTICLE_REF = r"(?:khoan\s+(\d+)\s+)?dieu\s+(\d+[a-z]?)\b"
PRECEDENT_REF = r"\ban\s+le\s+so\s+(\d+\s*/\s*\d{4}\s*/\s*al)\b"
MAX_VARIANTS = 10
# Rows of different texts that are broadcast; bytes of different lists that a part of the result has on average, and most parts.
BROADCAST_TEXTS, PART_BYTES, MOST_PARTS = 100_000, 128 << 10, 2000
# ---------------------------------------------------------------------------

EMPTY = "array<string>"


def alternatives(condition: str | tuple[str, ...]) -> tuple[str, ...]:
    """The options of a condition: a list of terms, or `a + b | c`."""
    return condition if isinstance(condition, tuple) else tuple(condition.split(" | "))


def holds(text: Column, condition: str | tuple[str, ...]) -> Column:
    """Compile a condition; a term's own trailing blank counts."""
    options = []
    for option in alternatives(condition):
        terms = [F.contains(text, F.lit(term)) for term in option.split(" + ")]
        options.append(reduce(lambda a, b: a & b, terms))
    return reduce(lambda a, b: a | b, options)


def strings(items=()) -> Column:
    return F.array(*[F.lit(i) for i in items]).cast(EMPTY)


def union(*arrays: Column) -> Column:
    return F.array_distinct(F.concat(*arrays))


def all_matches(text: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def normal_query(text: Column) -> Column:
    return tx.collapse(tx.nfc(F.coalesce(text, F.lit(""))))


def source_types(text: Column) -> Column:
    """Document types named in folded text."""
    return F.array_compact(F.array(*[F.when(holds(text, c), F.lit(t)) for t, c in SOURCE_PHRASES]))


def scenario_terms(haystack: Column, plain: Column) -> Column:
    """Terms found in the question, else in its folded form.

    Both arguments should be plain columns: each is read once per variant.
    """
    def hits(text):
        return F.array_compact(F.array(*[
            F.when(
                reduce(lambda a, b: a | b, [F.contains(text, F.lit(v)) | F.contains(text, F.lit(_folded(v))) for v in variants]),
                F.lit(name),
            )
            for name, variants in SCENARIO_TERMS
        ]))

    found = hits(haystack)
    return F.when(F.size(found) > 0, found).otherwise(hits(plain))


def _folded(text: str) -> str:
    return text.lower().translate(str.maketrans(tx.ACCENTED, tx.PLAIN))


def _plain_articles(plain: Column) -> Column:
    return F.transform(
        all_matches(plain, ARTICLE_MENTION_PLAIN),
        lambda m: F.regexp_replace(F.regexp_replace(m, r"\bdieu\b", "Điều"), r"\bkhoan\b", "Khoản"),
    )


def _named_targets(kind: str) -> Column:
    """Targets that a rule reads from the question itself."""
    normal, plain = F.col("normalized_query"), F.col("_plain")
    if kind == "precedents":
        found = all_matches(normal, r"(?iu)(án lệ số\s+\d+/\d+/AL)")
        return F.when(F.size(found) > 0, found).otherwise(all_matches(plain, r"(?i)(an le so\s+\d+/\d+/AL)"))
    if kind == "documents":
        found = all_matches(normal, DOCUMENT_MENTION)
        first = F.regexp_extract(plain, r"\b(nghi dinh\s+\d+/\d{4}/[a-z\-]+)", 1)
        return F.when(F.size(found) > 0, found).when(first != "", F.array(first)).otherwise(strings())
    article = F.nullif(F.regexp_extract(plain, r"\bdieu\s+(\d+[a-z]?)\b", 1), F.lit(""))
    if kind == "decree99":
        article = F.coalesce(article, *[F.when(holds(plain, c), F.lit(n)) for c, n in DECREE_99_ARTICLES])
    name = {"decree21": DECREE_21, "decree99": DECREE_99}[kind]
    return F.array(F.concat(F.lit(name), F.coalesce(F.concat(F.lit(", Điều "), article), F.lit(""))))


def _targets(spec) -> Column:
    return _named_targets(spec) if isinstance(spec, str) else strings(spec)


def _first_rule(df: DataFrame, name: str, rules, allowed: Column) -> DataFrame:
    """Adds the number of the first rule that holds (null when none or not allowed)."""
    number = F.lit(None).cast("int")
    for i in range(len(rules) - 1, -1, -1):
        number = F.when(holds(F.col("_plain"), rules[i][1]), F.lit(i)).otherwise(number)
    return df.withColumn(name, F.when(allowed, number))


def _by_rule(name: str, rules, pick, default: Column) -> Column:
    out = default
    for i in range(len(rules) - 1, -1, -1):
        out = F.when(F.col(name) == i, pick(rules[i])).otherwise(out)
    return out


def analyse(questions: DataFrame) -> DataFrame:
    """Questions (`query_id, raw_query`) to intents, by deterministic rules.

    A step only refines columns set before it, so the whole analysis is one
    projection per step with no join and no shuffle.
    """
    df = questions.withColumn("normalized_query", normal_query(F.col("raw_query")))
    df = df.withColumns({"_hay": tx.casefold(F.col("normalized_query")), "_plain": tx.match_form(F.col("normalized_query"))})
    df = df.withColumns({
        "scenario_terms": scenario_terms(F.col("_hay"), F.col("_plain")),
        "_articles": all_matches(F.col("normalized_query"), ARTICLE_MENTION),
        "_documents": all_matches(F.col("normalized_query"), DOCUMENT_MENTION),
    })
    df = df.withColumn("_articles", F.when(F.size("_articles") > 0, F.col("_articles")).otherwise(_plain_articles(F.col("_plain"))))

    # Routing rules, then citations, then the coarse fallback.
    df = _first_rule(df, "_route", ROUTES, F.lit(True))
    routed = F.col("_route").isNotNull()
    cited = (F.size("_articles") > 0) | (F.size("_documents") > 0)
    plain = F.col("_plain")
    fallback = (
        F.when(holds(plain, FALLBACK_VALIDITY), "validity_question").when(cited, "citation_lookup")
        .when(holds(plain, FALLBACK_SCENARIO), "scenario_application")
    )
    df = df.withColumns({
        "request_type": F.when(routed, _by_rule("_route", ROUTES, lambda r: F.lit(r[0]), F.lit(None).cast("string")))
        .otherwise(F.coalesce(fallback, F.lit("general_legal_question"))),
        "_done": routed | fallback.isNotNull(),
        "citation_targets": F.when(routed, _by_rule("_route", ROUTES, lambda r: _targets(r[2]), strings()))
        .otherwise(F.concat("_articles", "_documents")),
        "key_phrases": _by_rule("_route", ROUTES, lambda r: strings(r[3]), strings()),
        "scenario_terms": F.concat("scenario_terms", _by_rule("_route", ROUTES, lambda r: strings(r[4]), strings())),
    })

    # Facts are missing: answer as a scenario, with care.
    missing = holds(plain, MISSING_FACTS) & holds(plain, LEGAL_FACTS)
    df = df.withColumn("insufficient_facts", missing)
    contract = ~holds(plain, TRAFFIC) & holds(plain, ("hop dong", "giao dich", "vo hieu"))
    lacking = F.col("insufficient_facts")
    df = df.withColumns({
        "citation_targets": F.when(lacking & contract, union(F.col("citation_targets"), strings(("Điều 117",)))).otherwise(F.col("citation_targets")),
        "key_phrases": F.when(lacking, union(F.col("key_phrases"), strings(("điều kiện có hiệu lực", *MISSING_HINTS)))).otherwise(F.col("key_phrases")),
        "missing_fact_hints": F.when(lacking, strings(MISSING_HINTS)).otherwise(strings()),
        "request_type": F.when(lacking, F.lit("scenario_application")).otherwise(F.col("request_type")),
        "_done": F.col("_done") | lacking,
    })

    # Security interests against third parties.
    third = holds(plain, THIRD_PARTY)
    grow = lambda c, items: F.when(third, union(F.col(c), strings(items))).otherwise(F.col(c))
    df = df.withColumns({
        "request_type": F.when(third, F.lit("scenario_application")).otherwise(F.col("request_type")),
        "_done": F.col("_done") | third,
        "citation_targets": grow("citation_targets", (f"{CIVIL}, Điều 319, Khoản 2", "Khoản 2 Điều 319")),
        "key_phrases": grow("key_phrases", ("hiệu lực đối kháng", "người thứ ba", "đăng ký", "thế chấp tài sản")),
        "scenario_terms": grow("scenario_terms", ("đối kháng", "người thứ ba", "đăng ký", "thế chấp")),
    })

    # Topics with a governing authority.
    topics = TOPICS_FIRST + TOPICS_THEN
    df = _first_rule(df, "_topic", topics, F.lit(True))

    def topic_type(rule):
        kind = rule[0]
        if kind == "decree99":
            return F.when(holds(plain, DECREE_99_VALIDITY), "validity_question").otherwise("citation_lookup")
        if kind.startswith("~"):
            return F.when(lacking, "scenario_application").otherwise(F.lit(kind[1:]))
        return F.lit(kind)

    def topic_targets(rule):
        new = _targets(rule[2])
        return union(new) if rule[4] == "replace" else union(F.col("citation_targets"), new)

    hit = F.col("_topic").isNotNull()
    df = df.withColumns({
        "request_type": F.when(lacking, F.lit("scenario_application")).otherwise(
            _by_rule("_topic", topics, topic_type, F.col("request_type"))),
        "_done": F.col("_done") | hit,
        "citation_targets": _by_rule("_topic", topics, topic_targets, F.col("citation_targets")),
        "key_phrases": _by_rule(
            "_topic", topics, lambda r: union(F.col("key_phrases"), strings(r[3])) if r[3] else F.col("key_phrases"), F.col("key_phrases")),
    })

    late = (
        F.when(holds(plain, LATE_SCENARIO), "scenario_application").when(holds(plain, LATE_VALIDITY), "validity_question")
        .when(holds(plain, LATE_LOOKUP), "citation_lookup")
    )
    words = F.col("normalized_query")
    for stop in STOP_WORDS:
        words = F.regexp_replace(words, rf"(?iuU)\b{stop}\b", "")
    extra = F.array_compact(F.array(*[F.when(F.contains(plain, F.lit(p)), F.lit(p)) for p in DOMAIN_PHRASES]))
    df = df.withColumns({
        "request_type": F.when(~F.col("_done"), F.coalesce(late, F.col("request_type"))).otherwise(F.col("request_type")),
        "year_hint": F.nullif(F.regexp_extract("normalized_query", YEAR, 1), F.lit("")),
        "keywords": F.array_distinct(F.filter(F.split(words, r"\s+"), lambda w: F.length(w) > 2)),
        "key_phrases": F.concat("key_phrases", F.array_except(extra, "key_phrases")),
    })
    return with_variants(df).drop("_hay", "_plain", "_articles", "_documents", "_route", "_topic", "_done")


def with_variants(df: DataFrame, preferred: str | None = None) -> DataFrame:
    """Query variants (at most ten) and the source order, preferred sources first."""
    first = lambda c: F.slice(F.col(c), 1, 4)
    variants = F.concat(F.array("normalized_query"), "citation_targets", first("key_phrases"), first("scenario_terms"))
    preference = F.col(preferred) if preferred else strings()
    known = F.filter(preference, lambda s: s.isin(*SOURCE_ORDER))
    return df.withColumns({
        "query_variants": F.slice(F.array_distinct(F.filter(variants, lambda v: v.isNotNull() & (v != ""))), 1, MAX_VARIANTS),
        "source_preference": known,
        "source_priority": union(known, strings(SOURCE_ORDER)),
        "legal_roles": strings(),
    })


# ---- documents named in text --------------------------------------------------


def alias_terms(registry: DataFrame) -> DataFrame:
    """Folded names of each registry document: `doc_id, term`.

    `registry`: doc_id, official_number, document_title, aliases array<string>.
    """
    names = F.concat(F.array("official_number", "document_title"), F.coalesce("aliases", strings()))
    return (
        registry.where(F.coalesce("doc_id", F.lit("")) != "")
        .select("doc_id", F.explode(names).alias("name"))
        .select("doc_id", tx.match_form(F.col("name")).alias("term"))
        .where(F.col("term") != "")
        .distinct()
    )


def resolve_documents(texts: DataFrame, terms: DataFrame, key: str, separator: str | None = None) -> DataFrame:
    """Documents whose name is contained in a text: `key, doc_ids array` (with a separator: one string).

    Texts stream past an automaton of the names (`names.names_in`), each different text
    once. The documents of a name are listed, and joined, once for each set of names that
    occurs together, however many texts have it; the result comes ordered by that set, and
    in as many parts as keep the lists of one part small enough for a dictionary of a file.
    """
    named = terms.where(F.length("term") > 0).select("doc_id", "term").distinct()
    rows = texts.select(key, F.col("text").cast("string").alias("text"))
    # `names` is a set of names: few, as each occurs in one text.
    hits = names_in(rows.select("text").distinct(), named.select("term").distinct(), "text")
    held = materialize(hits.groupBy("text").agg(F.sort_array(F.collect_set("term")).alias("names")))
    few = F.broadcast(held) if fits(held, BROADCAST_TEXTS) else held
    # Dealt by key before they are grouped: hardly any key comes twice, so grouping first would only sort.
    sets = rows.join(few, "text").select(key, "names").repartition(key).groupBy(key).agg(F.collect_set("names").alias("sets"))
    found = sets.select(key, F.when(F.size("sets") == 1, F.get("sets", 0)).otherwise(F.sort_array(F.array_distinct(F.flatten("sets")))).alias("names"))
    sizes = named.groupBy("term").agg(F.sum(F.octet_length("doc_id") + 1).alias("n"))
    total = held.select("names").distinct().select(F.explode("names").alias("term")).join(sizes, "term").agg(F.sum("n").alias("n")).first().n
    parts = max(texts.sparkSession.sparkContext.defaultParallelism, min((total or 0) // PART_BYTES, MOST_PARTS))
    named = named.groupBy("term").agg(F.sort_array(F.collect_set("doc_id")).alias("docs"))
    lists = found.select("names").distinct().select("names", F.explode("names").alias("term")).join(named, "term").repartition(parts, "names").groupBy("names").agg(
        F.sort_array(F.array_distinct(F.flatten(F.collect_list("docs")))).alias("doc_ids"))
    if separator is not None:
        lists = lists.withColumn("doc_ids", F.array_join("doc_ids", separator))
    return found.repartition(parts, "names").join(lists.hint("merge"), "names").select(key, "doc_ids")


def exact_constraints(queries: DataFrame, terms: DataFrame | None = None) -> DataFrame:
    """Adds the question's article and clause numbers, documents and types."""
    text = tx.match_form(F.concat_ws(" ", "raw_query", "normalized_query", F.array_join("citation_targets", " ")))
    df = queries.withColumn("text", text)
    clauses = F.filter(all_matches(F.col("text"), ARTICLE_REF, 1), lambda c: c != "")
    articles = F.array_distinct(all_matches(F.col("text"), ARTICLE_REF, 2))
    types = source_types(F.col("text"))
    coded = (F.size(articles) > 0) & holds(F.col("text"), "dan su | hinh su")
    df = df.withColumns({
        "c_articles": articles, "c_clauses": F.array_distinct(clauses),
        "c_types": F.when(coded, union(types, strings(("bo_luat",)))).otherwise(types),
    })
    if terms is None:
        return df.withColumn("c_docs", strings()).drop("text")
    named = resolve_documents(df.select("query_id", "text"), terms, "query_id")
    return df.join(named.withColumnRenamed("doc_ids", "c_docs"), "query_id", "left").withColumn(
        "c_docs", F.coalesce("c_docs", strings())
    ).drop("text")


def target_constraints(queries: DataFrame, terms: DataFrame | None = None) -> DataFrame:
    """One row per explicit target with its own constraints.

    Targets are alternatives, so each has its own numbers; documents and types
    fall back to those of the question (documents only when the target names
    no authority itself). Needs the columns of `exact_constraints`.
    """
    rows = queries.select(
        "*", F.posexplode(F.array_distinct("citation_targets")).alias("target_no", "target")
    ).withColumn("text", tx.match_form(F.col("target")))
    own_types = source_types(F.col("text"))
    rows = rows.withColumn("target_key", F.concat_ws("#", "query_id", "target_no"))
    if terms is None:
        rows = rows.withColumn("own_docs", strings())
    else:
        named = resolve_documents(rows.select("target_key", "text"), terms, "target_key")
        rows = rows.join(named.withColumnRenamed("doc_ids", "own_docs"), "target_key", "left").withColumn(
            "own_docs", F.coalesce("own_docs", strings())
        )
    named_authority = holds(F.col("text"), AUTHORITY_WORDS)
    return rows.withColumns({
        "t_articles": F.array_distinct(all_matches(F.col("text"), ARTICLE_REF, 2)),
        "t_clauses": F.array_distinct(F.filter(all_matches(F.col("text"), ARTICLE_REF, 1), lambda c: c != "")),
        "t_docs": F.when(F.size("own_docs") > 0, F.col("own_docs")).when(named_authority, strings()).otherwise(F.col("c_docs")),
        "t_types": F.when(F.size(own_types) > 0, own_types).otherwise(F.col("c_types")),
        "t_numbers": all_matches(F.col("text"), r"\b(\d+/\d{4}/[a-z0-9-]+)\b"),
        "t_name": F.coalesce(*[
            F.when(F.contains("text", F.lit(p)), F.lit(p)) for p in ("bo luat dan su", "bo luat hinh su", "bo luat to tung dan su")
        ]),
        "target_form": F.col("text"),
    }).drop("text", "own_docs")


def article_matches(article_no: Column, citation: Column, numbers: Column) -> Column:
    """No number asked, or the unit's own number or its citation holds one."""
    words = tx.match_tokens(citation)
    cited = F.array_contains(words, "dieu") & F.arrays_overlap(words, numbers)
    return (F.size(numbers) == 0) | F.coalesce(F.array_contains(numbers, tx.match_form(article_no)), F.lit(False)) | F.coalesce(cited, F.lit(False))


def clause_matches(clause_no: Column, citation: Column, numbers: Column) -> Column:
    words = tx.match_tokens(citation)
    cited = F.array_contains(words, "khoan") & F.arrays_overlap(words, numbers)
    return (F.size(numbers) == 0) | F.coalesce(F.array_contains(numbers, tx.match_form(clause_no)), F.lit(False)) | F.coalesce(cited, F.lit(False))


def satisfies(prefix: str) -> Column:
    """A chunk row meets the constraints `<prefix>docs/types/articles/clauses`."""
    c = lambda n: F.col(prefix + n)
    member = lambda values, value: (F.size(values) == 0) | F.coalesce(F.array_contains(values, value), F.lit(False))
    return (
        member(c("docs"), F.col("doc_id")) & member(c("types"), F.col("doc_type"))
        & article_matches(F.col("article_no"), F.col("citation"), c("articles"))
        & clause_matches(F.col("clause_no"), F.col("citation"), c("clauses"))
    )


def year_of(value: Column) -> Column:
    return F.nullif(F.regexp_extract(F.coalesce(value.cast("string"), F.lit("")), YEAR, 1), F.lit("")).cast("int")


def query_year() -> Column:
    return F.coalesce(year_of(F.col("year_hint")), year_of(F.col("raw_query")))


def wants_history() -> Column:
    """The question itself speaks of another time."""
    text = tx.match_form(F.concat_ws(
        " ", "raw_query", "normalized_query", F.array_join("key_phrases", " "), F.array_join("keywords", " ")))
    return query_year().isNotNull() | holds(text, HISTORY_TERMS)


def requires_exact_anchor() -> Column:
    text = tx.match_form(F.concat_ws(" ", "raw_query", "normalized_query", F.array_join("key_phrases", " ")))
    return (F.col("request_type") == "scenario_application") & (F.size("citation_targets") > 0) & holds(text, THIRD_PARTY)


def valid_length(query: Column) -> Column:
    return F.length(query).between(1, 12000)
