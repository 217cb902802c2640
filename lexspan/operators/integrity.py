"""Inventories, set comparison and validators of every stage's output."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexspan.functions import text as tx
from lexspan.operators import structure as st

# ---- fixed values ---------------------------------------------------------
FOOTER_MARKERS = (
    "Nơi nhận:", "TM. HỘI ĐỒNG", "CHÁNH ÁN", "Ủy ban Thường vụ Quốc hội (để giám sát)", "Lưu: VT,",
)
VALID_ENDINGS = r'[.;:)”"]$'
CLEANED_CHECKS = (
    ("page_label", r"(?iu)Trang\s+\d+"),
    ("english_page_label", r"(?iu)Page\s+\d+"),
    ("watermark", r"(?iu)THƯ VIỆN PHÁP LUẬT"),
    ("double_blank", r"  "),
    ("blank_before_punctuation", r"\s+[\.,;:]"),
    ("citation_not_capitalised", r"(?U)\bđiều\s+\d+|\bkhoản\s+\d+"),
)
LONG_CHUNK, VECTOR_SIZE, MIN_SUMMARY, MIN_KEYWORD, MIN_FORM = 2500, 1024, 15, 3, 300
SUSPICIOUS_TITLES = ("BỘ LUẬT", "unknown")
PROVENANCE_FIELDS = (
    "source_verification_status", "source_checksum_sha256", "source_of_validity", "validity_basis", "validity_confidence",
)
# Bytes of a file that is read as one value; larger ones are streamed, some at a time.
ROW_BYTES, STREAMS = 128 << 20, 4
# ---------------------------------------------------------------------------


def _empty(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit("")) == ""


def id_digest(ids: DataFrame, column: str, depth: int = 2) -> DataFrame:
    """Order-free SHA-256 of the distinct ids.

    Ids are spread over 16^depth buckets by their own hash; each bucket's
    sorted ids are hashed, then the hashes of sixteen buckets at a time up to
    one. No group holds more than a bucket; depth 0 hashes all ids in one.
    """
    hashed = ids.select(F.col(column).cast("string").alias("item")).where(F.col("item").isNotNull()).distinct()
    level = hashed.withColumn("bucket", F.substring(F.sha2("item", 256), 1, depth) if depth else F.lit(""))
    for size in range(depth, -1, -1):
        level = level.groupBy("bucket").agg(
            F.sha2(F.array_join(F.sort_array(F.collect_list("item")), "\n"), 256).alias("digest")
        )
        if size:
            # Child order is the bucket name, carried in front of the digest.
            level = level.select(
                F.concat_ws(":", "bucket", "digest").alias("item"),
                (F.substring("bucket", 1, size - 1) if size > 1 else F.lit("")).alias("bucket"),
            )
    return level.select("digest")


def inventory(records: DataFrame, id_column: str = "chunk_id", require_embedding: bool = False) -> DataFrame:
    """Rows, distinct ids, duplicated ids and invalid records, in one row."""
    invalid = _empty(id_column)
    if require_embedding:
        invalid = invalid | (F.coalesce(F.size("embedding"), F.lit(0)) <= 0)
    flagged = records.select(F.col(id_column).cast("string").alias("id"), invalid.alias("invalid"))
    per_id = flagged.groupBy(F.when(~F.col("invalid"), F.col("id")).alias("id")).agg(F.count("*").alias("n"))
    usable = F.col("id").isNotNull()
    return per_id.agg(
        F.coalesce(F.sum(F.when(usable, F.col("n"))), F.lit(0)).alias("row_count"),
        F.count("id").alias("unique_ids"),
        F.coalesce(F.sum(F.when(usable & (F.col("n") > 1), 1)), F.lit(0)).alias("duplicate_ids"),
        F.coalesce(F.sum(F.when(~usable, F.col("n"))), F.lit(0)).alias("invalid_records"),
    )


def duplicate_ids(records: DataFrame, id_column: str = "chunk_id") -> DataFrame:
    return records.where(~_empty(id_column)).groupBy(id_column).agg(F.count("*").alias("n")).where("n > 1")


def set_difference(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Ids on one side only: `key, side` with `missing` (left only) or `orphan`."""
    a = left.select(key).where(F.col(key).isNotNull()).distinct().withColumn("_l", F.lit(1))
    b = right.select(key).where(F.col(key).isNotNull()).distinct().withColumn("_r", F.lit(1))
    return a.join(b, key, "full_outer").where(F.col("_l").isNull() | F.col("_r").isNull()).select(
        key, F.when(F.col("_r").isNull(), "missing").otherwise("orphan").alias("side")
    )


def consistency(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """One row: sizes, differences and whether both sides agree."""
    a = left.select(key).where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("_l"))
    b = right.select(key).where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("_r"))
    count = lambda c: F.coalesce(F.sum(F.when(c, 1)), F.lit(0)).cast("long")
    left_only, right_only = F.col("_r").isNull(), F.col("_l").isNull()
    rows = a.join(b, key, "full_outer").agg(
        count(F.col("_l").isNotNull()).alias("left_ids"), count(F.col("_r").isNotNull()).alias("right_ids"),
        count(left_only).alias("missing"), count(right_only).alias("orphan"),
        count((F.col("_l") > 1) | (F.col("_r") > 1)).alias("duplicates"),
    )
    return rows.withColumn("is_consistent", (F.col("missing") == 0) & (F.col("orphan") == 0) & (F.col("duplicates") == 0))


def file_fingerprints(spark, root: str) -> DataFrame:
    """`path, sha256` of every file below a folder; Spark lists no empty ones.

    The reader gives a file as one value, of 2 GB at most. Larger files than ROW_BYTES are
    read as streams instead, some at a time: a digest runs through a file from its start,
    so a file is one thread's work wherever it is done.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    most = min(ROW_BYTES, int(spark.conf.get("spark.sql.sources.binaryFile.maxLength", str(ROW_BYTES))))
    large = [row.path for row in files.where(F.col("length") > most).select("path").collect()]
    small = files.where(F.col("length") <= most).select("path", F.sha2("content", 256).alias("sha256"))
    if not large:
        return small

    def digest(path: str) -> tuple[str, str]:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        stream = place.getFileSystem(spark._jsc.hadoopConfiguration()).open(place)
        try:
            return path, spark._jvm.org.apache.commons.codec.digest.DigestUtils.sha256Hex(stream)
        finally:
            stream.close()

    with ThreadPoolExecutor(STREAMS) as pool:
        digests = list(pool.map(digest, large))
    return small.unionByName(spark.createDataFrame(digests, "path string, sha256 string"))


def parsed_document_issues(docs: DataFrame, articles: DataFrame, forms: DataFrame | None = None) -> DataFrame:
    """Issues of parsed statutes: `doc_id, issue, detail`.

    `docs`: doc_id, number, title, issued_on, issuer, declared_articles.
    `articles`: doc_id, article_no, article_title, text, clauses (count),
    tail_text (last clause, else the text). `forms`: doc_id, form_code,
    form_name, content.
    """
    say = lambda name, test, detail=None: F.when(
        test, F.struct(F.lit(name).alias("issue"), (detail if detail is not None else F.lit(None)).cast("string").alias("detail"))
    )
    explode = lambda df, codes: df.select("doc_id", F.explode(F.array_compact(F.array(*codes))).alias("i")).select(
        "doc_id", "i.issue", "i.detail"
    )
    of_docs = explode(docs, [
        say("unknown_number", _empty("number") | (F.col("number") == "unknown")),
        say("no_issue_date", F.col("issued_on").isNull()),
        say("suspicious_title", _empty("title") | F.col("title").isin(*SUSPICIOUS_TITLES), F.col("title")),
        say("no_issuer", _empty("issuer")),
    ])
    number = F.col("article_no").try_cast("long")
    numbered = articles.withColumn("no", number)
    per_number = numbered.where(F.col("no").isNotNull()).groupBy("doc_id", "no").agg(F.count("*").alias("n"))
    gaps = per_number.groupBy("doc_id").agg(
        (F.max("no") - F.min("no") + 1 - F.count("*")).alias("missing"), F.sum(F.when(F.col("n") > 1, 1).otherwise(0)).alias("twice")
    )
    counts = numbered.groupBy("doc_id").agg(
        F.count("*").alias("found"),
        F.count(F.when(F.col("no").isNull(), 1)).alias("odd"),
        F.count(F.when(_empty("article_title"), 1)).alias("untitled"),
        F.count(F.when((F.col("clauses") == 0) & _empty("text"), 1)).alias("hollow"),
        F.max_by("tail_text", F.struct(st.article_order().alias("a"), F.col("article_at").alias("b"))).alias("tail"),
    )
    joined = docs.select("doc_id", "declared_articles").join(counts, "doc_id", "left").join(gaps, "doc_id", "left")
    leak = reduce(lambda a, b: a | b, [F.contains("tail", F.lit(m)) for m in FOOTER_MARKERS])
    of_articles = explode(joined, [
        say("no_article", F.col("found").isNull()),
        say("odd_article_number", F.col("odd") > 0, F.col("odd")),
        say("article_count_differs", F.col("declared_articles") != F.col("found"), F.col("found")),
        say("missing_articles", F.col("missing") > 0, F.col("missing")),
        say("repeated_articles", F.col("twice") > 0, F.col("twice")),
        say("untitled_articles", F.col("untitled") > 0, F.col("untitled")),
        say("hollow_articles", F.col("hollow") > 0, F.col("hollow")),
        say("footer_in_text", leak),
    ])
    issues = of_docs.unionByName(of_articles)
    if forms is None:
        return issues
    stub = F.trim("form_code").startswith("|") | (_empty("form_name") & (F.length(tx.strip(F.col("content"))) < MIN_FORM))
    per_code = forms.groupBy("doc_id", "form_code").agg(
        F.count("*").alias("n"), F.sum(F.when(stub, 1).otherwise(0)).alias("stubs"), F.sum(F.length("content")).alias("size")
    )
    per_doc = per_code.groupBy("doc_id").agg(
        F.sum(F.when(F.col("n") > 1, 1).otherwise(0)).alias("twice"), F.sum("stubs").alias("stubs"), F.sum("size").alias("size")
    )
    declared = F.col("declared_appendix_chars") if "declared_appendix_chars" in docs.columns else F.lit(None).cast("long")
    with_docs = docs.select("doc_id", declared.alias("declared_size")).join(per_doc, "doc_id")
    return issues.unionByName(explode(with_docs, [
        say("appendix_length_differs", F.col("declared_size") != F.col("size"), F.col("size")),
        say("repeated_forms", F.col("twice") > 0, F.col("twice")),
        say("stub_forms", F.col("stubs") > 0, F.col("stubs")),
    ]))


def parsed_precedent_issues(precedents: DataFrame) -> DataFrame:
    legacy = ~_empty("summary")
    last = F.try_element_at("related_provisions", F.lit(-1))
    short_words = F.size(F.filter("keywords", lambda w: F.length(F.trim(w)) < MIN_KEYWORD))
    rules = [
        ("no_issue_section", _empty("issue") & ~legacy),
        ("no_holding", _empty("holding") & ~legacy),
        ("no_facts", _empty("facts")),
        ("no_provisions", F.size("related_provisions") <= 0),
        ("no_publication_date", F.col("published_on").isNull()),
        ("no_reasoning", _empty("reasoning")),
        ("no_keywords", F.size("keywords") <= 0),
        ("short_summary", F.col("summary").isNotNull() & (F.length(F.trim("summary")) < MIN_SUMMARY)),
        ("truncated_provision", last.isNotNull() & (last != "") & ~tx.strip(last).rlike(VALID_ENDINGS)),
        ("short_keyword", short_words > 0),
    ]
    codes = F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in rules]))
    return precedents.select("doc_id", F.explode(codes).alias("issue"))


def cleaned_text_issues(fields: DataFrame, keys: list[str]) -> DataFrame:
    """Issues left in cleaned text fields (`keys, field, text`)."""
    codes = F.array_compact(F.array(*[F.when(F.col("text").rlike(p), F.lit(name)) for name, p in CLEANED_CHECKS]))
    return fields.where(F.coalesce("text", F.lit("")) != "").select(*keys, "field", F.explode(codes).alias("issue"))


def text_fields(df: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    """Text columns as rows `keys, field, text`."""
    return df.unpivot(keys, names, "field", "text")


def metadata_checks(nodes: DataFrame) -> DataFrame:
    """Passed and failed checks per node.

    A node without metadata fails once; else citation, role, hierarchy and, for
    articles, clauses and points, statistics are checked one by one.
    """
    has = ~F.coalesce(F.col("has_metadata"), F.lit(False))
    ok = lambda test: F.when(test, 1).otherwise(0)
    counted = F.col("node_type").isin("dieu", "khoan", "diem")
    tests = [ok(~_empty("citation")), ok(~_empty("legal_role")), ok(~_empty("node_id"))]
    passed = reduce(lambda a, b: a + b, tests) + F.when(counted, ok(F.col("words").isNotNull())).otherwise(0)
    total = F.lit(len(tests)) + F.when(counted, 1).otherwise(0)
    return nodes.select(
        "doc_id", "node_type", F.when(has, 0).otherwise(passed).alias("passed"),
        F.when(has, 1).otherwise(total - passed).alias("failed"),
    )


def document_metadata_checks(docs: DataFrame) -> DataFrame:
    ok = lambda test: F.when(test, 1).otherwise(0)
    musts = [~_empty("number"), ~_empty("citation"), ~_empty("validity_status"), F.col("related_documents").isNotNull()]
    musts.append((F.col("doc_type") != "an_le") | (F.coalesce(F.size("keywords"), F.lit(0)) > 0))
    passed = reduce(lambda a, b: a + b, [ok(m) for m in musts])
    warned = reduce(lambda a, b: a + b, [ok(F.col(n).isNull()) for n in PROVENANCE_FIELDS])
    return docs.select(
        "doc_id", passed.alias("passed"), (F.lit(len(musts)) - passed).alias("failed"), warned.alias("warnings")
    )


def chunk_checks(chunks: DataFrame) -> DataFrame:
    """First failing rule per chunk (null when it passes) and the length warning."""
    rule = (
        F.when(_empty("chunk_id") | _empty("doc_id") | _empty("text"), "missing_field")
        .when(_empty("number") & _empty("doc_type"), "no_document_metadata")
        .when(_empty("citation"), "no_citation")
        .when(_empty("legal_role"), "no_legal_role")
    )
    checked = chunks.withColumn("failure", rule)
    return checked.withColumn("too_long", F.col("failure").isNull() & (F.length("text") > LONG_CHUNK))


def chunk_check_counts(chunks: DataFrame) -> DataFrame:
    checked = chunk_checks(chunks)
    return checked.groupBy("doc_type").agg(
        F.count(F.when(F.col("failure").isNull(), 1)).alias("passed"),
        F.count("failure").alias("failed"), F.count(F.when(F.col("too_long"), 1)).alias("warnings"),
    )


def vector_checks(embeddings: DataFrame, size: int = VECTOR_SIZE) -> DataFrame:
    """Counts of present, absent and wrongly sized vectors."""
    n = F.coalesce(F.size("embedding"), F.lit(0))
    return embeddings.agg(
        F.count(F.when(n > 0, 1)).alias("passed"), F.count(F.when(n <= 0, 1)).alias("failed"),
        F.count(F.when((n > 0) & (n != size), 1)).alias("wrong_size"),
    )


def snapshot_health(snapshot: DataFrame, size: int = VECTOR_SIZE) -> DataFrame:
    """Is the snapshot non-empty, readable and of the right vector size?"""
    n = F.coalesce(F.size("embedding"), F.lit(0))
    seen = snapshot.agg(
        F.count("*").alias("points"), F.count(F.when(~_empty("text"), 1)).alias("readable"),
        F.count(F.when(n != size, 1)).alias("wrong_size"),
    )
    return seen.withColumn(
        "status",
        F.when(F.col("points") == 0, "empty").when(F.col("wrong_size") > 0, "wrong_vector_size")
        .when(F.col("readable") == 0, "no_usable_text").otherwise("ok"),
    )


def number_gaps(articles: DataFrame) -> DataFrame:
    """Missing article numbers as ranges, from neighbours of distinct numbers."""
    numbers = articles.select("doc_id", F.col("article_no").try_cast("long").alias("no")).where("no is not null").distinct()
    after = F.lead("no").over(Window.partitionBy("doc_id").orderBy("no"))
    return numbers.withColumn("next", after).where(F.col("next") - F.col("no") > 1).select(
        "doc_id", (F.col("no") + 1).alias("first_missing"), (F.col("next") - 1).alias("last_missing")
    )
