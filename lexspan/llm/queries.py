"""Named queries of the training-data operators, over whole tables and whole texts."""

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexspan.llm import (
    byte_bpe, exact_dedup, fingerprints, langid, oracles, packing, quality, secret_scan, simhash_dedup, spelling, token_store, topk, url_filter, whitening,
)
from lexspan.llm.scratch import fresh_folder, small_batches, stored

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(function: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[function.__name__] = function
    return function


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def file_of(name: str) -> bytes:
    """A vocabulary file of the installed public tokenizers, read once by the driver."""
    with open(public_tokenizers.path(name), "rb") as source:
        return source.read()


@query
def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode every document, decode it again, and give digests of both."""
    small_batches(spark)
    ranks = file_of("byte_bpe_multi_50k.tiktoken")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    both = byte_bpe.decode(byte_bpe.encode(docs, ranks, public_tokenizers.PATTERN), ranks)
    return both.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query
def op8_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write the ids of every document as bit-plane files and read the files back."""
    small_batches(spark)
    folder = fresh_folder(spark, "tokens")
    token_store.write(table(spark, sf_dir, "documents"), folder, file_of("word_bpe_49k.json").decode(), end_id=1, special_tokens=True)
    return token_store.read(spark, folder).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@query
def op4_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose fingerprints of three-word shingles differ in three bits at most."""
    small_batches(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    marked = stored(simhash_dedup.fingerprints(docs).select("doc_id", "fp"), "simhash")
    return simhash_dedup.group(marked).select("doc_id", simhash_dedup.as_hex(F.col("fp")).alias("fingerprint"), "component_id")


@query
def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text, and its near documents."""
    return fingerprints.describe(table(spark, sf_dir, "documents"))


@query
def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learnt from those whose crc32 of the id is not 2 modulo 4."""
    small_batches(spark)
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    filters = langid.train(docs.where(~held_out))
    return langid.predict(docs.select("doc_id", "text", held_out.alias("held_out")), filters).select("doc_id", "held_out", "lang_pred", "score")


@query
def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posterior quality of every document, with its source and language as host and path."""
    docs = table(spark, sf_dir, "documents")
    judged = quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels")))
    return judged.select("doc_id", "evidence", "host_prior", "path_prior", "quality_score", (F.col("quality_score") >= 0.5).alias("keep"))


#: The tables hold no fetch times and no lists. Page ids stand for the order of the
#: crawl, a page a minute. Every tenth page is a report: it lists the page's host, its
#: domain or its path from the time it was fetched, with an action that a hash deals.
CRAWL_START = 1704067200
REPORTS = """
    select case page_id div 10 % 3 when 0 then host when 1 then regexp_extract(host, '([^.]+[.][^.]+)$', 1)
                else concat(host, '/', regexp_extract(url, '^[^/]*//[^/]*/([^/?#]*)', 1), '/') end as pattern,
           element_at(array('block', 'allow', 'remove', 'block'), cast(page_id div 30 % 4 as int) + 1) as action,
           timestamp_seconds({start} + page_id * 60) as listed_at
    from {{captures}} where page_id % 10 = 3
"""


@query
def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The list entry that was active when each page was fetched, and what it says."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", F.timestamp_seconds(F.lit(CRAWL_START) + F.col("page_id") * 60).alias("fetched_at"))
    reports = spark.sql(REPORTS.format(start=CRAWL_START), captures=pages.withColumn("host", url_filter.host_of(F.col("url"))))
    return url_filter.judge(pages, reports)


@query
def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's words packed into length buckets and batches."""
    counted = table(spark, sf_dir, "documents").select("doc_id", F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")).alias("n_tokens"), F.xxhash64("text").alias("mark"))
    return packing.pack(counted, mark="mark")


@query
def op7_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best other vectors for every vector whose id is divisible by 100."""
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


@query
def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document: base spans, and what the Markov models add."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = secret_scan.scan(docs, secret_scan.train(docs))

    def count(kind: str):
        return F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = secret_scan.KINDS[:3]
    return found.select("doc_id", *map(count, base), F.sha2(secret_scan.joined(F.col("found"), base).cast("binary"), 256).alias("base_sha256"), secret_scan.joined(F.col("found")).alias("spans"))


@query
def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of equal texts among all documents, and the document of each that stays."""
    return exact_dedup.decide(table(spark, sf_dir, "documents"), digest="text_sha256")


@query
def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word of the documents with its commonest near word and the root of its chain."""
    small_batches(spark)
    return spelling.group(spelling.words(table(spark, sf_dir, "documents")))


@query
def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector on the first eight components of the exact scatter, whitened."""
    found = whitening.whiten(table(spark, sf_dir, "embeddings"))
    return found.withColumn("deviation", F.expr("try_cast(deviation as long)"))


ORACLES |= {
    "op5_url_filter": oracles.URL_FILTER.format(start=CRAWL_START),
    "op7_top_k": oracles.TOP_K,
    "op9_secrets": oracles.SECRETS,
    "op11_exact_dedup": oracles.EXACT_DEDUP,
}
