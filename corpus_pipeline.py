"""The corpus pipeline: quality, language, near-dedup, secrets, packing.

Each stage takes all rows that its predecessor kept, written as Parquet in the shared
folder and read again; all but the last return the columns of documents.

Cases, besides those of the operators: rows with a null text fail the language stage
(no language can be told); missing ids and repeated rows are judged row by row; of a
near-duplicate group the row of the smallest id stays (of equal rows one); empty tables
pass through; columns beyond those of documents, of any type and name, are carried along
(columns of one name twice are not).
"""

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexspan.llm import langid, near_copies, packing, quality, secret_scan
from lexspan.llm.scratch import fresh, small_batches, stored

#: Least posterior of a document that stays; least part of its n-grams that its language
#: has, corrected for chance, and least lead of that language over the second.
MIN_QUALITY = 0.5
MIN_LANGUAGE = 0.3
MIN_LEAD = 0.02
#: Columns that stages read; any others are theirs to carry, whatever their names.
DOCUMENT = ("doc_id", "text", "lang", "source", "n_chars")


def carrying(stage):
    """The stage, with names of other columns out of its way."""

    @functools.wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        names = {name: name if name in DOCUMENT else fresh("carried") for name in docs.columns}
        out = stage(spark, docs.select(*[F.col(f"`{name}`").alias(own) for name, own in names.items()]), sf_dir)
        return out.select(*[F.col(own).alias(name) for name, own in names.items()])

    return run_stage


@carrying
def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose posterior of being good is at least MIN_QUALITY."""
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.score(docs, model).where(F.col("quality_score") >= MIN_QUALITY).select(*docs.columns)


@carrying
def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a language can be told."""
    small_batches(spark)
    lang, share, rate, lead = fresh("lang"), fresh("share"), fresh("rate"), fresh("lead")
    judged = langid.predict(docs, langid.train(docs), out=lang, score=share, rate=rate, lead=lead)
    told = (F.col(lang) != langid.UNDETERMINED) & (F.col(rate) >= MIN_LANGUAGE) & (F.col(lead) >= MIN_LEAD)
    return judged.where(told).select(*docs.columns)


@carrying
def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word Jaccard of 0.8 or more), that of the smallest id."""
    small_batches(spark)
    return near_copies.deduplicate(docs)


@carrying
def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every secret replaced by a mask."""
    out = fresh("found")
    found = secret_scan.scan(docs, secret_scan.train(docs), out=out)
    clean = secret_scan.masked(found, found=out).select(*docs.columns)
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else clean


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' words, in length buckets and batches."""
    counted = docs.select("doc_id", F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")).alias("n_tokens"), F.xxhash64("text").alias("mark"))
    return packing.pack(counted, mark="mark")


STAGES = [
    ("quality", quality_stage),
    ("language", language_stage),
    ("near_dedup", dedup_stage),
    ("secrets", secrets_stage),
    ("packing", packing_stage),
]

#: SQL cannot express the fingerprints and the language filters; tests/llm holds the
#: stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
