"""Source registry: lookup, overlay of official fields, audit and review queue."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexspan.operators.metadata import OFFICIAL_VALIDITY_SOURCES, VALIDITY_FIELDS

# ---- fixed values ---------------------------------------------------------
OFFICIAL = "official_verified"
LOCAL_ONLY = "local_checksum_only"
SOURCE_FIELDS = ("source_name", "source_url", "source_verified_at", "source_verification_status")
MATCH_KEYS = ("doc_id", "source_file", "source_checksum_sha256")
# Values that a sketch of frequent ones tracks and gives, the least share of such a value
# in the rows (one in so many), and the parts that its rows are dealt over.
TRACKED, LISTED, ONE_IN, PARTS = 10_000, 100, 1_000, 64
# ---------------------------------------------------------------------------


def _filled(value: Column) -> Column:
    return F.coalesce(value.cast("string"), F.lit("")) != ""


def _all_filled(prefix: str, *names: str) -> Column:
    return reduce(lambda a, b: a & b, [_filled(F.col(prefix + n)) for n in names])


def source_evidence(prefix: str = "") -> Column:
    return _all_filled(prefix, "source_checksum_sha256", "source_url", "source_verified_at")


def validity_evidence(prefix: str = "") -> Column:
    c = lambda n: F.col(prefix + n)
    return F.coalesce(
        (c("source_verification_status") == OFFICIAL)
        & F.trim(c("source_of_validity")).isin(*OFFICIAL_VALIDITY_SOURCES)
        & _all_filled(prefix, "validity_status", "validity_basis", "validity_checked_at")
        & (F.lower(F.trim(c("validity_confidence"))) == "high"),
        F.lit(False),
    )


def frequent_values(items: DataFrame) -> dict[str, list]:
    """Of each match key the values that many rows share, LISTED at most, in one pass."""
    sketches = [F.call_function("approx_top_k", F.col(key), F.lit(LISTED), F.lit(TRACKED)).alias(key) for key in MATCH_KEYS]
    seen = items.agg(F.count("*").alias("n"), *sketches).first()
    return {key: [v["item"] for v in seen[key] or [] if v["item"] is not None and v["count"] * ONE_IN > seen["n"]] for key in MATCH_KEYS}


def dealt_lookup(items: DataFrame, key: str, entries: DataFrame, on: str, frequent: list) -> DataFrame:
    """Left join of items and `entries` by equality, in which no key gathers in one task.

    Rows of a frequent value are dealt over PARTS parts, to each of which its entries are
    copied; so are rows that can match nothing. Those of one task stay together, which
    keeps them as compressible as they came.
    """
    anywhere = ~_filled(F.col(key)) | F.col(key).isin(frequent)
    left = items.withColumn("_part", F.when(anywhere, F.pmod(F.spark_partition_id(), F.lit(PARTS))).otherwise(0))
    copies = F.when(F.col(on).isin(frequent), F.sequence(F.lit(0), F.lit(PARTS - 1))).otherwise(F.array(F.lit(0)))
    right = entries.withColumn("_copy", F.explode(copies))
    return left.join(right, (F.col(key) == F.col(on)) & (F.col("_part") == F.col("_copy")), "left").drop("_part", "_copy")


def smallest_entries(registry: DataFrame, key: str, value: str, idx: str) -> DataFrame:
    """The smallest entry number of each value of a match key."""
    return registry.where(_filled(F.col(key))).groupBy(F.col(key).alias(value)).agg(F.min("idx").alias(idx))


def first_match(items: DataFrame, registry: DataFrame, frequent: dict[str, list] | None = None) -> DataFrame:
    """Adds `entry_idx`: the first registry entry sharing id, file or checksum.

    An OR condition would be a nested loop; instead each key gets its smallest
    entry number once and is joined by equality. No item is shuffled twice for
    the choice: the smallest of the three numbers wins.
    """
    frequent = frequent or frequent_values(items)
    found = items
    for i, key in enumerate(MATCH_KEYS):
        found = dealt_lookup(found, key, smallest_entries(registry, key, f"_k{i}", f"_i{i}"), f"_k{i}", frequent[key]).drop(f"_k{i}")
    return found.withColumn("entry_idx", F.least("_i0", "_i1", "_i2")).drop("_i0", "_i1", "_i2")


def apply_registry(items: DataFrame, registry: DataFrame) -> DataFrame:
    """Registry status per item and overlay of source and validity fields.

    Items carry `doc_id, source_file, source_checksum_sha256`; fields missing
    on the item side are added as null first.
    """
    missing = {n: F.lit(None).cast("string") for n in (*SOURCE_FIELDS, *VALIDITY_FIELDS) if n not in items.columns}
    items = items.withColumns(missing) if missing else items
    entries = registry.select(*[F.col(c).alias(f"reg_{c}") for c in registry.columns])
    frequent = frequent_values(items)
    # An entry that many rows take is the first one of a frequent value.
    firsts = [smallest_entries(registry, key, "value", "idx").where(F.col("value").isin(frequent[key])).select("idx") for key in MATCH_KEYS]
    taken = [row.idx for row in reduce(DataFrame.union, firsts).distinct().collect()]
    joined = dealt_lookup(first_match(items, registry, frequent), "entry_idx", entries, "reg_idx", taken)
    reg_sum = F.col("reg_source_checksum_sha256")
    same = ~_filled(reg_sum) | F.coalesce(reg_sum == F.col("source_checksum_sha256"), F.lit(False))
    official = F.coalesce(F.col("reg_source_verification_status") == OFFICIAL, F.lit(False))
    status = (
        F.when(F.col("entry_idx").isNull(), "not_found")
        .when(~same, "checksum_mismatch")
        .when(official & ~source_evidence("reg_"), "incomplete_official_evidence")
        .otherwise("matched")
    )
    joined = joined.withColumn("source_registry_status", status)
    matched = F.col("source_registry_status") == "matched"
    overlay = {
        n: F.when(matched, F.coalesce(F.col(f"reg_{n}").cast("string"), F.col(n).cast("string"))).otherwise(F.col(n).cast("string"))
        for n in SOURCE_FIELDS
    }
    trusted = matched & validity_evidence("reg_")
    overlay.update({
        n: F.when(trusted, F.coalesce(F.col(f"reg_{n}").cast("string"), F.col(n).cast("string"))).otherwise(F.col(n).cast("string"))
        for n in VALIDITY_FIELDS
    })
    return joined.withColumns(overlay).drop("entry_idx", *[f"reg_{c}" for c in registry.columns])


def enrich_candidates(items: DataFrame, registry: DataFrame) -> DataFrame:
    """Overlay at query time; rows without provenance pass through untouched."""
    known = _filled(F.col("source_checksum_sha256")) | _filled(F.col("source_file"))
    enriched = apply_registry(items.where(known), registry)
    return enriched.unionByName(items.where(~known), allowMissingColumns=True)


def audit_registry(registry: DataFrame) -> DataFrame:
    """Issues per entry: `idx, doc_id, code`.

    Optional columns: `is_object` (entry was a JSON object), `aliases_is_list`.
    """
    cols = set(registry.columns)
    is_object = F.col("is_object") if "is_object" in cols else F.lit(True)
    listed = F.col("aliases_is_list") if "aliases_is_list" in cols else F.lit(True)
    official = F.coalesce(F.col("source_verification_status") == OFFICIAL, F.lit(False))
    any_validity = reduce(lambda a, b: a | b, [F.col(n).isNotNull() for n in VALIDITY_FIELDS if n in cols])
    # Only the first entry of an id keeps it. The comparison with the group's
    # smallest index aggregates before it shuffles, so a hot id cannot pile up.
    valid = registry.where(is_object & _filled(F.col("doc_id")))
    firsts = valid.groupBy("doc_id").agg(F.min("idx").alias("first_idx"))
    rows = registry.join(firsts, "doc_id", "left")
    codes = F.array_compact(F.array(
        F.when(~is_object, "invalid_entry_type"),
        F.when(is_object & ~_filled(F.col("doc_id")), "missing_doc_id"),
        F.when(is_object & (F.col("idx") > F.col("first_idx")), "duplicate_doc_id"),
        F.when(is_object & official & ~source_evidence(), "incomplete_official_source"),
        F.when(is_object & official & any_validity & ~validity_evidence(), "incomplete_official_validity"),
        F.when(is_object & ~listed, "invalid_aliases"),
    ))
    return rows.select("idx", "doc_id", F.explode(codes).alias("code"))


def registry_gate(registry: DataFrame, require_documents: bool = True) -> DataFrame:
    """All audit issues plus one when the registry holds no entry at all."""
    issues = audit_registry(registry)
    if not require_documents:
        return issues
    empty = registry.agg(F.count("*").alias("n")).where(F.col("n") == 0).select(
        F.lit(None).cast("long").alias("idx"), F.lit(None).cast("string").alias("doc_id"),
        F.lit("empty_source_registry").alias("code"),
    )
    return issues.unionByName(empty)


def review_queue(items: DataFrame) -> DataFrame:
    """Documents whose source is not officially verified."""
    status = F.coalesce("source_verification_status", F.lit(""))
    return items.where(status != OFFICIAL).select(
        "source_file", "doc_id", "source_registry_status", "source_verification_status"
    )


def provenance(files: DataFrame, root: str) -> DataFrame:
    """Provenance of raw files (`path, content`) without any claim of verification."""
    relative = F.regexp_replace(F.col("path"), "^(?:[a-z]+:)?/*" + root.strip("/") + "/", "")
    name = F.element_at(F.split(relative, "/"), -1)
    return files.select(
        F.regexp_replace(name, r"\.[^.]*$", "").alias("doc_id"),
        relative.alias("source_file"),
        F.lower(F.regexp_extract(name, r"\.([^.]*)$", 1)).alias("source_format"),
        F.sha2("content", 256).alias("source_checksum_sha256"),
        F.lit(None).cast("string").alias("source_url"),
        F.lit(LOCAL_ONLY).alias("source_verification_status"),
        F.lit(None).cast("string").alias("source_verified_at"),
    )
