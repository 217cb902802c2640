"""Matching of names and citations, in a bounded and a loose variant."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexspan.functions import text as tx

# ---- fixed values ---------------------------------------------------------
DOCUMENT_NUMBER = r"\b(\d+/\d{4}/[a-z0-9-]+)\b"
ARTICLE_NUMBER = r"\bdieu\s+(\d+[a-z]?)\b"
CLAUSE_NUMBER = r"\bkhoan\s+(\d+)\b"
CONFIDENCE_LEVELS = {"low": 1, "medium": 2, "high": 3}
# ---------------------------------------------------------------------------


def found(text: Column, pattern: str) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)))


def bounded(haystack: Column, needle: Column) -> Column:
    """`needle` occurs in `haystack` with no word character next to it."""
    pattern = F.concat(
        F.lit(r"(?U)(?<!\w)\Q"), F.replace(needle, F.lit("\\E"), F.lit("")), F.lit(r"\E(?!\w)")
    )
    return (haystack != "") & (needle != "") & F.contains(haystack, needle) & F.regexp_like(haystack, pattern)


def mentions(haystack: Column, needle: Column) -> Column:
    """All words of `needle` occur in `haystack` (which a bounded hit implies).

    A needle without any word is compared as a bounded string.
    """
    plain = tx.match_form(needle)
    wanted = F.array_distinct(tx.words_of(plain))
    return F.when(
        F.size(wanted) > 0, F.size(F.array_except(wanted, tx.match_tokens(haystack))) == 0
    ).otherwise((plain != "") & bounded(tx.match_form(haystack), plain))


def numbers(form: Column) -> Column:
    """Document, article and clause numbers of a folded citation."""
    return F.struct(
        found(form, DOCUMENT_NUMBER).alias("docs"), found(form, ARTICLE_NUMBER).alias("articles"),
        found(form, CLAUSE_NUMBER).alias("clauses"),
    )


def numbers_agree(observed: Column, expected: Column) -> Column:
    """The rule on `numbers` of both sides; numbers worked out once per row serve many pairs."""
    docs, arts, clauses = expected["docs"], expected["articles"], expected["clauses"]
    return (
        ((F.size(docs) == 0) | F.arrays_overlap(docs, observed["docs"]))
        & (F.size(F.array_except(arts, observed["articles"])) == 0)
        & (F.size(F.array_except(clauses, observed["clauses"])) == 0)
        & (F.size(docs) + F.size(arts) + F.size(clauses) > 0)
    )


def _number_rules(observed: Column, expected: Column) -> Column:
    return numbers_agree(numbers(observed), numbers(expected))


def citation_matches(observed: Column, expected: Column) -> Column:
    """Routing variant: containment must respect word borders."""
    obs, exp = tx.match_form(observed), tx.match_form(expected)
    return (obs != "") & (exp != "") & (bounded(obs, exp) | bounded(exp, obs) | _number_rules(obs, exp))


def citation_matches_loose(observed: Column, expected: Column) -> Column:
    """Reporting variant: plain containment, so article 1 also matches article 12."""
    obs, exp = tx.report_form(observed), tx.report_form(expected)
    return (obs != "") & (exp != "") & (F.contains(obs, exp) | F.contains(exp, obs) | _number_rules(obs, exp))


def level_rank(level: Column) -> Column:
    rank = F.lit(0)
    for name, value in CONFIDENCE_LEVELS.items():
        rank = F.when(level == name, F.lit(value)).otherwise(rank)
    return rank


def level_at_least(observed: Column, minimum: Column) -> Column:
    return level_rank(observed) >= level_rank(minimum)
