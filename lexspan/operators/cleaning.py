"""Cleaning of every text field of a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexspan.functions import text as tx

# Text fields of a precedent, in the order of the source form (fixed names).
PRECEDENT_TEXTS = (
    "title", "source_note", "court", "location_note", "summary", "issue", "holding", "facts", "reasoning",
)
PRECEDENT_LISTS = ("related_provisions", "keywords")


def clean_fields(df: DataFrame, texts: list[str], lists: list[str] = ()) -> DataFrame:
    """Apply the rule chain to string columns and to arrays of strings.

    NFC runs once per string column; array items are composed as one joined
    string, so no per-item Python call is needed.
    """
    composed = {name: tx.nfc(F.col(name)) for name in texts}
    composed.update({
        name: F.split(tx.nfc(F.array_join(F.col(name), "\x00")), "\x00") for name in lists
    })
    df = df.withColumns(composed) if composed else df
    cleaned = {name: tx.clean(F.col(name), composed=True) for name in texts}
    cleaned.update({
        name: F.transform(F.col(name), lambda item: tx.clean(item, composed=True)) for name in lists
    })
    return df.withColumns(cleaned) if cleaned else df


def clean_precedents(df: DataFrame) -> DataFrame:
    return clean_fields(
        df,
        [name for name in PRECEDENT_TEXTS if name in df.columns],
        [name for name in PRECEDENT_LISTS if name in df.columns],
    )
