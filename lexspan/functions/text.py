"""Text rules as Column expressions.

All of them stay inside whole-stage codegen except `nfc`, which has no built-in
counterpart and runs once, when text is cleaned.
"""

from __future__ import annotations

import sys
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

WORD = r"[\p{L}\p{M}\p{N}_]+"
LINE_BREAK = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x85  ]"


def _accent_table() -> tuple[str, str]:
    """Characters that lose their marks, and what remains of them."""
    source, target = [], []
    for point in range(0xC0, min(sys.maxunicode, 0x2FFF) + 1):
        char = chr(point)
        base = "".join(c for c in unicodedata.normalize("NFD", char) if unicodedata.category(c) != "Mn")
        if len(base) == 1 and base != char:
            source.append(char)
            target.append(base)
    return "".join(source) + "đĐ", "".join(target) + "dD"


ACCENTED, PLAIN = _accent_table()

# ---- fixed values ---------------------------------------------------------
NOISE_LINES = (
    r"^\s*Trang\s+\d+\s*$",
    r"^\s*Page\s+\d+\s*$",
    r"^\s*\d+\s*$",
    r"^\s*\d+\s+Án lệ này do .*$",
    r"THƯ VIỆN PHÁP LUẬT",
    r"VIETLAW",
    r"^[-_=]{3,}$",
)
CITATION_WORDS = (
    ("Điều", r"\d+"),
    ("Khoản", r"\d+"),
    ("Điểm", r"[a-z]"),
    ("Chương", r"[IVXLCDM]+"),
    ("Mục", r"\d+"),
)
GROUNDING_STOPWORDS = (
    "theo", "cua", "của", "va", "và", "la", "là", "co", "có", "khong", "không", "duoc", "được", "phai", "phải", "neu",
    "nếu", "thi", "thì", "cho", "trong", "mot", "một", "cac", "các", "ve", "về", "voi", "với", "tu", "từ", "tai",
    "tại", "nay", "này", "do", "đó", "can", "cần", "se", "sẽ", "hoac", "hoặc", "khi", "nhung", "những", "noi", "nội",
    "dung", "quy", "dinh", "định", "phap", "pháp", "luat", "luật", "van", "văn", "ban", "bản",
)
INJECTION_PATTERNS = (
    r"bo\s*qua\s*cac\s*lenh",
    r"bỏ\s*qua\s*các\s*lệnh",
    r"ignore\s*previous\s*instructions",
    r"hay\s*dong\s*vai",
    r"hãy\s*đóng\s*vai",
    r"act\s*as\s*",
    r"system\s*prompt",
    r"tiet\s*lo\s*huong\s*dan",
    r"tiết\s*lộ\s*hướng\s*dẫn",
    r"quen\s*tat\s*ca",
    r"quên\s*tất\s*cả",
)
MOJIBAKE_TOKENS = (
    "Ä\u0090", "Ä‘", "á»", "áº", "Æ¡", "Æ°",
    "ðŸ", "CÃ¢", "khÃ´", "phÃ¡", "luáº", "ngÆ°",
)
UUID_DNS_NAMESPACE = "6ba7b8109dad11d180b400c04fd430c8"
EMAIL = r"[a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\.[a-zA-Z0-9-.]+"
PHONE = r"\b(0|\+84)\d{9}\b"
# ---------------------------------------------------------------------------


@F.pandas_udf(T.StringType())
def nfc(text: pd.Series) -> pd.Series:
    """Canonical composition (Arrow batches; already composed values pass through)."""
    return text.map(
        lambda s: s if s is None or unicodedata.is_normalized("NFC", s) else unicodedata.normalize("NFC", s)
    )


def let(value: Column, body) -> Column:
    """Bind an expensive value once; lambdas would otherwise evaluate it per element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def is_ascii(text: Column) -> Column:
    return F.octet_length(text) == F.length(text)


def either_case(word: str) -> str:
    """A pattern for `word` in any case, without the cost of Unicode case flags."""
    return "".join(f"[{c.upper()}{c.lower()}]" if c.upper() != c.lower() else c for c in word)


#: What (?U)\s stands for in a pattern.
_BLANKS = "".join(map(chr, (*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))


def strip(text: Column) -> Column:
    """White space (by Unicode) off both ends."""
    return F.trim(text, F.lit(_BLANKS))


def collapse(text: Column) -> Column:
    """Every run of white space becomes one blank; ends trimmed."""
    return F.trim(F.regexp_replace(text, r"(?U)\s{2,}|[^\S ]", " "))  # a single blank stands already


def tidy_whitespace(text: Column) -> Column:
    return strip(F.regexp_replace(F.regexp_replace(text, r"[ \t]+", " "), r"\n{3,}", "\n\n"))


def drop_noise_lines(text: Column) -> Column:
    noise = "(?iu)" + "|".join(NOISE_LINES)
    lines = F.split(F.regexp_replace(text, f"(?:{LINE_BREAK})$", ""), LINE_BREAK)
    return F.array_join(F.filter(lines, lambda line: ~line.rlike(noise)), "\n")


def tidy_punctuation(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)\s+([.,;:])", "$1")


def canonical_citations(text: Column) -> Column:
    """Spelling of citation words; plain ASCII text cannot hold any of them."""
    out = text
    for word, number in CITATION_WORDS:
        letter, rest = either_case(word[0]), either_case(word[1:])
        number = number.replace("a-z", "a-zA-Z").replace("IVXLCDM", "IVXLCDMivxlcdm")
        inside = r"[\p{L}\p{M}\p{N}_]"
        out = F.regexp_replace(
            out, rf"{letter}(?<!{inside}{letter}){rest}[\s\u00A0]+({number})(?!{inside})", f"{word} $1"
        )
    return F.when(is_ascii(text), text).otherwise(out)


def clean(text: Column, composed: bool = False) -> Column:
    """The whole rule chain in order; `composed=True` skips NFC for text known to be composed."""
    text = text if composed else nfc(text)
    return canonical_citations(tidy_punctuation(drop_noise_lines(tidy_whitespace(text))))


def casefold(text: Column) -> Column:
    return F.translate(F.replace(F.lower(text), F.lit("ß"), F.lit("ss")), "ς", "σ")


def fold(text: Column) -> Column:
    """Drop accents: composed letters by table, loose marks by class."""
    stripped = F.regexp_replace(F.translate(text, ACCENTED, PLAIN), r"\p{Mn}+", "")
    return F.when(is_ascii(text), text).otherwise(stripped)


def match_form(text: Column) -> Column:
    return collapse(fold(casefold(F.coalesce(text, F.lit("")))))


def report_form(text: Column) -> Column:
    """The looser form used for scoring reports: only a-z, 0-9 and / survive."""
    return F.trim(F.regexp_replace(fold(F.lower(F.coalesce(text, F.lit("")))), r"[^a-z0-9/]+", " "))


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(1))


def match_tokens(text: Column) -> Column:
    return F.array_distinct(words_of(match_form(text)))


def search_tokens(text: Column) -> Column:
    """Distinct tokens of length two or more, each with its folded form."""
    lowered = casefold(F.coalesce(text, F.lit("")))
    both = F.concat(words_of(lowered), words_of(fold(lowered)))
    return F.filter(F.array_distinct(both), lambda token: F.length(token) >= 2)


def grounding_tokens(text: Column) -> Column:
    stop = F.array(*[F.lit(word) for word in sorted(set(GROUNDING_STOPWORDS))])
    tokens = F.array_distinct(words_of(casefold(F.coalesce(text, F.lit("")))))
    return F.filter(
        F.array_except(tokens, stop),
        lambda token: (F.length(token) >= 3) & ~token.rlike(r"^\p{Nd}+$"),
    )


def truncate(text: Column, size: int = 400) -> Column:
    short = collapse(text)
    return F.when(F.length(short) <= size, short).otherwise(
        F.concat(F.rtrim(F.substring(short, 1, size - 3)), F.lit("..."))
    )


def snippet(text: Column) -> Column:
    return truncate(F.coalesce(text, F.lit("")), 240)


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"(?U)\S+")), F.lit(0)).cast("long")


def char_count(text: Column) -> Column:
    return F.coalesce(F.length(text), F.lit(0)).cast("long")


def safe_part(value: Column) -> Column:
    dashed = F.regexp_replace(F.lower(strip(value.cast("string"))), r"(?U)[^\w.-]+", "_")
    trimmed = F.regexp_replace(dashed, "^_+|_+$", "")
    return F.when(F.coalesce(trimmed, F.lit("")) == "", F.lit("unknown")).otherwise(trimmed)


def node_key(doc_id: Column, kind: str, *parts: Column) -> Column:
    """Readable node id; missing parts are left out."""
    suffix = [F.when(part.isNotNull() & (part.cast("string") != ""), safe_part(part)) for part in parts]
    return F.concat_ws("_", safe_part(doc_id), F.lit(kind), *suffix)


def section_slug(value: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(value), "[^a-z0-9_]+", "_"), "^_+|_+$", "")


def point_uuid(name: Column) -> Column:
    """Version-5 UUID in the DNS namespace, from SHA-1 alone."""
    digest = F.sha1(F.concat(F.unhex(F.lit(UUID_DNS_NAMESPACE)), F.encode(name, "UTF-8")))
    variant = F.translate(F.substring(digest, 17, 1), "0123456789abcdef", "89ab89ab89ab89ab")
    return F.concat(
        F.substring(digest, 1, 8), F.lit("-"), F.substring(digest, 9, 4), F.lit("-5"),
        F.substring(digest, 14, 3), F.lit("-"), variant, F.substring(digest, 18, 3),
        F.lit("-"), F.substring(digest, 21, 12),
    )


def fingerprint(value: Column) -> Column:
    return F.sha2(value, 256)


def fixed(value: Column, places: int) -> Column:
    """A double with `places` decimals, rounded by its exact binary value (halves to even) as C's printf does."""
    number = F.call_function("format_number", value, F.lit("0." + "0" * places))
    endless = F.when(F.isnan(value), "nan").when(value == float("inf"), "inf").when(value == float("-inf"), "-inf")
    return F.coalesce(endless, number)


def redact(message: Column) -> Column:
    hidden = F.regexp_replace(F.regexp_replace(message, EMAIL, "[REDACTED_EMAIL]"), PHONE, "[REDACTED_PHONE]")
    return F.when(
        hidden.contains("Received API query:") & (F.length(hidden) > 60),
        F.concat(F.substring(hidden, 1, 60), F.lit("... [REDACTED_LONG_QUERY]")),
    ).otherwise(hidden)


def log_value(value: Column, size: int = 500) -> Column:
    flat = strip(F.regexp_replace(F.regexp_replace(F.coalesce(value, F.lit("")), r"[\r\n\t]+", " "), r"\s{2,}", " "))
    return F.when(F.length(flat) <= size, flat).otherwise(
        F.concat(F.substring(flat, 1, size - 3), F.lit("..."))
    )


def injection_hit(query: Column) -> Column:
    """First matching pattern, or null."""
    lowered = F.lower(query)
    return F.coalesce(*[F.when(lowered.rlike(p), F.lit(p)) for p in INJECTION_PATTERNS])


def mojibake_hits(text: Column) -> Column:
    return F.filter(F.array(*[F.lit(t) for t in MOJIBAKE_TOKENS]), lambda token: F.contains(text, token))
