"""Scalar functions on text as column expressions; the one Arrow function is Unicode composition, which Spark lacks."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import PandasUDFType, pandas_udf

# Combining marks that count as parts of words (general, Devanagari, Bengali, Tamil, zero-width joiner).
MARKS = r"̀-ͯऀ-ःऺ-ॏ॑-ॗॢॣঁ-ঃ়া-্ৗৢৣஂா-்ௗ‍"
WORD = rf"[\p{{L}}\p{{N}}_{MARKS}]+"
# Patterns of personal data and what takes their place.
EMAIL = r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}"
PHONE = r"(?U)(?<!\w)(?:\+\d[\d \t().\-]{5,}\d|\(\d{2,4}\)[ \t]?[\d \t().\-]{4,}\d)(?!\w)"
EMAIL_MASK, PHONE_MASK, PHONE_DIGITS = "[EMAIL]", "[PHONE]", 7
PRETOKEN = r" ?\S+|\s+"


def _composed(text: pd.Series) -> pd.Series:
    return text.map(lambda t: t if t is None or unicodedata.is_normalized("NFC", t) else unicodedata.normalize("NFC", t))


def nfc(text: Column) -> Column:
    return pandas_udf(_composed, "string", PandasUDFType.SCALAR)(text)


def normalize(text: Column, composed: bool = False) -> Column:
    """Canonical text: composed, line feeds only, no control characters, single spaces, trimmed lines, no runs of blank lines."""
    out = text if composed else nfc(text)
    for pattern, to in ((r"\r\n?", "\n"), (r"[\p{Cc}&&[^\n\t]]", ""), (r"[ \t]+", " "), (r"(?md)^ +| +$", ""), (r"\n{3,}", "\n\n"), (r"(?U)\A\s+|\s+\z", "")):
        out = F.regexp_replace(out, pattern, to)
    return out


def est_tokens(text: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.octet_length(text) / 4)).cast("long")


def content_hash(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def grams(tokens: Column, n: int) -> Column:
    """All runs of n tokens, space-joined, with repeats; none if there are fewer tokens."""
    return F.when(F.size(tokens) >= n, F.transform(F.sequence(F.lit(1), F.size(tokens) - (n - 1)), lambda i: F.array_join(F.slice(tokens, i, n), " "))).otherwise(F.array().cast("array<string>"))


def scrub_emails(text: Column) -> Column:
    return F.regexp_replace(text, EMAIL, EMAIL_MASK)


def _phones(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(PHONE), F.lit(0))


def _is_phone(match: Column) -> Column:
    return F.length(F.regexp_replace(match, r"(?U)\D", "")) >= PHONE_DIGITS


def scrub_phones(text: Column) -> Column:
    """Masks numbers with a dialling mark and enough digits; the rest of the text and shorter matches stay as they are."""
    pieces, found = F.split(text, PHONE, -1), _phones(text)
    return F.array_join(F.zip_with(pieces, found, lambda s, m: F.concat(F.coalesce(s, F.lit("")), F.when(m.isNull(), "").when(_is_phone(m), PHONE_MASK).otherwise(m))), "")


def scrub(text: Column) -> Column:
    return scrub_phones(scrub_emails(text))


def redactions(text: Column) -> Column:
    return (F.size(F.regexp_extract_all(text, F.lit(EMAIL), F.lit(0))) + F.size(F.filter(_phones(scrub_emails(text)), _is_phone))).cast("long")


def pretokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit("(?U)" + PRETOKEN), F.lit(0))
