"""Amounts, identifiers and token types in receipt text, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns and lexicons that decide results.
NUMERIC = r"[0-9][0-9\.,:/\-]*"
DATE = r"(?U)\b(?:[0-3]?\d[\-/][01]?\d[\-/](?:\d{2}|\d{4})|[01]?\d[\-/](?:\d{2}|\d{4}))\b"
AMOUNT = r"\$?\s*\(?\s*[0-9]{1,3}(?:[\.,][0-9]{3})*(?:[\.,][0-9]{1,2})\s*\)?"
MERGED = r",\d{2}"
CARD = r"(?:\b\d[\d\s\-]{11,22}\d\b|\b\*{2,}\s*\d{4,6}\b)"
MASKED_CARD = r"\*{2,}\s*\d{3,6}"
DOCUMENT_NUMBER = r"\b([0-9]{7,8})\b"
BANKS = (
    "BBVA", "SANTANDER", "PROVINCIA", "NACION", "NACIÓN", "NATIVA", "GALICIA", "PATAGONIA", "MACRO", "ICBC",
    "SUPERVIELLE", "CREDICOOP", "CIUDAD", "HSBC", "MERCADOPAGO", "MERCADO PAGO", "FRANCES", "FRANCA", "BNA", "BANCO",
)


def parse_amount(raw: Column) -> Column:
    """Money in any locale as a double: the last separator is decimal, parentheses are negative; else null."""
    value = F.trim(raw)
    negative = value.startswith("(") & value.endswith(")") & (F.length(value) > 1)
    inner = F.when(negative, F.regexp_replace(value, r"^\(|\)$", "")).otherwise(value)
    digits = F.regexp_replace(inner, r"[^0-9,.\-]", "")
    comma, dot = F.locate(",", F.reverse(digits)), F.locate(".", F.reverse(digits))  # from the end; 0 is none
    comma_last = (comma > 0) & ((dot == 0) | (comma < dot))
    plain = F.when(comma_last, F.replace(F.replace(digits, F.lit("."), F.lit("")), F.lit(","), F.lit("."))).otherwise(F.replace(digits, F.lit(","), F.lit("")))
    valid = plain.rlike(r"^-?(?:[0-9]+\.?[0-9]*|\.[0-9]+)$")
    number = F.when(valid, plain.try_cast("double"))
    return F.when(negative, -number).otherwise(number)


def card_numbers(text: Column) -> Column:
    """Digits of card-like runs, 13 to 19 of them, each once in order of appearance."""
    found = F.regexp_extract_all(text, F.lit(CARD), F.lit(0))
    digits = F.transform(found, lambda x: F.regexp_replace(x, "[^0-9]", ""))
    return F.array_distinct(F.filter(digits, lambda x: F.length(x).between(13, 19)))


def masked_card_numbers(text: Column) -> Column:
    found = F.regexp_extract_all(text, F.lit(MASKED_CARD), F.lit(0))
    return F.array_distinct(F.transform(found, lambda x: F.replace(x, F.lit(" "), F.lit(""))))


def document_number(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, DOCUMENT_NUMBER, 1), F.lit(""))


def bank_name(upper_text: Column) -> Column:
    """The first keyword, by the list's order, that the text holds."""
    found = F.filter(F.array(*map(F.lit, BANKS)), lambda k: F.contains(upper_text, k))
    return F.initcap(F.lower(F.get(found, 0)))


def is_numeric(token: Column) -> Column:
    return token.rlike(NUMERIC)


def is_date(token: Column) -> Column:
    return token.rlike(DATE)


def is_amount(token: Column) -> Column:
    return token.rlike(AMOUNT)


def is_merged(token: Column) -> Column:
    """Two cells read as one: two decimal endings or two currency signs."""
    return (F.regexp_count(token, F.lit(MERGED)) >= 2) | (F.length(token) - F.length(F.replace(token, F.lit("$"), F.lit(""))) >= 2)
