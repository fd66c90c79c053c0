"""Labelled amounts, periods and identifiers in the text of a receipt, as columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from foliospark.functions.arrays import let
from foliospark.functions.text import parse_amount

# Patterns and lexicons that decide results.
PERIOD_LABEL = r"(?iU)per[ií]odo(?:\s+(?:abonado|liquidado))?|per\.?\s*abonado|per\.?\s*liquidado|sueldo\s*mes|mes\s*liquidado"
RANGE_BOUNDARY = r"(?iU)\bdesde\b|\bhasta\b"
MONTHS = {
    "enero": 1, "febrero": 2, "marzo": 3, "abril": 4, "mayo": 5, "junio": 6, "julio": 7, "agosto": 8,
    "septiembre": 9, "setiembre": 9, "octubre": 10, "noviembre": 11, "diciembre": 12,
}
PERIOD_VALUE = r"(?iU)(?:(?<!\d)(0?[1-9]|1[0-2])[\-/](\d{4}))|(?:(?<!\d)(\d{2})(0[1-9]|1[0-2])\b)|(?:(" + "|".join(MONTHS) + r")\s*(\d{4})?)"
HEADER_CONTEXT = r"(?iU)concepto|recibo\s+de"
WINDOW_AMOUNT = r"(?U)\(?\$?\s*([0-9]{1,3}(?:\.?[0-9]{3})*,[0-9]{2})\)?"
DECIMAL_TAIL = r"(?U)[\.,]\s?[0-9]{1,2}\)?\s*$"
WELL_FORMED_AMOUNT = r"(?U)^\$?\s*\d{1,3}(\.\d{3})*,\d{2}$"
PROCEDURE_NUMBER = r"(?iU)(?:tramite|tr[aá]mite)[^0-9]{0,20}([0-9]{6,14})"
AMOUNT_LABELS = {
    "total_haberes": [r"TOTAL\s+HABERES?", r"\bHABERES\b"],
    "total_descuentos": [r"TOTAL\s+DESCUENTOS?", r"\bDESCUENTOS\b"],
    "neto": [r"NETO\s+ANS(?:ES)?", r"\bNETO\b"],
    "neto_a_cobrar": [r"NETO\s+A\s+COBRAR", r"A\s+COBRAR", r"NETO\s+EFECTIVO", r"LIQ(?:\.|UIDO)?\s*(?:QUINCENA|MENSUAL)?"],
    "liquido": [r"LIQ\.?\s*(?:QUINCENA|MENSUAL)", r"TOTAL\s+LIQUIDO"],
}
# Characters around a label that are looked at.
RANGE_BEFORE, RANGE_AFTER, PERIOD_WINDOW, HEADER_BEFORE, AMOUNT_WINDOW = 25, 10, 40, 20, 120


def spans(text: Column, pattern: str) -> Column:
    """The pattern's matches in order as array<struct<label, start, stop>>, in characters from 0.

    The text between matches gives the positions that Spark's extraction leaves out.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pieces = F.zip_with(found, F.split(text, pattern, -1), lambda m, p: F.struct(m.alias("label"), F.length(p).alias("gap")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<label:string,start:int,stop:int>>").alias("out"))

    def step(s: Column, m: Column) -> Column:
        first = s["at"] + m["gap"]
        last = first + F.length(m["label"])
        return F.struct(last.alias("at"), F.concat(s["out"], F.array(F.struct(m["label"].alias("label"), first.alias("start"), last.alias("stop")))).alias("out"))

    return F.aggregate(F.filter(pieces, lambda m: m["label"].isNotNull()), start, step, lambda s: s["out"])


def _between(text: Column, start: Column, stop: Column) -> Column:
    return F.substring(text, F.greatest(start, F.lit(0)) + 1, stop - F.greatest(start, F.lit(0)))


def normal_period(value: Column) -> Column:
    """struct<month, year> of the first period in a text: ``05/2024``, ``2405`` or ``mayo 2024``; null without a year."""
    part = lambda k: F.nullif(F.regexp_extract(value, PERIOD_VALUE, k), F.lit(""))
    number = lambda k: part(k).try_cast("int")
    year = F.when(number(3) < 70, number(3) + 2000).otherwise(number(3) + 1900)
    names = F.create_map(*(F.lit(x) for pair in MONTHS.items() for x in pair))
    month = F.when(part(1).isNotNull(), number(1)).when(part(4).isNotNull(), number(4)).when(part(5).isNotNull(), F.try_element_at(names, F.lower(part(5))))
    of_year = F.when(part(1).isNotNull(), number(2)).when(part(4).isNotNull(), year).when(part(5).isNotNull(), number(6))
    return F.when(month.isNotNull() & of_year.isNotNull(), F.struct(month.alias("month"), of_year.alias("year")))


def periods(text: Column) -> Column:
    """Every labelled period in order: array<struct<label, raw, period>>. Labels beside ``desde`` or ``hasta`` bound a range and don't count."""
    near = lambda m: _between(text, m["start"] - RANGE_BEFORE, m["stop"] + RANGE_AFTER)
    labels = F.filter(spans(text, PERIOD_LABEL), lambda m: ~near(m).rlike(RANGE_BOUNDARY))

    def read(m: Column) -> Column:
        return let(_between(text, m["stop"], m["stop"] + PERIOD_WINDOW), lambda w: F.struct(F.trim(m["label"]).alias("label"), F.trim(F.regexp_extract(w, PERIOD_VALUE, 0)).alias("raw"), normal_period(w).alias("period")))

    return F.filter(F.transform(labels, read), lambda p: p["period"].isNotNull())


def period_score(found: Column) -> Column:
    """2 if the rows of ``periods`` name two periods or more, else 0."""
    return F.when(F.size(F.array_distinct(F.transform(found, lambda p: p["period"]))) >= 2, 2).otherwise(0)


def period_signal(found: Column) -> Column:
    """What the periods say of each other; null if fewer than two are named."""
    named = lambda p: F.concat(F.lit("'"), p["label"], F.lit(" "), p["raw"], F.lit("'"))
    first = F.get(found, 0)
    other = F.get(F.filter(found, lambda p: p["period"] != first["period"]), 0)
    differ = F.concat(F.lit("Inconsistencia de período: "), named(first), F.lit(" vs "), named(other), F.lit("."))
    return F.when(other.isNotNull(), differ).when(F.size(found) >= 2, "Períodos consistentes entre los campos detectados.")


def amount_after(text: Column, patterns: Sequence[str]) -> Column:
    """struct<value, raw, found>: the first readable amount behind a label, by pattern and then position.

    ``found`` tells an unreadable value (true) from a missing label. Labels behind a column
    header or in the document's title don't count. A null text has no label.
    """
    text = F.coalesce(text, F.lit(""))
    header = lambda m: _between(text, m["start"] - HEADER_BEFORE, m["start"]).rlike(HEADER_CONTEXT)
    labels = F.concat(*(F.filter(spans(text, f"(?iU){p}"), lambda m: ~header(m)) for p in patterns))
    behind = lambda m: F.regexp_extract(_between(text, m["stop"], m["stop"] + AMOUNT_WINDOW), WINDOW_AMOUNT, 0)
    read = lambda raw: F.struct(parse_amount(raw).alias("value"), F.trim(raw).alias("raw"))

    def first(ls: Column) -> Column:
        amounts = F.filter(F.transform(F.transform(ls, behind), read), lambda a: a["value"].isNotNull())
        return let(F.get(amounts, 0), lambda a: F.struct(a["value"].alias("value"), a["raw"].alias("raw"), (F.size(ls) > 0).alias("found")))

    return let(labels, first)


def plausible_amount(raw: Column) -> Column:
    """A decimal ending or at least four digits: shorter bare numbers are codes."""
    digits = F.length(F.regexp_replace(raw, "[^0-9]", ""))
    return (digits > 0) & (F.trim(raw).rlike(DECIMAL_TAIL) | (digits >= 4))


def typography_bucket(text: Column, is_date: Column, is_amount: Column) -> Column:
    """``dates``, ``amounts`` for well-formed money, else null: only like is compared with like."""
    return F.when(is_date, "dates").when(is_amount & F.trim(text).rlike(WELL_FORMED_AMOUNT), "amounts")


def procedure_number(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, PROCEDURE_NUMBER, 1), F.lit(""))
