"""Tokens worth a closer look, a document's token summary and its columns."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliospark.functions.arrays import let
from foliospark.functions.text import is_amount, is_date, is_merged, is_numeric

# Words of a line that make its tokens candidates.
LABEL_HINTS = (
    "haberes", "descuentos", "neto", "liquido", "a cobrar", "total", "periodo", "periodo liquidado", "periodo abonado", "fecha", "venc", "item", "cod", "concepto",
    "cuota", "retencion", "retención", "acreditado", "sueldo", "haber mensual", "aporte", "jubilatorio", "beneficio", "prestacion", "prestación", "titular",
    "vencimiento", "resumen", "detalle", "saldo", "importe", "monto", "movimiento", "transferencia", "alias", "operacion", "operación", "destinatario", "origen", "cvu", "cbu",
)
# Words of lines whose dates name a law or a record.
REFERENCE_LINE = ("acta", "acuerdo", "art.", " art ", "resolucion", "resolución", "decreto", "ley ")
# Words that a summary counts.
CRITICAL_KEYWORDS = (
    "total", "neto", "cbu", "cuil", "cuit", "dni", "doc", "fecha", "haber", "descuento", "cobrar", "cuenta", "importe", "monto", "saldo", "benef", "periodo", "sueldo", "recibo",
    "comprobante", "aporte", "jubila", "pension", "pensión", "beneficio", "titular", "vencimiento", "resumen", "detalle", "retencion", "retención", "movimiento",
    "transferencia", "alias", "operacion", "operación", "destinatario", "origen", "cvu",
)
# Lengths and numbers that results are cut to.
LINE_TEXT, MAX_CANDIDATES, MAX_HITS = 220, 200, 10


def contains_any(text: Column, words: tuple[str, ...]) -> Column:
    """One alternation, so that a text is searched once and not once a word."""
    return text.rlike("|".join(re.escape(w) for w in words))


def candidates(tokens: DataFrame, doc: str, line: str, idx: str, text: str) -> DataFrame:
    """``line_candidates`` of tokens, which one shuffle gathers to lines."""
    lines = tokens.groupBy(doc, line).agg(F.sort_array(F.collect_list(F.struct(F.col(idx).alias("idx"), F.col(text).alias("text")))).alias("ts"))
    return line_candidates(lines, doc, line, idx, text)


def line_candidates(lines: DataFrame, doc: str, line: str, idx: str, text: str) -> DataFrame:
    """(doc, line, idx, text, type, priority, is_key_field, is_numeric, is_date, is_amount, line_text) of tokens worth a look.

    ``lines`` has a line's tokens in order as ``ts``, array<struct<idx, text>>. A token must be a
    number or stand in a line with a label hint, and not be two cells read as one. A line's text
    is searched once. Narrow.
    """
    lines = lines.withColumn("joined", F.array_join(F.transform("ts", lambda t: t["text"]), " "))
    low = F.lower("joined")
    lines = lines.select(doc, line, "ts", contains_any(low, LABEL_HINTS).alias("hinted"), contains_any(low, REFERENCE_LINE).alias("reference"), F.substring("joined", 1, LINE_TEXT).alias("line_text"))
    one = lines.select(doc, line, F.explode("ts").alias("t"), "hinted", "reference", "line_text").select(doc, line, F.col("t.idx").alias(idx), F.col("t.text").alias(text), "hinted", "reference", "line_text")
    typed = one.filter(~is_merged(F.col(text))).withColumns({"is_numeric": is_numeric(F.col(text)), "is_date": is_date(F.col(text)) & ~F.col("reference"), "is_amount": is_amount(F.col(text))})
    value = F.col("is_numeric") & (F.col("is_amount") | F.col("is_date"))
    priority = F.when(value & F.col("hinted"), 4).when(F.col("is_numeric") & F.col("hinted"), 3).when(value, 2).when(F.col("hinted"), 1).otherwise(0)
    ranked = typed.withColumn("priority", priority).filter("priority > 0")
    kind = F.element_at(F.array(*map(F.lit, ("key_context", "generic_numeric", "line_numeric", "key_numeric"))), F.col("priority"))
    return ranked.select(doc, line, idx, text, kind.alias("type"), "priority", (F.col("priority") == 4).alias("is_key_field"), "is_numeric", "is_date", "is_amount", "line_text")


def ranked_candidates(found: DataFrame, doc: str, order: list[str], text: str) -> DataFrame:
    """A document's MAX_CANDIDATES first candidates with ``place``: by priority, then length, then reading order."""
    by = Window.partitionBy(doc).orderBy(F.desc("priority"), F.desc(F.length(text)), *order)
    return found.withColumn("place", F.row_number().over(by)).filter(F.col("place") <= MAX_CANDIDATES)


def token_summary(words: Column, confidences: Column) -> Column:
    """struct<word_count, numeric_token_count, keyword_hits, mean_confidence, richness_score> of a document's tokens in reading order. Narrow."""
    n = F.size(words)
    numeric = F.size(F.filter(words, is_numeric))
    hits = F.filter(words, lambda w: contains_any(F.lower(w), CRITICAL_KEYWORDS))
    mean = F.when(n > 0, F.aggregate(confidences, F.lit(0.0), lambda a, c: a + c) / F.greatest(n, F.lit(1))).otherwise(F.lit(0.0))
    richness = (n > 0).cast("int") + (numeric >= 3).cast("int") + (F.size(hits) >= 2).cast("int") + (mean >= 70).cast("int")
    return F.struct(n.alias("word_count"), numeric.alias("numeric_token_count"), F.slice(hits, 1, MAX_HITS).alias("keyword_hits"), F.round(mean, 2).alias("mean_confidence"), richness.alias("richness_score"))


def split_columns(tokens: DataFrame, doc: str, idx: str, left: str, right: str, groups: str) -> DataFrame:
    """(doc, idx, column): a line's tokens cut at its ``groups`` - 1 widest gaps, earlier gaps first among equals.

    Lines with fewer tokens than groups, or no groups, have no rows. A line's tokens are one array,
    so one sort of narrow rows serves order, gaps and cuts.
    """
    token = F.struct(F.col(left).alias("x1"), F.col(idx).alias("idx"), F.col(right).alias("x2"), F.col(groups).cast("int").alias("groups"))
    lines = tokens.groupBy(doc).agg(F.sort_array(F.collect_list(token)).alias("ts"))

    def cut(ts: Column) -> Column:
        gaps = F.transform(ts, lambda t, i: F.struct((t["x1"] - F.get(ts, i - 1)["x2"]).alias("gap"), (-i).alias("back")))
        widest = F.transform(F.sort_array(F.filter(gaps, lambda g: g["gap"].isNotNull()), asc=False), lambda g: -g["back"])
        return let(widest, lambda w: F.transform(F.filter(F.transform(ts, lambda t, i: F.struct(t.alias("t"), i.alias("i"))), lambda x: x["t"]["groups"].between(1, F.size(ts))), lambda x: F.struct(x["t"]["idx"].alias("idx"), F.size(F.filter(F.slice(w, F.lit(1), x["t"]["groups"] - 1), lambda k: k <= x["i"])).alias("column"))))

    return lines.select(doc, F.explode(let(F.col("ts"), cut)).alias("t")).select(doc, F.col("t.idx").alias(idx), "t.column")


def reading_suspicion(word_count: Column, numeric: Column, hits: Column, mean: Column) -> Column:
    """0 to 4 points for a poor reading; ``mean`` is the unrounded confidence and ``hits`` the number of critical words."""
    document = (word_count >= 8) | (hits >= 2) | (numeric >= 3)
    one = lambda c: c.cast("int")
    poor = F.when(word_count == 0, 2).when(document, one(hits == 0) + one(mean < 45)).otherwise(one(mean < 35))
    return F.least(F.lit(4), poor + one(document & (numeric == 0)))
