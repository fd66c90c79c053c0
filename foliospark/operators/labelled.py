"""Values that stand beside or below a label: table columns, tax numbers and names."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliospark.functions.arrays import let
from foliospark.functions.receipt import spans
from foliospark.functions.text import is_numeric, parse_amount

# Patterns that decide results.
TAX_NUMBER = r"(?U)\b(\d{2}-?\d{8}-?\d)\b"
DASHED_TAX_NUMBER = r"(?U)^\d{2}-\d{7,8}-\d$"
TAX_LABEL, HOLDER_LABEL = r"(?iU)\bcuil\b", r"(?iU)\btitular\b"
PERSON_LABEL = r"(?iU)personal|titular|beneficiario|apellido\s+y\s+nombre"
ID_BEFORE_NAME, TAX_WORD = r"(?iU)DNI\s*[:\-]?\s*\d{6,9}", r"(?iU)CUIL"
NAME, NAME_WORD = r"[A-Za-zÀ-ÿ]{3,}", r"^[A-Za-zÀ-ÿ.]+$"
NOT_IN_NAME = ("cuil", "dni", "titular", "personal", "beneficiario")
EDGES = " :-."
# Pixels of tolerance, least gap and gap in label widths, characters before a number.
TOLERANCE, LEAST_GAP, GAP_RATIO, LABEL_BEFORE = 12, 40.0, 1.5, 15


def token_lines(tokens: DataFrame, doc: str, line: str, idx: str, text: str, x1: str, x2: str, top: str) -> DataFrame:
    """(doc, line, top, ts, below, line_text): each line's tokens and those of the next lower line.

    One shuffle by document serves the lines and their order; ties of the top edge go by line.
    """
    token = F.struct(F.col(idx).alias("idx"), F.col(text).alias("text"), F.col(x1).cast("double").alias("x1"), F.col(x2).cast("double").alias("x2"))
    lines = tokens.repartition(F.col(doc)).groupBy(doc, line).agg(F.sort_array(F.collect_list(token)).alias("ts"), F.min(top).alias("top"))
    below = F.lead("ts").over(Window.partitionBy(doc).orderBy("top", line))
    return lines.select(doc, F.col(line).alias("line"), "top", "ts", below.alias("below"), _joined(F.col("ts")).alias("line_text"))


def receipts(lines: DataFrame, doc: str) -> DataFrame:
    """(doc, lines): every document's rows of ``token_lines`` from top to bottom, without another shuffle."""
    return lines.groupBy(doc).agg(F.sort_array(F.collect_list(F.struct("top", "line", "ts", "below", "line_text"))).alias("lines"))


def document_lines(words: Column) -> Column:
    """The ``lines`` of ``receipts`` from a document's lines of words, array<array<struct<token, x1, x2>>> from top to bottom. Narrow.

    No line may be empty.
    """
    ts = F.transform(words, lambda line: F.transform(line, lambda w, i: F.struct(i.alias("idx"), w["token"].alias("text"), w["x1"].cast("double").alias("x1"), w["x2"].cast("double").alias("x2"))))
    return let(ts, lambda all: F.transform(all, lambda t, i: F.struct((i * 20).alias("top"), i.alias("line"), t.alias("ts"), F.get(all, i + 1).alias("below"), _joined(t).alias("line_text"))))


def _joined(tokens: Column) -> Column:
    return F.array_join(F.transform(tokens, lambda t: t["text"]), " ")


def first_span(text: Column, pattern: str) -> Column:
    """struct<label, start, stop> of the first match in characters from 0; null without one."""
    return F.get(spans(text, pattern), 0)


def covered(tokens: Column, span: Column) -> Column:
    """The tokens that a span of their joined text touches."""
    sizes = F.transform(tokens, lambda t: F.length(t["text"]))

    def touched(n: Column) -> Column:
        start = lambda i: F.aggregate(F.slice(n, 1, i), i, lambda a, x: a + x)  # noqa: E731  a space behind each token before
        placed = F.transform(tokens, lambda t, i: F.struct(t.alias("t"), start(i).alias("at"), F.get(n, i).alias("n")))
        return F.filter(placed, lambda p: (p["at"] < span["stop"]) & (p["at"] + p["n"] > span["start"]))

    return F.transform(let(sizes, touched), lambda p: p["t"])


def left_edge(tokens: Column) -> Column:
    return F.array_min(F.transform(tokens, lambda t: t["x1"]))


def right_edge(tokens: Column) -> Column:
    return F.array_max(F.transform(tokens, lambda t: t["x2"]))


def nearest_token(tokens: Column, x1: Column, x2: Column) -> Column:
    """The token nearest to the middle of an extent, the earlier one of equals; null beyond GAP_RATIO extents of at least LEAST_GAP."""
    middle = (x1 + x2) / 2
    near = F.array_min(F.transform(tokens, lambda t, i: F.struct(F.abs((t["x1"] + t["x2"]) / 2 - middle).alias("d"), i.alias("i"))))
    return let(near, lambda n: F.when(n["d"] <= F.greatest(x2 - x1, F.lit(LEAST_GAP)) * GAP_RATIO, F.get(tokens, n["i"])))


def values_row(tokens: Column) -> Column:
    """At least half of the tokens, and one, have digits."""
    return F.coalesce(F.size(F.filter(tokens, lambda t: is_numeric(t["text"]))) >= F.greatest(F.lit(1.0), F.size(tokens) / 2), F.lit(False))


def labelled_value(line: Column, pattern: str, valid: Callable[[Column], Column]) -> Column:
    """The valid value of a line's label, or null.

    The rest of the line counts first; else the tokens below that lie in the label's column,
    which reaches from the token left of the label to the one right of it.
    """
    tokens = line["ts"]

    def under(label: Column) -> Column:
        left = right_edge(F.filter(tokens, lambda t: t["x2"] <= label["x1"]))
        right = left_edge(F.filter(tokens, lambda t: t["x1"] >= label["x2"]))
        column = F.struct(left.alias("left"), right.alias("right"))

        def read(c: Column) -> Column:
            inside = lambda t: (c["left"].isNull() | (t["x1"] >= c["left"] - TOLERANCE)) & (c["right"].isNull() | (t["x2"] <= c["right"] + TOLERANCE))
            found = F.transform(F.filter(line["below"], inside), lambda t: F.struct(t["x1"].alias("x1"), t["idx"].alias("idx"), t["text"].alias("text")))
            return F.btrim(_joined(F.array_sort(found)), F.lit(EDGES))

        return let(column, read)

    good = lambda v: F.when(F.coalesce((v != "") & valid(v), F.lit(False)), v)

    def look(span: Column) -> Column:
        rest = F.btrim(F.substring(line["line_text"], span["stop"] + 1, F.length(line["line_text"])), F.lit(EDGES))
        extent = let(covered(tokens, span), lambda label: F.struct(left_edge(label).alias("x1"), right_edge(label).alias("x2")))
        return F.when(span.isNotNull(), F.coalesce(let(rest, good), let(let(extent, under), good)))

    return let(first_span(line["line_text"], pattern), look)


def column_values(lines: Column, pattern: str, valid: Callable[[Column], Column]) -> Column:
    """A document's valid values of a label from top to bottom, from the ``lines`` of ``receipts``. Narrow."""
    return F.filter(F.transform(lines, lambda x: labelled_value(x, pattern, valid)), lambda v: v.isNotNull())


def labelled_values(lines: DataFrame, pattern: str, valid: Callable[[Column], Column]) -> DataFrame:
    """Adds ``value`` to the lines with a label and keeps those that have a valid one. Narrow."""
    line = F.struct("ts", "below", "line_text")
    # An exploded value can't be pushed into a filter, so it is read once.
    found = F.explode_outer(F.array(let(line, lambda x: labelled_value(x, pattern, valid))))
    return lines.select("*", found.alias("value")).filter("value IS NOT NULL")


def first_value(values: DataFrame, doc: str, name: str = "value") -> DataFrame:
    """(doc, name): the value of a document's uppermost line that has one."""
    return values.groupBy(doc).agg(F.min_by("value", F.struct("top", "line")).alias(name))


def all_values(values: DataFrame, doc: str, name: str = "values") -> DataFrame:
    """(doc, name): all of a document's values from top to bottom."""
    return values.groupBy(doc).agg(F.transform(F.sort_array(F.collect_list(F.struct("top", "line", "value"))), lambda v: v["value"]).alias(name))


def amount_below(lines: Column, patterns: Sequence[str]) -> Column:
    """struct<amount, raw>: the amount below a column header, nearest to the header's centre, of the uppermost line that has one."""

    def read(line: Column) -> Column:
        span = F.coalesce(*(first_span(line["line_text"], f"(?iU){p}") for p in patterns))

        def below(s: Column) -> Column:
            label = covered(line["ts"], s)
            token = let(label, lambda t: nearest_token(line["below"], left_edge(t), right_edge(t)))
            value = let(token, lambda t: F.struct(parse_amount(t["text"]).alias("amount"), F.trim(t["text"]).alias("raw")))
            return F.when(s.isNotNull() & values_row(line["below"]), value)

        return let(span, below)

    return F.get(F.filter(F.transform(lines, read), lambda a: a["amount"].isNotNull()), 0)


def table_amount(lines: DataFrame, doc: str, patterns: Sequence[str]) -> DataFrame:
    """(doc, amount, raw) of the documents that have an ``amount_below`` the label."""
    found = receipts(lines, doc).select(doc, F.explode_outer(F.array(amount_below(F.col("lines"), patterns))).alias("a"))
    return found.filter("a IS NOT NULL").select(doc, "a.amount", "a.raw")


def tax_number_in_text(text: Column) -> Column:
    """Behind a label and dashed, else behind a label, else the first one."""
    near = lambda m: F.contains(F.lower(F.substring(text, F.greatest(m["start"] - LABEL_BEFORE, F.lit(0)) + 1, F.least(m["start"], F.lit(LABEL_BEFORE)))), F.lit("cuil"))
    found = F.transform(spans(text, TAX_NUMBER), lambda m: F.struct(m["label"].alias("number"), near(m).alias("near"), m["label"].rlike(DASHED_TAX_NUMBER).alias("dashed")))
    return let(found, lambda f: F.coalesce(F.get(F.filter(f, lambda m: m["near"] & m["dashed"]), 0), F.get(F.filter(f, lambda m: m["near"]), 0), F.get(f, 0))["number"])


def bare(value: Column) -> Column:
    return F.replace(value, F.lit(" "), F.lit(""))


def is_tax_number(value: Column) -> Column:
    return bare(value).rlike(r"(?U)^\d{2}-?\d{8}-?\d$")


def is_dashed(value: Column) -> Column:
    return bare(value).rlike(DASHED_TAX_NUMBER)


def labelled_tax_numbers(lines: Column) -> Column:
    """A document's tax numbers beside or below their labels, each once: the dashed ones from top to bottom, then the others.

    A line may offer a plain number beside its label and a dashed one below, so each kind is looked up alone.
    """
    dashed = F.filter(column_values(lines, TAX_LABEL, is_dashed), is_tax_number)
    return F.array_distinct(F.transform(F.concat(dashed, column_values(lines, TAX_LABEL, is_tax_number)), bare))


def reading_text(lines: Column) -> Column:
    """The document's text in reading order, which is that of the line numbers."""
    return F.array_join(F.transform(F.array_sort(F.transform(lines, lambda x: F.struct(x["line"].alias("line"), x["line_text"].alias("text")))), lambda x: x["text"]), " ")


def tax_number(lines: Column) -> Column:
    """The first dashed value of a label, else its first value, else the one in the text; else null."""
    first = lambda ok: let(F.get(column_values(lines, TAX_LABEL, ok), 0), lambda v: F.when(is_tax_number(v), bare(v)))
    return F.coalesce(first(is_dashed), first(is_tax_number), let(reading_text(lines), tax_number_in_text))


def tax_numbers(lines: DataFrame, doc: str) -> DataFrame:
    """(doc, tax_number) of every document: the labelled dashed one, the labelled one, the one in the text; else null."""
    return receipts(lines, doc).select(doc, tax_number(F.col("lines")).alias("tax_number"))


def looks_like_name(value: Column) -> Column:
    low = F.lower(value)
    return value.rlike(NAME) & ~reduce(lambda a, b: a | b, (F.contains(low, F.lit(w)) for w in NOT_IN_NAME))


def person_name(lines: Column) -> Column:
    """The holder's column, else a name in the first line with a person label; else null."""

    def inline(text: Column) -> Column:
        def read(m: Column) -> Column:
            between = F.btrim(F.substring(text, m["id"]["stop"] + 1, m["tax"]["start"] - m["id"]["stop"]), F.lit(EDGES))
            words = F.filter(F.split(F.substring(text, m["label"]["stop"] + 1, F.length(text)), r"(?U)\s+"), lambda w: w.rlike(NAME_WORD))
            named = F.when(m["tax"]["start"] > m["id"]["stop"], F.nullif(between, F.lit("")))
            return F.when(m["label"].isNotNull(), F.coalesce(named, F.nullif(F.array_join(words, " "), F.lit(""))))

        return let(F.struct(first_span(text, PERSON_LABEL).alias("label"), first_span(text, ID_BEFORE_NAME).alias("id"), first_span(text, TAX_WORD).alias("tax")), read)

    by_line = F.array_sort(F.transform(lines, lambda x: F.struct(x["line"].alias("line"), inline(x["line_text"]).alias("name"))))
    return F.coalesce(F.get(column_values(lines, HOLDER_LABEL, looks_like_name), 0), F.get(F.filter(by_line, lambda x: x["name"].isNotNull()), 0)["name"])


def person_names(lines: DataFrame, doc: str) -> DataFrame:
    """(doc, person_name) of every document."""
    return receipts(lines, doc).select(doc, person_name(F.col("lines")).alias("person_name"))
