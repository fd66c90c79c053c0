"""Line items, the three-column concept table, the issuer and what its receipts carry.

All of it reads a document's ``lines`` as ``labelled.receipts`` gives them, so a corpus of receipts
is shuffled once, by document, however many readers follow.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from foliospark.functions.arrays import let
from foliospark.functions.receipt import plausible_amount
from foliospark.functions.text import parse_amount
from foliospark.operators.candidates import contains_any
from foliospark.operators.labelled import bare, column_values, covered, first_span, labelled_tax_numbers, left_edge, looks_like_name, nearest_token, right_edge, values_row

# Patterns that decide results.
IDENTITY_DASH = r"(?U)\b\d{1,2}-\d{6,9}-\d\b"
TRAILING_NUMBER = r"(?U)(?<![0-9])-?\(?\$?\s*[0-9]+(?:\s?[.,]\s?[0-9]+)*\)?\s*$"
CONCEPT, EARNINGS, DEDUCTIONS = r"(?iU)\bconcepto\b", r"(?iU)\bhaberes\b", r"(?iU)\bdeducciones\b"
SUBTOTAL, TOTAL_PAID = r"(?iU)\bsubtotal\b", r"(?iU)total\s+a\s+cobrar"
BENEFIT_LABEL, BENEFIT_NUMBER_LABEL, AGENT_LABEL = r"(?iU)prestaci[oó]n", r"""(?iU)n[°'"]?\s*de\s*beneficio""", r"(?iU)persona\s+apoderada"
BENEFIT_NUMBER = r"^[0-9]{5,15}$"
# Words of lines that other readers take.
NOT_AN_ITEM = (
    "legajo", "dni", "cuil", "cuit", "periodo", "período", "nro.rec", "nro rec", "localidad", "destino", "personal", "titular", "beneficiario", "acreditado",
    "caja de ahorro", "sucursal", "cbu", "cvu", "alias", "concepto", "n° de beneficio", "nro de beneficio", "n de beneficio", "prestacion", "prestación",
)
# Issuers by a keyword of the document's head, in the order that decides.
ISSUERS = {
    "anses": "ANSES",
    "consejo provincial de educacion": "Consejo Provincial de Educación", "consejo provincial de educación": "Consejo Provincial de Educación",
    "provincia de santa cruz": "Provincia de Santa Cruz", "provincia de buenos aires": "Provincia de Buenos Aires",
    "municipalidad": "Municipalidad", "ministerio": "Ministerio", "policia": "Policía", "policía": "Policía",
}
PAYROLL_SIGNALS = ("haberes", "descuentos", "legajo", "jubilat", "recibo de sueldo", "recibo de haberes", "aportes personal", "cct ")
# Characters of the head, least characters of a concept, what is trimmed off it.
HEAD, LEAST_LABEL, LABEL_EDGES = 250, 3, " .:-"
UNKNOWN_ISSUER, BANK_PREFIX = "Desconocido", "Homebanking / "

_ITEM = "struct<concept: string, amount: double, raw: string, x1: double, x2: double>"


def _label(text: Column) -> Column:
    return F.btrim(text, F.lit(LABEL_EDGES))


def _texts(tokens: Column) -> Column:
    return F.array_join(F.transform(tokens, lambda t: t["text"]), " ")


def _item(concept: Column, amount: Column, raw: Column, tokens: Column) -> Column:
    return F.struct(concept.alias("concept"), amount.alias("amount"), F.trim(raw).alias("raw"), left_edge(tokens).alias("x1"), right_edge(tokens).alias("x2"))


def column_groups(tokens: Column, groups: Column) -> Column:
    """The tokens from left to right cut at their ``groups`` - 1 widest gaps, earlier gaps first among equals."""

    def cut(ordered: Column) -> Column:
        gaps = F.transform(F.sequence(F.lit(1), F.size(ordered) - 1), lambda k: F.struct((F.get(ordered, k - 1)["t"]["x2"] - F.get(ordered, k)["t"]["x1"]).alias("narrow"), k.alias("k")))
        widest = F.when(F.size(ordered) > 1, F.slice(F.array_sort(gaps), 1, groups - 1)).otherwise(F.array().cast("array<struct<narrow:double,k:int>>"))
        starts = F.array_sort(F.concat(F.array(F.lit(0)), F.transform(widest, lambda g: g["k"])))
        return let(starts, lambda s: F.transform(s, lambda a, i: F.transform(F.slice(ordered, a + 1, F.coalesce(F.get(s, i + 1), F.size(ordered)) - a), lambda o: o["t"])))

    return let(F.array_sort(F.transform(tokens, lambda t, i: F.struct(t["x1"].alias("x1"), i.alias("i"), t.alias("t")))), cut)


def _same_line(line: Column) -> Column:
    """The item of a line that ends in its amount, else null."""

    def read(raw: Column) -> Column:
        start = F.length(line["line_text"]) - F.length(raw)
        before = F.substring(line["line_text"], F.lit(1), start)
        span = F.struct(start.alias("start"), F.length(line["line_text"]).alias("stop"))

        def made(amount: Column) -> Column:
            ok = (raw != "") & ~F.rtrim(before).endswith("/") & plausible_amount(raw) & amount.isNotNull() & (F.length(_label(before)) >= LEAST_LABEL)
            return F.when(ok, _item(_label(before), amount, raw, covered(line["ts"], span)))

        return let(parse_amount(raw), made)

    return let(F.regexp_extract(line["line_text"], TRAILING_NUMBER, 0), read)


def _two_lines(line: Column) -> Column:
    """The items of a line of concepts above a line of as many values."""

    def paired(tokens: Column) -> Column:
        value = nearest_token(line["below"], left_edge(tokens), right_edge(tokens))

        def made(v: Column) -> Column:
            return F.when(F.length(_label(_texts(tokens))) >= LEAST_LABEL, let(parse_amount(v["text"]), lambda a: F.when(a.isNotNull(), _item(_label(_texts(tokens)), a, v["text"], F.array(v)))))

        return let(value, made)

    groups = F.size(line["below"])
    fits = line["line_text"].rlike(r"\p{L}") & (groups >= 2) & values_row(line["below"]) & (F.size(line["ts"]) >= groups)
    items = F.filter(F.transform(column_groups(line["ts"], groups), paired), lambda x: x.isNotNull())
    return F.when(fits, items).otherwise(F.array().cast(f"array<{_ITEM}>"))


def _read_items(line: Column) -> Column:
    """struct<items, takes>: what a line gives, and whether it takes the line below with it."""
    none = F.array().cast(f"array<{_ITEM}>")
    result = lambda items, takes: F.struct(items.alias("items"), F.coalesce(takes, F.lit(False)).alias("takes"))
    under = _texts(line["below"])
    label_only = (under != "") & ~under.rlike(r"\p{L}")

    def open_line(item: Column) -> Column:
        return F.when(item.isNotNull(), result(F.array(item), F.lit(False))).otherwise(let(_two_lines(line), lambda items: result(items, F.size(items) > 0)))

    return F.when(line["line_text"].rlike(IDENTITY_DASH), result(none, F.lit(False))).when(contains_any(F.lower(line["line_text"]), NOT_AN_ITEM), result(none, label_only)).otherwise(let(_same_line(line), open_line))


def line_items(lines: Column) -> Column:
    """array<struct<concept, amount, raw, x1, x2>> of a document from top to bottom.

    A line ends in its amount, or is a row of concepts above a row of values. Lines of identity
    data give nothing and take a bare value below with them, as a row of concepts does; a line
    that was taken is not read itself and takes nothing.
    """

    def kept(read: Column) -> Column:
        start = F.struct(F.lit(False).alias("taken"), F.array().cast("array<boolean>").alias("out"))
        taken = F.aggregate(read, start, lambda s, r: F.struct((~s["taken"] & r["takes"]).alias("taken"), F.concat(s["out"], F.array(s["taken"])).alias("out")), lambda s: s["out"])
        return let(taken, lambda gone: F.flatten(F.transform(F.filter(read, lambda r, i: ~F.get(gone, i)), lambda r: r["items"])))

    return let(F.transform(lines, _read_items), kept)


_ROW = "struct<concept: string, earnings: double, deductions: double>"


def concept_table(lines: Column) -> Column:
    """struct<detected, items, subtotal_earnings, subtotal_deductions, total> of a table with concept, earnings and deductions.

    The header's words give three zones. Rows go down to the line of the total, whose amount may
    stand below it. The last subtotal counts; a document without such a header has ``detected`` false.
    """

    def header(line: Column, i: Column) -> Column:
        words = F.struct(*(first_span(line["line_text"], p).alias(n) for n, p in (("c", CONCEPT), ("e", EARNINGS), ("d", DEDUCTIONS))))

        def edges(w: Column) -> Column:
            boxes = F.struct(right_edge(covered(line["ts"], w["c"])).alias("c2"), left_edge(covered(line["ts"], w["e"])).alias("e1"), right_edge(covered(line["ts"], w["e"])).alias("e2"), left_edge(covered(line["ts"], w["d"])).alias("d1"))
            return F.when(w["c"].isNotNull() & w["e"].isNotNull() & w["d"].isNotNull(), let(boxes, lambda b: F.struct(i.alias("i"), ((b["c2"] + b["e1"]) / 2).alias("first"), ((b["e2"] + b["d1"]) / 2).alias("second"))))

        return let(words, edges)

    def total_in(line: Column) -> Column:
        def read(span: Column) -> Column:
            rest = F.btrim(F.substring(line["line_text"], span["stop"] + 1, F.length(line["line_text"])), F.lit(" :-."))
            return F.when(span.isNotNull(), F.struct(F.coalesce(parse_amount(F.nullif(rest, F.lit(""))), parse_amount(_texts(line["below"]))).alias("amount")))

        return let(first_span(line["line_text"], TOTAL_PAID), read)

    def row(line: Column, h: Column) -> Column:
        middle = lambda t: (t["x1"] + t["x2"]) / 2
        zones = F.struct(
            _label(_texts(F.filter(line["ts"], lambda t: middle(t) < h["first"]))).alias("concept"),
            F.trim(_texts(F.filter(line["ts"], lambda t: (middle(t) >= h["first"]) & (middle(t) < h["second"])))).alias("e"),
            F.trim(_texts(F.filter(line["ts"], lambda t: (middle(t) >= h["first"]) & (middle(t) >= h["second"])))).alias("d"),
        )
        amount = lambda t: F.when((t != "") & (t != "-"), parse_amount(t))
        return let(zones, lambda z: F.struct(z["concept"].alias("concept"), amount(z["e"]).alias("earnings"), amount(z["d"]).alias("deductions")))

    def table(h: Column) -> Column:
        after = F.slice(lines, h["i"] + 2, F.greatest(F.size(lines), F.lit(1)))

        def body(rest: Column) -> Column:
            totals = F.filter(F.transform(rest, lambda x, k: F.struct(k.alias("k"), total_in(x).alias("t"))), lambda x: x["t"].isNotNull())

            def read(total: Column) -> Column:
                named = F.filter(F.transform(F.slice(rest, 1, F.coalesce(total["k"], F.size(rest))), lambda x: row(x, h)), lambda r: r["concept"] != "")

                def built(rows: Column) -> Column:
                    is_subtotal = lambda r: r["concept"].rlike(SUBTOTAL)
                    items = F.filter(rows, lambda r: ~is_subtotal(r) & (r["earnings"].isNotNull() | r["deductions"].isNotNull()))
                    last = F.try_element_at(F.filter(rows, is_subtotal), F.lit(-1))
                    return F.struct(F.lit(True).alias("detected"), items.alias("items"), last["earnings"].alias("subtotal_earnings"), last["deductions"].alias("subtotal_deductions"), total["t"]["amount"].alias("total"))

                return let(named, built)

            return let(F.get(totals, 0), read)

        empty = F.struct(F.lit(False).alias("detected"), F.array().cast(f"array<{_ROW}>").alias("items"), *(F.lit(None).cast("double").alias(n) for n in ("subtotal_earnings", "subtotal_deductions", "total")))
        return F.when(h.isNotNull(), let(after, body)).otherwise(empty)

    return let(F.get(F.filter(F.transform(lines, header), lambda h: h.isNotNull()), 0), table)


def issuer(text: Column, bank: Column) -> Column:
    """Who issued a document: a keyword of its head, else the bank unless the text speaks of pay, else unknown."""
    low = F.lower(F.coalesce(text, F.lit("")))
    head = F.substring(low, 1, HEAD)
    named = F.coalesce(*(F.when(F.contains(head, F.lit(k)), F.lit(v)) for k, v in ISSUERS.items()))
    banked = F.when(bank.isNotNull() & (bank != "") & ~contains_any(low, PAYROLL_SIGNALS), F.concat(F.lit(BANK_PREFIX), bank))
    return F.coalesce(named, banked, F.lit(UNKNOWN_ISSUER))


def pension_detail(lines: Column, holder: Column) -> Column:
    """struct of what a pension receipt carries: the benefit, its number, the holder and an agent with their tax numbers, the table."""
    first = lambda pattern, valid: F.get(column_values(lines, pattern, valid), 0)
    numbers = labelled_tax_numbers(lines)
    return let(numbers, lambda n: F.struct(
        first(BENEFIT_LABEL, looks_like_name).alias("benefit"), holder.alias("holder"), F.get(n, 0).alias("holder_tax_number"),
        first(BENEFIT_NUMBER_LABEL, lambda v: bare(v).rlike(BENEFIT_NUMBER)).alias("benefit_number"),
        first(AGENT_LABEL, looks_like_name).alias("agent"), F.get(n, 1).alias("agent_tax_number"), concept_table(lines).alias("table"),
    ))


#: Readers by issuer: what a template's receipts carry beyond the general fields.
TEMPLATES = {"ANSES": pension_detail}


def template_detail(issued_by: Column, lines: Column, holder: Column) -> Column:
    """The struct of the issuer's own reader; null for issuers without one."""
    return reduce(lambda found, name: found.when(issued_by == name, TEMPLATES[name](lines, holder)) if found is not None else F.when(issued_by == name, TEMPLATES[name](lines, holder)), TEMPLATES, None)
