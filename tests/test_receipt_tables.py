"""Receipts as tokens with the results that their readers must give."""

import pytest
from pyspark.sql import functions as F

from foliospark.operators import labelled, receipt_tables as tables


def frame(spark, docs):
    """Documents as lists of lines; a line is a list of (text, x1, x2)."""
    rows = [(d, n, i, t, a, b, n * 24) for d, lines in enumerate(docs) for n, line in enumerate(lines) for i, (t, a, b) in enumerate(line)]
    tokens = spark.createDataFrame(rows, "doc int, line int, idx int, token string, x1 int, x2 int, top int").repartition(3)
    return labelled.receipts(labelled.token_lines(tokens, "doc", "line", "idx", "token", "x1", "x2", "top"), "doc")


def words(text, x=0):
    out = []
    for w in text.split():
        out.append((w, x, x + 8 * len(w)))
        x += 8 * len(w) + 6
    return out


ITEMS = [
    (["301 ASIGNACION POR CARGO: 506029.27"], [("301 ASIGNACION POR CARGO", 506029.27)]),
    (["301 ASIGNACION POR CARGO 506029 . 27"], [("301 ASIGNACION POR CARGO", 506029.27)]),  # decimals split over tokens
    (["Sueldo 19032 34,783.45"], [("Sueldo 19032", 34783.45)]),
    (["CUIL 20-11111111-2"], []),
    (["Codigo 20-11111111-2"], []),
    (["FECHA PROX. COBRO DESDE: 13/08/2026"], []),
    (["Codigo 301"], []),
    (["ab 1.000,00"], []),
    (["Periodo", "06/2026", "Basico 1.500,00"], [("Basico", 1500.0)]),
    (["Concepto", "HABER MENSUAL $552.322,59"], [("HABER MENSUAL", 552322.59)]),
    (["nota 123456789012"], [("nota", 123456789012.0)]),
    (["Descuento -99,50"], [("Descuento", -99.5)]),
    (["Total (1,00)"], [("Total", -1.0)]),
    ([], []),
]


def test_items_on_one_line(spark):
    got = {r.doc: r["items"] for r in frame(spark, [[words(t) for t in lines] for lines, _ in ITEMS]).select("doc", tables.line_items(F.col("lines")).alias("items")).collect()}
    for d, (lines, want) in enumerate(ITEMS):
        found = [(i.concept, i.amount) for i in got.get(d, [])]
        assert found == want, lines


def test_items_in_two_lines(spark):
    head = [("Haberes", 40, 120), ("Retenciones", 300, 420)]
    values = [("500,00", 50, 110), ("80,00", 310, 370)]
    wide = [("R.", 0, 20), ("con", 25, 50), ("Aportes", 55, 110), ("Salario", 300, 350), ("Familiar", 355, 420)]
    below = [("1.000,00", 20, 90), ("nada", 330, 390)]
    docs = [[head, values], [head, values, values], [wide, below], [head, [("x", 50, 60), ("y", 310, 320)]], [head, [("9,00", 900, 940), ("8,00", 1000, 1040)]], [head[:1], values]]
    got = {r.doc: [(i.concept, i.amount, i.x1) for i in r["items"]] for r in frame(spark, docs).select("doc", tables.line_items(F.col("lines")).alias("items")).collect()}
    assert got[0] == [("Haberes", 500.0, 50.0), ("Retenciones", 80.0, 310.0)]
    # The second row of values is no longer taken and reads for itself: its label is too short to be kept.
    assert got[1][:2] == got[0] and len(got[1]) == 3 and got[1][2][0] == "500,00"
    assert got[2] == [("R. con Aportes", 1000.0, 20.0)]
    assert got[3] == []
    # Values too far off, or more of them than words above: the row of values reads for itself.
    assert got[4] == [("9,00", 8.0, 1000.0)] and got[5] == [("500,00", 80.0, 310.0)]


HEADER = [("Concepto", 0, 80), ("Haberes", 200, 260), ("Deducciones", 400, 500)]


def test_concept_table(spark):
    docs = [
        [words("ANSES"), HEADER, [("HABER", 0, 40), ("MENSUAL", 45, 100), ("1.000,00", 200, 260)], [("Obra", 0, 40), ("social:", 45, 90), ("-", 220, 225), ("100,50", 420, 480)], [("sin", 0, 30), ("monto", 35, 80)], [("Subtotal", 0, 70), ("1.000,00", 200, 260), ("100,50", 420, 480)], [("Total", 0, 40), ("a", 45, 50), ("cobrar", 55, 100), ("$", 200, 205), ("899,50", 210, 260)], [("Otro", 0, 40), ("9,00", 200, 240)]],
        [HEADER, [("Total", 0, 40), ("a", 45, 50), ("cobrar:", 55, 100)], [("77,00", 210, 260)]],
        [HEADER, [("7,00", 200, 240)], [("Plus", 0, 40), ("5,00", 200, 240)]],
        [words("nada de tabla"), words("Total a cobrar 5,00")],
    ]
    got = {r.doc: r.t for r in frame(spark, docs).select("doc", tables.concept_table(F.col("lines")).alias("t")).collect()}
    assert [tuple(i) for i in got[0]["items"]] == [("HABER MENSUAL", 1000.0, None), ("Obra social", None, 100.5)]
    assert (got[0].detected, got[0].subtotal_earnings, got[0].subtotal_deductions, got[0].total) == (True, 1000.0, 100.5, 899.5)
    assert (got[1].detected, got[1]["items"], got[1].total) == (True, [], 77.0)
    assert ([tuple(i) for i in got[2]["items"]], got[2].total) == ([("Plus", 5.0, None)], None)
    assert (got[3].detected, got[3].total) == (False, None)


def test_detail_by_issuer(spark):
    docs = [
        [words("ANSES recibo"), [("Prestación", 0, 80), ("Titular", 200, 260), ("CUIL", 400, 440)], [("JUBILACION", 0, 90), ("ANA", 200, 230), ("SOSA", 235, 270), ("20-11111111-2", 400, 500)],
         [("N°", 0, 10), ("de", 15, 30), ("beneficio", 35, 90), ("Persona", 200, 250), ("apoderada", 255, 320), ("CUIL", 400, 440)], [("15", 0, 20), ("0123456", 25, 80), ("EVA", 200, 230), ("RUIZ", 235, 270), ("27222222223", 400, 500)], HEADER, [("Haber", 0, 40), ("10,00", 200, 250)]],
        [words("Municipalidad")],
    ]
    rows = frame(spark, docs).select("doc", F.when(F.col("doc") == 0, "ANSES").otherwise("Municipalidad").alias("by"), "lines")
    got = {r.doc: r.t for r in rows.select("doc", tables.template_detail(F.col("by"), F.col("lines"), labelled.person_name(F.col("lines"))).alias("t")).collect()}
    t = got[0]
    assert (t.benefit, t.holder, t.holder_tax_number, t.benefit_number, t.agent, t.agent_tax_number) == ("JUBILACION", "ANA SOSA", "20-11111111-2", "15 0123456", "EVA RUIZ", "27222222223")
    assert t.table.detected and len(t.table["items"]) == 1 and got[1] is None


@pytest.mark.parametrize(
    ("text", "bank", "want"),
    [("ANSES recibo", "Galicia", "ANSES"), ("x" * 250 + " anses", None, "Desconocido"), ("Policía de x", None, "Policía"), ("transferencia GALICIA", "Galicia", "Homebanking / Galicia"), ("total haberes GALICIA", "Galicia", "Desconocido"), (None, None, "Desconocido"), ("Provincia de Santa Cruz Ministerio", None, "Provincia de Santa Cruz")],
)
def test_issuer(spark, text, bank, want):
    assert spark.createDataFrame([(text, bank)], "t string, b string").select(tables.issuer(F.col("t"), F.col("b"))).first()[0] == want
