import random

import duckdb
import pytest
from pyspark.sql import functions as F

from foliospark.functions.numbers import half_even, one_decimal
from foliospark.functions.report import audit_report
from foliospark.plans import triage_queries
from foliospark.plans.triage import triage
from tests.test_forensic import rows


@pytest.mark.parametrize("sf", ["0.001", "0.01"])
def test_query_equals_sql(spark, sf):
    con = duckdb.connect()
    folder = f"/root/testdata/sf{sf}"
    for t in ("lineitem", "orders"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    got, want = triage_queries.q50_triage(spark, folder).toPandas(), con.execute(triage_queries.Q50).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert len(got) and rows(got) == rows(want)


def test_rounding_is_python_s(spark):
    rng = random.Random(7)
    values = [k / 1000 for k in range(3000)] + [k / 8 for k in range(900)] + [k / 40 + 0.005 for k in range(500)] + [rng.random() * 10**e for e in range(-3, 6) for _ in range(300)]
    values += [-v for v in values[::7]]
    got = spark.createDataFrame([(v,) for v in values], "v double").select("v", half_even(F.col("v"), 1).alias("a"), half_even(F.col("v"), 2).alias("b"), one_decimal(F.abs("v")).alias("s"), one_decimal(F.abs("v"), signed=True).alias("p")).collect()
    for r in got:
        assert (r.a, r.b, r.s, r.p) == (round(r.v, 1), round(r.v, 2), f"{abs(r.v):.1f}", f"{abs(r.v):+.1f}"), r.v


DOCS = "doc long, photo boolean, page_level int, mean_confidence double, ocr_points int, ocr_signals array<string>, metadata_points int, metadata_signals array<string>, consistency_points int, consistency_signals array<string>, unreadable_labels array<string>"
REGIONS = "doc long, ord int, text string, cx double, cy double, level int, is_key boolean, highlighted boolean"
FIELDS = "doc long, bucket string, ord int, text string, cx double, cy double, is_key boolean, shape_reliable boolean, height double, ink_ratio double, slant_angle double, aspect_ratio double"


def run(spark, docs, regions=(), fields=()):
    frames = (spark.createDataFrame(list(r), s) for r, s in ((docs, DOCS), (regions, REGIONS), (fields, FIELDS)))
    return triage(*frames, "doc")


def test_edited_amount_in_words(spark):
    regions = [(1, k, f"{k}00", 10.0 * k, 5.0, 50 if k == 3 else 2, True, False) for k in range(8)]
    fields = [(1, "amounts", k, f"{k}00", 10.0 * k, 5.0, True, True, 60.0 if k == 3 else 12.0, 0.9 if k == 3 else 0.3, 0.0, 0.5) for k in range(8)]
    doc = (1, False, 0, 80.0, 0, None, 0, ["a", "a", "b"], 0, [], None)
    out = run(spark, [doc], regions, fields)
    r = out.first()
    assert (r.score, r.risk_label, r.local_ela, r.key_ela_hits, r.corroborated_text) == (75.0, "Altamente sospechoso", 100.0, 1, "300")
    assert r.primary_reason == "Posible edición confirmada en campo clave: '300' (ELA local + tipografía coinciden)."
    # 0.59 * 100 + 0.10 * 35
    assert [tuple(e) for e in r.evidence] == [
        (r.primary_reason, "piso aplicado: 75 (score ponderado base era 62.5)"),
        ("Tipografía marcadamente distinta en campo clave: altura de letra distinta en '300' (z-score 32.38). Patrón típico de sustitución de fuente/caligrafía sin rastro de compresión JPEG que ELA pueda corroborar.", "piso de 35 no fue el determinante (score final ya es 75.0)"),
        ("Anomalía de ELA local en un campo clave coincide con otra inconsistencia del documento (lógica, tipográfica, o una fuente que no se puede leer): la medición de píxeles, que no depende del OCR, corrobora una señal independiente — fuerte indicio de que algo fue modificado.", "piso de 65 no fue el determinante (score final ya es 75.0)"),
        ("Revisión prioritaria recomendada.", "informativo (refleja la banda final, no aporta puntos propios)"),
        ("Anomalía localizada fuerte en texto o números críticos.", "incluido en componente 'local_ela': +59.0 pts (59% × 100.0)"),
        ("Anomalía ELA detectada en un campo clave (fecha o monto).", "incluido en componente 'local_ela': +59.0 pts (59% × 100.0)"),
        ("Altura de letra distinta en '300' (z-score 32.38) en campo clave.", "incluido en componente 'typography': +3.5 pts (10% × 35.0)"),
        ("a", "informativo (metadata no pesa en el score)"),
    ]
    odd = F.transform("odd", lambda f: F.struct(f["text"].alias("text"), f["dominant_feature"].alias("feature"), f["max_abs_z"].alias("z")))
    ela = F.transform("ela_fields", lambda f: F.struct(f["text"].alias("text"), f["level"].alias("max_difference"), f["z"].alias("z")))
    report = out.select(audit_report(F.lit("r.jpg"), F.lit("recibo"), F.lit(90.0), F.lit("receipt_control"), F.col("score"), F.col("risk_label"), F.lit(None).cast("double"), F.col("primary_reason"), F.col("evidence"), ela, odd, F.col("consistency_signals"))).first()[0]
    assert "Score de sospecha: 75.0/100 — Altamente sospechoso" in report and "  - '300' (diff=50, z relativo=32.38)" in report and "señal dominante: height (z=32.38)" in report


def test_fields_elsewhere_are_not_corroborated(spark):
    regions = [(1, k, "x", 10.0 * k, 5.0, 50 if k == 3 else 2, True, False) for k in range(8)]
    fields = [(1, "amounts", k, "x", 10.0 * k, 5.0, True, True, 60.0 if k == 6 else 12.0, 0.9 if k == 6 else 0.3, 0.0, 0.5) for k in range(8)]
    r = run(spark, [(1, True, None, None, None, None, None, None, None, None, [])], regions, fields).first()
    assert (r.score, r.corroborated, r.corroborated_text, r.key_typography_hits) == (65.0, False, None, 1)


def test_nothing_and_odd_inputs(spark):
    empty = (1, None, None, None, None, None, None, None, None, None, None)
    full = (2, False, 60, 44.25, 4, ["o1", "o2", "o3"], 4, None, 1, None, ["Neto", "Total"])
    out = {r.doc: r for r in run(spark, [empty, full], [(3, 0, "lost", 0.0, 0.0, 90, True, False), (1, 0, None, None, None, None, None, None)]).collect()}
    assert (out[1].score, out[1].primary_reason) == (0.0, "Sin señales de peso relevante detectadas.")
    assert [e.text for e in out[1].evidence] == ["Sin señales fuertes de fraude."]
    assert (out[2].score, out[2].primary_reason[:40]) == (50.0, "No se pudo leer el monto de 'Neto, Total")
    assert [e.text for e in out[2].evidence][1:] == ["Revisión humana sugerida.", "OCR con confianza media baja (44.2%).", "Posible inconsistencia leve entre montos del recibo.", "o1", "o2"]
    assert sorted(out) == [1, 2] and run(spark, []).collect() == []
