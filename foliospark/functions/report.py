"""Results as the text of an audit report and as response records."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Wording of the report and of a response without fraud control.
TITLE, RULE = "INFORME DE AUDITORÍA — ", "=" * 50
NO_CONTROL = "Este tipo de documento no recibe control de fraude (solo categorización)."
REASON, EVIDENCE, ELA = "MOTIVO PRINCIPAL:", "EVIDENCIA (con aporte al scoring):", "CAMPOS SEÑALADOS POR ELA LOCAL:"
TYPOGRAPHY, CONSISTENCY = "CAMPOS SEÑALADOS POR TIPOGRAFÍA:", "CONSISTENCIA DEL RECIBO:"
CATEGORY_BAND, CATEGORY_LABEL, CATEGORY_EVIDENCE = "not_applicable", "Solo categorización", "Este tipo de documento no recibe control de fraude."


def _section(title: str, lines: Column) -> Column:
    """A title, its lines and an empty line; nothing without lines."""
    return F.when(F.coalesce(F.size(lines), F.lit(0)) > 0, F.concat(F.array(F.lit(title)), lines, F.array(F.lit("")))).otherwise(F.array().cast("array<string>"))


def audit_report(file_name: Column, document_type: Column, confidence: Column, route: Column, score: Column, risk_label: Column, total_seconds: Column, reason: Column, evidence: Column, ela_fields: Column, typography_fields: Column, signals: Column) -> Column:
    """The report as one string. Half ties of printed numbers round away from zero.

    ``evidence`` is array<struct<text, contribution>>, ``ela_fields`` array<struct<text,
    max_difference, z>> and ``typography_fields`` array<struct<text, feature, z>>. Null or empty
    parts are left out; routes without fraud control end after the route.
    """
    head = F.array(F.concat(F.lit(TITLE), file_name), F.lit(RULE), F.format_string("Tipo de documento: %s (%.1f%%)", document_type, confidence.cast("double")), F.concat(F.lit("Ruta de análisis: "), route))
    points = F.when(score.isNotNull(), F.format_string("%.1f/100", score.cast("double"))).otherwise("N/A")
    verdict = F.filter(
        F.array(F.concat(F.lit("Score de sospecha: "), points, F.lit(" — "), F.coalesce(risk_label, F.lit("N/A"))), F.when(total_seconds.isNotNull(), F.format_string("Tiempo total de análisis: %.2fs", total_seconds.cast("double"))), F.lit("")),
        lambda x: x.isNotNull(),
    )
    item = lambda e: F.filter(F.array(F.concat(F.lit("  - "), e["text"]), F.concat(F.lit("      ↳ "), F.nullif(e["contribution"], F.lit("")))), lambda x: x.isNotNull())
    shown = lambda z: F.coalesce(z.cast("string"), F.lit("None"))
    parts = [
        _section(REASON, F.when(F.length(reason) > 0, F.array(F.concat(F.lit("  "), reason)))),
        _section(EVIDENCE, F.flatten(F.transform(evidence, item))),
        _section(ELA, F.transform(ela_fields, lambda f: F.concat(F.lit("  - '"), f["text"], F.lit("' (diff="), f["max_difference"].cast("string"), F.lit(", z relativo="), shown(f["z"]), F.lit(")")))),
        _section(TYPOGRAPHY, F.transform(typography_fields, lambda f: F.concat(F.lit("  - '"), f["text"], F.lit("' — señal dominante: "), f["feature"], F.lit(" (z="), shown(f["z"]), F.lit(")")))),
        _section(CONSISTENCY, F.transform(signals, lambda s: F.concat(F.lit("  - "), s))),
    ]
    body = F.when(route == "receipt_control", F.concat(head, verdict, *parts)).otherwise(F.concat(head, F.array(F.lit(NO_CONTROL))))
    return F.regexp_replace(F.array_join(body, "\n"), r"\s+$", "")


def response(file_name: Column, document_type: Column, confidence: Column, route: Column, score: Column, band: Column, label: Column, components: Column, evidence: Column) -> Column:
    """The response record; documents that only get a category have no score or components."""
    control = route == "receipt_control"
    decision = F.struct(
        F.when(control, score).alias("score"),
        F.when(control, band).otherwise(CATEGORY_BAND).alias("risk_band"),
        F.when(control, label).otherwise(CATEGORY_LABEL).alias("risk_label"),
        F.when(control, components).otherwise(F.create_map().cast("map<string,double>")).alias("component_scores"),
        F.when(control, evidence).otherwise(F.array(F.lit(CATEGORY_EVIDENCE))).alias("evidence"),
    )
    mode = F.when(control, "receipt-control").otherwise("category-only")
    diagnostics = F.struct(file_name.alias("file_name"), mode.alias("validation_mode"))
    return F.struct(F.lit("success").alias("status"), route.alias("analysis_route"), F.coalesce(document_type, F.lit("unknown")).alias("document_type"), F.coalesce(confidence, F.lit(0.0)).alias("document_type_confidence"), decision.alias("final_decision"), diagnostics.alias("diagnostics"))
