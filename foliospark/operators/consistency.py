"""Whether the amounts and periods that a receipt states agree with each other."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from foliospark.functions.arrays import let
from foliospark.functions.receipt import AMOUNT_LABELS, amount_after, period_score, period_signal, periods
from foliospark.functions.scores import difference_points, difference_tier
from foliospark.operators.candidates import LABEL_HINTS, contains_any
from foliospark.operators.labelled import amount_below

# Names of the amounts in signals, and the mean confidence from which a missing amount is odd.
SHOWN = {"total_haberes": "Total Haberes", "total_descuentos": "Total Descuentos", "neto": "Neto", "neto_a_cobrar": "Neto a Cobrar", "liquido": "Líquido"}
GOOD_READING = 65.0
# How far apart amounts may be, as a share and at least.
RATIO, LEAST = 0.015, 1.0
# Amounts that are enough to judge a receipt, and the most points.
ENOUGH, MOST = 3, 4

_DIFFERENCE = "array<struct<label: string, expected: double, observed: double, delta: double, tolerance: double>>"


def _difference(label: str, expected: Column, observed: Column) -> Column:
    """struct<points, signal, found> of two amounts; null unless both are there."""
    delta = F.abs(expected - observed)
    shown = F.format_string("%.2f", delta)
    tolerance = F.greatest(F.lit(LEAST), F.abs(expected) * RATIO)
    entry = F.struct(F.lit(label).alias("label"), expected.alias("expected"), observed.alias("observed"), delta.alias("delta"), tolerance.alias("tolerance"))

    def told(tier: Column) -> Column:
        text = F.when(tier == "unreliable", F.lit(f"{label}: no se pudo comparar de forma confiable (posible error de lectura de OCR)."))
        text = text.when(tier == "ok", F.concat(F.lit(f"{label} consistente (delta "), shown, F.lit(").")))
        text = text.when(tier == "leve", F.concat(F.lit(f"{label} con diferencia leve (delta "), shown, F.lit(").")))
        text = text.otherwise(F.concat(F.lit(f"{label} inconsistente (delta "), shown, F.lit(").")))
        return F.when(tier.isNotNull(), F.struct(difference_points(tier).alias("points"), text.alias("signal"), F.when(tier != "unreliable", entry).alias("found")))

    return let(difference_tier(expected, observed, RATIO, LEAST), told)


def receipt_consistency(text: Column, confidence: Column, lines: Column, second_reading: Mapping[str, Column] | None = None) -> Column:
    """struct<detected, consistency_score, signals, values, expected_net, differences, periods, unreadable>.

    Every amount is looked for behind its label, then below it as a column, then in
    ``second_reading`` (amounts by field, from a reader's second pass). A label without an amount
    is a signal, a stronger one where the document is read well. Stated amounts and periods are
    compared; 0 to MOST points. A null or empty text, or one without any label, is not a receipt.
    """
    text = F.coalesce(text, F.lit(""))
    second = second_reading or {}

    def amount(name: str) -> Column:
        def read(a: Column) -> Column:
            more = [amount_below(lines, AMOUNT_LABELS[name])["amount"], *([second[name]] if name in second else [])]
            value = F.when(a["value"].isNotNull(), a["value"]).when(a["found"], F.coalesce(*more))
            return F.struct(value.alias("value"), a["found"].alias("found"))

        return let(amount_after(text, AMOUNT_LABELS[name]), read)

    def judged(x: Column) -> Column:
        value = {n: x[n]["value"] for n in AMOUNT_LABELS}
        expected = value["total_haberes"] - value["total_descuentos"]
        missing = lambda n: x[n]["found"] & value[n].isNull()
        well = F.coalesce(confidence, F.lit(0.0)) >= GOOD_READING
        unread = lambda n: F.when(missing(n), F.when(well, F.concat(F.lit(f"Se encontró la etiqueta '{SHOWN[n]}' pero no se pudo leer su monto, pese a que el resto del documento se lee con buena confianza ("), F.format_string("%.1f", confidence), F.lit("%) — posible fuente sustituida deliberadamente, revisar manualmente."))).otherwise(F.lit(f"Se encontró la etiqueta '{SHOWN[n]}' pero no se pudo leer su monto — revisar manualmente.")))
        compared = F.filter(
            F.array(_difference("neto_vs_haberes_menos_descuentos", expected, value["neto"]), _difference("neto_vs_neto_a_cobrar", value["neto"], value["neto_a_cobrar"]), _difference("neto_vs_liquido", value["neto"], value["liquido"])),
            lambda d: d.isNotNull(),
        )
        state = F.struct(compared.alias("d"), periods(text).alias("p"), F.filter(F.array(*(F.when(missing(n), F.lit(n)) for n in AMOUNT_LABELS)), lambda n: n.isNotNull()).alias("gone"))

        def result(s: Column) -> Column:
            found = F.filter(F.transform(s["d"], lambda d: d["found"]), lambda d: d.isNotNull())
            one = lambda c: c.cast("int")
            stated = sum((one(v.isNotNull()) for v in value.values()), one(expected.isNotNull())) + one(F.size(found) > 0)
            gone = F.size(s["gone"]) * F.when(well, 2).otherwise(1)
            points = gone + F.aggregate(s["d"], F.lit(0), lambda a, d: a + d["points"]) + one(stated >= ENOUGH) + period_score(s["p"])
            any_field = (stated > 0) | (F.size(s["p"]) > 0)
            signals = F.concat(
                F.array(*(unread(n) for n in AMOUNT_LABELS)), F.transform(s["d"], lambda d: d["signal"]),
                F.array(F.when(stated >= ENOUGH, F.lit("Se detectaron suficientes montos clave para validar el recibo.")), period_signal(s["p"]), F.when((points == 0) & any_field, F.lit("Montos clave coherentes en la muestra OCR."))),
            )
            return F.struct(
                any_field.alias("detected"), F.least(points, F.lit(MOST)).alias("consistency_score"), F.filter(signals, lambda t: t.isNotNull()).alias("signals"), F.struct(*(value[n].alias(n) for n in AMOUNT_LABELS)).alias("values"),
                expected.alias("expected_net"), found.cast(_DIFFERENCE).alias("differences"), s["p"].alias("periods"), F.when(well, s["gone"]).otherwise(F.array().cast("array<string>")).alias("unreadable"),
            )

        return let(state, result)

    whole = let(F.struct(*(amount(n).alias(n) for n in AMOUNT_LABELS)), judged)
    none = F.struct(
        F.lit(False).alias("detected"), F.lit(0).alias("consistency_score"), F.array().cast("array<string>").alias("signals"), F.struct(*(F.lit(None).cast("double").alias(n) for n in AMOUNT_LABELS)).alias("values"), F.lit(None).cast("double").alias("expected_net"),
        F.array().cast(_DIFFERENCE).alias("differences"), F.slice(periods(F.lit("")), 1, 0).alias("periods"), F.array().cast("array<string>").alias("unreadable"),
    )
    return F.when(contains_any(F.lower(text), LABEL_HINTS), whole).otherwise(none)
