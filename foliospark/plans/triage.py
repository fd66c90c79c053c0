"""From the tables of all readers to a worded verdict for each document, as one batch graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.functions import scores
from foliospark.functions.arrays import let
from foliospark.functions.numbers import half_even, one_decimal
from foliospark.operators.layout import SAME_FIELD
from foliospark.operators.ranking import DISCOUNTS
from foliospark.operators.robust import relative_calibration
from foliospark.operators.typography import describe_field, odd_fields, typography_outliers
from foliospark.plans.decision import FLOORS, WEIGHTS, base_score, decide, final_score, winning_component, with_signals

# Error levels above which a region and a page are anomalous, and the least mean confidence that needs no mention.
REGION_LEVEL, PAGE_LEVEL, LOW_CONFIDENCE = 20, 35, 45.0
# Wording of levels, evidence and reasons.
LABELS = {"altamente_sospechoso": "Altamente sospechoso", "sospechoso": "Sospechoso", "poco_sospechoso": "Poco sospechoso"}
LEVELS = {"altamente_sospechoso": "Revisión prioritaria recomendada.", "sospechoso": "Revisión humana sugerida.", "poco_sospechoso": "Sin señales fuertes de fraude."}
CORROBORATED = ("Posible edición confirmada en campo clave: '", "' (ELA local + tipografía coinciden).")
STRONG_TYPOGRAPHY = ("Tipografía marcadamente distinta en campo clave: ", ". Patrón típico de sustitución de fuente/caligrafía sin rastro de compresión JPEG que ELA pueda corroborar.")
ELA_PLUS_OTHER = "Anomalía de ELA local en un campo clave coincide con otra inconsistencia del documento (lógica, tipográfica, o una fuente que no se puede leer): la medición de píxeles, que no depende del OCR, corrobora una señal independiente — fuerte indicio de que algo fue modificado."
STRONG_ELA = "Múltiples campos clave con anomalía de ELA local, sin necesitar otra corroboración: la medición de píxeles por sí sola, en más de un campo, ya es un indicio fuerte de edición."
CROSS_FAMILY = "Inconsistencia lógica (período o aritmética) coincide con una anomalía de tipografía en un campo clave (sin corroboración de ELA)."
UNREADABLE = ("No se pudo leer el monto de '", "' pese a que el resto del documento se lee con buena confianza — posible fuente sustituida deliberadamente, no una falla genérica de OCR.")
APPLIED, NOT_DECISIVE = "piso aplicado: %d (score ponderado base era %s)", "piso de %d no fue el determinante (score final ya es %s)"
INCLUDED = "incluido en componente '%s': %s pts (%d%% × %s)"
LEVEL_NOTE, METADATA_NOTE = "informativo (refleja la banda final, no aporta puntos propios)", "informativo (metadata no pesa en el score)"
LOCAL_STRONG, LOCAL_SOME = "Anomalía localizada fuerte en texto o números críticos.", "Variación localizada compatible con edición."
KEY_MANY, KEY_ONE = "Múltiples anomalías ELA en campos clave (fechas/montos).", "Anomalía ELA detectada en un campo clave (fecha o monto)."
IN_KEY_FIELD, LOW_READING = " en campo clave.", "OCR con confianza media baja (%s%%)."
ARITHMETIC, ARITHMETIC_SLIGHT = "Inconsistencia aritmética en montos del recibo.", "Posible inconsistencia leve entre montos del recibo."
NO_REASON = "Sin señales de peso relevante detectadas."
REASON = ("Motivo principal: ", " (mayor peso en el score).")
REASON_LOCAL, NO_TEXT = ("anomalía ELA en el campo '", "'"), "sin identificar"
REASON_DEFAULTS = {"receipt_consistency": "inconsistencia en montos del recibo", "ocr": "baja calidad de lectura OCR", "metadata": "señales de metadatos", "global_ela": "anomalía de compresión JPEG generalizada en la imagen"}
#: Signals of a reader that are shown.
SHOWN_SIGNALS = 2


def worded(docs: DataFrame) -> DataFrame:
    """Documents after ``decide`` with risk_label, evidence array<struct<text, contribution>> and primary_reason in words.

    Besides what ``decide`` reads it needs corroborated_text, strong_key, first_key and first_odd
    (as from ``odd_fields``), top_text, unreadable_labels (array<string>), mean_confidence, and the arrays
    metadata_signals, ocr_signals and consistency_signals. Null parts, and empty arrays, say
    nothing; a text is listed once, with its first contribution.
    """
    final = F.col("__final")

    def of_floor(name: str) -> Column:
        applied = F.format_string(APPLIED, F.lit(int(FLOORS[name])), F.col("__base_text"))
        return F.when(F.abs(final - FLOORS[name]) < 1e-6, applied).otherwise(F.format_string(NOT_DECISIVE, F.lit(int(FLOORS[name])), F.col("__final_text")))

    def of_component(name: str) -> Column:
        return F.col(f"__{name}_text")

    def made(name: str) -> Column:
        points = one_decimal(half_even(F.lit(WEIGHTS[name]) * F.col(name), 2), signed=True)
        return F.format_string(INCLUDED, F.lit(name), points, F.lit(round(WEIGHTS[name] * 100)), one_decimal(F.col(name)))

    def around(ends: tuple[str, str], value: Column) -> Column:
        return F.concat(F.lit(ends[0]), value, F.lit(ends[1]))

    def first_upper(value: Column) -> Column:
        return F.concat(F.upper(F.substring(value, 1, 1)), F.lower(F.substr(value, F.lit(2))))

    band = scores.risk_band(final)
    named = lambda words: F.coalesce(*(F.when(band == k, F.lit(v)) for k, v in words.items()))
    floors = {
        "corroborated": around(CORROBORATED, F.coalesce("corroborated_text", F.lit(""))),
        "strong_typography": around(STRONG_TYPOGRAPHY, describe_field(F.col("strong_key"))),
        "ela_plus_other": F.lit(ELA_PLUS_OTHER),
        "strong_ela_alone": F.lit(STRONG_ELA),
        "cross_family": F.lit(CROSS_FAMILY),
        "unreadable": around(UNREADABLE, F.array_join("unreadable_labels", ", ")),
    }
    messages = {k: F.when(F.col(k), v) for k, v in floors.items()}
    lines = [(messages[k], of_floor(k)) for k in messages]
    lines += [
        (named(LEVELS), F.lit(LEVEL_NOTE)),
        (F.when(F.col("local_ela") >= 70, LOCAL_STRONG).when(F.col("local_ela") >= 40, LOCAL_SOME), of_component("local_ela")),
        (F.when(F.col("key_ela_hits") >= 2, KEY_MANY).when(F.col("key_ela_hits") == 1, KEY_ONE), of_component("local_ela")),
        (F.concat(first_upper(describe_field(F.col("first_key"))), F.lit(IN_KEY_FIELD)), of_component("typography")),
        (F.when((F.col("mean_confidence") != 0) & (F.col("mean_confidence") < LOW_CONFIDENCE), F.format_string(LOW_READING, one_decimal(F.col("mean_confidence")))), of_component("ocr")),
        (F.when(F.col("consistency_points") >= 3, ARITHMETIC).when(F.col("consistency_points") >= 1, ARITHMETIC_SLIGHT), of_component("receipt_consistency")),
    ]
    for signals, note in (("metadata_signals", F.lit(METADATA_NOTE)), ("ocr_signals", of_component("ocr")), ("consistency_signals", of_component("receipt_consistency"))):
        lines += [(F.get(F.col(signals), k), note) for k in range(SHOWN_SIGNALS)]
    listed = F.filter(F.array(*(F.struct(t.alias("text"), c.alias("contribution")) for t, c in lines)), lambda e: e["text"].isNotNull())

    causes = {
        "local_ela": around(REASON_LOCAL, F.coalesce(F.nullif("top_text", F.lit("")), F.lit(NO_TEXT))),
        "typography": describe_field(F.coalesce("first_key", "first_odd")),
        "receipt_consistency": F.coalesce(F.get("consistency_signals", 0), F.lit(REASON_DEFAULTS["receipt_consistency"])),
        "ocr": F.coalesce(F.get("ocr_signals", 0), F.lit(REASON_DEFAULTS["ocr"])),
        "metadata": F.coalesce(F.get("metadata_signals", 0), F.lit(REASON_DEFAULTS["metadata"])),
        "global_ela": F.lit(REASON_DEFAULTS["global_ela"]),
    }
    winner = winning_component()
    cause = F.coalesce(*(F.when(winner == k, around(REASON, v)) for k, v in causes.items()), F.lit(NO_REASON))
    reason = F.coalesce(*(messages[k] for k in FLOORS), cause)
    notes = {f"__{k}_text": made(k) for k in ("local_ela", "typography", "ocr", "receipt_consistency")} | {"__base_text": one_decimal(base_score()), "__final_text": one_decimal(final)}
    out = docs.withColumn("__final", final_score()).withColumns(notes).withColumns({"risk_label": named(LABELS), "evidence": listed, "primary_reason": reason}).drop("__final", *notes)
    once = lambda texts: F.filter("evidence", lambda e, i: F.array_position(texts, e["text"]) == i + 1)
    return out.withColumn("evidence", let(F.transform("evidence", lambda e: e["text"]), once))


def triage(documents: DataFrame, regions: DataFrame, fields: DataFrame, doc: str) -> DataFrame:
    """``documents`` with components, signals, score, risk_band, risk_label, evidence, primary_reason, ela_fields and odd.

    ``documents``: doc, photo, page_level, mean_confidence, ocr_points, ocr_signals,
    metadata_points, metadata_signals, consistency_points, consistency_signals, unreadable_labels.
    ``regions``: doc, ord (an integer, unique in a document), text, cx, cy, level, is_key,
    highlighted. ``fields``: doc, bucket, ord, text, cx, cy, is_key, shape_reliable and the
    typography features. Documents without regions or fields get no points for them; null numbers
    count as 0. Everything is grouped and joined on ``doc`` alone; a document's regions and fields
    (200 at most, as ranked candidates are) meet as arrays of its row.
    """
    marked = regions.withColumn("anomaly", F.coalesce(F.col("level") > REGION_LEVEL, F.lit(False))).withColumn("is_key", F.coalesce("is_key", F.lit(False)))
    measured = relative_calibration(marked, doc, "level", ["ord"], "anomaly", F.col("highlighted"))
    measured = measured.withColumn("points", scores.region_error_score(F.col("level"), F.col("anomaly"), F.col("is_key")))
    region = F.struct((-F.col("points")).alias("less"), "ord", "text", "points")
    field = F.struct("ord", "text", "level", F.round("z", 2).alias("z"))
    hit = F.col("anomaly") & F.col("is_key")
    local = measured.groupBy(doc).agg(
        F.sort_array(F.collect_list(F.when(F.col("points") > 0, region))).alias("ranked"),
        F.sort_array(F.collect_list(F.when(F.col("anomaly"), field))).alias("ela_fields"),
        F.sort_array(F.collect_list(F.when(hit, F.struct("ord", "text", "cx", "cy")))).alias("hits"),
    )
    places = [F.coalesce(F.get("ranked", k)["points"], F.lit(0.0)) * w for k, w in enumerate(DISCOUNTS)]
    local = local.select(doc, scores.clamp(sum(places, F.lit(0.0))).alias("local_ela"), F.get("ranked", 0)["text"].alias("top_text"), "ela_fields", "hits", F.size("hits").alias("key_ela_hits"))

    placed = fields.withColumn("ord", F.struct("ord", "cx", "cy")).drop("cx", "cy")
    scored = typography_outliers(placed.join(documents.select(doc, "photo"), doc), doc, "bucket", ["ord"], F.col("photo"))
    odd = odd_fields(scored, doc, ["ord"], "is_key", "text", F.col("photo")).withColumnRenamed("anomalies", "odd")
    near = lambda r, f: (F.abs(r["cx"] - f["ord"]["cx"]) <= SAME_FIELD) & (F.abs(r["cy"] - f["ord"]["cy"]) <= SAME_FIELD)
    both = F.get(F.filter("hits", lambda r: F.exists(F.filter("odd", lambda f: f["is_key"]), lambda f: near(r, f))), 0)

    zero = lambda c, kind="double": F.coalesce(F.col(c).cast(kind), F.lit(0).cast(kind))
    rows = documents.join(local, doc, "left").join(odd, doc, "left").withColumn("both", both).drop("hits")
    rows = rows.withColumns({c: zero(c, "int") for c in ("key_ela_hits", "key_typography_hits", "other_typography_hits", "consistency_points", "page_level")})
    rows = rows.withColumns({
        "local_ela": zero("local_ela"), "typography": scores.typography_score(F.col("key_typography_hits"), F.col("other_typography_hits")),
        "receipt_consistency": scores.quarter_score(F.col("consistency_points")), "ocr": scores.quarter_score(zero("ocr_points")), "metadata": scores.quarter_score(zero("metadata_points")),
        "global_ela": scores.global_error_score(F.col("page_level"), F.col("page_level") > PAGE_LEVEL), "unreadable_fields": F.coalesce(F.size("unreadable_labels"), F.lit(0)),
        "corroborated": F.col("both").isNotNull(), "corroborated_text": F.col("both.text"), "strong_typography": F.col("strong_key").isNotNull(), "first_odd": F.get("odd", 0),
    })
    return worded(decide(with_signals(rows.drop("both"))))
