"""From component scores and signals to a risk score, its band, reason and evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.functions.numbers import half_even
from foliospark.functions.scores import clamp, risk_band

# Weights of the components, in the order that decides ties.
WEIGHTS = {"local_ela": 0.59, "typography": 0.10, "receipt_consistency": 0.20, "ocr": 0.08, "global_ela": 0.03, "metadata": 0.0}
# The least score that each signal justifies, in the order of reasons.
FLOORS = {"corroborated": 75.0, "ela_plus_other": 65.0, "strong_ela_alone": 58.0, "unreadable": 50.0, "cross_family": 40.0, "strong_typography": 35.0}
# Fixed value: a component that contributes no more is no reason.
LEAST_REASON = 0.5


def with_signals(docs: DataFrame) -> DataFrame:
    """Adds the floors' conditions from counts: key_ela_hits, key_typography_hits, unreadable_fields, consistency_points."""
    logical, typography, ela, unreadable = F.col("consistency_points") >= 3, F.col("key_typography_hits") > 0, F.col("key_ela_hits") > 0, F.col("unreadable_fields") > 0
    return docs.withColumns({
        "cross_family": logical & typography & ~ela,
        "ela_plus_other": ela & (logical | typography | unreadable),
        "strong_ela_alone": F.col("key_ela_hits") >= 2,
        "unreadable": unreadable,
    })


def base_score() -> Column:
    """Each component's points are rounded to two places before they are added up."""
    total = F.lit(0.0)
    for name, weight in WEIGHTS.items():
        total = total + half_even(F.lit(weight) * F.col(name), 2)
    return clamp(total)


def final_score() -> Column:
    """The base score or the highest floor of the signals present, before rounding."""
    return F.greatest(base_score(), *(F.when(F.col(s), F.lit(f)) for s, f in FLOORS.items()))


def winning_component() -> Column:
    """The component that contributes most, unrounded; the earlier one wins ties."""
    best = F.greatest(*(F.lit(w) * F.col(n) for n, w in WEIGHTS.items()))
    found = F.when(best <= LEAST_REASON, "none")
    for name, weight in WEIGHTS.items():
        found = found.when(F.lit(weight) * F.col(name) == best, name)
    return found


def decide(docs: DataFrame) -> DataFrame:
    """Adds score, risk_band, primary_reason and evidence to documents with components and signals.

    Floors are a maximum and not a sum; the band uses the score before rounding. The reason is the
    signal of the highest floor, else the component that contributes most. Evidence lists the
    signals present, a floor's contribution named ``applied`` only where it is the score.
    """
    scored = docs.withColumn("raw_score", final_score())
    reason = F.coalesce(*(F.when(F.col(s), F.lit(s)) for s in FLOORS), winning_component())
    order = ["corroborated", "strong_typography", "ela_plus_other", "strong_ela_alone", "cross_family", "unreadable"]
    lines = [F.when(F.col(s), F.concat(F.lit(f"{s}:"), F.when(F.abs(F.col("raw_score") - FLOORS[s]) < 1e-6, "applied").otherwise("present"))) for s in order]
    level = F.concat(F.lit("level:"), risk_band(F.col("raw_score")))
    components = [F.when(F.col("local_ela") >= 40, F.when(F.col("local_ela") >= 70, "local_ela:high").otherwise("local_ela:medium")), F.when(F.col("key_typography_hits") > 0, F.lit("typography:key")), F.when(F.col("consistency_points") >= 1, F.when(F.col("consistency_points") >= 3, "receipt_consistency:high").otherwise("receipt_consistency:low"))]
    evidence = F.filter(F.array(*lines, level, *components), lambda x: x.isNotNull())
    return scored.withColumns({"score": half_even(F.col("raw_score"), 2), "risk_band": risk_band(F.col("raw_score")), "primary_reason": reason, "evidence": evidence}).drop("raw_score")
