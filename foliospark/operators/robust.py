"""Robust outlier scores within documents.

A document's regions (200 at most) are one array, so leave-one-out statistics need one shuffle on
the document and no self-join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.functions.arrays import let, median

# Fixed values of the relative calibration.
MIN_SAMPLES, Z_THRESHOLD = 6, 2.5


def robust_z(value: Column, others: Column, floor: float) -> Column:
    """How far a value lies from the others' median in MADs of at least ``floor``; 0 with fewer than two others."""

    def about(m: Column) -> Column:
        mad = F.greatest(median(F.transform(others, lambda o: F.abs(o - m))), F.lit(floor))
        return let(mad, lambda d: F.when(d > 0, F.abs(F.lit(0.6745) * (value - m) / d)).otherwise(F.lit(0.0)))

    return F.when(F.size(others) >= 2, let(median(others), about)).otherwise(F.lit(0.0))


def leave_one_out_z(regions: DataFrame, doc: str, value: str, order: list[str], floor: float = 1.0, reliable: Column | None = None, count: str | None = None) -> DataFrame:
    """``regions`` with ``z`` against the median and MAD of the document's other reliable regions.

    Fewer than two others, an unreliable region, or a MAD of 0 without a floor give 0. ``count``
    names a further column with the number of the document's reliable regions.
    """
    trusted = F.coalesce(reliable, F.lit(False)) if reliable is not None else F.lit(True)
    rest = [c for c in regions.columns if c not in (doc, value, *order)]
    entry = F.struct(*order, F.col(value).cast("double").alias("v"), trusted.alias("ok"), F.struct(F.col(value), *rest).alias("row"))
    docs = regions.groupBy(doc).agg(F.sort_array(F.collect_list(entry)).alias("rows"))

    def scored(rows: Column) -> Column:
        others = lambda i: F.transform(F.filter(rows, lambda e, j: e["ok"] & (j != i)), lambda e: e["v"])
        return F.transform(rows, lambda e, i: F.struct(e.alias("e"), F.when(e["ok"], let(others(i), lambda o: robust_z(e["v"], o, floor))).otherwise(F.lit(0.0)).alias("z")))

    counted = [] if count is None else [F.size(F.filter("rows", lambda e: e["ok"])).alias(count)]
    out = docs.select(doc, *counted, F.explode(let(F.col("rows"), scored)).alias("x"))
    return out.select(doc, *([] if count is None else [count]), *(F.col(f"x.e.{c}").alias(c) for c in order), *(F.col(f"x.e.row.{c}").alias(c) for c in [value, *rest] if c not in order), F.col("x.z").alias("z"))


def relative_calibration(regions: DataFrame, doc: str, value: str, order: list[str], anomaly: str, highlighted: Column) -> DataFrame:
    """``regions`` with ``z`` and the calibrated ``anomaly``.

    With MIN_SAMPLES regions that are not highlighted, an anomaly must also stand out from them;
    with fewer, and for highlighted regions, z is null and the anomaly stays.
    """
    marked = regions.withColumn("__hl", F.coalesce(highlighted, F.lit(False)))
    scored = leave_one_out_z(marked, doc, value, order, 1.0, ~F.col("__hl"), "__n")
    applies = (F.col("__n") >= MIN_SAMPLES) & ~F.col("__hl")
    return scored.withColumn(anomaly, F.when(applies, F.col(anomaly) & (F.col("z") > Z_THRESHOLD)).otherwise(F.col(anomaly))).withColumn("z", F.when(applies, F.col("z"))).drop("__hl", "__n")


def median_and_mad(rows: DataFrame, key: str, value: str) -> DataFrame:
    """Exact median and MAD per key, in two pre-aggregated passes."""
    middle = rows.groupBy(key).agg(F.median(value).alias("med"))
    return rows.join(middle, key).groupBy(key).agg(F.first("med").alias("med"), F.median(F.abs(F.col(value) - F.col("med"))).alias("mad"))
