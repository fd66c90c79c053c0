"""Histogram thresholding (Otsu) over any number of pixels."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def otsu(pixels: DataFrame, key: str, value: str) -> DataFrame:
    """(key, threshold, separability): pixels are counted per value first, 256 rows a key at most.

    The first threshold of the largest between-class variance wins; without any split it is 128
    with separability 0.
    """
    bins = pixels.groupBy(key, F.col(value).cast("int").alias("v")).agg(F.count(F.lit(1)).cast("double").alias("n"))
    up_to = Window.partitionBy(key).orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy(key)
    sums = bins.select(key, "v", F.sum("n").over(up_to).alias("wb"), F.sum(F.col("v") * F.col("n")).over(up_to).alias("sb"), F.sum("n").over(whole).alias("w"), F.sum(F.col("v") * F.col("n")).over(whole).alias("s"))
    wf = F.col("w") - F.col("wb")
    gap = F.col("sb") / F.col("wb") - (F.col("s") - F.col("sb")) / wf
    sums = sums.withColumn("variance", F.when(wf > 0, F.col("wb") * wf * gap * gap))
    best = sums.groupBy(key).agg(F.max(F.struct("variance", (-F.col("v")).alias("at"))).alias("b"), F.max("w").alias("w"))
    variance = F.col("b.variance")
    return best.select(
        key,
        F.when(variance.isNotNull(), (-F.col("b.at")).cast("double")).otherwise(F.lit(128.0)).alias("threshold"),
        F.when(variance > 0, variance / (F.col("w") * F.col("w") * F.lit(255.0 * 255.0) / F.lit(4.0))).otherwise(F.lit(0.0)).alias("separability"),
    )


def ink_split(pixels: DataFrame, key: str, value: str) -> DataFrame:
    """(key, dark_ink, ink_ratio, mean_ink, ink_std, background_mean): the side of ``otsu`` with fewer pixels is ink.

    Dark ink is below the threshold and wins a tie. Without ink the mean and the population's
    deviation are those of all pixels. Everything follows from one count per value.
    """
    bins = pixels.groupBy(key, F.col(value).cast("int").alias("v")).agg(F.count(F.lit(1)).cast("double").alias("n"))
    marked = bins.join(otsu(pixels, key, value).select(key, "threshold"), key).withColumn("dark", F.col("v") < F.col("threshold"))
    total = lambda c, f=F.lit(True): F.coalesce(F.sum(F.when(f, c)), F.lit(0.0))
    n, v = F.col("n"), F.col("v").cast("double")
    sums = marked.groupBy(key).agg(*(total(c, f).alias(f"{a}{b}") for a, c in (("n", n), ("s", n * v), ("q", n * v * v)) for b, f in (("", F.lit(True)), ("_dark", F.col("dark")))))
    split = sums.withColumn("below", F.col("n_dark") / F.col("n")).withColumn("dark_ink", F.col("below") <= 0.5)
    ink = {a: F.when(F.col("dark_ink"), F.col(f"{a}_dark")).otherwise(F.col(a) - F.col(f"{a}_dark")) for a in ("n", "s", "q")}
    some = ink["n"] > 0
    count, first, second = (F.when(some, ink[a]).otherwise(F.col(a)) for a in ("n", "s", "q"))
    mean = first / count
    rest = F.col("n") - ink["n"]
    return split.select(
        key, "dark_ink", F.when(F.col("dark_ink"), F.col("below")).otherwise(1 - F.col("below")).alias("ink_ratio"), mean.alias("mean_ink"),
        F.sqrt(F.greatest(second / count - mean * mean, F.lit(0.0))).alias("ink_std"), F.when(rest > 0, (F.col("s") - ink["s"]) / F.when(rest > 0, rest)).alias("background_mean"),
    )
