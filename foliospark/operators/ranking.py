"""Rank-discounted sums."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliospark.functions.scores import clamp

# What the best four scores count.
DISCOUNTS = (1.0, 0.7, 0.5, 0.3)


def discounted_top(scores: DataFrame, doc: str, score: str, order: list[str]) -> DataFrame:
    """(doc, total): positive scores, largest first, times DISCOUNTS, at most 100."""
    place = F.row_number().over(Window.partitionBy(doc).orderBy(F.desc(score), *order))
    top = scores.filter(F.col(score) > 0).withColumn("place", place).filter(F.col("place") <= len(DISCOUNTS))
    weight = F.element_at(F.array(*map(F.lit, DISCOUNTS)), F.col("place"))
    return top.groupBy(doc).agg(clamp(F.sum(F.col(score) * weight)).alias("total"))
