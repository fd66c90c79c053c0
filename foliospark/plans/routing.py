"""Zero-shot document types from embeddings, and the route that follows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Types that only get a category, and the least confidence for it.
CATEGORY_ONLY, LEAST_CONFIDENCE = ("dni_front", "dni_back", "card"), 45.0


def centroids(vectors: DataFrame, label: str, vector: str, most: int = 1000) -> dict[int, list[float]]:
    """The mean vector of each label. Labels are a fixed list; more than ``most`` are an error."""
    parts = vectors.select(label, F.posexplode(vector).alias("pos", "x")).groupBy(label, "pos").agg(F.avg(F.col("x").cast("double")).alias("x"))
    rows = parts.groupBy(label).agg(F.sort_array(F.collect_list(F.struct("pos", "x"))).alias("v")).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} labels")
    return {r[label]: [p["x"] for p in r["v"]] for r in sorted(rows, key=lambda r: r[label])}


def softmax_types(vectors: DataFrame, vector: str, labels: dict[int, list[float]], scale: float) -> DataFrame:
    """Adds ``probabilities`` (percent, in label order), the best label (first wins ties) and its ``confidence``."""
    dot = lambda c: F.aggregate(F.zip_with(F.col(vector), F.array(*map(F.lit, c)), lambda a, b: a.cast("double") * b), F.lit(0.0), lambda s, x: s + x)
    logits = vectors.withColumn("__l", F.array(*(dot(c) * F.lit(scale) for c in labels.values())))
    exps = logits.withColumn("__e", F.transform("__l", lambda x: F.exp(x - F.array_max("__l"))))
    total = F.aggregate("__e", F.lit(0.0), lambda s, x: s + x)
    found = exps.withColumn("probabilities", F.transform("__e", lambda x: F.round(x / total * 100, 2)))
    best = F.array_position("__e", F.array_max("__e")).cast("int")
    return found.withColumns({"label_found": F.get(F.array(*map(F.lit, labels)), best - 1), "confidence": F.get("probabilities", best - 1)}).drop("__l", "__e")


def route(document_type: Column, confidence: Column) -> Column:
    return F.when(document_type.isin(*CATEGORY_ONLY) & (confidence >= LEAST_CONFIDENCE), "category_only").otherwise("receipt_control")
