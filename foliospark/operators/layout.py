"""Geometry of tokens: lines, nearest values, matching boxes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Fixed value: how far apart centres of the same field may be, in pixels.
SAME_FIELD = 6


def cluster_lines(tokens: DataFrame, doc: str, token: str, centre: str, height: str) -> DataFrame:
    """(doc, token, line_no): tokens by centre; one further than 0.6 heights from the line's running mean starts a line."""
    entries = F.sort_array(F.collect_list(F.struct(F.col(centre).cast("double").alias("c"), F.col(token).alias("t"), F.col(height).cast("double").alias("h"))))
    token_type = tokens.schema[token].dataType.simpleString()
    start = F.struct(F.lit(-1).alias("line"), F.lit(0.0).alias("c"), F.lit(0.0).alias("h"), F.array().cast(f"array<struct<t:{token_type},l:int>>").alias("out"))

    def step(s, e):
        new = (s["line"] < 0) | (F.abs(e["c"] - s["c"]) > F.lit(0.6) * F.greatest(s["h"], e["h"]))
        line = F.when(new, s["line"] + 1).otherwise(s["line"])
        c = F.when(new, e["c"]).otherwise((s["c"] + e["c"]) / 2)
        h = F.when(new, e["h"]).otherwise((s["h"] + e["h"]) / 2)
        return F.struct(line.alias("line"), c.alias("c"), h.alias("h"), F.concat(s["out"], F.array(F.struct(e["t"].alias("t"), line.alias("l")))).alias("out"))

    folded = tokens.groupBy(doc).agg(entries.alias("e")).select(doc, F.explode(F.aggregate("e", start, step, lambda s: s["out"])).alias("x"))
    return folded.select(doc, F.col("x.t").alias(token), F.col("x.l").alias("line_no"))


def first_same_field(regions: DataFrame, fields: DataFrame, doc: str) -> DataFrame:
    """The first pair of a document's regions and fields (doc, ord, cx, cy) with centres within SAME_FIELD.

    An equi-join on the document and grid cells of SAME_FIELD keeps documents of thousands of boxes linear.
    """
    cell = lambda c: F.floor(F.col(c) / F.lit(float(SAME_FIELD)))
    around = lambda c: F.explode(F.array(*(cell(c) + k for k in (-1, 0, 1))))
    a = regions.select(doc, F.col("ord").alias("region_ord"), F.col("cx").alias("ax"), F.col("cy").alias("ay"), cell("cx").alias("gx"), cell("cy").alias("gy"))
    b = fields.select(doc, F.col("ord").alias("field_ord"), F.col("cx").alias("bx"), F.col("cy").alias("by"), around("cx").alias("gx"), "cy").withColumn("gy", F.explode(F.array(*(F.floor(F.col("cy") / F.lit(float(SAME_FIELD))) + k for k in (-1, 0, 1)))))
    near = (F.abs(F.col("ax") - F.col("bx")) <= SAME_FIELD) & (F.abs(F.col("ay") - F.col("by")) <= SAME_FIELD)
    pairs = a.join(b, [doc, "gx", "gy"]).filter(near)
    return pairs.groupBy(doc).agg(F.min(F.struct("region_ord", "field_ord")).alias("p")).select(doc, "p.region_ord", "p.field_ord")


def nearest_value(labels: DataFrame, values: DataFrame, doc: str) -> DataFrame:
    """For each label (doc, label, cx, width) the value (doc, idx, vx) nearest to it, if within 1.5 widths (40 at least); the lower idx wins ties."""
    listed = values.groupBy(doc).agg(F.collect_list(F.struct("idx", "vx")).alias("vs"))
    found = F.array_min(F.transform("vs", lambda v: F.struct(F.abs(F.col("cx") - v["vx"]).alias("d"), v["idx"].alias("idx"))))
    joined = labels.join(listed, doc).withColumn("n", found)
    return joined.filter(F.col("n.d") <= F.greatest("width", F.lit(40.0)) * 1.5).select(doc, "label", F.col("n.idx").alias("idx"), F.col("n.d").alias("distance"))


def next_line(lines: DataFrame, doc: str, top: str, line: str, text: str) -> DataFrame:
    """Each line with the text of the one below it, by top edge and then line number."""
    return lines.withColumn("next_text", F.lead(text).over(Window.partitionBy(doc).orderBy(top, line)))
