"""Fields that are printed unlike the others of their kind in a document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.functions.arrays import let
from foliospark.operators.robust import robust_z

# The least deviation of each feature that means something, in the order that decides ties.
FEATURES = {"height": 1.0, "ink_ratio": 0.02, "slant_angle": 1.0, "aspect_ratio": 0.05}
#: Features that are only known where a field has enough ink.
SHAPE = ("slant_angle", "aspect_ratio")
# Least fields of a kind, and how features must differ.
LEAST_FIELDS, OTHER_LEAST = {"amounts": 5, "dates": 3}, 4
Z_LIMIT, AGREEING, PHOTO_FACTOR = 3.5, 2, 1.3
# What makes an odd key field strong evidence by itself.
STRONG_Z, STRONG_FIELDS = 10.0, 8
# Names of the features in evidence.
SHOWN = {"height": "altura de letra", "ink_ratio": "densidad de tinta", "slant_angle": "inclinación/caligrafía", "aspect_ratio": "proporción de letra"}


def typography_outliers(fields: DataFrame, doc: str, bucket: str, order: list[str], photo: Column, reliable: str = "shape_reliable") -> DataFrame:
    """``fields`` of sufficient kinds with each feature's z, max_abs_z, dominant_feature, agreeing, bucket_size and typography_anomaly.

    A field is compared with the others of its document and bucket; shapes only among reliable
    ones. Fields without a bucket, and of buckets with too few fields, have no row. The z are
    rounded to two places, the anomaly is judged by the unrounded ones. One shuffle.
    """
    rest = [c for c in fields.columns if c not in (doc, bucket, *order)]
    marked = fields.filter(F.col(bucket).isNotNull()).withColumn("__limit", F.when(F.coalesce(photo, F.lit(False)), Z_LIMIT * PHOTO_FACTOR).otherwise(Z_LIMIT))
    entry = F.struct(*order, F.struct(*rest).alias("row"), F.coalesce(reliable, F.lit(False)).alias("ok"), "__limit")
    groups = marked.groupBy(doc, bucket).agg(F.sort_array(F.collect_list(entry)).alias("rows"))
    least = F.coalesce(*(F.when(F.col(bucket) == b, F.lit(n)) for b, n in LEAST_FIELDS.items()), F.lit(OTHER_LEAST))
    groups = groups.filter(F.size("rows") >= least)

    def z(rows: Column, e: Column, i: Column, name: str) -> Column:
        of = lambda x: x["row"][name].cast("double")
        masked = name in SHAPE
        others = F.transform(F.filter(rows, lambda x, j: (j != i) & (x["ok"] if masked else F.lit(True))), of)
        found = let(others, lambda o: robust_z(of(e), o, FEATURES[name]))
        return F.when(e["ok"], found).otherwise(F.lit(0.0)) if masked else found

    def scored(rows: Column) -> Column:
        return F.transform(rows, lambda e, i: F.struct(e.alias("e"), F.struct(*(z(rows, e, i, n).alias(n) for n in FEATURES)).alias("z")))

    one = groups.select(doc, bucket, F.size("rows").alias("bucket_size"), F.explode(let(F.col("rows"), scored)).alias("x"))
    zs = [F.col(f"x.z.{n}") for n in FEATURES]
    most = F.greatest(*zs)
    dominant = F.coalesce(*(F.when(F.col(f"x.z.{n}") == most, F.lit(n)) for n in FEATURES))
    agreeing = sum((c > F.col("x.e.__limit")).cast("int") for c in zs)
    out = one.select(doc, bucket, *(F.col(f"x.e.{c}").alias(c) for c in order), *(F.col(f"x.e.row.{c}").alias(c) for c in rest), "bucket_size", *(F.round(c, 2).alias(f"z_{n}") for n, c in zip(FEATURES, zs, strict=True)), F.round(most, 2).alias("max_abs_z"), dominant.alias("dominant_feature"), agreeing.alias("agreeing"))
    return out.withColumn("typography_anomaly", F.col("agreeing") >= AGREEING)


def odd_fields(scored: DataFrame, doc: str, order: list[str], is_key: str, text: str, photo: Column) -> DataFrame:
    """(doc, anomalies, key_typography_hits, other_typography_hits, first_key, strong_key): a document's odd fields, greatest z first.

    ``strong_key`` is the key field that is evidence by itself: far beyond the limit, in a bucket
    of many fields. Amounts come before dates among equals. Documents without an odd field have no row.
    """
    limit = F.when(F.coalesce(photo, F.lit(False)), STRONG_Z * PHOTO_FACTOR).otherwise(STRONG_Z)
    field = F.struct((-F.col("max_abs_z")).alias("less"), "bucket", *order, F.col(text).alias("text"), "max_abs_z", "dominant_feature", F.coalesce(F.col(is_key), F.lit(False)).alias("is_key"), ((F.col("max_abs_z") >= limit) & (F.col("bucket_size") >= STRONG_FIELDS)).alias("strong"))
    found = scored.filter("typography_anomaly").groupBy(doc).agg(F.sort_array(F.collect_list(field)).alias("anomalies"))
    key = F.filter("anomalies", lambda a: a["is_key"])
    return found.select(doc, "anomalies", F.size(key).alias("key_typography_hits"), F.size(F.filter("anomalies", lambda a: ~a["is_key"])).alias("other_typography_hits"), F.get(key, 0).alias("first_key"), F.get(F.filter(key, lambda a: a["strong"]), 0).alias("strong_key"))


def describe_field(field: Column) -> Column:
    """What is odd about a row of ``odd_fields``, in words."""
    named = F.coalesce(*(F.when(field["dominant_feature"] == k, F.lit(v)) for k, v in SHOWN.items()), F.lit("tipografía"))
    return F.concat(named, F.lit(" distinta en '"), field["text"], F.lit("' (z-score "), field["max_abs_z"].cast("string"), F.lit(")"))
