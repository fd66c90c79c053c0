"""Registered queries of the forensic operators with their DuckDB SQL.

The tables hold no receipts, so orders stand for documents and their lines for regions, tokens
and fields; every query runs over the whole tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.functions import scores, text
from foliospark.functions.metadata import metadata_score
from foliospark.operators.histogram import otsu
from foliospark.operators.layout import cluster_lines, first_same_field, nearest_value, next_line
from foliospark.operators.ranking import discounted_top
from foliospark.operators.robust import leave_one_out_z, median_and_mad, relative_calibration
from foliospark.plans.decision import decide, with_signals
from foliospark.plans.routing import centroids, route, softmax_types

LINE_ORDER = ["l_linenumber", "l_partkey", "l_suppkey"]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _cents(c: str) -> Column:
    return F.round(F.col(c) * 100).cast("long")


def consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with the tier of their total against the sum of their lines, in cents."""
    lines = _table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg((F.sum(_cents("l_extendedprice")) / F.lit(100.0)).alias("expected"))
    orders = _table(spark, sf_dir, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
    return orders.withColumn("tier", scores.difference_tier(F.col("expected"), F.col("o_totalprice")))


TIER_SQL = """
t AS (
  SELECT o.*, expected, CASE WHEN least(abs(expected), abs(o_totalprice)) > 0 AND greatest(abs(expected), abs(o_totalprice)) > least(abs(expected), abs(o_totalprice)) * 10.0::DOUBLE THEN 'unreliable'
    WHEN abs(expected - o_totalprice) <= greatest(1.0::DOUBLE, abs(expected) * 0.015::DOUBLE) THEN 'ok' WHEN abs(expected - o_totalprice) <= greatest(1.0::DOUBLE, abs(expected) * 0.015::DOUBLE) * 3 THEN 'leve' ELSE 'inconsistente' END AS tier
  FROM orders o JOIN (SELECT l_orderkey, sum(round(l_extendedprice * 100)::BIGINT)::BIGINT / 100.0::DOUBLE AS expected FROM lineitem GROUP BY 1) l ON l_orderkey = o_orderkey
)
"""


def q01_receipt_consistency_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    tiers = consistency(spark, sf_dir)
    score = scores.quarter_score(scores.difference_points(F.col("tier")))
    return tiers.groupBy("tier", scores.risk_band(score).alias("risk_band")).agg(F.count(F.lit(1)).alias("n"), F.avg(score).alias("mean_score"))


Q01 = f"""WITH {TIER_SQL}, s AS (SELECT tier, CASE tier WHEN 'leve' THEN 25.0 WHEN 'inconsistente' THEN 50.0 ELSE 0.0 END::DOUBLE AS score FROM t)
SELECT tier, CASE WHEN score >= 60 THEN 'altamente_sospechoso' WHEN score >= 25 THEN 'sospechoso' ELSE 'poco_sospechoso' END AS risk_band, count(*) AS n, avg(score) AS mean_score FROM s GROUP BY ALL"""


def q02_loo_robust_z(spark: SparkSession, sf_dir: str) -> DataFrame:
    z = leave_one_out_z(_table(spark, sf_dir, "lineitem").select("l_orderkey", *LINE_ORDER, "l_extendedprice"), "l_orderkey", "l_extendedprice", LINE_ORDER)
    return z.withColumn("z", F.round("z", 8))


def _loo_sql(value: str, floor: str, ok: str = "true", extra: str = "") -> str:
    return f"""
r AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {value}::DOUBLE AS v, ({ok}) AS ok, row_number() OVER () AS rid {extra} FROM lineitem),
g AS (SELECT l_orderkey, list({{'rid': rid, 'v': v, 'ok': ok}}) AS vs FROM r GROUP BY 1),
o AS (SELECT r.*, list_transform(list_filter(vs, lambda e: e.ok AND e.rid <> r.rid), lambda e: e.v) AS others, len(list_filter(vs, lambda e: e.ok)) AS n_ok FROM r JOIN g USING (l_orderkey)),
m AS (SELECT *, list_aggregate(others, 'median') AS med FROM o),
d AS (SELECT *, greatest(list_aggregate(list_transform(others, lambda x: abs(x - med)), 'median'), {floor}) AS mad FROM m),
z AS (SELECT *, CASE WHEN ok AND len(others) >= 2 AND mad > 0 THEN abs(0.6745 * (v - med) / mad) ELSE 0.0 END AS z FROM d)
"""


Q02 = f"WITH {_loo_sql('l_extendedprice', '1.0')} SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, v AS l_extendedprice, round(z, 8) AS z FROM z"


def q03_relative_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _table(spark, sf_dir, "lineitem").select("l_orderkey", *LINE_ORDER, "l_quantity", "l_returnflag", (F.col("l_quantity") > 20).alias("anomaly"))
    out = relative_calibration(lines, "l_orderkey", "l_quantity", LINE_ORDER, "anomaly", F.col("l_returnflag") == "R")
    return out.select("l_orderkey", *LINE_ORDER, "l_quantity", "anomaly", F.round("z", 8).alias("z"))


Q03 = f"""WITH {_loo_sql("l_quantity", "1.0", "l_returnflag <> 'R'")}
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, v AS l_quantity, CASE WHEN n_ok >= 6 AND ok THEN v > 20 AND z > 2.5 ELSE v > 20 END AS anomaly, CASE WHEN n_ok >= 6 AND ok THEN round(z, 8) END AS z FROM z"""


def q04_masked_loo_z(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _table(spark, sf_dir, "lineitem").select("l_orderkey", *LINE_ORDER, "l_discount", "l_linestatus")
    z = leave_one_out_z(lines, "l_orderkey", "l_discount", LINE_ORDER, 0.02, F.col("l_linestatus") == "O")
    return z.select("l_orderkey", *LINE_ORDER, "l_discount", F.round("z", 8).alias("z"))


Q04 = f"""WITH {_loo_sql("l_discount", "0.02", "l_linestatus = 'O'")} SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, v AS l_discount, round(z, 8) AS z FROM z"""


def q06_mad_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = median_and_mad(_table(spark, sf_dir, "events").select("event_type", "value"), "event_type", "value")
    return out.select("event_type", F.round("med", 6).alias("med"), F.round("mad", 6).alias("mad"))


Q06 = "SELECT event_type, round(median(value), 6) AS med, round(mad(value), 6) AS mad FROM events GROUP BY 1"


def q07_otsu(spark: SparkSession, sf_dir: str) -> DataFrame:
    pixels = _table(spark, sf_dir, "events").select("event_type", F.least(F.greatest(F.floor("value"), F.lit(0)), F.lit(255)).cast("int").alias("v"))
    return otsu(pixels, "event_type", "v").withColumn("separability", F.round("separability", 9))


Q07 = """WITH b AS (SELECT event_type, least(greatest(floor(value), 0), 255)::INTEGER AS v, count(*)::DOUBLE AS n FROM events GROUP BY ALL),
c AS (SELECT event_type, v, sum(n) OVER u AS wb, sum(v * n) OVER u AS sb, sum(n) OVER w AS t, sum(v * n) OVER w AS s FROM b WINDOW u AS (PARTITION BY event_type ORDER BY v), w AS (PARTITION BY event_type)),
x AS (SELECT *, CASE WHEN t > wb THEN wb * (t - wb) * (sb / wb - (s - sb) / (t - wb)) * (sb / wb - (s - sb) / (t - wb)) END AS variance FROM c)
SELECT event_type, CASE WHEN max(variance) IS NULL THEN 128.0::DOUBLE ELSE min(CASE WHEN variance = best THEN v END)::DOUBLE END AS threshold, round(coalesce(CASE WHEN max(variance) > 0 THEN max(variance) / (max(t) * max(t) * 65025.0::DOUBLE / 4.0::DOUBLE) END, 0.0::DOUBLE), 9) AS separability
FROM (SELECT *, max(variance) OVER (PARTITION BY event_type) AS best FROM x) GROUP BY event_type"""


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as regions: quantity is the error level, above 20 an anomaly, returned lines are key fields."""
    lines = _table(spark, sf_dir, "lineitem").select("*", F.col("l_quantity").cast("int").alias("level"), (F.col("l_returnflag") == "R").alias("is_key"))
    return lines.withColumn("anomaly", F.col("level") > 20).withColumn("score", scores.region_error_score(F.col("level"), F.col("anomaly") & (F.col("l_linestatus") == "O"), F.col("is_key")))


REGION_SQL = """
rg AS (SELECT *, l_quantity::INTEGER AS level, l_returnflag = 'R' AS is_key, l_quantity::INTEGER > 20 AS anomaly, CASE WHEN l_returnflag = 'R' THEN 1.45::DOUBLE ELSE 1.0::DOUBLE END AS k FROM lineitem),
rs AS (SELECT *, CASE WHEN anomaly AND l_linestatus = 'O' THEN least(greatest((78.0::DOUBLE + greatest(0, level - 20) * 1.5::DOUBLE) * k, 0.0), 100.0)
  WHEN level > 20 THEN 30.0::DOUBLE * k WHEN 20 - level <= 4 THEN (10.0::DOUBLE + greatest(0, 4 - (20 - level)) * 2.0::DOUBLE) * k ELSE 0.0::DOUBLE END AS score FROM rg)
"""


def q09_top4_discounted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return discounted_top(regions(spark, sf_dir).select("l_orderkey", "score", *LINE_ORDER), "l_orderkey", "score", LINE_ORDER).withColumn("total", F.round("total", 6))


TOP_SQL = """
tp AS (SELECT l_orderkey, round(least(greatest(sum(score * CASE place WHEN 1 THEN 1.0::DOUBLE WHEN 2 THEN 0.7::DOUBLE WHEN 3 THEN 0.5::DOUBLE ELSE 0.3::DOUBLE END), 0.0), 100.0), 6) AS total
  FROM (SELECT l_orderkey, score, row_number() OVER (PARTITION BY l_orderkey ORDER BY score DESC) AS place FROM rs WHERE score > 0) WHERE place <= 4 GROUP BY 1)
"""
Q09 = f"WITH {REGION_SQL}, {TOP_SQL} SELECT * FROM tp"


def q10_region_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regions(spark, sf_dir).groupBy("level", "is_key", "l_linestatus", F.round("score", 6).alias("score")).agg(F.count(F.lit(1)).alias("n"))


Q10 = f"WITH {REGION_SQL} SELECT level, is_key, l_linestatus, round(score, 6) AS score, count(*) AS n FROM rs GROUP BY ALL"


def q11_global_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    level = (F.col("o_orderkey") % 61).cast("int")
    return _table(spark, sf_dir, "orders").select(level.alias("level"), F.round(scores.global_error_score(level, level > 35), 6).alias("score")).groupBy("level", "score").agg(F.count(F.lit(1)).alias("n"))


GLOBAL_SQL = "CASE WHEN o_orderkey % 61 > 35 THEN least(55.0::DOUBLE + (o_orderkey % 61 - 35) * 1.5::DOUBLE, 100.0::DOUBLE) WHEN o_orderkey % 61 >= 24 THEN 25.0::DOUBLE + (o_orderkey % 61) / 35.0::DOUBLE * 20.0::DOUBLE ELSE 0.0::DOUBLE END"
Q11 = f"SELECT (o_orderkey % 61)::INTEGER AS level, round({GLOBAL_SQL}, 6) AS score, count(*) AS n FROM orders GROUP BY ALL"


def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order with lines as a document: components, signals, score, band, reason and evidence."""
    whole = regions(spark, sf_dir)
    top = discounted_top(whole.select("l_orderkey", "score", *LINE_ORDER), "l_orderkey", "score", LINE_ORDER).select("l_orderkey", F.round("total", 6).alias("local_ela"))
    odd = F.col("l_discount") >= 0.09
    counts = whole.groupBy("l_orderkey").agg(
        F.count_if(odd & F.col("is_key")).alias("key_typography_hits"), F.count_if(odd & ~F.col("is_key")).alias("other_typography_hits"), F.count_if(F.col("anomaly") & F.col("is_key")).alias("key_ela_hits"),
        (F.count_if((F.col("l_tax") >= 0.07) & F.col("is_key")) >= 2).alias("corroborated"), ((F.max("l_quantity") >= 49) & (F.count(F.lit(1)) >= 5)).alias("strong_typography"),
    )
    docs = consistency(spark, sf_dir).drop("l_orderkey").join(counts, F.col("o_orderkey") == F.col("l_orderkey")).drop("l_orderkey").join(top, F.col("o_orderkey") == F.col("l_orderkey"), "left").drop("l_orderkey")
    points = scores.difference_points(F.col("tier")) + F.when(F.col("o_custkey") % 3 == 0, 1).otherwise(0)
    level = (F.col("o_orderkey") % 61).cast("int")
    docs = docs.withColumns({
        "consistency_points": points, "unreadable_fields": F.when(F.col("tier") == "unreliable", 1).otherwise(0), "local_ela": F.coalesce("local_ela", F.lit(0.0)),
        "typography": scores.typography_score(F.col("key_typography_hits"), F.col("other_typography_hits")), "receipt_consistency": scores.quarter_score(points), "ocr": scores.quarter_score(F.col("o_orderkey") % 5),
        "global_ela": scores.global_error_score(level, level > 35), "metadata": scores.quarter_score(F.col("o_custkey") % 5),
    })
    return decide(with_signals(docs))


DECISION_SQL = f"""WITH {TIER_SQL}, {REGION_SQL}, {TOP_SQL},
ct AS (SELECT l_orderkey, count(*) FILTER (WHERE l_discount >= 0.09::DOUBLE AND is_key) AS kt, count(*) FILTER (WHERE l_discount >= 0.09::DOUBLE AND NOT is_key) AS ot, count(*) FILTER (WHERE anomaly AND is_key) AS ke,
  count(*) FILTER (WHERE l_tax >= 0.07::DOUBLE AND is_key) >= 2 AS corroborated, max(l_quantity) >= 49 AND count(*) >= 5 AS strong_typography FROM rg GROUP BY 1),
c0 AS (SELECT t.*, ct.*, coalesce(tp.total, 0.0::DOUBLE) AS local_ela, CASE tier WHEN 'leve' THEN 1 WHEN 'inconsistente' THEN 2 ELSE 0 END + CASE WHEN o_custkey % 3 = 0 THEN 1 ELSE 0 END AS pts, tier = 'unreliable' AS unreadable
  FROM t JOIN ct ON ct.l_orderkey = o_orderkey LEFT JOIN tp ON tp.l_orderkey = o_orderkey),
c1 AS (SELECT *, least(kt * 35.0::DOUBLE + ot * 15.0::DOUBLE, 100.0::DOUBLE) AS typography, least(pts / 4.0::DOUBLE * 100.0::DOUBLE, 100.0) AS rc, least((o_orderkey % 5) / 4.0::DOUBLE * 100.0::DOUBLE, 100.0) AS ocr, {GLOBAL_SQL} AS ge,
  pts >= 3 AND kt > 0 AND NOT ke > 0 AS cf, ke > 0 AND (pts >= 3 OR kt > 0 OR unreadable) AS eo, ke >= 2 AS ea FROM c0),
c2 AS (SELECT *, least(format('{{:.2f}}', 0.59::DOUBLE * local_ela)::DOUBLE + format('{{:.2f}}', 0.10::DOUBLE * typography)::DOUBLE + format('{{:.2f}}', 0.20::DOUBLE * rc)::DOUBLE + format('{{:.2f}}', 0.08::DOUBLE * ocr)::DOUBLE + format('{{:.2f}}', 0.03::DOUBLE * ge)::DOUBLE, 100.0::DOUBLE) AS base,
  greatest(0.59::DOUBLE * local_ela, 0.10::DOUBLE * typography, 0.20::DOUBLE * rc, 0.08::DOUBLE * ocr, 0.03::DOUBLE * ge) AS best FROM c1),
dc AS (SELECT *, greatest(base, CASE WHEN corroborated THEN 75.0 ELSE 0.0 END, CASE WHEN eo THEN 65.0 ELSE 0.0 END, CASE WHEN ea THEN 58.0 ELSE 0.0 END, CASE WHEN unreadable THEN 50.0 ELSE 0.0 END, CASE WHEN cf THEN 40.0 ELSE 0.0 END, CASE WHEN strong_typography THEN 35.0 ELSE 0.0 END)::DOUBLE AS raw FROM c2),
dd AS (SELECT *, CASE WHEN raw >= 60 THEN 'altamente_sospechoso' WHEN raw >= 25 THEN 'sospechoso' ELSE 'poco_sospechoso' END AS risk_band,
  CASE WHEN corroborated THEN 'corroborated' WHEN eo THEN 'ela_plus_other' WHEN ea THEN 'strong_ela_alone' WHEN unreadable THEN 'unreadable' WHEN cf THEN 'cross_family' WHEN strong_typography THEN 'strong_typography' WHEN best <= 0.5 THEN 'none'
    WHEN 0.59::DOUBLE * local_ela = best THEN 'local_ela' WHEN 0.10::DOUBLE * typography = best THEN 'typography' WHEN 0.20::DOUBLE * rc = best THEN 'receipt_consistency' WHEN 0.08::DOUBLE * ocr = best THEN 'ocr' ELSE 'global_ela' END AS primary_reason FROM dc)
"""


def q12_weighted_floors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decisions(spark, sf_dir).select("o_orderkey", "score", "risk_band")


Q12 = f"{DECISION_SQL} SELECT o_orderkey, format('{{:.2f}}', raw)::DOUBLE AS score, risk_band FROM dd"


def q13_primary_reason(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decisions(spark, sf_dir).groupBy("risk_band", "primary_reason").agg(F.count(F.lit(1)).alias("n"))


Q13 = f"{DECISION_SQL} SELECT risk_band, primary_reason, count(*) AS n FROM dd GROUP BY ALL"


def q14_evidence_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decisions(spark, sf_dir).select("o_orderkey", F.array_join("evidence", ";").alias("evidence"))


Q14 = (
    DECISION_SQL
    + "SELECT o_orderkey, concat_ws(';', "
    + ", ".join(f"CASE WHEN {c} THEN '{n}:' || CASE WHEN abs(raw - {f}) < 1e-6 THEN 'applied' ELSE 'present' END END" for n, c, f in (("corroborated", "corroborated", 75), ("strong_typography", "strong_typography", 35), ("ela_plus_other", "eo", 65), ("strong_ela_alone", "ea", 58), ("cross_family", "cf", 40), ("unreadable", "unreadable", 50)))
    + ", 'level:' || risk_band, CASE WHEN local_ela >= 70 THEN 'local_ela:high' WHEN local_ela >= 40 THEN 'local_ela:medium' END, CASE WHEN kt > 0 THEN 'typography:key' END, CASE WHEN pts >= 3 THEN 'receipt_consistency:high' WHEN pts >= 1 THEN 'receipt_consistency:low' END) AS evidence FROM dd"
)


def q15_spatial_band_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    boxes = _table(spark, sf_dir, "lineitem").select("l_orderkey", F.struct(*LINE_ORDER).alias("ord"), F.col("l_quantity").alias("cx"), (F.col("l_linenumber") * 3).cast("double").alias("cy"), "l_returnflag")
    found = first_same_field(boxes.filter("l_returnflag = 'R'"), boxes.filter("l_returnflag = 'A'"), "l_orderkey")
    return found.select("l_orderkey", F.col("region_ord.l_linenumber").alias("region_line"), F.col("region_ord.l_partkey").alias("region_part"), F.col("field_ord.l_linenumber").alias("field_line"), F.col("field_ord.l_partkey").alias("field_part"))


Q15 = """WITH p AS (SELECT a.l_orderkey, a.l_linenumber AS region_line, a.l_partkey AS region_part, b.l_linenumber AS field_line, b.l_partkey AS field_part,
  row_number() OVER (PARTITION BY a.l_orderkey ORDER BY a.l_linenumber, a.l_partkey, a.l_suppkey, b.l_linenumber, b.l_partkey, b.l_suppkey) AS k
  FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_returnflag = 'R' AND b.l_returnflag = 'A' AND abs(a.l_quantity - b.l_quantity) <= 6 AND abs(a.l_linenumber * 3 - b.l_linenumber * 3) <= 6)
SELECT l_orderkey, region_line, region_part, field_line, field_part FROM p WHERE k = 1"""


def q16_nearest_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _table(spark, sf_dir, "lineitem")
    labels = lines.filter("l_returnflag = 'R'").select("l_orderkey", F.concat_ws("-", "l_linenumber", "l_partkey", "l_suppkey").alias("label"), (F.col("l_quantity") * 20).alias("cx"), F.lit(50.0).alias("width"))
    values = lines.filter("l_returnflag = 'A'").select("l_orderkey", F.struct(*LINE_ORDER).alias("idx"), (F.col("l_quantity") * 20).alias("vx"))
    return nearest_value(labels, values, "l_orderkey").select("l_orderkey", "label", F.col("idx.l_linenumber").alias("value_line"), F.col("idx.l_partkey").alias("value_part"), "distance")


Q16 = """WITH l AS (SELECT *, row_number() OVER () AS rid FROM lineitem WHERE l_returnflag = 'R'),
p AS (SELECT a.rid, a.l_orderkey, concat_ws('-', a.l_linenumber, a.l_partkey, a.l_suppkey) AS label, b.l_linenumber AS value_line, b.l_partkey AS value_part, abs(a.l_quantity * 20 - b.l_quantity * 20) AS distance,
  row_number() OVER (PARTITION BY a.rid ORDER BY abs(a.l_quantity * 20 - b.l_quantity * 20), b.l_linenumber, b.l_partkey, b.l_suppkey) AS k FROM l a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_returnflag = 'A')
SELECT l_orderkey, label, value_line, value_part, distance FROM p WHERE k = 1 AND distance <= 75"""


def q19_adjacent_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_quantity").alias("top"), F.max(F.concat_ws("/", F.lpad(F.col("l_partkey").cast("string"), 12, "0"), "l_returnflag")).alias("line_text"))
    return next_line(lines, "l_orderkey", "top", "l_linenumber", "line_text")


Q19 = """WITH l AS (SELECT l_orderkey, l_linenumber, min(l_quantity) AS top, max(lpad(l_partkey::VARCHAR, 12, '0') || '/' || l_returnflag) AS line_text FROM lineitem GROUP BY ALL)
SELECT *, lead(line_text) OVER (PARTITION BY l_orderkey ORDER BY top, l_linenumber) AS next_text FROM l"""


def q20_line_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = _table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber", "l_partkey").agg(F.max("l_quantity").alias("q"))
    tokens = tokens.select("l_orderkey", F.struct("l_linenumber", "l_partkey").alias("token"), (F.col("q") * 4).alias("cy"), (F.col("l_linenumber") + 8).cast("double").alias("h"))
    return cluster_lines(tokens, "l_orderkey", "token", "cy", "h").select("l_orderkey", "token.l_linenumber", "token.l_partkey", "line_no")


Q20 = """WITH RECURSIVE t AS (SELECT l_orderkey, l_linenumber, l_partkey, max(l_quantity) * 4 AS c, (l_linenumber + 8)::DOUBLE AS h FROM lineitem GROUP BY ALL),
n AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY c, l_linenumber, l_partkey) AS k FROM t),
f AS (
  SELECT l_orderkey, l_linenumber, l_partkey, k, c, h, 0 AS line_no FROM n WHERE k = 1
  UNION ALL
  SELECT n.l_orderkey, n.l_linenumber, n.l_partkey, n.k, CASE WHEN abs(n.c - f.c) > 0.6::DOUBLE * greatest(f.h, n.h) THEN n.c ELSE (f.c + n.c) / 2 END, CASE WHEN abs(n.c - f.c) > 0.6::DOUBLE * greatest(f.h, n.h) THEN n.h ELSE (f.h + n.h) / 2 END,
    f.line_no + CASE WHEN abs(n.c - f.c) > 0.6::DOUBLE * greatest(f.h, n.h) THEN 1 ELSE 0 END FROM f JOIN n ON n.l_orderkey = f.l_orderkey AND n.k = f.k + 1
)
SELECT l_orderkey, l_linenumber, l_partkey, line_no FROM f"""


def q22_parse_amount(spark: SparkSession, sf_dir: str) -> DataFrame:
    cents = F.format_string("%02d", _cents("l_extendedprice") % 100)
    whole = (_cents("l_extendedprice") / 100).cast("long").cast("string")
    grouped = lambda mark: F.regexp_replace(whole, r"(\d)(?=(\d{3})+$)", f"$1{mark}")
    style = F.col("l_orderkey") % 6
    raw = F.when(style == 0, F.concat(grouped("."), F.lit(","), cents)).when(style == 1, F.concat(grouped(","), F.lit("."), cents)).when(style == 2, F.concat(F.lit("("), grouped("."), F.lit(","), cents, F.lit(")")))
    raw = raw.when(style == 3, F.concat(F.lit("$ "), whole)).when(style == 4, grouped(".")).otherwise(F.concat(whole, F.lit("-")))
    return _table(spark, sf_dir, "lineitem").select("l_orderkey", *LINE_ORDER, raw.alias("raw")).withColumn("amount", text.parse_amount(F.col("raw")))


Q22 = r"""WITH c AS (SELECT *, round(l_extendedprice * 100)::BIGINT AS c FROM lineitem), w AS (SELECT *, (c // 100)::VARCHAR AS w, lpad((c % 100)::VARCHAR, 2, '0') AS e, l_orderkey % 6 AS style FROM c),
g AS (SELECT *, reverse(regexp_replace(reverse(w), '([0-9]{3})', '\1.', 'g')) AS g0 FROM w), h AS (SELECT *, ltrim(g0, '.') AS dots, replace(ltrim(g0, '.'), '.', ',') AS commas FROM g)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE style WHEN 0 THEN dots || ',' || e WHEN 1 THEN commas || '.' || e WHEN 2 THEN '(' || dots || ',' || e || ')' WHEN 3 THEN '$ ' || w WHEN 4 THEN dots ELSE w || '-' END AS raw,
  CASE style WHEN 0 THEN (w || '.' || e)::DOUBLE WHEN 1 THEN (w || '.' || e)::DOUBLE WHEN 2 THEN -((w || '.' || e)::DOUBLE) WHEN 3 THEN w::DOUBLE WHEN 4 THEN TRY_CAST(dots AS DOUBLE) END AS amount FROM h"""


def _found(spark: SparkSession, sf_dir: str, found: Column, name: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", F.array_join(found, "|").alias(name)).filter(F.col(name) != "")


def q28_card_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(spark, sf_dir, text.card_numbers(F.col("text")), "cards")


Q28 = r"""WITH m AS (SELECT doc_id, list_filter(list_transform(regexp_extract_all(text, '(?:\b\d[\d\s\-]{11,22}\d\b|\b\*{2,}\s*\d{4,6}\b)'), lambda x: regexp_replace(x, '[^0-9]', '', 'g')), lambda x: len(x) BETWEEN 13 AND 19) AS c FROM documents)
SELECT doc_id, array_to_string(list_filter(c, lambda x, i: list_position(c, x) = i), '|') AS cards FROM m WHERE len(c) > 0"""


def q29_masked_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(spark, sf_dir, text.masked_card_numbers(F.col("text")), "masked")


Q29 = r"""WITH m AS (SELECT doc_id, list_transform(regexp_extract_all(text, '\*{2,}\s*\d{3,6}'), lambda x: replace(x, ' ', '')) AS c FROM documents)
SELECT doc_id, array_to_string(list_filter(c, lambda x, i: list_position(c, x) = i), '|') AS masked FROM m WHERE len(c) > 0"""


def q31_bank_issuer(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = F.concat_ws(" ", F.lit("pago"), F.element_at(F.array(*map(F.lit, text.BANKS)), (F.col("o_orderkey") % 20 + 1).cast("int")), F.element_at(F.array(*map(F.lit, text.BANKS)), (F.col("o_custkey") % 20 + 1).cast("int")))
    return _table(spark, sf_dir, "orders").select(text.bank_name(F.upper(named)).alias("bank")).groupBy("bank").agg(F.count(F.lit(1)).alias("n"))


_BANK_LIST = "[" + ", ".join(f"'{b}'" for b in text.BANKS) + "]"
Q31 = f"""WITH b AS (SELECT {_BANK_LIST} AS bs), o AS (SELECT bs, upper('pago ' || bs[o_orderkey % 20 + 1] || ' ' || bs[o_custkey % 20 + 1]) AS t FROM orders, b), f AS (SELECT list_filter(bs, lambda k: contains(t, k))[1] AS k FROM o)
SELECT array_to_string(list_transform(string_split(lower(k), ' '), lambda w: upper(w[1]) || w[2:]), ' ') AS bank, count(*) AS n FROM f GROUP BY 1"""


def q33_token_typing(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = _table(spark, sf_dir, "documents").select("lang", F.explode(F.split("text", r"[\x20\x09-\x0D]+")).alias("token")).filter("token != ''")
    t = F.col("token")
    return tokens.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.count_if(text.is_numeric(t)).alias("numeric"), F.count_if(text.is_amount(t)).alias("amounts"), F.count_if(text.is_merged(t)).alias("merged"))


Q33 = r"""WITH w AS (SELECT lang, unnest(string_split_regex(text, '[\x20\x09-\x0D]+')) AS token FROM documents)
SELECT lang, count(*) AS n, count(*) FILTER (WHERE regexp_matches(token, '[0-9][0-9\.,:/\-]*')) AS numeric, count(*) FILTER (WHERE regexp_matches(token, '\$?\s*\(?\s*[0-9]{1,3}(?:[\.,][0-9]{3})*(?:[\.,][0-9]{1,2})\s*\)?')) AS amounts,
  count(*) FILTER (WHERE len(regexp_extract_all(token, ',\d{2}')) >= 2 OR len(token) - len(replace(token, '$', '')) >= 2) AS merged FROM w WHERE token <> '' GROUP BY 1"""


def q36_metadata_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    i = F.col("doc_id")
    software = F.when(i % 7 == 0, F.lit("Adobe Photoshop 24")).when(i % 7 == 1, F.lit("scanner"))
    kind = F.element_at(F.array(*map(F.lit, ("JPEG", "PNG", "BMP"))), (i % 3 + 1).cast("int"))
    score = metadata_score(i % 2 == 0, software, F.when(i % 4 == 0, F.lit(72)), F.col("n_chars"), i % 900, F.lit(800), kind)
    return docs.select("doc_id", score.cast("int").alias("metadata_score"))


Q36 = """SELECT doc_id, least(4, (doc_id % 2 <> 0)::INT + 2 * (doc_id % 7 = 0)::INT + (doc_id % 4 <> 0)::INT + coalesce(n_chars < 20000, false)::INT + (doc_id % 900 < 500)::INT + (doc_id % 3 = 2)::INT)::INTEGER AS metadata_score FROM documents"""


def q37_zero_shot_softmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    out = softmax_types(vectors, "embedding", centroids(vectors, "label", "embedding"), 10.0)
    return out.select("vec_id", "label_found", F.round("confidence", 1).alias("confidence"))


SOFTMAX_SQL = """WITH e AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, unnest(range(1, len(embedding) + 1)) AS pos FROM embeddings),
c AS (SELECT label, list(x ORDER BY pos) AS v FROM (SELECT label, pos, avg(x) AS x FROM e GROUP BY ALL) GROUP BY 1),
l AS (SELECT vec_id, c.label, list_inner_product(embedding::DOUBLE[], v) * 10.0::DOUBLE AS z FROM embeddings, c),
p AS (SELECT vec_id, label, exp(z - max(z) OVER w) AS x, row_number() OVER (PARTITION BY vec_id ORDER BY z DESC, label) AS k FROM l WINDOW w AS (PARTITION BY vec_id)),
b AS (SELECT vec_id, max(label) FILTER (WHERE k = 1) AS label_found, round(round(max(x) FILTER (WHERE k = 1) / sum(x) * 100, 2), 1) AS confidence FROM p GROUP BY 1)
"""
Q37 = SOFTMAX_SQL + "SELECT vec_id, label_found::INTEGER AS label_found, confidence FROM b"

TYPES = ("receipt", "dni_front", "dni_back", "card", "homebanking", "unknown")


def q38_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    typed = q37_zero_shot_softmax(spark, sf_dir).withColumn("document_type", F.element_at(F.array(*map(F.lit, TYPES)), (F.col("label_found") % 6 + 1).cast("int")))
    return typed.groupBy("document_type", route(F.col("document_type"), F.col("confidence")).alias("analysis_route")).agg(F.count(F.lit(1)).alias("n"))


Q38 = SOFTMAX_SQL + f""", y AS (SELECT (['{"', '".join(TYPES)}'])[label_found % 6 + 1] AS document_type, confidence FROM b)
SELECT document_type, CASE WHEN document_type IN ('dni_front', 'dni_back', 'card') AND confidence >= 45 THEN 'category_only' ELSE 'receipt_control' END AS analysis_route, count(*) AS n FROM y GROUP BY ALL"""


_SQL = {"q01": Q01, "q02": Q02, "q03": Q03, "q04": Q04, "q06": Q06, "q07": Q07, "q09": Q09, "q10": Q10, "q11": Q11, "q12": Q12, "q13": Q13, "q14": Q14, "q15": Q15, "q16": Q16, "q19": Q19, "q20": Q20, "q22": Q22, "q28": Q28, "q29": Q29, "q31": Q31, "q33": Q33, "q36": Q36, "q37": Q37, "q38": Q38}
QUERIES = {name: f for name, f in list(globals().items()) if name[:1] == "q" and name[1:3].isdigit()}
ORACLE_SQL = {name: _SQL[name[:3]] for name in QUERIES if name[:3] in _SQL}
