"""The whole verdict over the test tables, with its DuckDB SQL.

Orders stand for documents and their lines for regions and fields at the same places.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.operators.typography import SHOWN
from foliospark.plans import triage as t
from foliospark.plans.decision import FLOORS, WEIGHTS
from foliospark.plans.queries import GLOBAL_SQL, _loo_sql
from foliospark.plans.receipt_queries import _table
from foliospark.plans.table_queries import LINE_SQL, Q05_SQL, _fields, _lines


def verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order through ``triage``."""
    lines = _lines(spark, sf_dir)
    at = lines.select("l_orderkey", F.col("place").alias("ord"), F.col("l_quantity").alias("cx"), (F.col("place") * 3).alias("cy"), "l_returnflag", "l_linestatus")
    regions = at.select("l_orderkey", "ord", F.concat(F.lit("f"), "ord").alias("text"), "cx", "cy", F.col("cx").cast("int").alias("level"), (F.col("l_returnflag") == "R").alias("is_key"), (F.col("l_linestatus") == "O").alias("highlighted"))
    fields = _fields(spark, sf_dir).withColumnsRenamed({"place": "ord", "is_key_field": "is_key"}).join(at.select("l_orderkey", "ord", "cx", "cy"), ["l_orderkey", "ord"])
    key, some = F.col("o_orderkey"), F.col("o_custkey")
    orders = _table(spark, sf_dir, "orders").select(
        key.alias("l_orderkey"), (key % 3 == 0).alias("photo"), (key % 61).cast("int").alias("page_level"), (key % 60 + 30.25).alias("mean_confidence"), (key % 5).alias("ocr_points"), (some % 5).alias("metadata_points"), F.greatest(some % 9 - 4, F.lit(0)).alias("consistency_points"),
        F.when(key % 5 > 2, F.array(F.lit("o1"), F.lit("o2"), F.lit("o3"))).alias("ocr_signals"), F.when(some % 5 > 0, F.array(F.lit("m1"), F.lit("m1"))).alias("metadata_signals"), F.when(some % 9 == 6, F.array(F.lit("c1"))).otherwise(F.array().cast("array<string>")).alias("consistency_signals"),
        F.when(some % 13 == 0, F.array(F.lit("Neto"), F.lit("Total"))).alias("unreadable_labels"),
    )
    return t.triage(orders, regions, fields, "l_orderkey")


def q50_triage(spark: SparkSession, sf_dir: str) -> DataFrame:
    item = F.transform("evidence", lambda e: F.concat_ws(" => ", e["text"], e["contribution"]))
    return verdicts(spark, sf_dir).select("l_orderkey", "score", "risk_band", "risk_label", "primary_reason", F.array_join(item, "\n").alias("evidence"))


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _one(value: str) -> str:
    return f"format('{{:.1f}}', {value})"


def _floor_sql(name: str) -> str:
    floor = f"{FLOORS[name]:.0f}"
    return f"CASE WHEN abs(raw - {floor}) < 1e-6 THEN replace({_q(t.APPLIED.replace('%d', floor))}, '%s', {_one('base')}) ELSE replace({_q(t.NOT_DECISIVE.replace('%d', floor))}, '%s', {_one('raw')}) END"


def _component_sql(name: str) -> str:
    head, middle, tail = t.INCLUDED.replace("%s", name, 1).replace("%%", "%").split("%s")
    points = f"format('{{:+.1f}}', format('{{:.2f}}', {WEIGHTS[name]}::DOUBLE * {name})::DOUBLE)"
    return f"{_q(head)} || {points} || {_q(middle.replace('%d', f'{WEIGHTS[name] * 100:.0f}'))} || {_one(name)} || {_q(tail)}"


def _between(ends: tuple[str, str], value: str) -> str:
    return f"{_q(ends[0])} || {value} || {_q(ends[1])}"


_SHOWN = "CASE dominant_feature " + " ".join(f"WHEN {_q(k)} THEN {_q(v)}" for k, v in SHOWN.items()) + " END || ' distinta en ''f' || place || ''' (z-score ' || max_abs_z || ')'"
_FLOOR_LINES = (
    ("corroborated", "corroborated", _between(t.CORROBORATED, "corroborated_text")), ("strong_typography", "strong_key IS NOT NULL", _between(t.STRONG_TYPOGRAPHY, "strong_key")), ("ela_plus_other", "eo", _q(t.ELA_PLUS_OTHER)),
    ("strong_ela_alone", "ke >= 2", _q(t.STRONG_ELA)), ("cross_family", "cf", _q(t.CROSS_FAMILY)), ("unreadable", "unreadable", _between(t.UNREADABLE, "'Neto, Total'")),
)
_LINES = [(f"CASE WHEN {c} THEN {text} END", _floor_sql(name)) for name, c, text in _FLOOR_LINES] + [
    ("CASE risk_band " + " ".join(f"WHEN {_q(k)} THEN {_q(v)}" for k, v in t.LEVELS.items()) + " END", _q(t.LEVEL_NOTE)),
    (f"CASE WHEN local_ela >= 70 THEN {_q(t.LOCAL_STRONG)} WHEN local_ela >= 40 THEN {_q(t.LOCAL_SOME)} END", _component_sql("local_ela")),
    (f"CASE WHEN ke >= 2 THEN {_q(t.KEY_MANY)} WHEN ke = 1 THEN {_q(t.KEY_ONE)} END", _component_sql("local_ela")),
    (f"upper(first_key[1]) || lower(first_key[2:]) || {_q(t.IN_KEY_FIELD)}", _component_sql("typography")),
    (f"CASE WHEN mean_confidence < 45 THEN replace({_q(t.LOW_READING.replace('%%', '%'))}, '%s', {_one('mean_confidence')}) END", _component_sql("ocr")),
    (f"CASE WHEN points >= 3 THEN {_q(t.ARITHMETIC)} WHEN points >= 1 THEN {_q(t.ARITHMETIC_SLIGHT)} END", _component_sql("receipt_consistency")),
    ("CASE WHEN o_custkey % 5 > 0 THEN 'm1' END", _q(t.METADATA_NOTE)),
    ("CASE WHEN o_orderkey % 5 > 2 THEN 'o1' END", _component_sql("ocr")), ("CASE WHEN o_orderkey % 5 > 2 THEN 'o2' END", _component_sql("ocr")),
    ("CASE WHEN o_custkey % 9 = 6 THEN 'c1' END", _component_sql("receipt_consistency")),
]
_CAUSES = {"local_ela": _between(t.REASON_LOCAL, f"coalesce(top_text, {_q(t.NO_TEXT)})"), "typography": "coalesce(first_key, first_odd)", "receipt_consistency": f"CASE WHEN o_custkey % 9 = 6 THEN 'c1' ELSE {_q(t.REASON_DEFAULTS['receipt_consistency'])} END", "ocr": f"CASE WHEN o_orderkey % 5 > 2 THEN 'o1' ELSE {_q(t.REASON_DEFAULTS['ocr'])} END", "global_ela": _q(t.REASON_DEFAULTS["global_ela"])}
_BEST = "greatest(" + ", ".join(f"{WEIGHTS[k]}::DOUBLE * {k}" for k in _CAUSES) + ")"
_STRONGEST = sorted(_FLOOR_LINES, key=lambda x: -FLOORS[x[0]])

Q50 = f"""WITH ty AS ({Q05_SQL} SELECT * FROM sc), ln AS (WITH {LINE_SQL} SELECT * FROM ln),
an AS (SELECT ty.*, ln.l_quantity AS cx, place * 3 AS cy, ty.l_suppkey % 2 = 0 AS is_key, max_abs_z >= CASE WHEN ty.l_orderkey % 3 = 0 THEN 13 ELSE 10 END AND bucket_size >= 8 AS strong, {_SHOWN} AS shown FROM ty JOIN ln USING (l_orderkey, place) WHERE agreeing >= 2),
od AS (SELECT l_orderkey, count(*) FILTER (WHERE is_key) AS kt, count(*) FILTER (WHERE NOT is_key) AS ot, first(shown ORDER BY max_abs_z DESC, bucket, place) AS first_odd, first(shown ORDER BY max_abs_z DESC, bucket, place) FILTER (WHERE is_key) AS first_key, first(shown ORDER BY max_abs_z DESC, bucket, place) FILTER (WHERE is_key AND strong) AS strong_key FROM an GROUP BY 1),
cal AS (WITH {_loo_sql("l_quantity::INTEGER", "1.0", "l_linestatus <> 'O'", ", place, l_returnflag = 'R' AS is_key, l_quantity AS cx").replace("FROM lineitem", "FROM ln")} SELECT l_orderkey, place, is_key, cx, v AS level, CASE WHEN n_ok >= 6 AND ok THEN v > 20 AND z > 2.5 ELSE v > 20 END AS anomaly FROM z),
rs AS (SELECT *, CASE WHEN is_key THEN 1.45::DOUBLE ELSE 1.0::DOUBLE END AS k, CASE WHEN anomaly THEN least((78.0::DOUBLE + (level - 20) * 1.5::DOUBLE) * k, 100.0::DOUBLE) WHEN level > 20 THEN 30.0::DOUBLE * k WHEN 20 - level <= 4 THEN (10.0::DOUBLE + greatest(0, 4 - (20 - level)) * 2.0::DOUBLE) * k ELSE 0.0::DOUBLE END AS pts FROM cal),
rk AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY pts DESC, place) AS nth FROM rs),
lc AS (SELECT l_orderkey, least(coalesce(max(pts) FILTER (WHERE nth = 1), 0.0::DOUBLE) * 1.0::DOUBLE + coalesce(max(pts) FILTER (WHERE nth = 2), 0.0::DOUBLE) * 0.7::DOUBLE + coalesce(max(pts) FILTER (WHERE nth = 3), 0.0::DOUBLE) * 0.5::DOUBLE + coalesce(max(pts) FILTER (WHERE nth = 4), 0.0::DOUBLE) * 0.3::DOUBLE, 100.0::DOUBLE) AS total,
  max('f' || place) FILTER (WHERE nth = 1 AND pts > 0) AS top_text, count(*) FILTER (WHERE anomaly AND is_key) AS ke FROM rk GROUP BY 1),
co AS (SELECT r.l_orderkey, 'f' || min(r.place) AS corroborated_text FROM cal r JOIN an a ON a.l_orderkey = r.l_orderkey AND r.anomaly AND r.is_key AND a.is_key AND abs(r.cx - a.cx) <= 6 AND abs(r.place * 3 - a.cy) <= 6 GROUP BY 1),
d0 AS (SELECT o_orderkey, o_custkey, coalesce(total, 0.0::DOUBLE) AS local_ela, top_text, coalesce(ke, 0) AS ke, coalesce(kt, 0) AS kt, coalesce(ot, 0) AS ot, first_odd, first_key, strong_key, corroborated_text, corroborated_text IS NOT NULL AS corroborated, o_orderkey % 60 + 30.25::DOUBLE AS mean_confidence, greatest(o_custkey % 9 - 4, 0) AS points, o_custkey % 13 = 0 AS unreadable, {GLOBAL_SQL}::DOUBLE AS global_ela
  FROM orders LEFT JOIN lc ON lc.l_orderkey = o_orderkey LEFT JOIN od ON od.l_orderkey = o_orderkey LEFT JOIN co ON co.l_orderkey = o_orderkey),
d1 AS (SELECT *, least(kt * 35.0::DOUBLE + ot * 15.0::DOUBLE, 100.0::DOUBLE) AS typography, least(points * 25.0::DOUBLE, 100.0::DOUBLE) AS receipt_consistency, least((o_orderkey % 5) * 25.0::DOUBLE, 100.0::DOUBLE) AS ocr, points >= 3 AND kt > 0 AND NOT ke > 0 AS cf, ke > 0 AND (points >= 3 OR kt > 0 OR unreadable) AS eo FROM d0),
d2 AS (SELECT *, least({" + ".join(f"format('{{:.2f}}', {WEIGHTS[k]}::DOUBLE * {k})::DOUBLE" for k in _CAUSES)}, 100.0::DOUBLE) AS base, {_BEST} AS best FROM d1),
d3 AS (SELECT *, greatest(base, {", ".join(f"CASE WHEN {c} THEN {FLOORS[n]}::DOUBLE ELSE 0.0::DOUBLE END" for n, c, _ in _FLOOR_LINES)}) AS raw, CASE WHEN raw >= 60 THEN 'altamente_sospechoso' WHEN raw >= 25 THEN 'sospechoso' ELSE 'poco_sospechoso' END AS risk_band FROM d2)
SELECT o_orderkey AS l_orderkey, format('{{:.2f}}', raw)::DOUBLE AS score, risk_band, CASE risk_band {" ".join(f"WHEN {_q(k)} THEN {_q(v)}" for k, v in t.LABELS.items())} END AS risk_label,
  CASE {" ".join(f"WHEN {c} THEN {text}" for _, c, text in _STRONGEST)} WHEN best <= 0.5 THEN {_q(t.NO_REASON)} {" ".join(f"WHEN best = {WEIGHTS[k]}::DOUBLE * {k} THEN {_between(t.REASON, v)}" for k, v in _CAUSES.items())} END AS primary_reason,
  concat_ws(chr(10), {", ".join(f"({a}) || ' => ' || {b}" for a, b in _LINES)}) AS evidence FROM d3"""

QUERIES = {"q50_triage": q50_triage}
ORACLE_SQL = {"q50_triage": Q50}
