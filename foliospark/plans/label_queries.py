"""Registered queries of label lookups, reading suspicion, reports and responses, and DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.functions import receipt, report
from foliospark.functions.text import is_numeric
from foliospark.operators import labelled
from foliospark.operators.candidates import CRITICAL_KEYWORDS, contains_any, reading_suspicion
from foliospark.plans.receipt_queries import _money, _money_sql, _sql_list, _table


def _tokens(*words: tuple[int, Column | str, int, int]) -> Column:
    return F.array(*(F.struct(F.lit(line).alias("line"), F.lit(i).alias("idx"), (w if isinstance(w, Column) else F.lit(w)).alias("token"), F.lit(x1).alias("x1"), F.lit(x2).alias("x2")) for i, (line, w, x1, x2) in enumerate(words)))


def printed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order as a receipt: a two-line table, labels beside values, an identity line, or a bare number."""
    digits = F.lpad((F.col("o_orderkey") % 100_000_000).cast("string"), 8, "0")
    dashed, plain, style = F.concat(F.lit("20-"), digits, F.lit("-3")), F.concat(F.lit("27"), digits, F.lit("9")), F.col("o_orderkey") % 4
    table = _tokens((0, "Titular", 0, 60), (0, "CUIL", 200, 240), (0, "Total", 320, 350), (0, "Liquido", 355, 400), (1, "Ana", 0, 40), (1, "Lopez", 45, 150), (1, dashed, 195, 290), (1, _money("o_totalprice"), 325, 395))
    beside = _tokens((0, "CUIL:", 0, 40), (0, dashed, 50, 140), (1, "Titular:", 0, 60), (1, "Eva", 70, 100), (1, "Ruiz", 105, 150))
    identity = _tokens((0, "Personal", 0, 60), (0, "DNI", 70, 90), (0, "25985232", 95, 160), (0, "SOSA", 170, 210), (0, "INES", 215, 250), (0, "CUIL", 260, 290), (0, plain, 300, 380))
    printed = F.when(style == 0, table).when(style == 1, beside).when(style == 2, identity).otherwise(_tokens((0, "Pago", 0, 40), (0, plain, 50, 140)))
    rows = _table(spark, sf_dir, "orders").select("o_orderkey", F.inline(printed))
    return labelled.token_lines(rows.withColumn("top", F.col("line") * 20 + 10), "o_orderkey", "line", "idx", "token", "x1", "x2", "top")


def q17_labelled_tax_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labelled.tax_numbers(printed_lines(spark, sf_dir), "o_orderkey")


Q17 = """SELECT o_orderkey, CASE WHEN o_orderkey % 4 < 2 THEN '20-' || lpad((o_orderkey % 100000000)::VARCHAR, 8, '0') || '-3' ELSE '27' || lpad((o_orderkey % 100000000)::VARCHAR, 8, '0') || '9' END AS tax_number FROM orders"""


def q18_table_amount(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labelled.table_amount(printed_lines(spark, sf_dir), "o_orderkey", receipt.AMOUNT_LABELS["liquido"])


Q18 = f"SELECT o_orderkey, round(o_totalprice * 100)::BIGINT / 100.0::DOUBLE AS amount, {_money_sql('o_totalprice')} AS raw FROM orders WHERE o_orderkey % 4 = 0"


def q32_person_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labelled.person_names(printed_lines(spark, sf_dir), "o_orderkey")


Q32 = "SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'Ana Lopez' WHEN 1 THEN 'Eva Ruiz' WHEN 2 THEN 'SOSA INES' END AS person_name FROM orders"


def q44_audit_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    odd = F.col("o_orderkey") % 2 == 1
    evidence = F.array(F.struct(F.lit("Diferencia").alias("text"), F.when(odd, F.lit("piso 75")).alias("contribution")))
    ela = F.when(odd, F.array(F.struct(F.lit("Neto").alias("text"), F.col("o_custkey").alias("max_difference"), F.lit(None).cast("double").alias("z"))))
    fields = F.when(~odd, F.array(F.struct(F.lit("Total").alias("text"), F.lit("slant").alias("feature"), F.lit(4.5).alias("z"))))
    route = F.when(F.col("o_orderkey") % 5 == 0, "category_only").otherwise("receipt_control")
    text = report.audit_report(F.concat("o_orderkey", F.lit(".png")), F.lit("receipt"), F.lit(90.0), route, (F.col("o_custkey") % 100).cast("double"), F.lit("Sospechoso"), F.when(odd, F.lit(2.0)), F.when(odd, F.lit("corroborated")), evidence, ela, fields, F.array().cast("array<string>"))
    return _table(spark, sf_dir, "orders").select("o_orderkey", text.alias("report"))


Q44 = f"""SELECT o_orderkey, '{report.TITLE}' || o_orderkey || '.png' || chr(10) || repeat('=', 50) || chr(10) || 'Tipo de documento: receipt (90.0%)' || chr(10) || 'Ruta de análisis: ' ||
  CASE WHEN o_orderkey % 5 = 0 THEN 'category_only' || chr(10) || '{report.NO_CONTROL}' ELSE 'receipt_control' || chr(10) || 'Score de sospecha: ' || (o_custkey % 100) || '.0/100 — Sospechoso' || chr(10)
  || CASE WHEN o_orderkey % 2 = 1 THEN 'Tiempo total de análisis: 2.00s' || chr(10) || chr(10) || '{report.REASON}' || chr(10) || '  corroborated' || chr(10) ELSE '' END || chr(10) || '{report.EVIDENCE}' || chr(10) || '  - Diferencia' || chr(10)
  || CASE WHEN o_orderkey % 2 = 1 THEN '      ↳ piso 75' || chr(10) || chr(10) || '{report.ELA}' || chr(10) || '  - ''Neto'' (diff=' || o_custkey || ', z relativo=None)' ELSE chr(10) || '{report.TYPOGRAPHY}' || chr(10) || '  - ''Total'' — señal dominante: slant (z=4.5)' END END AS report FROM orders"""


def q45_response_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    route = F.when(F.col("o_orderkey") % 5 == 0, "category_only").otherwise("receipt_control")
    record = report.response(F.concat("o_orderkey", F.lit(".png")), F.lit("receipt"), F.lit(90.0), route, (F.col("o_custkey") % 100).cast("double"), F.lit("sospechoso"), F.lit("Sospechoso"), F.create_map(F.lit("ocr"), F.lit(25.0)), F.array(F.lit("a"), F.lit("b")))
    sent = _table(spark, sf_dir, "orders").select("o_orderkey", F.to_json(record).alias("j"))
    part = lambda path: F.get_json_object("j", f"$.{path}")
    return sent.select("o_orderkey", part("analysis_route").alias("route"), part("final_decision.score").cast("double").alias("score"), part("final_decision.risk_band").alias("band"), part("final_decision.evidence[0]").alias("evidence"), part("diagnostics.file_name").alias("file_name"), part("diagnostics.validation_mode").alias("mode"))


Q45 = f"""SELECT o_orderkey, CASE WHEN c THEN 'category_only' ELSE 'receipt_control' END AS route, CASE WHEN NOT c THEN (o_custkey % 100)::DOUBLE END AS score, CASE WHEN c THEN '{report.CATEGORY_BAND}' ELSE 'sospechoso' END AS band,
  CASE WHEN c THEN '{report.CATEGORY_EVIDENCE}' ELSE 'a' END AS evidence, o_orderkey || '.png' AS file_name, CASE WHEN c THEN 'category-only' ELSE 'receipt-control' END AS mode FROM (SELECT *, o_orderkey % 5 = 0 AS c FROM orders)"""


def q47_reading_suspicion(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.filter(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    docs = _table(spark, sf_dir, "documents").select("doc_id", words.alias("w"))
    hits = F.size(F.filter("w", lambda w: contains_any(F.lower(w), CRITICAL_KEYWORDS)))
    counted = docs.select("doc_id", F.size("w").alias("n"), F.size(F.filter("w", is_numeric)).alias("k"), hits.alias("h"), (F.col("doc_id") % 80 + 20).cast("double").alias("c"))
    return counted.select("doc_id", reading_suspicion(F.col("n"), F.col("k"), F.col("h"), F.col("c")).alias("suspicion"))


Q47 = f"""WITH d AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w, {_sql_list(CRITICAL_KEYWORDS)} AS ks, (doc_id % 80 + 20) AS c FROM documents),
s AS (SELECT doc_id, c, len(w) AS n, len(list_filter(w, lambda x: regexp_matches(x, '[0-9]'))) AS k, len(list_filter(w, lambda x: len(list_filter(ks, lambda y: contains(lower(x), y))) > 0)) AS h FROM d),
t AS (SELECT *, n >= 8 OR h >= 2 OR k >= 3 AS doc FROM s)
SELECT doc_id, (CASE WHEN n = 0 THEN 2 WHEN doc THEN (h = 0)::INT + (c < 45)::INT ELSE (c < 35)::INT END + (doc AND k = 0)::INT)::INTEGER AS suspicion FROM t"""

_SQL = {"q17": Q17, "q18": Q18, "q32": Q32, "q44": Q44, "q45": Q45, "q47": Q47}
QUERIES = {name: f for name, f in list(globals().items()) if name[:1] == "q" and name[1:3].isdigit()}
ORACLE_SQL = {name: _SQL[name[:3]] for name in QUERIES}
