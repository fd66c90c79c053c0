import duckdb
import pytest
from pyspark.sql import functions as F

from foliospark.functions import receipt
from foliospark.operators.candidates import candidates, ranked_candidates, split_columns, token_summary
from foliospark.plans import receipt_queries
from tests.test_forensic import SF, rows


@pytest.mark.parametrize("name", sorted(receipt_queries.QUERIES))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("lineitem", "orders", "documents"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got, want = receipt_queries.QUERIES[name](spark, SF).toPandas(), con.execute(receipt_queries.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_periods(spark):
    cases = {
        "Periodo Liquidado 05/2024": ([(5, 2024)], 0),
        "Periodo Abonado 2405": ([(5, 2024)], 0),
        "Periodo Abonado 9812": ([(12, 1998)], 0),
        "Sueldo Mes mayo 2024": ([(5, 2024)], 0),
        "Sueldo Mes mayo": ([], 0),
        "Periodo Liquidado 05/2024 y luego Periodo Abonado 06/2024": ([(5, 2024), (6, 2024)], 2),
        "Periodo desde 05/2024": ([], 0),
        "recibo 123405": ([], 0),
        "": ([], 0),
    }
    frame = spark.createDataFrame([(t,) for t in cases], "text string").select("text", receipt.periods(F.col("text")).alias("p"))
    for r in frame.select("text", "p", receipt.period_score(F.col("p")).alias("s")).collect():
        assert ([tuple(p["period"]) for p in r["p"]], r["s"]) == cases[r["text"]]
    assert spark.createDataFrame([(None,)], "text string").select(receipt.period_score(receipt.periods(F.col("text")))).first()[0] == 0


def test_spans_are_characters(spark):
    found = spark.createDataFrame([("\U0001f600 ab ñ ab",)], "text string").select(receipt.spans(F.col("text"), "ab").alias("s")).first()["s"]
    assert [tuple(m) for m in found] == [("ab", 2, 4), ("ab", 7, 9)]


def test_amount_after(spark):
    cases = {
        "TOTAL HABERES $ 1.234,56": (1234.56, "$ 1.234,56", True),
        "HABERES (1,00)": (-1.0, "(1,00)", True),
        "HABERES 53558199": (None, None, True),
        "RECIBO DE HABERES 1,00": (None, None, False),
        "HABERES ilegible " + "x" * 120 + " 1,00": (None, None, True),
        None: (None, None, False),
    }
    frame = spark.createDataFrame([(t,) for t in cases], "text string")
    for r in frame.select("text", receipt.amount_after(F.col("text"), receipt.AMOUNT_LABELS["total_haberes"]).alias("a")).collect():
        assert tuple(r["a"]) == cases[r["text"]]


def test_plausible_amounts_and_buckets(spark):
    cases = {"27": False, "1000": True, "5,20": True, "506029 . 27": True, "abc": False, "": False}
    frame = spark.createDataFrame([(t,) for t in cases], "t string")
    assert {r["t"]: r["p"] for r in frame.select("t", receipt.plausible_amount(F.col("t")).alias("p")).collect()} == cases
    bucket = lambda t, d: spark.sql("SELECT 1").select(receipt.typography_bucket(F.lit(t), F.lit(d), F.lit(True))).first()[0]
    assert [bucket("$ 1.234,56", False), bucket("1234,56", False), bucket("01/02/2024", True)] == ["amounts", None, "dates"]


def test_split_columns(spark):
    tokens = [(1, 0, 0.0, 40.0, 2), (1, 1, 45.0, 90.0, 2), (1, 2, 200.0, 240.0, 2), (2, 0, 0.0, 5.0, 2), (3, 0, 9.0, 12.0, 1), (3, 1, 0.0, 5.0, 1), (4, 0, 0.0, 10.0, 2), (4, 1, 20.0, 30.0, 2), (4, 2, 40.0, 50.0, 2), (5, 0, 0.0, 1.0, 0)]
    out = split_columns(spark.createDataFrame(tokens, "doc int, i int, a double, b double, k int"), "doc", "i", "a", "b", "k")
    assert {(r["doc"], r["i"]): r["column"] for r in out.collect()} == {(1, 0): 0, (1, 1): 0, (1, 2): 1, (3, 0): 0, (3, 1): 0, (4, 0): 0, (4, 1): 1, (4, 2): 1}


def test_candidates(spark):
    tokens = [(1, 0, 0, "Neto"), (1, 0, 1, "1.000,00"), (1, 1, 2, "Acta"), (1, 1, 3, "16/06/19"), (1, 2, 4, "Cliente"), (1, 2, 5, "7"), (1, 2, 6, "8,50"), (1, 3, 7, "CBU"), (1, 3, 8, "342,902.340,25"), (1, 3, 9, "77"), (1, 4, 10, None)]
    frame = spark.createDataFrame(tokens, "doc int, line int, idx int, t string")
    found = ranked_candidates(candidates(frame, "doc", "line", "idx", "t"), "doc", ["idx"], "t").orderBy("place").collect()
    assert [(r["t"], r["type"], r["is_key_field"]) for r in found] == [("1.000,00", "key_numeric", True), ("77", "line_numeric", False), ("8,50", "generic_numeric", False), ("Neto", "key_context", False), ("CBU", "key_context", False)]
    assert candidates(frame.limit(0), "doc", "line", "idx", "t").count() == 0


def test_token_summary(spark):
    frame = spark.createDataFrame([(["Neto", "CBU", "1", "2", "3"], [70.0] * 5), ([], [])], "w array<string>, c array<double>")
    got = [tuple(r["s"]) for r in frame.select(token_summary(F.col("w"), F.col("c")).alias("s")).collect()]
    assert got == [(5, 3, ["Neto", "CBU"], 70.0, 4), (0, 0, [], 0.0, 0)]
