import colorsys

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from foliospark.operators import labelled
from foliospark.operators.pixels import capture_mode, capture_mode_column
from foliospark.plans import label_queries
from tests.test_forensic import SF, rows


@pytest.mark.parametrize("name", sorted(label_queries.QUERIES))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("orders", "documents"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got, want = label_queries.QUERIES[name](spark, SF).toPandas(), con.execute(label_queries.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert len(got) and rows(got) == rows(want)


def _lines(spark, data):
    tokens = spark.createDataFrame(data, "doc int, line int, idx int, token string, x1 int, x2 int, top int")
    return labelled.token_lines(tokens, "doc", "line", "idx", "token", "x1", "x2", "top")


def test_column_of_a_label(spark):
    table = [(1, 0, 0, "Titular", 100, 160, 10), (1, 0, 1, "CUIL", 200, 240, 10), (1, 1, 0, "Ana", 95, 130, 30), (1, 1, 1, "Sol", 135, 215, 30), (1, 1, 2, "20-11112222-3", 180, 300, 30)]
    # The last token of the name may reach past the next label's edge by no more than the tolerance.
    assert labelled.person_names(_lines(spark, table), "doc").collect() == [(1, "Ana")]
    # The number starts too far left of its column, so the text decides.
    assert labelled.tax_numbers(_lines(spark, table), "doc").collect() == [(1, "20-11112222-3")]
    assert labelled.tax_numbers(_lines(spark, []), "doc").count() == 0


def test_tax_numbers_prefer_dashes_and_labels(spark):
    texts = ["27259852329 CUIL 20111122223 y CUIL 20-11112222-3", "27259852329 CUIL 20111122223", "x 27259852329 y", "nada", None]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(labelled.tax_number_in_text(F.col("t"))).collect()
    assert [r[0] for r in got] == ["20-11112222-3", "20111122223", "27259852329", None, None]


def test_all_values_and_table_gap(spark):
    data = [(1, 0, 0, "CUIL:", 0, 40, 10), (1, 0, 1, "1", 50, 60, 10), (1, 1, 0, "CUIL:", 0, 40, 30), (1, 1, 1, "2", 50, 60, 30)]
    values = labelled.labelled_values(_lines(spark, data), labelled.TAX_LABEL, lambda v: v.rlike("^[0-9]$"))
    assert labelled.all_values(values, "doc").collect() == [(1, ["1", "2"])]
    far = [(1, 0, 0, "Neto", 0, 40, 10), (1, 1, 0, "5,00", 300, 340, 30), (2, 0, 0, "Neto", 0, 40, 10), (2, 1, 0, "5,00", 50, 90, 30)]
    assert labelled.table_amount(_lines(spark, far), "doc", [r"\bNETO\b"]).collect() == [(2, 5.0, "5,00")]


def test_capture_mode(spark):
    white, red = np.full((40, 30, 3), 255, np.uint8), np.full((40, 30, 3), (200, 20, 20), np.uint8)
    assert capture_mode(white) == ("digital_or_scan", 0.0, 0.0)
    assert capture_mode(red)[0] == "photo" and capture_mode(red)[2] == int(colorsys.rgb_to_hsv(200, 20, 20)[1] * 255)
    corner = white.copy()
    corner[-10:, :10] = 128
    assert capture_mode(corner)[0] == "photo"
    got = spark.createDataFrame([(bytearray(white.tobytes()), 30), (None, 30)], "p binary, w int").select(capture_mode_column(F.col("p"), F.col("w")).alias("c")).select("c.*").collect()
    assert [r["mode"] for r in got] == ["digital_or_scan", "digital_or_scan"] and got[0]["saturation"] == 0.0
