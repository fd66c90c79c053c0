import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from foliospark.functions import scores, text
from foliospark.functions.metadata import metadata_score
from foliospark.operators import pixels
from foliospark.operators.layout import cluster_lines, first_same_field
from foliospark.operators.robust import leave_one_out_z
from foliospark.plans import queries as forensic
from foliospark.sources.images import read_images, split_images
from foliospark.streaming.microbatch import run_stream

SF = "/root/testdata/sf0.001"


def rows(frame):
    columns = sorted(frame.columns)
    return sorted(map(str, frame[columns].astype(object).where(frame[columns].notna(), None).itertuples(index=False, name=None)))


@pytest.mark.parametrize("name", sorted(forensic.QUERIES))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("lineitem", "orders", "events", "embeddings", "documents"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got, want = forensic.QUERIES[name](spark, SF).toPandas(), con.execute(forensic.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


AMOUNTS = {"34,783.45": 34783.45, "(1,00)": -1.0, "1.234": 1.234, "1.234.567": None, "1,234": 1.234, "5-": None, "-7": -7.0, "$ 1.234,56": 1234.56, "abc": None, "": None, None: None, "(": None, "1.": 1.0}


def test_parse_amount(spark):
    df = spark.createDataFrame([(a,) for a in AMOUNTS], "raw string").select("raw", text.parse_amount(F.col("raw")).alias("amount"))
    assert {r.raw: r.amount for r in df.collect()} == AMOUNTS


def test_identifiers(spark):
    df = spark.createDataFrame([("card 4111 1111 1111 1111 and 4111-1111-1111-1111, ** 1234, dni 12345678",)], "t string")
    r = df.select(text.card_numbers("t").alias("c"), text.masked_card_numbers("t").alias("m"), text.document_number(F.col("t")).alias("d"), text.bank_name(F.lit("PAGO BANCO GALICIA")).alias("b")).first()
    assert (r.c, r.m, r.d, r.b) == (["4111111111111111"], ["**1234"], "12345678", "Galicia")
    tokens = spark.createDataFrame([("342,902.340,25",), ("$1$2",), ("1.234,56",)], "t string").select("t", text.is_merged(F.col("t")).alias("m")).collect()
    assert [r.m for r in tokens] == [True, True, False]


def test_scores(spark):
    df = spark.createDataFrame([(100.0, 101.5), (100.0, 104.0), (100.0, 110.0), (100.0, 1001.0), (None, 1.0), (0.0, 5.0)], "e double, o double")
    assert [r[0] for r in df.select(scores.difference_tier(F.col("e"), F.col("o"))).collect()] == ["ok", "leve", "inconsistente", "unreliable", None, "inconsistente"]
    r = spark.range(1).select(metadata_score(F.lit(False), F.lit("GIMP 2"), F.lit(None), F.lit(10), F.lit(10), F.lit(10), F.lit("GIF")).alias("m"), scores.risk_band(F.lit(25.0)).alias("b")).first()
    assert (r.m, r.b) == (4, "sospechoso")


def test_leave_one_out_is_order_free(spark):
    rng = np.random.default_rng(0)
    data = [(int(d), i, float(v)) for i, (d, v) in enumerate(zip(rng.integers(0, 5, 60), rng.normal(10, 3, 60)))] + [(9, 100, 1.0), (9, 101, 5.0)]
    a = leave_one_out_z(spark.createDataFrame(data, "d long, i long, v double"), "d", "v", ["i"]).collect()
    b = leave_one_out_z(spark.createDataFrame(data[::-1], "d long, i long, v double").repartition(7), "d", "v", ["i"]).collect()
    assert sorted(map(str, a)) == sorted(map(str, b))
    for r in a:
        others = np.array([v for d, i, v in data if d == r.d and i != r.i])
        want = 0.0 if len(others) < 2 else abs(0.6745 * (r.v - np.median(others)) / max(1.0, np.median(abs(others - np.median(others)))))
        assert r.z == pytest.approx(want)


def test_geometry(spark):
    tokens = spark.createDataFrame([(1, 0, 10.0, 10.0), (1, 1, 14.0, 10.0), (1, 2, 30.0, 10.0), (1, 3, 33.0, 8.0)], "d long, t long, c double, h double")
    assert {r.t: r.line_no for r in cluster_lines(tokens, "d", "t", "c", "h").collect()} == {0: 0, 1: 0, 2: 1, 3: 1}
    a = spark.createDataFrame([(1, 5, 0.0, 0.0), (1, 7, 50.0, 50.0)], "d long, ord long, cx double, cy double")
    b = spark.createDataFrame([(1, 2, 55.9, 44.1), (1, 1, -6.0, 6.0), (2, 0, 0.0, 0.0)], "d long, ord long, cx double, cy double")
    assert [tuple(r) for r in first_same_field(a, b, "d").collect()] == [(1, 5, 1)]


def test_pixels(spark):
    flat = np.full((20, 30), 200, np.uint8)
    assert pixels.ink_mask(flat) is None and pixels.error_level(flat) == 1
    page = flat.copy()
    page[5:15, 4:6] = 20
    page[5:15, 20:22] = 20
    assert not pixels.ink_mask(page).any()  # two values only: class 0 is counted up to the threshold but masked below it
    parts = pixels.connected_components(page == 20)
    assert [len(ys) for ys, _ in parts] == [20, 20]
    slant, aspect = pixels.component_shape(*parts[0])
    assert abs(abs(slant) - 90) < 1e-6 and aspect == 1 / 5  # width over height
    noisy = np.random.default_rng(1).integers(0, 256, (33, 47)).astype(np.uint8)
    assert pixels.error_level(noisy) > pixels.error_level(page) >= 1
    df = spark.createDataFrame([(noisy.tobytes(), 47), (None, 47)], "px binary, w int").select(pixels.error_level_column(F.col("px"), F.col("w")).alias("e"))
    assert [r.e for r in df.collect()] == [pixels.error_level(noisy), None]


def test_sources_and_stream(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.jpg").write_bytes(b"x" * 10)
    (folder / "b.txt").write_bytes(b"y")
    docs = read_images(spark, str(folder))
    assert [(r.file_name, r.content_type, r.length) for r in docs.collect()] == [("a.jpg", "image/jpeg", 10)]
    ok, rejected = split_images(spark.createDataFrame([("image/png",), ("text/plain",), (None,)], "content_type string"))
    assert (ok.count(), rejected.count()) == (1, 2)
    (tmp_path / "rows").mkdir()
    spark.range(5).write.parquet(f"{tmp_path}/rows/1")
    stream = spark.readStream.schema("id long").parquet(f"{tmp_path}/rows/*")
    run_stream(stream, lambda df: df.withColumn("twice", df.id * 2), f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
    assert sorted(r.twice for r in spark.read.parquet(f"{tmp_path}/out").collect()) == [0, 2, 4, 6, 8]
