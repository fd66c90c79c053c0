import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from foliospark.operators import pixels
from foliospark.operators.consistency import receipt_consistency
from foliospark.operators.typography import describe_field, odd_fields, typography_outliers
from foliospark.plans import table_queries
from tests.test_forensic import rows
from tests.test_receipt_tables import frame, words


@pytest.mark.parametrize("name", sorted(table_queries.ORACLE_SQL))
@pytest.mark.parametrize("sf", ["0.001", "0.01"])
def test_query_equals_sql(spark, name, sf):
    con = duckdb.connect()
    folder = f"/root/testdata/sf{sf}"
    for t in ("lineitem", "orders", "events", "part"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    got, want = table_queries.QUERIES[name](spark, folder).toPandas(), con.execute(table_queries.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert len(got) and rows(got) == rows(want)


def consistency(spark, text, confidence, lines=()):
    docs = frame(spark, [[words("x"), *lines]])
    made = docs.select(F.lit(text).cast("string").alias("t"), F.lit(confidence).cast("double").alias("c"), "lines")
    return made.select(receipt_consistency(F.col("t"), F.col("c"), F.col("lines")).alias("r")).first()["r"]


def test_consistency(spark):
    r = consistency(spark, "TOTAL HABERES 1.000,00 TOTAL DESCUENTOS 100,00 NETO 900,00", 80)
    assert (r.consistency_score, r.expected_net, [d.label for d in r.differences], r.unreadable) == (1, 900.0, ["neto_vs_haberes_menos_descuentos"], [])
    assert r.signals == ["neto_vs_haberes_menos_descuentos consistente (delta 0.00).", "Se detectaron suficientes montos clave para validar el recibo."]
    # Two amounts and their difference are three fields already.
    assert consistency(spark, "TOTAL HABERES 1.000,00 TOTAL DESCUENTOS 100,00", 80).consistency_score == 1
    assert consistency(spark, "TOTAL HABERES 1.000,00 TOTAL DESCUENTOS 100,00 NETO 880,00", 80).consistency_score == 2
    assert consistency(spark, "TOTAL HABERES 1.000,00 TOTAL DESCUENTOS 100,00 NETO 800,00", 80).consistency_score == 3
    far = consistency(spark, "TOTAL HABERES 10.000,00 TOTAL DESCUENTOS 100,00 NETO 90,00", 80)
    assert far.differences == [] and "no se pudo comparar" in far.signals[0]
    odd = consistency(spark, "NETO ilegible", 80)
    assert (odd.consistency_score, odd.unreadable, odd.detected) == (2, ["neto"], False) and "(80.0%)" in odd.signals[0]
    poor = consistency(spark, "NETO ilegible", 40)
    assert (poor.consistency_score, poor.unreadable) == (1, [])
    below = consistency(spark, "TOTAL LIQUIDO", 80, [[("TOTAL", 0, 40), ("LIQUIDO", 45, 100)], [("5,00", 40, 80)]])
    assert below["values"].liquido == 5.0 and below.signals == ["Montos clave coherentes en la muestra OCR."]
    periods = consistency(spark, "Periodo Abonado 05/2024 y despues Sueldo mes 06/2024", 80)
    assert (periods.consistency_score, periods.detected) == (2, True)
    loose = consistency(spark, "Periodo Liquidado 05/2024", 80)  # the label of the net to be paid is found in "Liquidado"
    assert (loose.consistency_score, loose.unreadable) == (2, ["neto_a_cobrar"])
    for text in (None, "", "sin nada"):
        r = consistency(spark, text, None)
        assert (r.detected, r.consistency_score, r.signals, r.periods) == (False, 0, [], [])


def test_typography(spark):
    def entry(d, i, bucket="amounts", **odd):
        return (d, bucket, i, *({"height": 20.0, "ink_ratio": 0.2, "slant_angle": 5.0, "aspect_ratio": 0.6} | odd).values(), True, True, f"t{i}")

    data = [entry(1, i) for i in range(8)] + [entry(1, 8, height=60.0, ink_ratio=0.6)]  # two features apart
    data += [entry(2, i) for i in range(8)] + [entry(2, 8, height=60.0)]  # one is not enough
    data += [entry(3, i) for i in range(3)] + [entry(3, 3, height=60.0, ink_ratio=0.6)]  # too few of a kind
    data += [entry(4, i, "dates") for i in range(2)] + [entry(4, 2, "dates", height=60.0, ink_ratio=0.6)]
    data += [entry(5, i) for i in range(8)] + [entry(5, 8, height=28.0, ink_ratio=0.35)]  # odd, but not strong
    fields = spark.createDataFrame([*data, (6, None, 0, 1.0, 1.0, 1.0, 1.0, None, None, None)], "doc int, bucket string, i int, height double, ink_ratio double, slant_angle double, aspect_ratio double, shape_reliable boolean, is_key boolean, text string")
    scored = typography_outliers(fields, "doc", "bucket", ["i"], F.lit(False))
    assert {(r.doc, r.i) for r in scored.filter("typography_anomaly").collect()} == {(1, 8), (4, 2), (5, 8)}
    assert {r.doc for r in scored.select("doc").distinct().collect()} == {1, 2, 4, 5}
    found = {r.doc: r for r in odd_fields(scored, "doc", ["i"], "is_key", "text", F.lit(False)).select("*", describe_field(F.col("first_key")).alias("said")).collect()}
    assert found[1].strong_key.text == "t8" and found[5].strong_key is None and found[4].strong_key is None and found[5].first_key.text == "t8"
    assert found[1].said == "altura de letra distinta en 't8' (z-score 26.98)"
    photo = typography_outliers(fields.filter("doc = 5"), "doc", "bucket", ["i"], F.lit(True))
    assert photo.filter("typography_anomaly").count() == 1 and typography_outliers(fields.limit(0), "doc", "bucket", ["i"], F.lit(True)).count() == 0


def test_regions(spark):
    page = np.full((60, 120), 240, np.uint8)
    page[20:40, 20:22] = page[20:40, 30:32] = 10
    page[20, 20] = 30  # the threshold is this level, and ink lies below it
    dark = page.copy()
    dark[10:50, 60:115] = 40
    dark[20:40, 70:74] = 250
    dark[20, 70] = 60
    assert 239 < pixels.background_mean(page, (18, 18, 34, 42)) < 240 and pixels.measure_region(page, (18, 18, 34, 42))["highlighted"] is False
    found = pixels.measure_region(dark, (64, 16, 110, 44))
    assert found["highlighted"] and found["ink_masked"] and found["level"] >= 1
    f = pixels.crop_features(page, (18, 18, 34, 42))
    assert f["shape_reliable"] and abs(f["aspect_ratio"] - 0.1) < 1e-9 and abs(f["slant_angle"]) <= 90 and f["mean_ink"] == 10 and f["ink_std"] == 0 and f["height"] == 30
    assert pixels.crop_features(page, (0, 0, 1, 1)) is None and pixels.crop_features(page, (80, 5, 110, 15)) is None
    assert pixels.pad_box((5, 5, 115, 58), 120, 60, 14) == (0, 0, 120, 60)
    boxes = F.array(F.struct(F.lit(18).alias("x1"), F.lit(18).alias("y1"), F.lit(34).alias("x2"), F.lit(42).alias("y2")), F.lit(None).cast("struct<x1:int,y1:int,x2:int,y2:int>"))
    got = spark.createDataFrame([(page.tobytes(),), (None,)], "p binary").select(pixels.measure_regions(F.col("p"), F.lit(120), boxes).alias("m")).collect()
    assert got[0].m[0].level == pixels.measure_region(page, (18, 18, 34, 42))["level"] and got[0].m[1] is None and got[1].m is None
    heat = pixels.heat_map(np.random.default_rng(2).integers(0, 256, (20, 20)).astype(np.uint8))
    assert heat.max() == 255 and pixels.heat_map(np.full((8, 8), 200, np.uint8)).max() <= 255
    box = spark.sql("SELECT array(struct(1.9 AS x, 2.0 AS y), struct(9.9 AS x, 7.2 AS y)) AS g").select(pixels.polygon_box(F.col("g"), 2.0).alias("b")).first()["b"]
    assert tuple(box) == (3, 4, 19, 14)
    assert (pixels.grey_of(np.array([[[255, 255, 255], [255, 0, 0]]], np.uint8)) == [[255, 76]]).all()


@pytest.mark.parametrize("mode", ["small", "empty"])
def test_components_against_flood_fill(mode):
    rng = np.random.default_rng(5)
    masks = [rng.random((rng.integers(1, 12), rng.integers(1, 12))) < p for p in (0.2, 0.4, 0.6) for _ in range(40)] if mode == "small" else [np.zeros((3, 4), bool)]
    for mask in masks:
        seen, want = np.zeros_like(mask), []
        for at in zip(*map(np.ndarray.tolist, np.nonzero(mask)), strict=True):
            if not seen[at]:
                part, todo = [], [at]
                seen[at] = True
                while todo:
                    y, x = todo.pop()
                    part.append((y, x))
                    for q in ((y + i, x + j) for i in (-1, 0, 1) for j in (-1, 0, 1)):
                        if 0 <= q[0] < mask.shape[0] and 0 <= q[1] < mask.shape[1] and mask[q] and not seen[q]:
                            seen[q] = True
                            todo.append(q)
                want.append(sorted(part))
        assert [sorted(zip(ys.tolist(), xs.tolist(), strict=True)) for ys, xs in pixels.connected_components(mask)] == want
