import numpy as np
from pyspark.sql import functions as F

from foliospark.operators import pixels
from foliospark.plans import table_queries


def test_stacks_measure_as_single_images():
    rng = np.random.default_rng(3)
    sizes = [(48, 64), (17, 21), (48, 64), (5, 3), (0, 8), (17, 21)]
    images = [rng.integers(0, 256, s).astype(np.uint8) for s in sizes]
    got = pixels.error_levels([*(x.tobytes() for x in images), None, b"1"], [*(w for _, w in sizes), 4, None])
    assert got == [*(pixels.error_level(x) for x in images), None, None]


def test_images_are_dealt_out_and_drawn_as_columns(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(table_queries, "IMAGES", 8)
    rows = [(k, s) for k in (0, 1, 13, 89, 719, 90_000_000_007) for s in (0, 1, 49, None)] + [(-5, 7), (None, 3), (13, 49)]
    spark.createDataFrame(rows, "p_partkey long, p_size int").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    drawn = table_queries._images(spark, str(tmp_path))
    assert drawn.select(F.spark_partition_id().alias("p")).distinct().count() == 4

    x, y = F.col("p_partkey"), F.col("p_size")

    def pixel(k):
        col, row = k % 64, F.floor(k / 64)
        stroke = ((col + x) % 8 < 2 + y % 3) & row.between(12 + x % 5, 30)
        return F.when(stroke, x % 90).otherwise(F.lit(250) - (row * (x % 7) + col) % 5).cast("int")

    values = F.transform(F.sequence(F.lit(0), F.lit(64 * 48 - 1)), lambda k: F.lpad(F.hex(pixel(k).cast("long")), 2, "0"))
    want = spark.createDataFrame(rows, "p_partkey long, p_size int").select("p_partkey", F.unhex(F.array_join(values, "")).alias("pixels"))
    order = lambda df: sorted(map(tuple, df.collect()), key=str)
    assert order(drawn) == order(want)


def test_a_field_is_split_once(monkeypatch):
    calls = []
    split = pixels.ink_mask
    monkeypatch.setattr(pixels, "ink_mask", lambda grey: calls.append(1) or split(grey))
    page = np.full((40, 60), 250, np.uint8)
    page[12:20, 10:30:3] = 20
    page[12:20, 10] = 30
    found = pixels.measure_region(page, [8, 10, 34, 22])
    assert len(calls) == 1 and not found["highlighted"] and found["shape_reliable"]
    assert found["ink_ratio"] == pixels.crop_features(page, [8, 10, 34, 22])["ink_ratio"]
