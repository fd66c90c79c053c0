"""Sharding by proportional stratified interleaving, with DataFrame functions only.

Rows of each stratum (source) get a seeded random order. A row's fractional rank says how far
down its stratum's order it stands, from 0 to 1. All rows sorted by it interleave the strata in
proportion, so every run of neighbours has the mixture of the whole. Equal cuts make the shards.

Both ranks are exact and no task holds a whole stratum: rows are counted in equal ranges of the
hashed key (then of the fractional rank), counts are summed up, and rows are numbered per range.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliospark.llm.common import materialise, partition_bits

KEY_BITS = 60


def stratified_shards(docs: DataFrame, n_shards: int = 8, seed: int = 42, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "source") -> DataFrame:
    """One row per row of ``docs``: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    Shards are 0 to ``n_shards`` - 1 with row counts at most one apart (law ``rows``), slots are
    gapless from 0. A null text has no bytes (size 1, checksum 0); a null stratum is a stratum;
    null ids rank like any other; rows that repeat an id take neighbouring ranks. An empty table
    gives an empty result. The same rows get the same shards in any order and partitioning.
    """
    size = (F.coalesce(F.octet_length(text_col), F.lit(0)) + 1).cast("long")
    named = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    key = F.conv(F.substring(F.md5(named), 1, KEY_BITS // 4), 16, 10).cast("long")
    rows = materialise(
        docs.select(F.col(id_col).alias("doc_id"), F.col(stratum_col).cast("string").alias("stratum"), size.alias("size"), F.coalesce(F.crc32(F.col(text_col).cast("binary")), F.lit(0)).cast("long").alias("text_crc32"), key.alias("key")),
        "shard-rows",
    )
    total = rows.count()
    bits = partition_bits(total)
    tie = ["key", "doc_id", "size", "text_crc32"]

    rows = rows.withColumn("range", F.shiftright("key", KEY_BITS - bits))
    per_range = rows.groupBy("stratum", "range").agg(F.count(F.lit(1)).alias("n"))
    up_to = Window.partitionBy("stratum").orderBy("range").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    starts = per_range.select(F.col("stratum").alias("s"), F.col("range").alias("r"), (F.sum("n").over(up_to) - F.col("n")).alias("before"), F.sum("n").over(Window.partitionBy("stratum")).alias("in_stratum"))
    numbered = rows.withColumn("number", F.row_number().over(Window.partitionBy("stratum", "range").orderBy(*tie)))
    ranked = numbered.join(starts, F.col("stratum").eqNullSafe(F.col("s")) & (F.col("range") == F.col("r")))
    fraction = (2 * (F.col("before") + F.col("number")) - 1).cast("double") / (2 * F.col("in_stratum")).cast("double")
    ranked = ranked.select("doc_id", "stratum", "size", "text_crc32", "key", fraction.alias("fraction"))

    ranked = ranked.withColumn("slice", F.floor(F.col("fraction") * F.lit(float(1 << bits))))
    per_slice = ranked.groupBy("slice").agg(F.count(F.lit(1)).alias("n"))
    so_far = Window.orderBy("slice").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # a row per 65,536 documents
    offsets = per_slice.select(F.col("slice").alias("l"), (F.sum("n").over(so_far) - F.col("n")).alias("before"))
    placed = ranked.withColumn("number", F.row_number().over(Window.partitionBy("slice").orderBy("fraction", "stratum", *tie)))
    placed = placed.join(offsets, F.col("slice") == F.col("l")).withColumn("at", F.col("before") + F.col("number") - 1)

    last = max(total, 1)
    shard = F.expr(f"at * {n_shards}L div {last}L")
    start = F.expr(f"((at * {n_shards}L div {last}L) * {last}L + {n_shards - 1}L) div {n_shards}L")
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), shard.cast("int").alias("shard"), (F.col("at") - start).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


#: CRC-32 spelt out in SQL, as DuckDB has no function for it.
SHARD_SQL = """
WITH crc_table AS (
  SELECT list(list_reduce([i] || [0,0,0,0,0,0,0,0]::BIGINT[], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END) ORDER BY i) AS t
  FROM (SELECT unnest(range(256))::BIGINT AS i)
),
d AS (
  SELECT doc_id, source, coalesce(strlen(text), 0) + 1 AS size, coalesce(text, '') AS txt,
         ('0x' || substr(md5('42:' || coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS key
  FROM documents
),
c AS (
  SELECT d.*, xor(4294967295::BIGINT, list_reduce([4294967295::BIGINT] || list_transform(range(1, strlen(txt) + 1), lambda i: ('0x' || substr(hex(encode(txt)), 2 * i - 1, 2))::BIGINT),
         lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1]))) AS crc
  FROM d, crc_table
),
r AS (
  SELECT *, (2 * row_number() OVER (PARTITION BY source ORDER BY key, doc_id, size, crc) - 1)::DOUBLE / (2 * count(*) OVER (PARTITION BY source))::DOUBLE AS fraction FROM c
),
p AS (
  SELECT *, row_number() OVER (ORDER BY fraction, source NULLS FIRST, key, doc_id, size, crc) - 1 AS pos, count(*) OVER () AS n FROM r
)
SELECT doc_id, size::BIGINT AS size, crc AS text_crc32, 'rows' AS law, (pos * 8 // n)::INTEGER AS shard,
       (pos - ((pos * 8 // n) * n + 7) // 8)::BIGINT AS slot, NULL::INTEGER AS grown_shard
FROM p
"""
