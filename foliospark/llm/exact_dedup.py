"""Exact deduplication with counting quotient filters.

Every partition of 64-bit text fingerprints becomes one counting quotient filter, cut into
blocks of neighbouring quotients. Blocks of the same quotients meet in one task and merge by
their sorted remainders, which loses nothing: quotient and remainder together are the whole
fingerprint. Fingerprints counted once are proven unique. The texts of all others are compared
byte by byte, by grouping on the text itself.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.llm.common import materialise, partition_bits

_WIDE = 255


class CountingQuotientFilter:
    """Sorted distinct 64-bit fingerprints with counts, stored as quotients, remainders and counters.

    ``base_bits`` leading bits are the same for all (the block's number) and not stored.
    Occupied quotients and ends of runs are bit vectors, remainders are slots of whole bytes,
    counters are bytes, and counters from 255 on have an exact overflow list.
    """

    def __init__(self, fingerprints: np.ndarray, counts: np.ndarray):
        self.fingerprints, self.counts = fingerprints, counts

    @classmethod
    def build(cls, fingerprints: np.ndarray) -> CountingQuotientFilter:
        return cls(*np.unique(fingerprints.astype(np.uint64), return_counts=True))

    @classmethod
    def merge(cls, filters: list[CountingQuotientFilter]) -> CountingQuotientFilter:
        """Neighbours merge in rounds; every merge is one pass over two sorted runs."""
        if not filters:
            return cls.build(np.empty(0, np.uint64))
        while len(filters) > 1:
            filters = [cls._two(*filters[k : k + 2]) if k + 1 < len(filters) else filters[k] for k in range(0, len(filters), 2)]
        return filters[0]

    @classmethod
    def _two(cls, a: CountingQuotientFilter, b: CountingQuotientFilter) -> CountingQuotientFilter:
        values = np.empty(len(a.fingerprints) + len(b.fingerprints), np.uint64)
        counts = np.empty(len(values), np.int64)
        at_b = np.searchsorted(a.fingerprints, b.fingerprints, side="right") + np.arange(len(b.fingerprints))
        from_a = np.ones(len(values), bool)
        from_a[at_b] = False
        values[at_b], counts[at_b] = b.fingerprints, b.counts
        values[from_a], counts[from_a] = a.fingerprints, a.counts
        second = np.flatnonzero(values[1:] == values[:-1]) + 1  # a value is in each filter once at most
        counts[second - 1] += counts[second]
        stay = np.ones(len(values), bool)
        stay[second] = False
        return cls(values[stay], counts[stay])

    def encode(self, base_bits: int) -> bytes:
        n = len(self.fingerprints)
        q = min(max(n - 1, 1).bit_length(), 64 - base_bits)
        r = 64 - base_bits - q
        low = self.fingerprints & np.uint64((1 << (64 - base_bits)) - 1)
        quotients = (low >> np.uint64(r)) if r < 64 else np.zeros(n, np.uint64)
        occupied = np.zeros(1 << q, bool)
        occupied[quotients.astype(np.int64)] = True
        ends = np.r_[quotients[1:] != quotients[:-1], True] if n else np.empty(0, bool)
        width = (r + 7) // 8
        remainders = (low & np.uint64((1 << r) - 1)).astype("<u8").view(np.uint8).reshape(n, 8)[:, :width]
        wide = self.counts[self.counts >= _WIDE].astype("<u8")
        head = np.array([n, q, len(wide)], "<u8").tobytes()
        return b"".join([head, np.packbits(occupied).tobytes(), np.packbits(ends).tobytes(), remainders.tobytes(), np.minimum(self.counts, _WIDE).astype(np.uint8).tobytes(), wide.tobytes()])

    @classmethod
    def decode(cls, data: bytes, block: int, base_bits: int) -> CountingQuotientFilter:
        n, q, n_wide = (int(x) for x in np.frombuffer(data, "<u8", 3))
        r, at = 64 - base_bits - q, 24
        take = lambda size: np.frombuffer(data, np.uint8, size, at)
        occupied = np.unpackbits(take(((1 << q) + 7) // 8))[: 1 << q]
        at += ((1 << q) + 7) // 8
        ends = np.unpackbits(take((n + 7) // 8))[:n]
        at += (n + 7) // 8
        width = (r + 7) // 8
        slots = np.zeros((n, 8), np.uint8)
        slots[:, :width] = take(n * width).reshape(n, width)
        at += n * width
        counts = take(n).astype(np.int64)
        at += n
        counts[counts == _WIDE] = np.frombuffer(data, "<u8", n_wide, at).astype(np.int64)
        run = np.cumsum(ends) - ends
        quotients = np.flatnonzero(occupied).astype(np.uint64)[run]
        values = slots.view("<u8").ravel().astype(np.uint64)
        if r < 64:
            values = values | (quotients << np.uint64(r))
        if base_bits:
            values = values | np.uint64(block << (64 - base_bits))
        return cls(values, counts)


def _build_blocks(base_bits: int):
    def run(batches):
        held = [np.asarray(b.column(0)).view(np.uint64) for b in batches if b.num_rows]
        if not held:
            return
        whole = CountingQuotientFilter.build(np.concatenate(held))
        block = (whole.fingerprints >> np.uint64(64 - base_bits)).astype(np.int64) if base_bits else np.zeros(len(whole.fingerprints), np.int64)
        cuts = np.r_[np.flatnonzero(np.r_[True, block[1:] != block[:-1]]), len(block)]
        for lo in range(0, len(cuts) - 1, 1000):
            spans = [(a, b) for a, b in zip(cuts[lo : lo + 1000], cuts[lo + 1 : lo + 1001], strict=False)]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([int(block[a]) for a, _ in spans], pa.int64()),
                    pa.array([CountingQuotientFilter(whole.fingerprints[a:b], whole.counts[a:b]).encode(base_bits) for a, b in spans], pa.binary()),
                ],
                names=["block", "filter"],
            )

    return run


def _merge_blocks(base_bits: int):
    def run(table: pa.Table) -> pa.Table:
        block = table.column("block")[0].as_py()
        merged = CountingQuotientFilter.merge([CountingQuotientFilter.decode(x.as_py(), block, base_bits) for x in table.column("filter")])
        many = merged.counts > 1
        return pa.table({"fp": pa.array(merged.fingerprints[many].view(np.int64)), "n": pa.array(merged.counts[many])})

    return run


def repeated_fingerprints(fingerprints: DataFrame, rows: int) -> DataFrame:
    """(fp, n) of the values of the one long column that occur more than once.

    A block holds about a million fingerprints of all partitions. They are hashes and each
    partition sends a value once, so no block grows with a value's frequency.
    """
    base_bits = partition_bits(rows, 1 << 20)
    blocks = fingerprints.mapInArrow(_build_blocks(base_bits), "block long, filter binary")
    return blocks.groupBy("block").applyInArrow(_merge_blocks(base_bits), "fp long, n long")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", broadcast_rows: int = 500_000) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Null texts count as empty, and empty texts are equal to each other. The row with the
    largest id stays; null ids are the smallest. Of rows that repeat the largest id too,
    exactly one has ``kept``. An empty table gives an empty result; other columns are ignored.

    Up to ``broadcast_rows`` repeated fingerprints (of 16 bytes) are broadcast to the scan of the
    texts, so only the texts of these are shuffled; beyond that, texts are shuffled by id.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    fp = F.xxhash64(text)
    rows = materialise(docs.select(F.col(id_col).alias("doc_id"), fp.alias("fp"), F.unhex(F.sha2(text, 256)).alias("sha"), F.monotonically_increasing_id().alias("uid")), "dedup-rows")
    repeated = materialise(repeated_fingerprints(rows.select("fp"), rows.count()), "dedup-repeated")
    few = repeated.count() <= broadcast_rows
    suspects = rows.join(F.broadcast(repeated) if few else repeated, "fp", "left_semi")
    texts = docs.select(F.col(id_col).alias("doc_id"), fp.alias("fp"), text.alias("text"))
    if few:  # unique texts stay where they are scanned
        texts = texts.join(F.broadcast(repeated.select("fp")), "fp", "left_semi")
    else:
        # Texts move by id, so a group of copies is spread out; copies within a task are counted before the second shuffle.
        ids = suspects.select(F.col("doc_id").alias("suspect_id")).distinct()
        texts = texts.join(ids, F.col("doc_id").eqNullSafe(F.col("suspect_id")), "left_semi")
    verified = texts.groupBy("fp", "text").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    verified = verified.filter("group_size > 1").select("fp", F.unhex(F.sha2("text", 256)).alias("sha"), "keep_id", "group_size")
    winners = suspects.groupBy("fp", "sha").agg(F.max(F.struct("doc_id", "uid")).alias("top"))
    groups = materialise(verified.join(winners, ["fp", "sha"]).select("fp", "sha", "keep_id", "group_size", F.col("top.uid").alias("keep_uid")), "dedup-groups")
    out = rows.join(groups, ["fp", "sha"], "left")
    alone = F.col("group_size").isNull()
    return out.select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        (alone | (F.col("uid") == F.col("keep_uid"))).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )
