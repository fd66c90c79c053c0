"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints at most three bits apart have a point between them that is at most one bit from
one and two from the other. Every distinct fingerprint emits the variants around it, variants
are shuffled, and equal ones bring near fingerprints together. Half of three being one and a
half, those with an even number of ones emit radius two and the others radius one: distance one
and three is only possible between the two kinds, and distance two is met at radius one of both.
Of the two-bit variants, those with both bits in the same half of the word are enough, since of
any three bits two lie in the same half.

All fingerprints that meet in a variant are joined to the one nearest to it if that is at most one
bit away, which every pair within three bits meets at least once, so no group emits its pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliospark.llm.common import materialise, partition_bits
from foliospark.llm.graph import connected_components

RADIUS = 3
_ONE = [1 << i for i in range(64)]
_TWO = [1 << i | 1 << j for h in (0, 32) for i in range(h, h + 32) for j in range(i + 1, h + 32)]
#: Masks by code; the first 65 are the ball of radius one.
MASKS = np.array([0, *_ONE, *_TWO], np.uint64)
WEIGHTS = np.array([0] + [1] * 64 + [2] * len(_TWO), np.uint8)
_MIX = np.uint64(0x9E3779B97F4A7C15)
#: Fingerprints whose variants (about 64 MB) one task emits.
EMITTERS = 12_000


def shingle_hashes(text: bytes, shingle: int, seed: int) -> list[int]:
    """The XXH64 of all word shingles of the text, or of all its words if they are fewer than a shingle."""
    words = text.lower().split()
    if not words:
        return []
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) < shingle:
        return [digest(joined, seed)]
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    return [digest(joined[a:b], seed) for a, b in zip(starts[: len(words) - shingle + 1].tolist(), ends[shingle - 1 :].tolist(), strict=True)]


def fingerprint(text: bytes, shingle: int = 3, seed: int = 42) -> int:
    """64 bits, each the majority of that bit over the XXH64 of all word shingles of the text."""
    hashes = shingle_hashes(text, shingle, seed)
    if not hashes:
        return 0
    ones = np.zeros(64, np.int64)
    for lo in range(0, len(hashes), 8192):
        part = np.array(hashes[lo : lo + 8192], "<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0])


def _fingerprints(shingle: int, seed: int):
    def run(batches):
        for batch in batches:
            found = [fingerprint(t or b"", shingle, seed) for t in batch.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(found, np.uint64).view(np.int64))], names=["doc_id", "fp"])

    return run


def fingerprints(docs: DataFrame, shingle: int = 3, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp) of every whole text, fp as a signed long; a text without words has 0."""
    schema = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("fp", T.LongType())])
    return docs.select(id_col, text_col).mapInArrow(_fingerprints(shingle, seed), schema)


def _emit(bucket_bits: int, group: int = 2048):
    def run(batches):
        for batch in batches:
            fps = np.asarray(batch.column(0)).view(np.uint64)
            odd = np.bitwise_count(fps) & 1 == 1
            for lo in range(0, len(fps), group):
                part, is_odd = fps[lo : lo + group], odd[lo : lo + group]
                variants, codes = [], []
                for own, n in ((part[is_odd], 65), (part[~is_odd], len(MASKS))):
                    variants.append((own[:, None] ^ MASKS[None, :n]).ravel())
                    codes.append(np.tile(np.arange(n, dtype=np.uint16), len(own)))
                v, c = np.concatenate(variants), np.concatenate(codes)
                bucket = (v * _MIX >> np.uint64(64 - bucket_bits)).astype(np.uint32) if bucket_bits else np.zeros(len(v), np.uint32)
                order = np.argsort(bucket, kind="stable")
                v, c, bucket = v[order], c[order], bucket[order]
                cuts = np.r_[np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]), len(bucket)] if len(bucket) else np.zeros(1, np.int64)
                spans = list(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([int(bucket[a]) for a, _ in spans], pa.int64()), pa.array([v[a:b].tobytes() for a, b in spans], pa.binary()), pa.array([c[a:b].tobytes() for a, b in spans], pa.binary())],
                    names=["bucket", "variants", "codes"],
                )

    return run


def _meet(table: pa.Table) -> pa.Table:
    v = np.frombuffer(b"".join(table.column("variants").to_pylist()), np.uint64)
    c = np.frombuffer(b"".join(table.column("codes").to_pylist()), np.uint16)
    order = np.argsort(v)
    v, c = v[order], c[order]
    same = v[1:] == v[:-1]
    met = np.r_[same, False] | np.r_[False, same]
    v, c = v[met], c[met]
    fps, weight = v ^ MASKS[c], WEIGHTS[c]
    order = np.lexsort((fps, weight, v))
    v, fps, weight = v[order], fps[order], weight[order]
    first = np.r_[True, v[1:] != v[:-1]] if len(v) else np.empty(0, bool)
    centre = np.maximum.accumulate(np.where(first, np.arange(len(v)), 0)) if len(v) else np.empty(0, np.int64)
    a, b = fps[centre], fps
    linked = ~first & (weight[centre] <= 1) & (np.bitwise_count(a ^ b) <= RADIUS)
    pairs = np.unique(np.stack([np.minimum(a, b)[linked], np.maximum(a, b)[linked]], axis=1), axis=0)
    return pa.table({"a": pa.array(np.ascontiguousarray(pairs[:, 0]).view(np.int64)), "b": pa.array(np.ascontiguousarray(pairs[:, 1]).view(np.int64))})


def near_links(distinct: DataFrame, count: int) -> DataFrame:
    """(a, b) links that join all of the distinct values of the one long column within three bits.

    Not every such pair is listed, but those listed are within three bits and connect the same.
    Variants go to buckets of about a million by a mix of all their bits, so buckets stay even.
    """
    bucket_bits = partition_bits(count * (len(MASKS) + 65) // 2, 1 << 20)
    # A fingerprint of eight bytes becomes some 5.6 KB: a small table must be dealt out before that.
    spread = distinct.repartition(max(1, -(-count // EMITTERS)))
    emitted = spread.mapInArrow(_emit(bucket_bits), "bucket long, variants binary, codes binary")
    return emitted.groupBy("bucket").applyInArrow(_meet, "a long, b long")


def near_duplicates(docs: DataFrame, shingle: int = 3, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, fingerprint (16 hex digits), component_id.

    Fingerprints at most three bits apart are linked; component_id is the smallest id reachable
    over links, the row's own included, and null only where all ids reached are null. Null, empty
    and blank texts have fingerprint zero and are linked like any other. Repeated rows share their
    fingerprint and component; an empty table gives an empty result; other columns are ignored.
    """
    rows = materialise(fingerprints(docs, shingle, seed, id_col, text_col), "simhash-rows")
    distinct = materialise(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-distinct")
    links = near_links(distinct.select("fp"), distinct.count())
    roots = connected_components(links).select(F.col("node").alias("fp"), "root")
    named = distinct.join(roots, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    components = materialise(named.select("fp", "root").join(least, "root").select("fp", "component_id"), "simhash-components")
    return rows.join(components, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
