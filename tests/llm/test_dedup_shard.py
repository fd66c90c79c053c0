import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from foliospark.llm.exact_dedup import CountingQuotientFilter, exact_dedup
from foliospark.llm.sharding import stratified_shards

SCHEMA = "doc_id long, text string, source string, kept string, fp string, size string"
ROWS = [(1, "a", "x"), (2, "a", "x"), (3, "b", None), (3, "a", "x"), (4, None, "y"), (5, "", "y"), (None, "b", "x"), (6, "é" * 3000, "x"), (7, "é" * 3000, "x"), (7, "é" * 3000, "x")]


def docs(spark, rows=ROWS, schema=SCHEMA):
    return spark.createDataFrame([(*r, "1", "2", "3") for r in rows], schema).repartition(3)


@pytest.mark.parametrize("base_bits", [0, 3])
def test_quotient_filter_round_trip_and_merge(base_bits):
    rng = np.random.default_rng(1)
    block = 5 if base_bits else 0
    top = np.uint64(block << (64 - base_bits)) if base_bits else np.uint64(0)
    pool = (rng.integers(0, 1 << 63, 500, dtype=np.uint64) >> np.uint64(base_bits)) | top
    parts = [np.concatenate([rng.choice(pool, 400), np.repeat(pool[:1], 300)]) for _ in range(3)]
    merged = CountingQuotientFilter.merge([CountingQuotientFilter.decode(CountingQuotientFilter.build(p).encode(base_bits), block, base_bits) for p in parts])
    assert dict(zip(merged.fingerprints.tolist(), merged.counts.tolist())) == Counter(np.concatenate(parts).tolist())


def test_exact_dedup(spark):
    out = exact_dedup(docs(spark)).collect()
    groups = defaultdict(list)
    for d, t, _ in ROWS:
        groups[t or ""].append(d)
    assert len(out) == len(ROWS)
    by_sha = {hashlib.sha256(t.encode()).hexdigest(): ids for t, ids in groups.items()}
    kept = Counter()
    for r in out:
        ids = by_sha[r.text_sha256]
        assert r.group_size == len(ids) and r.keep_id == max(i for i in ids if i is not None)
        if r.kept:
            kept[r.text_sha256] += 1
            assert r.doc_id == r.keep_id
    assert kept == Counter(by_sha.keys())


def test_empty(spark):
    assert exact_dedup(docs(spark, [])).collect() == []
    assert stratified_shards(docs(spark, [])).collect() == []


def test_shards(spark):
    rows = [*ROWS, *((i, f"t{i}", "hot" if i % 3 else f"s{i % 5}") for i in range(100, 500))]
    out = stratified_shards(docs(spark, rows), 8).collect()
    again = stratified_shards(docs(spark, rows[::-1]), 8).collect()
    assert sorted(map(str, out)) == sorted(map(str, again))
    sizes = Counter(r.shard for r in out)
    assert sorted(sizes) == list(range(8)) and max(sizes.values()) - min(sizes.values()) <= 1
    for s in range(8):
        assert sorted(r.slot for r in out if r.shard == s) == list(range(sizes[s]))
    crc = {i: zlib.crc32((t or "").encode()) for i, t, _ in rows if i not in (3, None)}
    assert all(crc[r.doc_id] == r.text_crc32 for r in out if r.doc_id in crc)
    hot = {i for i, _, s in rows if s == "hot"}
    share = Counter(r.shard for r in out if r.doc_id in hot)
    assert max(share.values()) - min(share.values()) <= 8  # the number of sources
