import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from foliospark.llm.bpe import MergeReplay, decode_documents, encode_digests, encode_documents, load_ranks, replay_of
from foliospark.llm.packing import encoder_of, pack_documents, plan_packing

JSON, RANKS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN
TEXTS = [None, "", " ", "\n", "a", " a  b\n\nc \n d\t\te\r\n", "it's don't 'S we'll", "x\x1cy \x85z\xa0w　v", "é" * 5000, "Zürich über naïve ñandú 漢字かな 🙂🙂", "<|endoftext|> a<|endoftext|>b", "aaaaaaaaaaaaa", "word " * 3000, " lead", "trail ", "trail\n", "12345 1,234.50 #$%&", "Ends.\nNext line, here"]


@pytest.fixture(scope="module")
def reference():
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=load_ranks(RANKS), special_tokens={})


text = st.text(st.one_of(st.sampled_from(" \n\t\r\xa0 \x1c'stre.,!1A"), st.characters(codec="utf-8")), max_size=60)


@settings(max_examples=300, deadline=None)
@given(text)
def test_replay_equals_tiktoken(reference, t):
    replay, encoder = replay_of(RANKS, PATTERN)
    ids = np.frombuffer(next(iter(encoder.encode([t]))), "<u4").tolist()
    assert ids == reference.encode_ordinary(t)
    assert b"".join(replay.token[i] for i in ids) == t.encode()


@settings(max_examples=200, deadline=None)
@given(text)
def test_chunks_equal_tokenizers(t):
    whole = Tokenizer.from_file(JSON) if not hasattr(test_chunks_equal_tokenizers, "t") else test_chunks_equal_tokenizers.t
    test_chunks_equal_tokenizers.t = whole
    assert np.frombuffer(next(iter(encoder_of(JSON).encode([t]))), "<u4").tolist() == whole.encode(t, add_special_tokens=False).ids


def test_rank_inversion():
    ranks = {bytes([b]): b for b in range(256)} | {b"za": 256, b"abc": 257, b"bc": 258, b"zabc": 259}
    replay = MergeReplay(ranks)
    enc = tiktoken.Encoding("own", pat_str=r"\w+", mergeable_ranks=ranks, special_tokens={})
    for w in ("zabcabc", "abcabc", "aabcbc", "bcbcabczabcq"):
        assert replay.encode([w.encode()])[0] == enc.encode_ordinary(w) == replay.one(w.encode()) or w.encode() in ranks


def test_encode_query(spark, reference):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)] + [(None, "a", None)], "doc_id long, text string, ids string").repartition(3)
    out = {r.doc_id: r for r in encode_digests(docs, RANKS, PATTERN).collect()}
    assert len(out) == len(TEXTS) + 1
    for i, t in enumerate(TEXTS):
        ids = reference.encode_ordinary(t or "")
        assert out[i].n_tokens == len(ids)
        assert out[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert out[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    back = {r.doc_id: bytes(r.data) for r in decode_documents(encode_documents(docs, RANKS, PATTERN), RANKS).collect()}
    assert all(back[i] == (t or "").encode() for i, t in enumerate(TEXTS))
    assert encode_digests(docs.limit(0), RANKS, PATTERN).collect() == []


def check_bins(placed, capacity):
    bins = defaultdict(list)
    for sequence, offset, length in placed:
        bins[sequence].append((offset, length))
    for items in bins.values():
        at = 0
        for offset, length in sorted(items):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=120))
def test_plan_fills_bins(lengths):
    counts = Counter(lengths)
    plan, bins = plan_packing(counts, 40)
    placed, seen = [], Counter()
    for p in plan:
        assert p.rank == seen[p.length]
        seen[p.length] += p.count
        placed += [(p.first_bin + k // p.per_bin, p.offset + k % p.per_bin * p.length, p.length) for k in range(p.count)]
    assert seen == counts and check_bins(placed, 40) == bins
    least = max(-(-sum(lengths) // 40), sum(x > 20 for x in lengths))
    assert bins <= least * 11 / 9 + 2


def test_pack_query(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(None, "a b"), (3, "\n")] + [(100 + i, "some words here " * (i % 97)) for i in range(300)]
    out = pack_documents(spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, piece long").repartition(5), JSON).collect()
    tokenizer = Tokenizer.from_file(JSON)
    want = Counter()
    for i, t in rows:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]
        first = len(ids) % 1024 or 1024
        cuts = [0, *range(first, len(ids), 1024), len(ids)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want[i, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out) == want
    n = check_bins([(r.sequence_id, r.offset, r.length) for r in out], 1024)
    assert n <= sum(r.length for r in out) / 1024 * 1.02 + 1
    assert pack_documents(spark.createDataFrame([], "doc_id long, text string"), JSON).collect() == []


LATIN = st.text(st.sampled_from("abcdeinrstuhAEIÉéñßüöçøłșȚ"), min_size=1, max_size=40)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(LATIN, st.sampled_from(["", ",", ".***", "!!", "'s", "7", "7;", "-", "(.", "\n"])), min_size=1, max_size=40), st.sampled_from([" ", "\n", "  ", "\x01", "\t"]))
def test_latin_words_equal_tokenizers(words, between):
    whole = Tokenizer.from_file(JSON) if not hasattr(test_latin_words_equal_tokenizers, "t") else test_latin_words_equal_tokenizers.t
    test_latin_words_equal_tokenizers.t = whole
    texts = [between.join(w + tail for w, tail in words), *(w + tail for w, tail in words), ""]
    got = [np.frombuffer(x, "<u4").tolist() for x in encoder_of(JSON).encode(list(texts))]
    assert got == [whole.encode(t, add_special_tokens=False).ids for t in texts]


def test_small_groups_and_long_texts():
    rng = np.random.default_rng(3)
    texts = [" ".join(rng.choice(["alpha", "beta,", "x\ny", "  ", "12."], n)) for n in (0, 1, 500, 3, 20_000, 7)]
    whole, encoder = Tokenizer.from_file(JSON), encoder_of(JSON)
    for size in (1, 50, 1000, 1 << 22):
        small = type(encoder)(encoder.encode_many, encoder.words, limit=2, size=size)
        assert [np.frombuffer(x, "<u4").tolist() for x in small.encode(list(texts))] == [whole.encode(t, add_special_tokens=False).ids for t in texts]
