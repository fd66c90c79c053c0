import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pytest
import xxhash

from foliospark.llm.graph import connected_components
from foliospark.llm.simhash import MASKS, fingerprint, near_duplicates, near_links
from foliospark.llm.substring_dedup import remove_repeats


def brute_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def roots(nodes, linked):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in linked:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def test_masks_cover_the_radius():
    assert len(MASKS) == 65 + 2 * 32 * 31 // 2 and len(set(MASKS.tolist())) == len(MASKS)


def test_links_connect_all_within_three_bits(spark):
    rng = random.Random(5)
    fps = {0}
    for _ in range(25):
        x = rng.getrandbits(64)
        for _ in range(rng.choice((1, 2, 30))):
            fps.add(x)
            for b in rng.sample(range(64), rng.choice((1, 2, 3, 3, 4))):
                x ^= 1 << b
    fps = sorted(fps)
    out = [(r.a & (1 << 64) - 1, r.b & (1 << 64) - 1) for r in near_links(spark.createDataFrame([(signed(f),) for f in fps], "fp long"), len(fps)).collect()]
    assert all((a ^ b).bit_count() <= 3 for a, b in out)
    near = [(a, b) for i, a in enumerate(fps) for b in fps[i + 1 :] if (a ^ b).bit_count() <= 3]
    assert len(near) > 100 and roots(fps, out) == roots(fps, near)


def test_components(spark):
    rng = random.Random(3)
    links = [(i, i + 1) for i in range(0, 60)] + [(100, 100 + i) for i in range(50)] + [(rng.randrange(200, 400), rng.randrange(200, 400)) for _ in range(90)] + [(7, 7), (-5, 30)]
    out = {r.node: r.root for r in connected_components(spark.createDataFrame([*links, (None, 3)], "a long, b long").repartition(3)).collect()}
    want = roots({x for p in links if p[0] != p[1] for x in p}, links)
    assert out == want
    assert connected_components(spark.createDataFrame([], "a long, b long")).collect() == []


BASE = " ".join(f"word{i % 211}{i % 7}" for i in range(600))
TEXTS = [None, "", " \n", "One two", "one TWO", "a b c", "A b\x0bc", "x" * 100_000, BASE, BASE + " tail", BASE.replace("word50", "other"), "É é", "é É", "rep " * 5000, "rep " * 4000]


def test_simhash_query(spark):
    rows = [*enumerate(TEXTS), (None, BASE), (8, BASE), (100, "only one of its kind here")]
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, fp long, root long").repartition(4)
    out = near_duplicates(docs).collect()
    assert len(out) == len(rows)
    fps = {t: brute_fingerprint(t) for _, t in rows}
    assert all(fingerprint((t or "").encode()) == f for t, f in fps.items())
    values = sorted(set(fps.values()))
    root = roots(values, [(a, b) for a in values for b in values if a < b and (a ^ b).bit_count() <= 3])
    least = defaultdict(lambda: 10**9)
    for d, t in rows:
        if d is not None:
            least[root[fps[t]]] = min(least[root[fps[t]]], d)
    want = sorted((str(d), f"{fps[t]:016x}", least[root[fps[t]]]) for d, t in rows)
    assert sorted((str(r.doc_id), r.fingerprint, r.component_id) for r in out) == want
    assert near_duplicates(docs.limit(0)).collect() == []


def brute_remove(texts, window):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    seen = defaultdict(list)
    for d, w in enumerate(words):
        for i in range(len(w) - window + 1):
            seen[tuple(w[i : i + window])].append((d, i))
    gone = [set() for _ in texts]
    for places in seen.values():
        if len(places) > 1:
            for d, i in places:
                gone[d].update(range(i, i + window))
    return [(len(w), len(g), " ".join(x for i, x in enumerate(w) if i not in g)) for w, g in zip(words, gone)]


def corpus(seed):
    rng = random.Random(seed)
    vocabulary = [f"v{i}é" for i in range(300)]
    fresh = lambda n: [rng.choice(vocabulary) + rng.choice("abcdefgh") for _ in range(n)]
    passages = [fresh(rng.randrange(30, 80)) for _ in range(8)]
    texts = [None, "", "  ", "short text", "same " * 34, "same " * 35, "same " * 36, "a b " * 40, "lone " * 34 + "x"]
    for _ in range(60):
        parts = []
        for _ in range(rng.randrange(1, 5)):
            p = list(rng.choice(passages))
            if rng.random() < 0.4:
                p[rng.randrange(len(p))] = "edit" + rng.choice("xyz")
            if rng.random() < 0.3:
                p = p[rng.randrange(5) :]
            parts += rng.choice([p, p, fresh(rng.randrange(1, 60)), p[: rng.randrange(20, len(p) + 1)]])
        texts.append((" \n\t"[rng.randrange(3)]).join(parts))
    return [*texts, *texts[-3:]]


@pytest.mark.parametrize("seed", [1, 2])
def test_remove_repeats(spark, seed):
    texts = corpus(seed)
    rows = [(i if i != 20 else None, t) for i, t in enumerate(texts)] + [(30, texts[30]), (31, texts[40])]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, place long, edge string").repartition(5)
    want = brute_remove([t for _, t in rows], 35)
    out = remove_repeats(docs, with_text=False).collect()
    digest = lambda k: hashlib.sha256(k.encode()).hexdigest()
    assert sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in out) == sorted((str(d), n, g, digest(k)) for (d, _), (n, g, k) in zip(rows, want))
    text_out = remove_repeats(docs).collect()
    assert sorted((str(r.doc_id), r.n_removed, " ".join(re.findall(r"[^\x20\x09-\x0D]+", r.kept_text))) for r in text_out) == sorted((str(d), g, k) for (d, _), (n, g, k) in zip(rows, want))
    assert 0 < sum(g for _, g, _ in want) < sum(n for n, _, _ in want)
    assert remove_repeats(docs.limit(0)).collect() == []


def test_long_text_is_cut_into_runs(spark, monkeypatch):
    import foliospark.llm.substring_dedup as s

    monkeypatch.setattr(s, "_RUN", 100)
    rng = np.random.default_rng(0)
    words = [f"w{x}" for x in rng.integers(0, 50, 900)]
    text = " ".join(words + words[200:420] + ["z"] + words[200:300]).encode()
    seen = defaultdict(list)
    for group in s._runs([text], 35):
        which, place, count, edge, content = s._paths(group, 35, 12)
        for w, p, c, e in zip(which.tolist(), place.tolist(), count.tolist(), edge.tolist()):
            for i in range(p, p + c):
                seen[i + group[w][1]].append(e)
    all_words = text.split()
    assert sorted(seen) == list(range(len(all_words) - 34)) and all(len(v) == 1 for v in seen.values())
    assert all(seen[200 + i] == seen[900 + i] for i in range(220 - 34))
