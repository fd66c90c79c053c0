"""The verdict of the quality rules against a plain model over single documents."""

import math

import pytest
import regex

from foliospark.llm.quality_rules import quality_filter
from tests.llm.test_quality_url import brute

#: (good, bad) of each rule on n words, code points in words, symbols, repeated lines, words in repeated windows, letters and lines.
VOTES = (
    lambda n, c, s, d, r, a, x: (False, n < 30),
    lambda n, c, s, d, r, a, x: (100 * s <= 3 * n, 100 * s > 25 * n),
    lambda n, c, s, d, r, a, x: (100 * a >= 90 * c, 100 * a < 80 * c),
    lambda n, c, s, d, r, a, x: (False, 100 * d > 30 * x),
    lambda n, c, s, d, r, a, x: (False, 100 * r > 30 * n),
    lambda n, c, s, d, r, a, x: (False, c < 2 * n or c > 15 * n),
)


def votes(text):
    n, c, s, d, r = brute(text)
    lines = [x for x in (text or "").split("\n") if regex.search(r"[^\x20\x09-\x0D]", x)]
    asked = [rule(n, c, s, d, r, len(regex.findall(r"\p{L}", text or "")), len(lines)) for rule in VOTES]
    return [-1 if bad else int(good) for good, bad in asked], n < 50 or 100 * r > 50 * n


def posteriors(rows):
    """Probabilities that documents are good, by EM over every single document."""

    def good(v):
        yes, no = prior, 1 - prior
        for x, a in zip(v, right, strict=True):
            if x:
                yes, no = yes * (a if x > 0 else 1 - a), no * (1 - a if x > 0 else a)
        return yes / (yes + no)

    prior, right = 0.8, [0.8] * len(VOTES)
    for _ in range(40):
        p = [good(v) for v in rows]
        sure = [sum(q if v[k] > 0 else 1 - q for v, q in zip(rows, p, strict=True) if v[k]) for k in range(len(VOTES))]
        cast = [sum(1 for v in rows if v[k]) for k in range(len(VOTES))]
        right = [min(0.98, max(0.55, (s + 8) / (n + 10))) for s, n in zip(sure, cast, strict=True)]
        prior = min(0.95, max(0.05, sum(p) / len(p)))
    return [good(v) for v in rows]


EXTRA = [None, "", "# $ % " * 80, "12345 67 8 " * 40, "one line of words\n" * 30, " ".join(f"w{i}" for i in range(300)), " ".join(f"word{chr(97 + i % 26)} {i} #" for i in range(90)), "a b c d e f g h " * 3 + " ".join("xyz"[i % 3] * (i + 2) for i in range(60))]


@pytest.mark.parametrize("twice", [False, True])
def test_verdict_against_single_documents(spark, twice):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    rows += [(10_000 + i, t) for i, t in enumerate(EXTRA)]
    # Repeated rows are documents like any other; other columns' names mean nothing.
    rows = rows + rows[-8:] * 3 if twice else rows
    judged = [votes(t) for _, t in rows]
    want = sorted((i, f, not f and p >= 0.5, p) for (i, _), (_, f), p in zip(rows, judged, posteriors([v for v, _ in judged]), strict=True))
    docs = spark.createDataFrame([(i, t, "n", -1, True) for i, t in rows], "doc_id long, text string, posterior string, v0 int, kept boolean").repartition(3)
    got = sorted((r.doc_id, r.base_failed, r.kept, r.posterior) for r in quality_filter(docs).collect())
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert all(math.isclose(g[3], w[3], rel_tol=1e-9, abs_tol=1e-12) for g, w in zip(got, want, strict=True))
    assert {k for _, _, k, _ in got} == {True, False} and any(not f and not k for _, f, k, _ in got)
