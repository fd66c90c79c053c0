import math
import re
from collections import Counter

from foliospark.llm.quality_rules import fit_label_model, quality_filter
from foliospark.llm.queries import URL_RULES
from foliospark.llm.url_filter import host_reputation, judge_urls


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    n = Counter(grams)
    covered = {i + k for i, g in enumerate(grams) if n[g] > 1 for k in range(3)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


TEXTS = [None, "", "  \n\t ", "a b", "a b c a b c", "a a a a", "x\x0by\x0cz " * 30, "a\nb\na\n\n \na", "ünï cödé\u00a0x " * 40, "word " * 60 + "#$%", " ".join(f"w{i}" for i in range(3000)), "one two three " * 2000, "q\x1cq \x85 q"]


def test_stats_against_brute_force(spark):
    out = {r.doc_id: r for r in quality_filter(spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").repartition(3)).collect()}
    for i, t in enumerate(TEXTS):
        r = out[i]
        want = brute(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, t
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r.base_failed and r.kept)
    assert out[10].kept


def test_label_model_recovers_accuracies():
    # three independent rules of accuracy 0.9, 0.8, 0.7 on 75 % good texts
    patterns = []
    for bits in range(8):
        votes = tuple(1 if bits >> k & 1 else -1 for k in range(3))
        p = sum(prior * math.prod(a if (v > 0) == good else 1 - a for v, a in zip(votes, (0.9, 0.8, 0.7))) for good, prior in ((True, 0.75), (False, 0.25)))
        patterns.append((votes, round(p * 100_000)))
    model = fit_label_model(patterns, 3, rounds=500)
    assert abs(model.prior - 0.75) < 0.03
    assert all(abs(a - b) < 0.03 for a, b in zip(model.accuracies, (0.9, 0.8, 0.7)))


def test_quality_empty(spark):
    assert quality_filter(spark.createDataFrame([], "doc_id long, text string")).collect() == []


URLS = {
    "HTTP://A.Example.NET/en/1?x#y": ("a.example.net", "/en/1", "example.net/en/"),
    "http://example.net/en": ("example.net", "/en", "net/"),
    "http://badexample.net/en/1": ("badexample.net", "/en/1", "net/"),
    "https://m.example.com/de/2#t": ("m.example.com", "/de/2", "example.com/de/"),
    "https://m.example.com/en/2": ("m.example.com", "/en/2", None),
    "http://x.org/fr/": ("x.org", "/fr/", "org/fr/"),
    "http://x.org?u=http://y.net/": ("x.org", "", None),
    "http://x.net": ("x.net", "", None),
    "no scheme": ("", "", None),
    None: ("", "", None),
    "http://": ("", "", None),
    "a://b\nc/d\ne": ("b\nc", "/d\ne", None),
}


def test_rules(spark):
    pages = spark.createDataFrame([(i, u, "z") for i, u in enumerate(URLS)], "page_id long, url string, host string")
    none = spark.createDataFrame([], "url string, bad long")
    out = {r.page_id: r for r in judge_urls(pages, none, URL_RULES).collect()}
    verdicts = {r.text: r.verdict for r in URL_RULES}
    for i, (host, path, rule) in enumerate(URLS.values()):
        assert (out[i].host, out[i].path, out[i].rule, out[i].verdict) == (host, path, rule, verdicts.get(rule, "allow"))
    assert judge_urls(pages.limit(0), none, URL_RULES).collect() == []


def test_reputation_shrinks(spark):
    rows = [("http://bad.spam.com/", 1)] * 40 + [("http://one.spam.com/", 1)] + [("http://one.fine.com/", 1)] + [(f"http://h{i % 9}.fine.com/", int(i % 30 == 0)) for i in range(300)] + [(None, 1), ("http://x.com/", None)]
    outcomes = spark.createDataFrame(rows, "url string, bad long")
    pages = spark.createDataFrame([(1, "http://bad.spam.com/z"), (2, "http://one.fine.com/z"), (3, "http://h1.fine.com/"), (4, "http://unseen.com/")], "page_id long, url string")
    out = {r.page_id: r for r in judge_urls(pages, outcomes, ()).collect()}
    assert [out[i].verdict for i in (1, 2, 3, 4)] == ["block", "allow", "allow", "allow"]
    hosts, rate, m_domain, m_host = host_reputation(outcomes.selectExpr("regexp_extract(url, '//([^/]*)', 1) AS host", "bad"))
    found = {r.host: r for r in hosts.collect()}
    a, b = found["one.fine.com"], found["one.spam.com"]
    assert a.domain_rate < rate < b.domain_rate and a.bound < b.bound and m_domain > 0 and m_host > 0
