import random

import numpy as np

from foliospark.llm.html_extract import Template, extract, extract_pages, induce_wrappers, merge, outline, parse
from foliospark.llm.language_id import UNKNOWN, fit, identify_languages, predict, presence, N_GRAMS

HEAD = '<!DOCTYPE html><html><head><title>T</title><style>p{margin:0}</style><script>var t="</p><article>";</script></head><body>'


def test_semantic_parts_go():
    page = HEAD + (
        '<header>H</header><nav><ul><li><a href="/x">menu</a></ul></nav><!-- <p>ad</p> --><div class="ad">buy</div><div id="cookie-notice">cookies</div>'
        '<article><h1>Title &amp; more</h1><p><b>One\n two&nbsp;<i>th</i>ree<br><p>Four &eacute; &#x41; &lt;b&gt;</p><form><input value="x">send<button>b</button></form>'
        '<aside>side</aside><ul><li>a<li>b</ul><table><tr><td>c<td>d</table><pre>x\n  y</pre><section class="comments"><p>reader</p></section></article>'
        '<div role="complementary">side</div><footer>&copy; foot</footer><noscript>no</noscript>'
    )
    assert extract(page) == "Title & more\nOne two three\nFour é A <b>\na\nb\nc\nd\nx y"


def test_odd_pages():
    assert extract("") == "" and extract("   ") == ""
    assert extract("plain a < b text") == "plain a < b text"
    assert extract("<p>a<p>b</div></p>c") == "a\nb\nc"
    assert extract("<article><p>x</article><p>y") == "x"
    assert extract("<script>never ends <p>x") == ""
    assert extract("<p title='a>b'>q</p>") == "q"
    assert extract("<div>" * 300 + "deep" + "</div>" * 300) == "deep"
    assert extract("<p>" + "word " * 50_000 + "</p>") == ("word " * 50_000).strip()


def site(n, body):
    return f'<body><div class="top">Welcome to the site</div><div class="mid">{body}</div><div class="end">Call 555 now</div><div class="stamp">page {n}</div></body>'


def test_wrapper_from_same_host_pages():
    pages = [site(i, f"<p>story {i}</p>" + "<p>more</p>" * (i % 3)) for i in range(6)]
    whole = Template()
    for p in pages:
        whole.add(Template(outline(parse(p)), {hash(p)}))
    wrapper = frozenset(whole.constants())
    assert extract(pages[4], wrapper) == "story 4\nmore\npage 4"
    backwards = Template()
    for p in reversed(pages):
        backwards.add(Template(outline(parse(p)), {hash(p)}))
    assert frozenset(backwards.constants()) == wrapper
    one = outline(parse(pages[0]))
    assert merge(one, one) == one


def test_extract_query(spark):
    rows = [(i, f"http://a.com/{i}", site(i, f"<p>story {i}</p>")) for i in range(8)]
    rows += [(20 + i, "http://copy.com/", site(1, "<p>same</p>")) for i in range(5)]  # copies are no evidence
    rows += [(30, None, None), (31, "x", ""), (32, None, "<p>free"), (None, "http://a.com/9", site(9, "<p>story 9</p>")), (3, "http://a.com/3", rows[3][2])]
    pages = spark.createDataFrame([(*r, 1, 2) for r in rows], "page_id long, url string, html string, text long, host long").repartition(4)
    for limit in (10_000, 0):
        out = extract_pages(pages, broadcast_rows=limit).collect()
        assert len(out) == len(rows)
        texts = {r.page_id: r.text for r in out}
        assert texts[3] == "story 3\npage 3" and texts[None] == "story 9\npage 9"
        assert texts[20] == "Welcome to the site\nsame\nCall 555 now\npage 1"
        assert texts[30] == "" and texts[31] == "" and texts[32] == "free"
        assert all(r.n_chars == len(r.text) for r in out)
    assert extract_pages(pages.limit(0)).collect() == []


def words(rng, syllables, n):
    return " ".join("".join(rng.choice(syllables) for _ in range(rng.randrange(1, 4))) for _ in range(n))


SYLLABLES = {"aa": "the ing er on at re".split(), "bb": "sch ung ein ß ver ich".split(), "cc": "ción os que ll ñ ar".split()}


def test_kernel_against_brute_force():
    rng = random.Random(1)
    train = [(lang, words(rng, s, 30)) for lang, s in SYLLABLES.items() for _ in range(20)]
    space = np.zeros(N_GRAMS, bool)

    def codes(text):
        space[:] = False
        presence(text, space)
        return np.flatnonzero(space).astype(np.int32)

    rows = sorted(((lang, codes(t)) for lang, t in train), key=lambda r: r[0])
    model = fit(rows, landmarks_per_language=20, ridge=1e-3)
    vocabulary = set(model.vocabulary.tolist())

    def kernel(a, b):  # all training texts are landmarks: plain kernel ridge regression
        return len(set(a.tolist()) & set(b.tolist()) & vocabulary) / (len(a) * len(b)) ** 0.5

    gram = np.array([[kernel(a, b) for _, b in rows] for _, a in rows])
    y = np.array([[1.0 if lang == x else -1.0 for x in model.languages] for lang, _ in rows])
    n = len(rows)
    # with an unpenalised constant, as in the model
    system = np.block([[gram + 1e-3 * n * np.eye(n), np.ones((n, 1))], [np.ones((1, n)), np.zeros((1, 1))]])
    solved = np.linalg.solve(system, np.r_[y, np.zeros((1, len(model.languages)))])
    for lang, s in SYLLABLES.items():
        text = words(rng, s, 12)
        own = codes(text)
        want = np.array([kernel(own, b) for _, b in rows]) @ solved[:-1] + solved[-1]
        (name,), (score,) = predict(model, [text])
        assert name == lang == model.languages[int(want.argmax())]
        assert abs(score - min(1, max(0, (want.max() + 1) / 2))) < 1e-2


def test_language_query(spark):
    rng = random.Random(2)
    rows = [(i, words(rng, SYLLABLES[lang], 20), lang, "s") for i in range(300) for lang in [rng.choice(list(SYLLABLES))]]
    odd = [(1000, None, "aa", "s"), (1001, "", None, "s"), (1002, "123 ...", "bb", "s"), (None, words(rng, SYLLABLES["bb"], 20), "aa", None), (5, rows[5][1], rows[5][2], "s"), (1003, words(rng, SYLLABLES["cc"], 20_000), None, "s")]
    docs = spark.createDataFrame([(*r, "x") for r in rows + odd], "doc_id long, text string, lang string, source string, lang_pred string").repartition(3)
    out = identify_languages(docs).collect()
    assert len(out) == len(rows) + len(odd)
    found = {r.doc_id: r for r in out}
    import zlib

    held = [i for i, *_ in rows if zlib.crc32(str(i).encode()) % 4 == 2]
    assert all(found[i].held_out == (i in held) for i, *_ in rows)
    assert sum(found[i].lang_pred == lang for i, _, lang, _ in rows if i in held) == len(held) > 40
    assert [found[i].lang_pred for i in (1000, 1001, 1002, None, 1003)] == [UNKNOWN, UNKNOWN, UNKNOWN, "bb", "cc"]
    assert all(0 <= r.score <= 1 for r in out)
    unlabelled = docs.withColumn("lang", docs.lang.substr(100, 1)).replace("", None, "lang")
    assert {r.lang_pred for r in identify_languages(unlabelled).collect()} == {UNKNOWN}
    assert identify_languages(docs.limit(0)).collect() == []


def test_letters_of_all_scripts(spark):
    """Languages that share no letter with a-z, and two that share a script."""
    rng = random.Random(6)
    scripts = {"uk": "ці на що її є ві".split(), "ru": "что ы на это ни ов".split(), "el": "και το η ση μα ν".split(), "zh": "的 是 不 了 人 在".split(), "ja": "の は を 人 です が".split()}
    rows = [(i, words(rng, scripts[lang], 25), lang, "s") for i in range(400) for lang in [rng.choice(list(scripts))]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(3)
    found = {r.doc_id: r for r in identify_languages(docs).collect()}
    held = [r for r in rows if found[r[0]].held_out]
    assert len(held) > 50 and all(found[i].lang_pred == lang for i, _, lang, _ in held)


def plain_site(rng, n):
    """A page without any element that says what it is, and the texts that are its content."""
    own = [words(rng, SYLLABLES["aa"], 12) for _ in range(rng.randrange(1, 6))]
    menu = "".join(f'<li><a href="/{n}">{words(rng, SYLLABLES["bb"], 2)}</a></li>' for _ in range(5))
    body = "".join(f"<p>{t}</p>" for t in own)
    extra = f'<div class="box">{words(rng, SYLLABLES["cc"], 3)}</div>' if n % 7 == 0 else ""
    page = f'<body class="page-{n}"><div class="a">Our site<ul id="m{n}">{menu}</ul></div><div id="id{n}"><h2>{own[0]} title</h2>{body}<p>Please share this page.</p></div><div class="z">All rights reserved</div></body>'
    return page.replace('<div class="z">', extra + '<div class="z">'), [f"{own[0]} title", *own, *([extra[17:-6]] if extra else [])]


def test_wrapper_decides_without_marks(spark):
    rng = random.Random(8)
    made = [plain_site(rng, n) for n in range(40)]
    odd = '<body><p>Error: nothing here at all</p></body>'
    rows = [(i, "https://plain.org/x", p) for i, (p, _) in enumerate(made)] + [(100, "https://plain.org/x", odd)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(7)
    for fan_in in (2, 64):
        wrappers = {r.host: frozenset(map(tuple, __import__("json").loads(r.wrapper))) for r in induce_wrappers(pages, fan_in=fan_in).collect()}
        assert all(extract(p, wrappers["plain.org"]) == "\n".join(want) for p, want in made)
    texts = {r.page_id: r.text for r in extract_pages(pages).collect()}
    assert [texts[i] for i in range(40)] == ["\n".join(want) for _, want in made] and texts[100] == "Error: nothing here at all"
    assert any(extract(p) != "\n".join(want) for p, want in made)  # the wrapper is what decides


def test_very_deep_and_unlike_pages():
    import time

    deep = "<div>" * 5000 + "<p>deep</p>" + "</div>" * 5000
    pages = [deep.replace("deep", f"deep {i}") + "<span class='k'>constant</span>" for i in range(4)]
    whole = Template()
    for p in pages:
        whole.add(Template(outline(parse(p)), {hash(p)}))
    assert extract(pages[2], frozenset(whole.constants())) == "deep 2"

    def unlike(level, odd):
        return f"<div class='{'a' if odd else 'b'}'>x{odd}</div><section>{unlike(level - 1, odd) if level else 'end'}</section><ul><li>{level}</ul><div class='{'c' if odd else 'd'}'>y</div>"

    began = time.time()
    merge(outline(parse(unlike(40, 0))), outline(parse(unlike(40, 1))), siblings=False)
    assert time.time() - began < 2
    for kept in ('<body class="no-sidebar"><article><p>kept?</p></article></body>', '<article class="post has-comments"><p>kept?</p></article>', '<div class="ad-free-reading"><p>kept?</p></div>'):
        assert extract(kept) == "kept?"
