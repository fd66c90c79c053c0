import json
import random

from foliospark.llm.html_extract import HELD_TEXTS, Template, _matching, _score, _sign, extract, induce_wrappers, merge, outline, parse


def whole(pages):
    out = Template()
    for p in pages:
        out.add(Template(outline(parse(p)), {_sign(p)}))
    return frozenset(out.constants())


def test_wrapper_after_many_children():
    """A template keeps every child of a node, however many unlike ones it has."""
    rows = "".join(f"<h2>head N-{i}</h2><p>text N-{i}</p>" for i in range(200))
    pages = [f'<body>{rows.replace("N", str(n))}<div class="end">Call 555 now</div></body>' for n in range(6)]
    pages[3] = pages[3].replace("<body>", "<body><section>only here</section>")
    wrapper = whole(pages)
    assert all("Call 555" not in extract(p, wrapper) and extract(p, wrapper).count("\n") >= 399 for p in pages)


def lists(n, share):
    """Pages of 3,000 items of their own; every second one also has the shared item, whose sign sorts last."""
    return [f"<body><ul>{''.join(f'<li>item {i} of {k}</li>' for i in range(3000))}{f'<li>{share}</li>' if k % 2 else ''}</ul></body>" for k in range(n)]


LAST = max((f"Share this {i}" for i in range(20_000)), key=_sign)


def test_wrapper_among_many_texts():
    """A node counts every text that it holds, also those that are rare at first."""
    pages = lists(6, LAST)
    assert [LAST in extract(p) for p in pages] == [False, True] * 3
    assert not any(LAST in extract(p, whole(pages)) for p in pages)
    assert extract(pages[0], whole(pages)).count("\n") == 2999


def test_counts_of_tasks_add_up(spark):
    pages = lists(4 * HELD_TEXTS // 3000, LAST)  # a task writes its counts more than once
    rows = [(i, "http://long.org/x", p) for i, p in enumerate(pages)]
    rows += [(1000 + i, f"http://s{i % 3}.org/{i}", f"<body><div>Site {i % 3}</div><ul><li><a href='/'>a{i}</a><li><a href='/'>b{i}</a><li><a href='/'>c{i}</a></ul><p>own {i}</p></body>") for i in range(30)]
    table = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    got = {r.host: frozenset(map(tuple, json.loads(r.wrapper))) for r in induce_wrappers(table, fan_in=2).collect()}
    assert got.pop("long.org") == whole(pages) == {("/#root/body/ul/li", _sign(LAST))}
    assert got == {f"s{k}.org": whole([r[2] for r in rows if r[1].startswith(f"http://s{k}.")]) for k in range(3)}
    assert all(("/#root/body/ul", None) in w and len(w) > 1 for w in got.values())


def brute(a, b):
    if not a or not b:
        return 0
    pair = 1 + brute(a[0][-1], b[0][-1]) + brute(a[1:], b[1:]) if a[0][0] == b[0][0] else 0
    return max(pair, brute(a[1:], b), brute(a, b[1:]))


def test_matching_is_the_best():
    rng = random.Random(3)

    def page(depth):
        return "".join(f"<{t}>{page(depth - 1) if depth else ''}</{t}>" for t in rng.choices(["div", "h1", "ul", "section"], k=rng.randrange(6)))

    for _ in range(200):
        a, b = outline(parse(page(1))), outline(parse(page(1)))
        pairs = _matching(a[-1], b[-1], {})
        assert pairs == sorted(pairs) and all(a[-1][i][0] == b[-1][j][0] for i, j in pairs)
        assert sum(_score(a[-1][i], b[-1][j], {}) for i, j in pairs) == brute(a[-1], b[-1])
        todo = [merge(a, b, siblings=False)]
        for node in todo:
            keys = [c[0] for c in node[-1]]
            assert all(x != y for x, y in zip(keys, keys[1:]))
            todo += node[-1]
