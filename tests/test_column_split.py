import random

from foliospark.operators.candidates import split_columns


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_columns_need_no_window(spark):
    rng = random.Random(2)
    rows = [(d, i, None if rng.random() < 0.05 else rng.randrange(200) * 1.0, None if rng.random() < 0.05 else rng.randrange(260) * 1.0, d % 5) for d in range(60) for i in range(d % 9 + 1)]
    out = split_columns(spark.createDataFrame(rows, "d int, i int, a double, b double, k int"), "d", "i", "a", "b", "k")
    assert "Window" not in plan(out)
    want = []
    for d in range(60):
        line = sorted((r for r in rows if r[0] == d), key=lambda r: (r[2] is not None, r[2] or 0, r[1]))
        gaps = [(-(y[2] - x[3]), n) for n, (x, y) in enumerate(zip(line, line[1:]), 1) if y[2] is not None and x[3] is not None]
        k = d % 5
        cuts = [n for _, n in sorted(gaps)[: max(k - 1, 0)]]
        want += [(d, r[1], sum(c <= n for c in cuts)) for n, r in enumerate(line)] if 0 < k <= len(line) else []
    assert sorted(map(tuple, out.select("d", "i", "column").collect())) == sorted(want)
