import duckdb

from foliospark.llm.queries import URL_SQL, op4_url_filter
from foliospark.llm.url_filter import judge_urls


def test_sql_backs_off_too(spark, tmp_path):
    hosts = [("spam.com", 1), ("fine.com", 0), ("x.bad", 1), ("y.good", 0), ("b.co.uk", 1)]
    urls = [f"http://h{i % 7}.{h}/en/{i * 10 + k}" for k, (h, _) in enumerate(hosts) for i in range(60)]
    unseen = ["http://new.spam.com/x", "http://new.fine.com/", "http://n.unseen.bad/x?q", "http://n.unseen.good", "http://a.zz/", "http://localhost/x", "no host", None, "http://new.b.co.uk/#x", "https://a.org/fr/x", "http://h.example.net/en/9"]
    pages = list(enumerate([*urls, *unseen, urls[0]]))
    spark.createDataFrame(pages, "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    labels = [(i * 10 + k, 1 - bad, 0) for k, (_, bad) in enumerate(hosts) for i in range(60)]
    spark.createDataFrame([*labels, (None, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    con = duckdb.connect()
    for t in ("pages", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tmp_path}/{t}.parquet/*.parquet')")
    got = sorted((tuple(r) for r in op4_url_filter(spark, str(tmp_path)).collect()), key=str)
    assert got == sorted(con.execute(URL_SQL).fetchall(), key=str) and {r[4] for r in got if r[0] >= len(urls)} == {"allow", "block"}


def test_hosts_without_outcomes_back_off(spark):
    rows = [(f"http://h{i % 20}.spam.com/", 1) for i in range(400)] + [(f"http://h{i % 20}.fine.com/", 0) for i in range(400)]
    rows += [(f"http://h.d{i % 50}.bad/", 1) for i in range(500)] + [(f"http://h.d{i % 50}.good/", 0) for i in range(500)]
    pages = ["http://new.spam.com/x", "http://new.fine.com/x", "http://new.unseen.bad/x", "http://new.unseen.good/x", "http://new.unseen.com/x", "http://a.unseen.zz/x", "no host"]
    docs = spark.createDataFrame(list(enumerate(pages)), "page_id long, url string")
    out = {r.page_id: r for r in judge_urls(docs, spark.createDataFrame(rows, "url string, bad long"), ()).collect()}
    assert len(out) == len(pages)
    assert [out[i].verdict for i in range(7)] == ["block", "allow", "block", "allow", "allow", "allow", "allow"]
    assert out[6].bad_bound is None and all(out[i].bad_bound is not None for i in range(6))
    assert out[0].bad_bound > out[4].bad_bound and out[0].bad_bound > out[1].bad_bound
