import re

from tidelog.llm import urlfilter as u


def split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), path


URLS = [None, "", "no scheme", "http://", "http://EXAMPLE.com/en/7x?q#f", "http://a.b.example.com/en/8", "http://notexample.com/en/7", "http://x.example.net/de/81", "http://net/de/", "http://xnet/de/", "http://y.org/es/1://2", "http://q.org?x=/es/", "http://É.org#a", "ftp://x.org/es/\nz"] + [
    f"http://h{i}.{d}/{p}/{i}" for i in range(30) for d, p in (("example.com", "en"), ("foo.net", "de"), ("foo.org", "fr"))
]


def test_split_rules_and_verdicts(spark):
    pages = spark.createDataFrame([(i, x, "", 1) for i, x in enumerate(URLS)] + [(None, URLS[4], "", 1)], "page_id long, url string, html string, HOST int")
    rows = {r["page_id"]: r for r in u.report(pages).collect()}
    assert len(rows) == len(URLS) + 1
    for i, x in enumerate(URLS):
        host, path = split(x)
        fits = [r for r in u.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        best = max(fits, key=lambda r: len(r.name), default=None)
        assert (rows[i]["host"], rows[i]["path"], rows[i]["rule"]) == (host, path, best and best.name)
        assert rows[i]["verdict"] == (best.verdict if best else ("block" if rows[i]["block_probability"] > 0.5 else "allow"))
    assert u.report(pages.limit(0)).count() == 0


def test_model_learns_what_labels_show(spark):
    data = [(f"http://shop{i}.casino.biz/win/{i}", True) for i in range(200)] + [(f"http://uni{i}.edu/paper/{i}", False) for i in range(200)] + [(None, True), ("http://a", None)]
    model = u.fit(spark.createDataFrame(data, "url string, block boolean"))
    test = spark.createDataFrame([(1, "http://new.casino.biz/win/x"), (2, "http://new.edu/paper/x")], "page_id long, url string")
    p = {r["page_id"]: r["block_probability"] for r in u.judge(test, model, ()).collect()}
    assert p[1] > 0.8 and p[2] < 0.2
    assert u.fit(spark.createDataFrame([], "url string, block boolean")).bias == -1.0


def test_held_out_labels(spark):
    """A model of three quarters of the labelled table judges the last quarter, and hosts of words it has not met together."""
    import zlib

    held = lambda x: zlib.crc32(x.encode()) % 4 == 2
    table = u.labelled_urls()
    assert 1_000 < len(table) < u.LABELLED_ROWS and len({x for x, _ in table}) == len(table)
    model = u.fit(spark.createDataFrame([x for x in table if not held(x[0])], "url string, block boolean"))
    test = [x for x in table if held(x[0])]
    out = u.judge(spark.createDataFrame([(i, x) for i, (x, _) in enumerate(test)], "page_id long, url string"), model, ()).collect()
    right = sum((r["verdict"] == "block") == test[r["page_id"]][1] for r in out)
    assert right / len(test) > 0.97
    # Names of other words, and none that the table has.
    whole = u.fit(spark.createDataFrame(table, "url string, block boolean"))
    other = ["http://www.tionand.example.com/en/1", "https://blog.onthe.example.net/fr/2", "http://anesh.example.org/de/3"]
    verdicts = u.judge(spark.createDataFrame([(i, x) for i, x in enumerate(other)], "page_id long, url string"), whole, ()).collect()
    assert {r["verdict"] for r in verdicts} == {"allow"}


def test_a_hot_labelled_url_does_not_fill_the_sample(spark):
    data = [("http://hot.casino.biz/1", True)] * 500 + [(f"http://a{i}.pills.biz/{i}", True) for i in range(20)] + [(f"http://b{i}.edu/{i}", False) for i in range(20)]
    model = u.fit(spark.createDataFrame(data, "url string, block boolean"), rows=60)
    out = u.judge(spark.createDataFrame([(1, "http://new.pills.biz/5")], "page_id long, url string"), model, ()).first()
    assert out["verdict"] == "block"


def test_very_long_url(spark):
    pages = spark.createDataFrame([(1, "http://x.org/" + "a" * 3_000_000)], "page_id long, url string")
    assert len(u.report(pages).first()["path"]) == 3_000_001
