import pytest

from quorumtab.llm import url_filter
from quorumtab.llm.url_filter import RULES, bloom_of, judge, possible_hits

LISTED = ["cheap-pills.example.com/en", "www.spam-farm.example.net", "foo.org", "a.com/df", "never.seen/at/all"]

URLS = [
    None, "", "no scheme", "http://A.EXAMPLE.org/en/1?x", "http://example.org/en/2", "https://xexample.org/es/", "https://b.c.example.org/es/q#t",
    "http://foo.org", "http://foo.org/", "http://org/x", "http://a.com/fr/", "http://a.com/de/x", "http://a.com/df/", "x://y://z.org/a", "ftp://cheap-pills.example.com/en/",
    "http://www.spam-farm.example.net?q", "http://É.com/fr/é", "http://a.com:80/fr/", "http:///fr/", "http://.org/", "http://a..org/", "http://" + "l." * 3000 + "com/de/" + "p" * 5000, "http://a\nb.org/es/\n",
]


def brute(url):
    if url is None or "://" not in url:
        return "", "", None, "allow"
    rest = url.split("://", 1)[1]
    cut = min((rest.index(c) for c in "/?#" if c in rest), default=len(rest))
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:]
    path = path[: min((path.index(c) for c in "?#" if c in path), default=len(path))]
    fits = lambda h: host == h or host.endswith("." + h)
    best = max(((len(k), k, v) for k, v in RULES if fits(k.split("/")[0]) and path.startswith(k[k.index("/") :])), default=None)
    return host, path, best and best[1], best[2] if best else "block" if host and host + path.rstrip("/") in LISTED else "allow"


def lists(spark):
    return spark.createDataFrame(RULES, "key string, verdict string"), spark.createDataFrame([(u,) for u in LISTED], "url string")


@pytest.mark.parametrize("most", [1 << 21, 0])
def test_verdicts_by_brute_force(spark, monkeypatch, most):
    monkeypatch.setattr(url_filter, "MOST_BLOCKS", most)
    df = spark.createDataFrame([(i, u, "k") for i, u in enumerate(URLS * 2)], "page_id long, url string, key string")
    out = judge(df, *lists(spark)).collect()
    assert len(out) == 2 * len(URLS)
    for r in out:
        assert (r.host, r.path, r.rule, r.verdict) == brute((URLS * 2)[r.page_id])


@pytest.mark.parametrize("most", [1 << 21, 0])
def test_filter_loses_no_listed_key_and_drops_most_others(spark, monkeypatch, most):
    monkeypatch.setattr(url_filter, "MOST_BLOCKS", most)
    listed = spark.range(20_000).selectExpr("concat('h', id, '.org/') AS key")
    assert possible_hits(listed, listed, 20_000).count() == 20_000
    others = spark.range(20_000).selectExpr("concat('other', id, '.org/') AS key")
    assert possible_hits(others, listed, 20_000).count() < 4_000
    assert bloom_of(listed, 20_000)[0].count() <= 3334


def test_empty_tables(spark):
    pages = spark.createDataFrame([], "page_id long, url string")
    assert judge(pages, *lists(spark)).count() == 0
    rules, none = (x.limit(0) for x in lists(spark))
    one = spark.createDataFrame([(1, "http://a.org/x")], "page_id long, url string")
    assert judge(one, rules, none).first().verdict == "allow"
