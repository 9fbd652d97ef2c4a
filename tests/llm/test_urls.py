from veritab.llm.urls import RULES, judge


def _brute(url):
    if url is None or "://" not in url:
        return "", "", None, "allow"
    rest = url.split("://", 1)[1]
    end = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host, path = rest[:end].lower(), rest[end:]
    path = path[: min([path.find(c) for c in "?#" if c in path] or [len(path)])]
    fit = [(len(h + p), h + p, v) for v, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fit)[1:] if fit else (None, "allow")))


def test_against_brute_force(spark):
    urls = [None, "", "no scheme", "http://", "https://COM/en/", "http://a.example.com/en/71", "http://example.com/en/8", "http://notexample.com/en/7", "x://b.net/de/8", "x://example.net/de/8?q", "x://a.b.example.net/de/8#t", "http://org/es/1", "http://a.org?x=/es/", "http://a.org/es", "http://a.org/es/#://b.com/en/", "http://a..com/en/1", "http://com./en/1", "http://a.com/en/" + "y" * 3000, "http://a.com/\nen/"] * 2
    df = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)], "page_id long, url string, host string")
    rules = spark.createDataFrame(list(RULES), "verdict string, host string, path string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in judge(df, "url", rules).collect()}
    assert got == {i: _brute(u) for i, u in enumerate(urls)}
    assert judge(df.limit(0), "url", rules).count() == 0
