import pytest

from tracekiln.llm import queries, url_filter

RULES = queries.URL_RULES


def brute(url, rules, default="allow"):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        end = next((i for i, c in enumerate(rest) if c in "/?#"), len(rest))
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:end])
        tail = rest[end:]
        path = tail[:next((i for i, c in enumerate(tail) if c in "?#"), len(tail))]
    fit = [(len(h) + len(p), len(h), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fit)[2:] if fit else (None, default)))


URLS = [None, "", "no scheme", "http://", "http://COM/", "http://a.com", "http://a.com/x", "https://example.com/en/1",
        "https://www.example.com/en/1", "https://Blog.www.Example.com/en/?x=1", "ftp://notexample.com/en/", "http://x.net/es/a#b",
        "http://net/fr/", "http://x.net/fr", "http://user@h.net:80/fr/", "a://b://c.com/en/", "http://É.com/É\n/x", "http://a..com/",
        "http://" + "a." * 3000 + "com/" + "p" * 50_000, "http://x.com?y/en/", "http://x.com#/"]


@pytest.mark.parametrize("how", [{}, {"inline_bytes": 0}, {"broadcast_rules": 0, "salts": 3}])
def test_matches_brute_force(spark, how):
    rows = [(i // 2, u, "x", "y") for i, u in enumerate(URLS + URLS)] + [(None, URLS[7], "x", "y")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, rule string, labels string")
    rules = spark.createDataFrame([*RULES, (None, "/", "block"), RULES[0]], "host string, path string, verdict string")
    got = sorted(map(tuple, url_filter.judge_urls(pages, rules, **how).collect()), key=repr)
    assert got == sorted(((p, *brute(u, RULES)) for p, u, *_ in rows), key=repr)


def test_many_rules_and_none(spark):
    rules = [(f"h{i % 50}.com", f"/p{i}/", "block") for i in range(3000)]
    rows = [(i, f"http://w.h{i % 50}.com/p{i * 3}/z") for i in range(2000)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string")
    df = spark.createDataFrame(rules, "host string, path string, verdict string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge_urls(pages, df).collect()}
    by_rule = {(h, p) for h, p, _ in rules}
    for i, u in rows:
        hit = (f"h{i % 50}.com", f"/p{i * 3}/") in by_rule
        assert (got[i][3] == "block") == hit
    none = url_filter.judge_urls(pages, df.limit(0)).collect()
    assert len(none) == 2000 and all(r.rule is None and r.verdict == "allow" for r in none)
    assert url_filter.judge_urls(pages.limit(0), df).collect() == []


def test_no_python_in_the_plan(spark):
    pages = spark.createDataFrame([(1, "http://a.com/")], "page_id bigint, url string")
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    plan = url_filter.judge_urls(pages, rules)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan
