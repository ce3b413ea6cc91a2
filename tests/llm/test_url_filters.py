import math
import re

import pytest
from conftest import SF001

from murmur.llm import url_filters as u


def brute_parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.split(r"[/?#]", rest, maxsplit=1)[0]
    path = re.split(r"[?#]", rest[len(host):], maxsplit=1)[0]
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), path


def brute_rule(host, path):
    best = None
    for text, says in u.RULES:
        own, _, prefix = text.partition("/")
        if (host == own or host.endswith("." + own)) and path.startswith("/" + prefix):
            if best is None or len(text) > len(best[0]):
                best = (text, says)
    return best


URLS = ["http://A.Example.NET/en/1", "https://example.net/en", "https://xexample.net/en/", "http://example.com/de/x?y#z",
        "http://example.com", "http://a.org?x=/fr/", "http://a.org/fr/#q", "://net/", "x://net", "nohost", "", None,
        "http://h\n.net/a\nb?c", "http://u@b.co.uk:80/p", "http://10.0.0.1/x", "http://É.net/", "a://b://c/d"]


def reputation(hosts, outcomes):
    """Python statement of the three-level shrinkage."""
    def domain(h):
        name = re.sub(r":[0-9]*$", "", h)
        m = re.search(rf"((?:[^.]+\.)?(?:(?:{u.SECOND_LEVEL})\.[a-z][a-z]|[^.]+))$", name)
        return name if re.match(r"^[0-9.]+$", name) or not m else m.group(1)

    def suffix(d):
        m = re.search(rf"((?:{u.SECOND_LEVEL})\.[a-z][a-z]|[^.]+)$", d)
        return d if re.match(r"^[0-9.]+$", d) or not m else m.group(1)

    counts = {h: [0, 0] for h in hosts}
    for h, bad in outcomes:
        counts[h][0] += 1
        counts[h][1] += bad
    up = {h: domain(h) for h in hosts}
    level2, level1 = {}, {}
    for h, (n, b) in counts.items():
        for table, key in ((level2, up[h]), (level1, suffix(up[h]))):
            have = table.setdefault(key, [0, 0])
            have[0] += n
            have[1] += b

    def shrink(groups, parent):
        some = {k: v for k, v in groups.items() if v[0]}
        s = sum((b - n * parent(k)) ** 2 / (n * parent(k) * (1 - parent(k))) for k, (n, b) in some.items()) - len(some)
        d = sum(n - 1 for n, _ in some.values())
        rho = max(u.RHO_MIN, min(u.RHO_MAX, s / d if d > 0 else u.RHO_MAX))
        k0 = 1 / rho - 1
        return {k: (k0 * parent(k) + b, k0 * (1 - parent(k)) + n - b) for k, (n, b) in groups.items()}

    n, b = (sum(v[i] for v in level1.values()) for i in (0, 1))
    mean = lambda ab: ab[0] / sum(ab)
    p1 = shrink(level1, lambda k: (b + 0.5) / (n + 1))
    p2 = shrink(level2, lambda k: mean(p1[suffix(k)]))
    p3 = shrink(counts, lambda k: mean(p2[up[k]]))
    return {h: (mean(ab), max(0.0, mean(ab) - u.Z * math.sqrt(mean(ab) * (1 - mean(ab)) / (sum(ab) + 1))))
            for h, ab in p3.items()}


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(i, x, 1) for i, x in enumerate(URLS * 2)] + [(None, "http://bad.spam.info/1", 2), (7, URLS[0], 3)]
    rows += [(100 + i, f"http://bad.spam.info/{i}", 0) for i in range(60)]
    return spark.createDataFrame(rows, "page_id long, url string, host int")


def test_rules_parts_and_reputation(spark, pages):
    outcomes = [(f"http://bad.spam.info/{i}", 1) for i in range(60)] + [("http://a.org/q", 0)] * 30 + [(URLS[0], 0)] * 20
    marks = spark.createDataFrame([*outcomes, ("http://a.org/q", None)], "url string, bad int")
    got = u.filter_urls(pages, marks).collect()
    assert len(got) == pages.count()
    hosts = {brute_parts(r["url"])[0] for r in got}
    want = reputation(hosts, [(brute_parts(x)[0], b) for x, b in outcomes])
    for r in got:
        host, path = brute_parts(r["url"])
        rule = brute_rule(host, path)
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule and rule[0])
        assert math.isclose(r["bad_rate"], want[host][0], rel_tol=1e-9)
        assert math.isclose(r["bad_rate_low"], want[host][1], rel_tol=1e-9, abs_tol=1e-12)
        assert r["verdict"] == (rule[1] if rule else "block" if want[host][1] > u.MAX_BAD else "allow")
    assert {r["verdict"] for r in got if r["host"] == "bad.spam.info"} == {"block"}


def test_empty_tables(spark, pages):
    none = spark.createDataFrame([], "url string, bad int")
    assert u.filter_urls(pages.limit(0), none).count() == 0
    got = u.filter_urls(pages, none).collect()
    assert len(got) == pages.count() and all(r["verdict"] == "allow" for r in got if r["rule"] is None)


def test_no_python_in_the_plan(spark):
    from murmur.llm.queries import QUERIES
    plan = QUERIES["op1_url_filters"](spark, SF001)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))
