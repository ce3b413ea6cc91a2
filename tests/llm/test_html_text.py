import html
import re

import numpy as np
from conftest import SF001
from hypothesis import given, settings
from hypothesis import strategies as st

from murmur.llm import html_text as h


def brute_article(source):
    """The article of the pages in the tables, whose blocks are h1 and p."""
    m = re.search(r"<article>(.*?)(</article>|$)", source, re.S)
    parts = re.split(r"</?(?:p|h1)>", m.group(1) if m else "")
    parts = [re.sub(r"<[^>]*(>|$)", "", p.replace("<br>", " ")) for p in parts]
    return "\n\n".join(x for x in (" ".join(html.unescape(p).split()) for p in parts) if x)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=1, max_size=60), st.integers(1, 7))
def test_ranks_are_a_suffix_array_of_that_depth(codes, depth):
    rank = h.suffix_ranks(np.array(codes), depth)
    keys = [tuple(codes[i:i + depth]) if i + depth <= len(codes) else None for i in range(len(codes))]
    order = {k: i for i, k in enumerate(sorted({k for k in keys if k is not None}))}
    assert rank.tolist() == [-1 if k is None else order[k] for k in keys]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 2), st.integers(1, 4), st.lists(st.integers(2, 4), max_size=12)), max_size=6))
def test_runs_equal_brute_force(raw):
    n = 3
    streams = [(host, page, np.array([0, 0, *t, 0, 0], dtype=np.uint64)) for host, page, t in raw]
    want = {}
    for host, page, t in streams:
        for k in h._run_keys(t, host, n).tolist():
            a, b = want.get(k, (page, page))
            want[k] = (min(a, page), max(b, page))
    key, low, high = h.repeated_runs(streams, n)
    assert dict(zip(key.tolist(), zip(low.tolist(), high.tolist()))) == want and len(key) == len(want)


def lines(source):
    return [x for x, _, marked in h.page_blocks(source) if not marked]


def test_blocks():
    assert lines("<p>a &amp; b<br>c<b> d</b>e<p>f") == ["a & b c de", "f"]
    assert lines("x<script>var t='<p>no</p>'</script>y<style>p{}</style><!-- <p>no -->") == ["xy"]
    assert lines("<div>a<div class='ad'>no</div>b</div>") == ["a", "b"]
    assert lines("<article><header><h1>t</h1></header><p>x</p><aside>no</aside></article><header>no</header>") == ["t", "x"]
    assert lines("<ul><li>a<li>b</ul><section id=comments><p>no</p></section>") == ["a", "b"]
    assert lines("a < b &lt;p&gt; <p title='a > b'>c") == ["a < b <p>", "c"]
    assert lines("") == [] and lines("<p>cut &am") == ["cut &am"] and lines("<p>cut<a href='x") == ["cut"]
    assert lines("<p>shadow heads addition</p>") == ["shadow heads addition"]


def test_marked_parts_with_names_of_their_place():
    for part in ('<ol class="comment-list"><li>no</ol>', '<div class="post-comments"><p>no</p></div>',
                 '<div class="site-footer">no</div>', '<ul class="main-nav"><li>no</ul>', '<div class="left-sidebar">no</div>',
                 '<div class="cookie-banner">no</div>', '<p class="ad">no</p>'):
        assert lines(f"<article><p>x</p>{part}<p>y</p></article>") == ["x", "y"]
        assert lines(f"<p>x</p>{part}<p>y</p>") == ["x", "y"]
    assert lines('<article><p class="notice">a</p><p class="related">b</p></article>') == ["a", "b"]
    assert lines('<div class="post"><p class="main">x</p></div>') == ["x"]


def test_articles_are_whole_whatever_their_names():
    for tag in ('article class="post comments-open"', 'main class="has-sidebar"', 'article id="menu"', "main role='search'"):
        assert lines(f"<nav>no</nav><{tag}><p>x</p></{tag.split()[0]}>") == ["x"]
    assert lines('<article><p>x</p><section id="related-work"><p>y</p></section></article>') == ["x", "y"]
    assert lines('<form id="aspnetForm"><nav>no</nav><article><p>x</p></article><div class="ad">no</div></form>') == ["x"]
    assert lines('<div class="ad">no<article><p>x</p></article>') == ["x"]
    assert lines('<form id="aspnetForm"><div>no article, but the page</div></form><p>foot</p>') == [
        "no article, but the page", "foot"]
    assert lines("<p>a text longer than its form</p><form>no</form>") == ["a text longer than its form"]
    assert lines('<article><p>x</p><div id="comments"><article class="c">no</article></div></article>') == ["x"]
    assert lines('<article><p>x <a href="/p?id=search" data-id="menu">y</a></p></article>') == ["x y"]
    assert lines('<div class="ad-banner">no</div><div class="cookie_notice wide">no</div><p>x</p>') == ["x"]


def test_self_closed_and_unclosed_elements_swallow_nothing():
    for tag in ("svg", "math", "object", "select", "noscript", "template", "iframe", "script"):
        assert lines(f'<p>a<{tag} title="1 > 0" /></p><p>b</p><{tag}>no</{tag}><p>c</p>') == ["a", "b", "c"]
        assert lines(f"<p>a<{tag}/>b</p>") == ["ab"]
    for tag in ("svg", "math", "object", "select", "noscript"):
        assert lines(f"<p>a</p><{tag}><p>b</p><{tag}>no</{tag}><p>c</p>") == ["a", "b", "c"]
        assert lines(f"<p>a<{tag}>no<{tag}>no</{tag}>no</{tag}>b</p>") == ["ab"]
    assert lines("<p>a</p><script>var t = '<p>no</p>") == ["a"]


def story(i):
    return " ".join(f"{w}{i}" for w in ("once", "there", "was", "a", "page", "with", "its", "own", "words"))


def test_repeated_blocks_go_and_unique_ones_stay(spark):
    menu = "<div>all our shops are open on every day of the week</div>"
    rows = [(i, f"http://a.net/{i}", f"{menu}<div>{story(i)}</div>") for i in range(8)]
    rows += [(20, "http://b.net/", menu + "<p>single page of the host</p>"), (20, "http://b.net/", menu + "<p>single page of the host</p>"),
             (21, "http://a.net/9", None), (None, None, ""), (22, "http://c.net/", "<p>" + "word " * 100_000 + "</p>")]
    copy = "<article><p>" + " ".join(f"w{i}" for i in range(80)) + "</p></article>"
    rows += [(30 + i, f"http://a.net/c{i}", menu + copy) for i in range(3)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, text string, bucket int")
    for bucket_bytes in (1 << 20, 200):
        got = sorted(((r["page_id"], r["text"]) for r in h.extract_text(df, bucket_bytes=bucket_bytes).collect()), key=str)
        own = "all our shops are open on every day of the week\n\nsingle page of the host"
        want = [(i, story(i)) for i in range(8)]
        want += [(20, own), (20, own), (21, ""), (None, ""), (22, ("word " * 100_000).strip())]
        want += [(30 + i, " ".join(f"w{i}" for i in range(80))) for i in range(3)]
        assert got == sorted(want, key=str)
    assert h.extract_text(df.limit(0)).count() == 0


def test_whole_table(spark):
    df = spark.read.parquet(f"{SF001}/pages.parquet")
    want = {r["page_id"]: brute_article(r["html"]) for r in df.collect()}
    got = {r["page_id"]: r["text"] for r in h.extract_text(df).collect()}
    assert got == want
