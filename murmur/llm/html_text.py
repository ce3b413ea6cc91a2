"""Main text of pages by host suffix arrays.

A page is read once into blocks of text. Blocks inside ``<article>`` or
``<main>`` are its article; blocks inside menus, headers, footers, sidebars,
forms, notices, adverts or reader comments, as element names and class names
tell, are marked. The token streams of all blocks outside the article are
concatenated by host and their suffixes sorted by prefix doubling to a depth
of ``run_tokens``: neighbours that agree that far are a run repeated in the
host. A run on two distinct pages is boilerplate; a block is removed when it
is marked or runs cover at least half of it, and unique blocks stay.

Article blocks are not in the streams: a text that several pages of a host
print is a copy, not a template, and must stay whole. Marked blocks are removed
even where no second page repeats them (an advert shown once); that decision
is structure's, not the suffix array's.

Hosts are not gathered. Pages are dealt to buckets of ``bucket_bytes`` by a
hash; each bucket sorts the suffixes of its pages, host by host, and gives
each distinct run once, with its smallest and largest page; these rows are
merged by run over all buckets, and repeated runs return to the buckets that
hold them.

Input cases: a null url is the host '' ; null html is empty; a page without
text gives an empty text; cut-off pages end where they end; very long pages
are taken whole; rows with equal ids are rows of their own but not distinct
pages; a null id is told apart by its url; an empty table gives no rows;
further input columns are ignored."""

from __future__ import annotations

import html
import math
import re
import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from murmur.llm._common import by_value, narrow
from murmur.llm.url_filters import url_host

by_value(__name__)

RUN_TOKENS = 6
BUCKET_BYTES = 8 << 20
COVERED = 0.5

_ATTRS = r"""[^>"']*(?:(?:"[^"]*(?:"|\Z)|'[^']*(?:'|\Z))[^>"']*)*"""
_TOKEN = re.compile(rf"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)({_ATTRS})(?:>|\Z)", re.S)
#: Elements whose content is not read: raw text, to the page's end where it is
#: not closed, and others, of which only the tag is skipped if it is not closed.
_RAW = frozenset("script style textarea title iframe".split())
_HIDDEN = frozenset("noscript template svg select object math".split())
_TAGS = {t: re.compile(rf"<(/?){t}(?=[\s/>]|\Z)({_ATTRS})(?:>|\Z)", re.S | re.I) for t in _HIDDEN}
_END = {t: re.compile(rf"</{t}\b[^>]*(?:>|\Z)", re.I) for t in _RAW}
_ATTR = re.compile(r"""([^\s"'>/=]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
_WORDS = re.compile(r"[a-z]+")
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section "
    "summary table tbody td tfoot th thead tr ul".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_ARTICLE = frozenset(("article", "main"))
_MARKED = frozenset("nav footer aside form dialog button menu head".split())
_MARKED_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo banner cookie cookies consent gdpr "
    "notice notices alert popup modal overlay sidebar menu nav navbar navigation breadcrumb breadcrumbs footer masthead "
    "comment comments disqus share sharing social related recommended newsletter subscribe signup search widget "
    "contentinfo complementary toolbar pagination".split())
#: Words that say where or how large a marked part is, not what it is.
_PLACE_NAMES = frozenset(
    "site page main primary secondary global left right top bottom upper lower side header post article list item items "
    "box bar block area section container wrapper inner outer links group thread form reply replies reader readers user "
    "users".split())
#: Names that an article's own paragraphs may have.
_PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre li dd dt td th figcaption".split())
_PROSE_NAMES = frozenset("notice notices alert search related recommended social toolbar overlay".split())
_PROSE_MARKED, _KNOWN_NAMES = _MARKED_NAMES - _PROSE_NAMES, _MARKED_NAMES | _PLACE_NAMES


_FORM, _MARK = 1, 2     # marked by a form only, marked


def _is_marked(tag: str, attrs: str, in_article: bool) -> bool:
    if tag in _MARKED or (tag == "header" and not in_article):
        return True
    if "=" not in attrs or tag in ("body", "html") or tag in _ARTICLE:
        return False
    marked = _PROSE_MARKED if in_article and tag in _PROSE else _MARKED_NAMES
    for m in _ATTR.finditer(attrs):
        if m.group(1).lower() in ("class", "id", "role"):
            for name in (m.group(2) or m.group(3) or m.group(4) or "").lower().split():
                # a whole name: "ad-banner" and "comment-list" are marked, "comments-open" and "has-sidebar" are not
                words = set(_WORDS.findall(name))
                if words & marked and words <= _KNOWN_NAMES:
                    return True
    return False


def _closed(source: str, tag: str) -> dict[int, int]:
    """Where the elements ``tag`` that are closed start and end."""
    ends: dict[int, int] = {}
    opened: list[int] = []
    for m in _TAGS[tag].finditer(source):
        if m.group(1):
            if opened:
                ends[opened.pop()] = m.end()
        elif not m.group(2).endswith("/"):
            opened.append(m.start())
    return ends


def page_blocks(source: str) -> list[tuple[str, bool, bool]]:
    """(text, in the article, marked) of a page's blocks in order: character
    references decoded, white space single, empty blocks left out. An article
    starts unmarked wherever it stands, but for one inside another article
    (a reader comment); a form round most of the page is its wrapper."""
    out: list[tuple[str, bool, int]] = []
    text: list[str] = []
    stack: list[tuple[str, bool, int]] = []     # (tag, in the article, mark) of open elements
    hidden: dict[str, dict[int, int]] = {}
    at = 0

    def flush() -> None:
        if text:
            joined = "".join(text)
            text.clear()
            line = " ".join((html.unescape(joined) if "&" in joined else joined).split())
            if line:
                out.append((line, stack[-1][1] if stack else False, stack[-1][2] if stack else 0))

    while m := _TOKEN.search(source, at):
        if m.start() > at:
            text.append(source[at:m.start()])
        at = m.end()
        tag = m.group(2)
        if tag is None:
            continue
        tag = tag.lower()
        if tag in _RAW or tag in _HIDDEN:
            if not m.group(1) and not m.group(3).endswith("/"):
                if tag in _RAW:
                    end = _END[tag].search(source, at)
                    at = end.end() if end else len(source)
                else:
                    if tag not in hidden:
                        hidden[tag] = _closed(source, tag)
                    at = max(at, hidden[tag].get(m.start(), at))
            continue
        if tag == "br":
            text.append(" ")
            continue
        if tag in _BLOCK:
            flush()
        if m.group(1):
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    if any(s[1] or s[2] for s in stack[i:]):
                        flush()
                    del stack[i:]
                    break
                if tag == "p" and stack[i][0] in _BLOCK:
                    break
            continue
        if tag in _BLOCK:       # a block ends an open paragraph
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == "p":
                    del stack[i:]
                    break
                if stack[i][0] in _BLOCK:
                    break
        if tag in _VOID or m.group(3).endswith("/"):
            continue
        _, inside, marked = stack[-1] if stack else ("", False, 0)
        mark = marked
        if tag in _ARTICLE:
            if marked and not any(s[0] == "article" for s in stack):
                mark = 0
        elif marked < _MARK and _is_marked(tag, m.group(3), inside):
            mark = _FORM if tag == "form" and not inside else _MARK
        if mark != marked or (tag in _ARTICLE and not inside):
            flush()
        stack.append((tag, inside or tag in _ARTICLE, mark))
    if at < len(source):
        text.append(source[at:])
    flush()
    wrapper = sum(len(x) for x, _, k in out if k == _FORM) > sum(len(x) for x, _, k in out if not k)
    return [(x, inside, k == _MARK or k == _FORM and not wrapper) for x, inside, k in out]


# --- streams and suffix arrays --------------------------------------------------------
_MULT = np.uint64(0x9E3779B97F4A7C15)


def _stream(blocks, run_tokens: int):
    """Token hashes of the blocks outside the article, with a boundary token
    round each, and the block of every token (-1: boundary)."""
    tokens, owner = [0] * (run_tokens - 1), [-1] * (run_tokens - 1)
    h = xxhash.xxh64_intdigest
    for i, (line, inside, _) in enumerate(blocks):
        if not inside:
            words = line.split()
            tokens += [h(w) for w in words]
            owner += [i] * len(words)
            tokens.append(1)
            owner.append(-1)
    tokens += [0] * (run_tokens - 1)
    owner += [-1] * (run_tokens - 1)
    return np.array(tokens, dtype=np.uint64), np.array(owner)


def _run_keys(tokens: np.ndarray, host: int, run_tokens: int) -> np.ndarray:
    """A 64-bit key of the run of ``run_tokens`` tokens at every place."""
    n = len(tokens) - run_tokens + 1
    start = (host * int(_MULT) + 1) % (1 << 64)
    key = np.full(n, start ^ (start >> 31), dtype=np.uint64)
    for j in range(run_tokens):
        key = (key ^ tokens[j:j + n]) * _MULT
        key ^= key >> np.uint64(29)
    return key.view(np.int64)


def suffix_ranks(codes: np.ndarray, depth: int) -> np.ndarray:
    """Rank of every suffix by its first ``depth`` codes (prefix doubling);
    equal ranks are suffixes that agree that far. Places whose suffix is
    shorter than ``depth`` get -1."""
    rank, have = np.unique(codes, return_inverse=True)[1].astype(np.int64), 1
    while have < depth:
        step = min(have, depth - have)
        n = len(rank) - step
        if n <= 0:
            return np.full(len(codes), -1)
        pair = rank[:n] * (rank.max() + 1) + rank[step:step + n]
        rank = np.unique(pair, return_inverse=True)[1].astype(np.int64)
        have += step
    return np.concatenate([rank, np.full(len(codes) - len(rank), -1)])


def repeated_runs(streams: list[tuple[int, int, np.ndarray]], run_tokens: int):
    """Over the streams (host, page, tokens) of a bucket: key, smallest and
    largest page of each distinct run, one row a run and host."""
    hosts = sorted({h for h, _, _ in streams})
    out = []
    for host in hosts:
        own = [(p, t) for h, p, t in streams if h == host]
        # streams end in boundary tokens; runs that cross a page's end are left out
        whole = np.concatenate([t for _, t in own])
        page = np.repeat(np.array([p for p, _ in own], dtype=np.int64), [len(t) for _, t in own])
        ends = np.repeat(np.cumsum([len(t) for _, t in own]), [len(t) for _, t in own])
        rank = suffix_ranks(whole, run_tokens)
        inside = np.flatnonzero((np.arange(len(whole)) + run_tokens <= ends) & (rank >= 0))
        order = inside[np.lexsort((page[inside], rank[inside]))]      # the suffix array, ties by page
        first = np.flatnonzero(np.r_[True, np.diff(rank[order]) != 0]) if len(order) else np.zeros(0, dtype=int)
        last = np.r_[first[1:], len(order)] - 1
        keys = np.concatenate([_run_keys(t, host, run_tokens) for _, t in own])
        starts = np.concatenate([np.arange(max(0, len(t) - run_tokens + 1)) + o for (_, t), o in
                                 zip(own, np.cumsum([0] + [len(t) for _, t in own[:-1]]))])
        key_at = np.zeros(len(whole), dtype=np.int64)
        key_at[starts] = keys
        out.append((key_at[order[first]], page[order[first]], page[order[last]]))
    return [np.concatenate(x) for x in zip(*out)] if out else [np.zeros(0, dtype=np.int64)] * 3


def main_text(blocks, tokens, owner, repeated: np.ndarray, run_tokens: int) -> tuple[str, int]:
    """The kept blocks, joined, and how many blocks repeated runs covered.
    ``repeated`` tells for every place whether a repeated run starts there."""
    cover = np.zeros(len(tokens) + 1, dtype=np.int64)
    at = np.flatnonzero(repeated)
    np.add.at(cover, at, 1)
    np.add.at(cover, at + run_tokens, -1)
    covered = np.cumsum(cover[:-1]) > 0
    size = np.bincount(owner[owner >= 0], minlength=len(blocks))
    hit = np.bincount(owner[(owner >= 0) & covered], minlength=len(blocks))
    boiler = (hit >= COVERED * size) & (size > 0)
    keep = [inside and not marked or not inside and not marked and not b
            for (_, inside, marked), b in zip(blocks, boiler)]
    if not any(keep):    # all that is not marked repeats: a copied page, not a template
        keep = [not marked for _, _, marked in blocks]
    return "\n\n".join(line for (line, _, _), k in zip(blocks, keep) if k), int(boiler.sum())


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
                 run_tokens: int = RUN_TOKENS, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """(page_id, url, text, covered_blocks) of every page."""
    own = narrow(pages, page_id=F.col(id_col).cast("long"), url=url_col, html=F.coalesce(F.col(html_col), F.lit("")))
    size = own.agg(F.sum(F.octet_length("html"))).first()[0] or 0
    buckets = max(1, math.ceil(size / bucket_bytes))
    dealt = own.select(
        F.pmod(F.xxhash64("page_id", "url"), F.lit(buckets)).cast("int").alias("bucket"), "page_id", "url",
        F.xxhash64(url_host(F.col("url"))).alias("host"),
        F.coalesce("page_id", F.xxhash64("url")).alias("page"), "html")

    def parsed(batches):
        """Pages as blocks, without markup and deflated: this is what moves."""
        for b in batches:
            for i in range(0, b.num_rows, 256):
                some = b.slice(i, 256)
                blocks = [page_blocks(x) for x in some.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [some.column(c) for c in ("bucket", "page_id", "url", "host", "page")]
                    + [pa.array([zlib.compress("\n".join(x[0] for x in p).encode(), 1) for p in blocks], pa.binary()),
                       pa.array([[x[1] for x in p] for p in blocks], pa.list_(pa.bool_())),
                       pa.array([[x[2] for x in p] for p in blocks], pa.list_(pa.bool_()))],
                    names=["bucket", "page_id", "url", "host", "page", "lines", "inside", "marked"])

    def outside(batches):
        """Only what the streams need."""
        for b in batches:
            for i in range(0, b.num_rows, 256):
                some = b.slice(i, 256)
                lines = [[x[0] for x in page_blocks(s) if not x[1]] for s in some.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [some.column(c) for c in ("bucket", "host", "page")] + [pa.array(lines, pa.list_(pa.string()))],
                    names=["bucket", "host", "page", "lines"])

    def runs(table: pa.Table) -> pa.Table:
        rows = zip(*[table.column(c).to_pylist() for c in ("host", "page", "lines")])
        streams = [(h & ((1 << 64) - 1), p, _stream([(x, False, False) for x in lines], run_tokens)[0])
                   for h, p, lines in rows]
        key, low, high = repeated_runs(streams, run_tokens)
        bucket = pa.array(np.full(len(key), table.column("bucket")[0].as_py()), pa.int32())
        return pa.table([bucket, pa.array(key, pa.int64()), pa.array(low, pa.int64()), pa.array(high, pa.int64())],
                        names=["bucket", "key", "low", "high"])

    def texts(left: pa.Table, right: pa.Table) -> pa.Table:
        known = np.unique(right.column("key").to_numpy()) if right.num_rows else np.zeros(0, dtype=np.int64)
        out, counts = [], []
        for h, lines, inside, marked in zip(*[left.column(c).to_pylist() for c in ("host", "lines", "inside", "marked")]):
            # blocks hold no line break and are not empty
            blocks = list(zip(zlib.decompress(lines).decode().split("\n"), inside, marked))
            tokens, owner = _stream(blocks, run_tokens)
            keys = _run_keys(tokens, h & ((1 << 64) - 1), run_tokens)
            at = np.minimum(np.searchsorted(known, keys), max(0, len(known) - 1))
            text, n = main_text(blocks, tokens, owner, known[at] == keys if len(known) else np.zeros(len(keys), bool),
                                run_tokens)
            out.append(text)
            counts.append(n)
        return pa.table([left.column("page_id"), left.column("url"), pa.array(out, pa.string()),
                         pa.array(counts, pa.int32())], names=["page_id", "url", "text", "covered_blocks"])

    found = dealt.mapInArrow(outside, "bucket int, host long, page long, lines array<string>").groupBy(
        "bucket").applyInArrow(runs, "bucket int, key long, low long, high long")
    everywhere = found.groupBy("key").agg(F.min("low").alias("low"), F.max("high").alias("high")).where("low < high")
    held = found.join(everywhere.select("key"), "key").select("bucket", "key")
    blocks = dealt.mapInArrow(parsed, "bucket int, page_id long, url string, host long, page long, "
                                      "lines binary, inside array<boolean>, marked array<boolean>")
    return blocks.groupBy("bucket").cogroup(held.groupBy("bucket")).applyInArrow(
        texts, "page_id long, url string, text string, covered_blocks int")
