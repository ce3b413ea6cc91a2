import hashlib
import re
import zlib

import pytest
from murmur.llm.prefix_trie import as_they_are, prefix_trie, rebuilt

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "conv_id long, turn long, role string, text string, n long, ord long, k1 string"


def turns_of(rows, rebuild):
    by = {}
    for c, turn, role, text in rows:
        if c is not None:
            by.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(ts)] for c, ts in by.items()}
    if not rebuild:
        return own
    out = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 4
        out[c] = own.get(c - c % 20, [])[:h] + own[c][h:]
    return out


def brute(rows, rebuild):
    convs = turns_of(rows, rebuild)
    nodes = {}
    for c in sorted(convs):
        for d in range(len(convs[c]) + 1):
            nodes.setdefault(tuple(convs[c][:d]), []).append(c)
    out = set()
    for key, members in nodes.items():
        sub = [k for k in nodes if k[:len(key)] == key]
        kids = [k for k in sub if len(k) == len(key) + 1]
        leaves = sum(not any(len(x) == len(k) + 1 and x[:len(k)] == k for x in sub) for k in sub)
        saved = sum((len(nodes[k]) - 1) * len(WORDS.findall(k[-1][1])) for k in sub if k)
        ends = ",".join(str(c) for c in members if len(convs[c]) == len(key))
        out.add((members[0], len(key), nodes[key[:-1]][0] if key else None, len(members), len(kids), leaves, saved,
                 hashlib.sha256(ends.encode()).hexdigest()))
    return out


def got(df, **how):
    cols = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
    rows = prefix_trie(df, **how).collect()
    out = {tuple(r[c] for c in cols) for r in rows}
    assert len(out) == len(rows)
    return out


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, "x") for r in rows], SCHEMA)


ODD = [(1, 0, "user", "hi you"), (1, 1, "assistant", "a b  c"), (2, 0, "user", "hi you"), (2, 1, "assistant", "a b  c"),
       (2, 2, "user", "more"), (3, None, "user", "hi you"), (3, 0, "assistant", None), (3, 0, "assistant", None),
       (4, 5, None, ""), (None, 0, "user", "hi you"), (5, 0, "user", "hi you"), (5, 1, "assistant", "a b  c"),
       (-3, 0, "user", "hi you"), (7, 0, "user hi", " you"), (8, 0, "user", "x " * 20000), (40, 0, "user", "hi you"),
       (41, 0, "user", "own"), (41, 1, "assistant", "own"), (41, 2, "user", "q"), (41, 3, "assistant", "own"), (60, 1, "user", "z")]


@pytest.mark.parametrize("rebuild", [False, True])
def test_edge_rows(spark, rebuild):
    rows = [r for r in ODD if not (rebuild and r[0] and r[0] < 0)]   # brute force uses Python's remainder
    df = frame(spark, rows)
    arrange = rebuilt if rebuild else as_they_are
    assert got(df, arrange=arrange) == got(df, arrange=arrange, shard_convs=2, band_turns=1) == brute(rows, rebuild)


def test_long_conversations_and_common_turns(spark):
    """Chains longer than several bands, their copies, and a first turn that
    most conversations share."""
    long = [("user" if t % 2 == 0 else "assistant", f"w{t} and") for t in range(70)]
    rows = [(c, t, *long[t]) for c, n in ((9, 70), (4, 70), (11, 33), (2, 50), (30, 69)) for t in range(n)]
    rows += [(11, 40, "user", "off"), (2, 90, "user", "off"), (2, 91, "user", "off")]
    rows += [(c, t, "user", "start" if t == 0 else f"{c % 3}") for c in range(100, 160) for t in range(2)]
    df = frame(spark, rows)
    assert got(df, shard_convs=8, band_turns=5) == got(df) == brute(rows, False)
    assert got(df, arrange=rebuilt, shard_convs=16, band_turns=7) == brute(rows, True)


def test_empty_table(spark):
    df = frame(spark, ODD).limit(0)
    assert got(df) == set() == got(df, arrange=rebuilt)
