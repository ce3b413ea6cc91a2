import hashlib

import numpy as np
from conftest import SF001
from hypothesis import given, settings
from hypothesis import strategies as st

from murmur.llm import chat as c

TOKENIZER = c.load_tokenizer()
PIECES = st.lists(st.sampled_from(["<turn>", "<text>", "</turn>", "\\", "<", "/", "turn>", "\\<", "a", " b", "\n", "é", "😀",
                                   "### Assistant:", " "]), max_size=12).map("".join)
TURNS = st.lists(st.tuples(st.sampled_from(["user", "assistant", "", "<turn>"]) | PIECES, PIECES), max_size=6)


@settings(max_examples=400, deadline=None)
@given(TURNS)
def test_round_trip_and_mask(turns):
    text, spans = c.render(turns)
    assert c.read_back(text) == turns
    assert [c.unescape(text[s:e]) for s, e in spans] == [t for _, t in turns]
    ids, starts, ends = c.encode(TOKENIZER, text)
    trained = [s for s, (role, _) in zip(spans, turns) if role == "assistant"]
    mask = c.loss_mask(starts, ends, trained)
    under = c.masked_spans(starts, ends, mask)
    assert "".join(c.unescape(text[s:e]) for s, e in under) == "".join(t for r, t in turns if r == "assistant")
    # brute force over all pairs
    assert mask.tolist() == [any(s < e2 and s2 < e for s2, e2 in trained) for s, e in zip(starts.tolist(), ends.tolist())]


def test_windows_give_the_ids_of_the_whole(monkeypatch):
    text, _ = c.render([("user", "some words, in a row. " * 50), ("assistant", "é " * 100 + "x" * 200)])
    whole = c.encode(TOKENIZER, text)
    monkeypatch.setattr(c, "PART_CHARS", 64)
    cut = c.encode(TOKENIZER, text)
    assert all(np.array_equal(a, b) for a, b in zip(whole, cut))


def brute(rows):
    by = {}
    for conv, turn, role, text in rows:
        by.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    out = {}
    for conv, own in by.items():
        own = sorted(own)
        said = "".join(t for _, _, r, t in own if r == "assistant")
        out[conv] = (len(own), hashlib.sha256("".join(f"{r}\n{t}\n" for _, _, r, t in own).encode()).hexdigest(),
                     len(said), hashlib.sha256(said.encode()).hexdigest())
    return out


def digest(df, **how):
    return {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"])
            for r in c.chat_digest(c.format_chats(df, **how)).collect()}


def test_edge_rows_and_split_conversations(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", None), (1, 1, "assistant", None), (None, 0, "assistant", "x"),
            (2, None, None, ""), (2, 0, "assistant", "</turn>\\"), (3, 0, "user", "only")]
    rows += [(9, t, "assistant" if t % 2 else "user", f"turn {t} é") for t in range(300)]
    df = spark.createDataFrame([(*r, "z") for r in rows],
                               "conv_id long, turn long, role string, text string, formatted string")
    assert digest(df) == digest(df, turns_each=7, part_chars=20) == brute(rows)
    assert digest(df.limit(0)) == {}
    parts = c.format_chats(df, turns_each=7, part_chars=20).where("conv_id = 9").orderBy("chunk", "part").collect()
    whole = c.format_chats(df, turns_each=10_000).where("conv_id = 9").collect()
    assert len(parts) > 40 and len(whole) == 1
    assert [i for p in parts for i in p["ids"]] == whole[0]["ids"]
    assert [i for p in parts for i in p["loss"]] == whole[0]["loss"]
    assert "".join(p["formatted"] for p in parts) == whole[0]["formatted"]


def test_whole_table(spark):
    from murmur.llm.queries import PROBE_ID, PROBE_TEXT, QUERIES
    rows = [tuple(r) for r in spark.read.parquet(f"{SF001}/conversations.parquet").select(
        "conv_id", "turn", "role", "text").collect()]
    rows += [(PROBE_ID, 0, "user", PROBE_TEXT), (PROBE_ID, 1, "assistant", PROBE_TEXT)]
    got = {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"])
           for r in QUERIES["op4_chat_formatting"](spark, SF001).collect()}
    assert got == brute(rows)
