"""Chat formatting with offset-aligned loss masks.

A conversation is rendered with three markers round each turn's role and text.
The markers are tokens of their own, and their strings cannot occur inside a
text, because a backslash is put behind the ``<`` of any that do (and before
every backslash). The rendering is encoded once, with offsets; the sorted spans
of the trained turns are then intersected with the sorted token spans by
binary search.

Turns are gathered ``turns_each`` turn numbers at a time, so a conversation
of any length is formatted by many tasks; as markers separate the turns, the
parts' tokens are those of the whole. Longer parts are cut at ``part_chars``.

Input cases: null roles and texts are empty; null turn numbers come first;
ties of a turn are ordered by role, then text, and repeated rows are turns of
their own; a null conversation id is a conversation; very long texts are encoded
window by window, cut before a space that a word follows; an empty table gives
no rows; further input columns are ignored."""

from __future__ import annotations

import hashlib
import os
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from murmur.llm._common import by_value, kept_in_worker, narrow

by_value(__name__)

OPEN, BODY, CLOSE = "<turn>", "<text>", "</turn>"
MARKERS = (OPEN, BODY, CLOSE)
TRAINED = ("assistant",)
TURNS_EACH = 64
PART_CHARS = 1 << 20
_CUT = re.compile(r"(?<=\S) (?=\S)")
_ESCAPED = re.compile(r"\\(.)", re.S)
_TURN = re.compile(f"{OPEN}(.*?){BODY}(.*?){CLOSE}", re.S)


def escape(text: str) -> str:
    text = text.replace("\\", "\\\\")
    for m in MARKERS:
        text = text.replace(m, m[0] + "\\" + m[1:])
    return text


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The rendering of (role, text) turns and the span of each text in it."""
    out, spans, at = [], [], 0
    for role, text in turns:
        head, body = OPEN + escape(role) + BODY, escape(text)
        spans.append((at + len(head), at + len(head) + len(body)))
        out += [head, body, CLOSE]
        at += len(head) + len(body) + len(CLOSE)
    return "".join(out), spans


def read_back(formatted: str) -> list[tuple[str, str]]:
    """The turns of a rendering."""
    return [(unescape(r), unescape(t)) for r, t in _TURN.findall(formatted)]


def load_tokenizer(path: str | None = None):
    """The byte-level tokenizer with the markers as tokens and offsets that
    keep leading spaces."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import AddedToken, Tokenizer, processors
    if path is None:
        import public_tokenizers
        path = public_tokenizers.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    t.post_processor = processors.ByteLevel(trim_offsets=False)
    t.add_tokens([AddedToken(m, normalized=False) for m in MARKERS])
    return t


def _windows(text: str):
    at = 0
    while at < len(text):
        stop = len(text)
        if stop - at > PART_CHARS and (m := _CUT.search(text, at + PART_CHARS)):
            stop = m.start()
        yield at, text[at:stop]
        at = stop


def encode(tokenizer, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Token ids with their first and past-last character."""
    ids, starts, ends = [], [], []
    for at, part in _windows(text):
        e = tokenizer.encode(part, add_special_tokens=False)
        o = np.array(e.offsets, dtype=np.int64).reshape(-1, 2) + at
        ids.append(np.array(e.ids, dtype=np.int32))
        starts.append(o[:, 0])
        ends.append(o[:, 1])
    empty = np.zeros(0, dtype=np.int64)
    return (np.concatenate(ids or [empty.astype(np.int32)]), np.concatenate(starts or [empty]),
            np.concatenate(ends or [empty]))


def loss_mask(starts: np.ndarray, ends: np.ndarray, spans: list[tuple[int, int]]) -> np.ndarray:
    """Tokens that share a character with one of the sorted spans."""
    mask = np.zeros(len(starts), dtype=bool)
    if spans and len(starts):
        s = np.array(spans, dtype=np.int64)
        s = s[s[:, 1] > s[:, 0]]
        first = np.searchsorted(ends, s[:, 0], side="right")
        past = np.searchsorted(starts, s[:, 1], side="left")
        for a, b in zip(first.tolist(), past.tolist()):
            mask[a:b] = True
    return mask


def masked_spans(starts, ends, mask) -> list[tuple[int, int]]:
    """The characters under the mask, as merged spans."""
    out: list[list[int]] = []
    for s, e in zip(starts[mask].tolist(), ends[mask].tolist()):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]


_FORMATTED = ("conv_id long, chunk long, part int, n_turns int, formatted string, ids array<int>, "
              "token_start array<int>, token_end array<int>, loss array<boolean>")


def format_chats(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                 text_col: str = "text", trained: tuple[str, ...] = TRAINED, path: str | None = None,
                 turns_each: int = TURNS_EACH, part_chars: int = PART_CHARS) -> DataFrame:
    """One row per part of a conversation, in the order of (chunk, part): the
    rendering, its token ids and offsets, and the loss mask over the tokens."""
    own = narrow(turns, conv_id=F.col(conv_col).cast("long"), turn=F.col(turn_col).cast("long"),
                 role=F.coalesce(F.col(role_col), F.lit("")), text=F.coalesce(F.col(text_col), F.lit("")))
    own = own.withColumn("chunk", F.floor(F.col("turn") / F.lit(turns_each)).cast("long"))
    placed = own.repartition("conv_id", "chunk").sortWithinPartitions("conv_id", "chunk", "turn", "role", "text")

    def run(batches):
        tokenizer = kept_in_worker(("chat", path), lambda: load_tokenizer(path))

        def one(key, part, rows):
            formatted, spans = render(rows)
            ids, starts, ends = encode(tokenizer, formatted)
            mask = loss_mask(starts, ends, [s for s, (role, _) in zip(spans, rows) if role in trained])
            return (key[0], key[1], part, len(rows), formatted, ids, starts, ends, mask)

        def flush(done):
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.list_(pa.int32()),
                     pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.bool_())]
            names = ["conv_id", "chunk", "part", "n_turns", "formatted", "ids", "token_start", "token_end", "loss"]
            return pa.RecordBatch.from_arrays(
                [pa.array([list(r[i]) if i > 4 else r[i] for r in done], k) for i, k in enumerate(kinds)], names=names)

        key, part, rows, size, done, held = None, 0, [], 0, [], 0
        for batch in batches:
            cols = [batch.column(c).to_pylist() for c in ("conv_id", "chunk", "role", "text")]
            for conv, chunk, role, text in zip(*cols):
                if rows and (key != (conv, chunk) or size >= part_chars):
                    done.append(one(key, part, rows))
                    part = part + 1 if key == (conv, chunk) else 0
                    held += size
                    rows, size = [], 0
                    if held >= part_chars:
                        yield flush(done)
                        done, held = [], 0
                key = (conv, chunk)
                rows.append((role, text))
                size += len(text)
        if rows:
            done.append(one(key, part, rows))
        if done:
            yield flush(done)

    return placed.mapInArrow(run, _FORMATTED)


def chat_digest(formatted: DataFrame) -> DataFrame:
    """Per conversation, read back from the formatted parts: turns, digest of
    all turns, digest and length of the text under the loss mask, length of
    the rendering. Parts stream through in order; only digests are held."""
    def spans(batches):
        for b in batches:
            out = []
            for s, e, m in zip(b.column("token_start"), b.column("token_end"), b.column("loss")):
                mask = np.array(m.values.to_numpy(zero_copy_only=False), dtype=bool)
                out.append([x for p in masked_spans(s.values.to_numpy(), e.values.to_numpy(), mask) for x in p])
            yield pa.RecordBatch.from_arrays(
                [b.column(c) for c in ("conv_id", "chunk", "part", "formatted")] + [pa.array(out, pa.list_(pa.int32()))],
                names=["conv_id", "chunk", "part", "formatted", "spans"])

    def digest(batches):
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        conv, any_row, state, done = None, False, None, []

        def close():
            n, turns, chars, loss, size = state
            return (conv, n, turns.hexdigest(), chars, loss.hexdigest(), size)

        for b in batches:
            for c, text, flat in zip(*[b.column(x).to_pylist() for x in ("conv_id", "formatted", "spans")]):
                if not any_row or c != conv:
                    if any_row:
                        done.append(close())
                    conv, any_row, state = c, True, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, said in read_back(text):
                    state[0] += 1
                    state[1].update(f"{role}\n{said}\n".encode())
                for s, e in zip(flat[::2], flat[1::2]):
                    trained = unescape(text[s:e])
                    state[2] += len(trained)
                    state[3].update(trained.encode())
                state[4] += len(text)
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*done), kinds)], names=names)
                done = []
        if any_row:
            done.append(close())
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*done), kinds)], names=names)

    small = formatted.mapInArrow(spans, "conv_id long, chunk long, part int, formatted string, spans array<int>")
    return small.repartition("conv_id").sortWithinPartitions("conv_id", "chunk", "part").mapInArrow(
        digest, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, "
                "formatted_chars long")
