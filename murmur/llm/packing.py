"""Best-fit packing of documents into sequences of at most ``seq_len`` tokens.

The configuration linear programme over the length histogram: a column is a
way to fill one sequence (a multiset of piece lengths), a row says that all
pieces of a length are placed. Only the histogram (at most ``seq_len`` rows)
reaches the driver, so its cost does not depend on the number of documents.
Multiplicative weights price the lengths, an unbounded-knapsack dynamic
programme finds the best-priced column, the column values are rounded down
and what rounding leaves is placed best-fit, largest first, on run lengths.

Pieces are then matched with places by rank: a piece's rank among all pieces
of its length comes from a running count inside its task plus the prefix sums
of the tasks before it, so no window ever gathers a length, however common.

Input cases: null text is empty text; an empty text is one piece holding the
end id alone; very long texts are cut; repeated rows and repeated or null
ids are packed row by row like any others; an empty table gives no rows;
further input columns are ignored."""

from __future__ import annotations

import json
import os
import re
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from murmur.functions.indexing import with_ordinal
from murmur.llm._common import by_value, kept_in_worker, narrow, parts, texts
from murmur.session import arrow_batches, cut_lineage

by_value(__name__)

SEQ_LEN = 2048
END_ID = 0
CACHE_WORDS = 150_000     # words whose ids a worker remembers
BATCH_ROWS = 512          # texts sent to a worker at a time
PLACE_ROWS = 32_768       # slices of groups of equal sequences


# --- token ids ------------------------------------------------------------------
class _Spaced(Exception):
    """A text whose spaces do not all precede a word."""


class ByteBpe:
    """Token ids as little-endian uint32 bytes, for the byte-level BPE whose
    ranks are in ``path``. The splitting pattern attaches a single space to
    the word after it, so a text can be cut before every space that a word
    follows; words seen before come from a cache, and the new words of a
    batch are encoded in one call and cut apart by their byte lengths. Texts
    with other spaces are encoded whole. The tokenizer's ``added`` tokens have
    ids of their own; texts are split at them first."""

    def __init__(self, path: str, pattern: str, added: dict[str, int] | None = None):
        import base64

        import tiktoken
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.enc = tiktoken.Encoding("byte_bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.size = np.zeros(max(ranks.values()) + 1, dtype=np.int64)
        for token, i in ranks.items():
            self.size[i] = len(token)
        self.known: dict[str, bytes] = {}
        self.added = {t: np.array([i], dtype="<u4").tobytes() for t, i in (added or {}).items()}
        longest = sorted(self.added, key=len, reverse=True)
        self.split = re.compile("(" + "|".join(map(re.escape, longest)) + ")").split if longest else lambda t: [t]

    def _whole(self, text: str) -> bytes:
        return np.array(self.enc.encode_ordinary(text), dtype="<u4").tobytes()

    def _learn(self, words: list[str]) -> dict[str, bytes]:
        joined = " " + " ".join(words)
        ids = np.array(self.enc.encode_ordinary(joined), dtype="<u4")
        ends = np.cumsum(self.size[ids])
        stop = np.cumsum(np.fromiter((len(w.encode()) + 1 for w in words), dtype=np.int64, count=len(words)))
        cut = np.searchsorted(ends, stop, side="right").tolist()
        data, at, out = ids.tobytes(), 0, {}
        for w, c in zip(words, cut):
            out[w] = data[4 * at:4 * c]
            at = c
        return out

    def encode(self, batch: list[str]) -> list[bytes]:
        cut = [self.split(t) for t in batch]     # text, added token, text, ...
        ids = iter(self._encode([t for c in cut for t in c[::2]]))
        return [b"".join([self.added[t] if k % 2 else next(ids) for k, t in enumerate(c)]) for c in cut]

    def _encode(self, batch: list[str]) -> list[bytes]:
        split = [t.split(" ") for t in batch]
        new = set().union(*(s[1:] for s in split)).difference(self.known) if split else set()
        new = [w for w in new if w and not w[0].isspace()]
        fresh = self._learn(new) if new else {}
        room = CACHE_WORDS - len(self.known)
        if room > 0:
            for w in new[:room]:
                self.known[w] = fresh[w]
        known, out = self.known, []
        for text, words in zip(batch, split):
            head = self._whole(words[0]) if words[0] else b""
            try:
                if any(not w or w[0].isspace() for w in words[1:]):
                    raise _Spaced
                body = b"".join([known[w] if w in known else fresh[w] for w in words[1:]])
            except _Spaced:
                out.append(self._whole(text))
                continue
            out.append(head + body)
        return out


def _added_tokens(path: str) -> dict[str, int]:
    """The added tokens of the tokenizer whose JSON lies beside the ranks."""
    path = os.path.splitext(path)[0] + ".json"
    if not os.path.exists(path):
        return {}
    with open(path, encoding="utf-8") as f:
        added = json.load(f).get("added_tokens") or []
    if any(t.get(k) for t in added for k in ("single_word", "lstrip", "rstrip")):
        raise ValueError(f"added tokens that depend on what is round them are not supported: {path}")
    return {t["content"]: t["id"] for t in added}


def _tokenizer(path: str | None, pattern: str | None):
    if path is None:
        import public_tokenizers
        path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    return kept_in_worker(("byte_bpe", path, pattern), lambda: ByteBpe(path, pattern, _added_tokens(path)))


def piece_bounds(n: int, seq_len: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of ``n`` ids: itself, or
    full pieces after a first one that takes the remainder."""
    if n <= seq_len:
        return [(0, n)]
    first = n % seq_len or seq_len
    return [(0, first)] + [(s, seq_len) for s in range(first, n, seq_len)]


_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, nth long"


def tokenize_pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seq_len: int = SEQ_LEN,
                    end_id: int = END_ID, path: str | None = None, pattern: str | None = None,
                    keep_ids: bool = False, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per piece: its document, number, start and length, a CRC-32 of
    its ids, and (part, nth): its place among the pieces of its length in the
    task that made it. ``keep_ids`` adds the ids themselves; ``carry`` adds
    columns of the document and ``row``, its number in the task."""
    schema = _PIECES + (", ids array<int>" if keep_ids else "")
    if carry:
        schema += ", row long" + "".join(f", `{c}` {docs.schema[c].dataType.simpleString()}" for c in carry)
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches):
        bpe = _tokenizer(path, pattern)
        part, seen = TaskContext.get().partitionId(), np.zeros(seq_len + 1, dtype=np.int64)
        row0 = 0
        for batch in batches:
            for some in parts(batch, 256):
                at = []
                rows = {k: [] for k in ("doc_id", "piece", "start", "length", "ids_crc32", "part", "nth", "ids")}
                for i, (doc, data) in enumerate(zip(some.column("doc_id").to_pylist(), bpe.encode(texts(some, "text")))):
                    data += end
                    for k, (start, length) in enumerate(piece_bounds(len(data) // 4, seq_len)):
                        own = data[4 * start:4 * (start + length)]
                        for name, v in (("doc_id", doc), ("piece", k), ("start", start), ("length", length),
                                        ("ids_crc32", zlib.crc32(own)), ("part", part), ("nth", int(seen[length]))):
                            rows[name].append(v)
                        if keep_ids:
                            rows["ids"].append(np.frombuffer(own, dtype="<i4"))
                        seen[length] += 1
                        at.append(i)
                cols = [pa.array(rows["doc_id"], pa.int64()), pa.array(rows["piece"], pa.int32()),
                        pa.array(rows["start"], pa.int64()), pa.array(rows["length"], pa.int64()),
                        pa.array(rows["ids_crc32"], pa.int64()), pa.array(rows["part"], pa.int32()),
                        pa.array(rows["nth"], pa.int64())]
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth"]
                if keep_ids:
                    cols.append(pa.array(rows["ids"], pa.list_(pa.int32())))
                    names.append("ids")
                if carry:
                    here = pa.array(at, pa.int64())
                    cols += [pa.array(np.array(at, dtype=np.int64) + row0)]
                    cols += [some.column(f"_c{k}").take(here) for k in range(len(carry))]
                    names += ["row", *carry]
                row0 += some.num_rows
                yield pa.RecordBatch.from_arrays(cols, names=names)

    own = narrow(docs, doc_id=F.col(id_col).cast("long"), text=text_col, **{f"_c{k}": c for k, c in enumerate(carry)})
    return own.mapInArrow(run, schema)


# --- configuration programme over the histogram --------------------------------------
def _best_column(price: np.ndarray, seq_len: int, usable: np.ndarray) -> dict[int, int]:
    """Unbounded knapsack: the multiset of usable lengths, at most ``seq_len``
    in total, of the highest price."""
    lengths = np.flatnonzero(usable)
    value, pick = np.zeros(seq_len + 1), np.zeros(seq_len + 1, dtype=np.int64)
    worth = price[lengths]
    fits = np.searchsorted(lengths, np.arange(seq_len + 1), side="right")
    for c in range(1, seq_len + 1):
        n = fits[c]
        value[c] = value[c - 1]
        if n:
            got = value[c - lengths[:n]] + worth[:n]
            k = int(got.argmax())
            if got[k] > value[c]:
                value[c], pick[c] = got[k], lengths[k]
    column, c = {}, seq_len
    while c > 0:
        if pick[c] and value[c] > value[c - 1]:
            column[int(pick[c])] = column.get(int(pick[c]), 0) + 1
            c -= int(pick[c])
        else:
            c -= 1
    return column


def solve_configurations(hist: np.ndarray, seq_len: int, rounds: int = 800, rate: float = 0.5,
                         direct: int = 1) -> list[tuple[dict[int, int], float]]:
    """Columns and their (fractional) values by multiplicative weights. Each
    round takes the best-priced column for ``rate`` of what its scarcest
    length still allows; a length's price falls with the part of it that is
    covered. Long lengths start a little dearer, as they are harder to place.
    It ends when fewer than ``direct`` pieces are not covered."""
    need = hist.astype(np.float64).copy()
    columns: list[tuple[dict[int, int], float]] = []
    size = np.arange(seq_len + 1)
    price = size * (1.0 + 0.02 * size / seq_len)
    for _ in range(rounds):
        usable = need >= 1.0
        usable[0] = False
        if need[usable].sum() < direct:
            break
        column = _best_column(price, seq_len, usable)
        most = min(need[k] / m for k, m in column.items())
        take = most if most < 4 else rate * most
        columns.append((column, take))
        for k, m in column.items():
            price[k] *= np.exp(-0.05 * take * m / hist[k])
            need[k] -= take * m
    return columns


def pack_histogram(hist: np.ndarray, seq_len: int = SEQ_LEN) -> list[tuple[list[int], int]]:
    """(lengths in one sequence, number of such sequences): the rounded
    programme, then best fit for the rest. Places every piece exactly once.
    Rounding can cost a small table more than the programme gains: best fit
    alone is taken where it fills fewer sequences."""
    rest = hist.astype(np.int64).copy()
    rest[0] = rest[seq_len] = 0
    return min((_rounded(hist, seq_len, columns) for columns in (solve_configurations(rest, seq_len), [])),
               key=lambda packed: sum(count for _, count in packed))


def _rounded(hist: np.ndarray, seq_len: int, columns) -> list[tuple[list[int], int]]:
    left = hist.astype(np.int64).copy()
    left[0] = 0
    filled: list[tuple[list[int], int]] = []
    if left[seq_len]:
        filled.append(([seq_len], int(left[seq_len])))
        left[seq_len] = 0
    open_by_room: dict[int, list[tuple[list[int], int]]] = {}

    def put(lengths: list[int], count: int) -> None:
        room = seq_len - sum(lengths)
        if room == 0:
            filled.append((lengths, count))
        else:
            open_by_room.setdefault(room, []).append((lengths, count))

    for column, value in columns:
        count = int(min([np.floor(value + 1e-9), *(left[k] // m for k, m in column.items())]))
        if count > 0:
            for k, m in column.items():
                left[k] -= count * m
            put([k for k, m in sorted(column.items(), reverse=True) for _ in range(m)], count)
    for length in range(seq_len - 1, 0, -1):
        n = int(left[length])
        while n:
            rooms = [r for r in open_by_room if r >= length]
            if not rooms:
                each = seq_len // length
                if n >= each:
                    put([length] * each, n // each)
                    n -= (n // each) * each
                if n:
                    put([length] * n, 1)
                    n = 0
                continue
            room = min(rooms)
            lengths, count = open_by_room[room].pop()
            if not open_by_room[room]:
                del open_by_room[room]
            each = min(room // length, n)
            used = min(count, n // each)
            if used < count:
                open_by_room.setdefault(room, []).append((lengths, count - used))
            put(lengths + [length] * each, used)
            n -= used * each
    return filled + [g for groups in open_by_room.values() for g in groups]


def interleaved(packed: list[tuple[list[int], int]]) -> list[tuple[list[int], int]]:
    """The same groups cut into slices, a slice of every group in turn: the
    sequences up to any slice take about the same part of each length."""
    turns = max(1, min(sum(n for _, n in packed), PLACE_ROWS // max(1, len(packed))))
    out = []
    for s in range(turns):
        for i, (lengths, count) in enumerate(packed):
            shift = i * 0.6180339887498949 % 1.0      # small groups do not all fall into one turn
            n = int(count * (s + 1) / turns + shift) - int(count * s / turns + shift)
            if n:
                out.append((lengths, n))
    return out


def place_table(packed: list[tuple[list[int], int]]) -> pd.DataFrame:
    """One row per (group of equal sequences, length): the ranks of pieces of
    that length that go there, ``rank`` to the next row's, ``each`` of them a
    sequence, the first at ``offset``. At most a few rows a column."""
    rows, used, first = [], {}, 0
    for lengths, count in packed:
        at = 0
        i = 0
        while i < len(lengths):
            k = lengths[i]
            m = 1
            while i + m < len(lengths) and lengths[i + m] == k:
                m += 1
            rows.append((k, used.get(k, 0), first, at, m))
            used[k] = used.get(k, 0) + m * count
            at += m * k
            i += m
        first += count
    return pd.DataFrame(rows, columns=["length", "rank", "first", "offset", "each"]).sort_values(
        ["length", "rank"], ignore_index=True)


def best_fit_pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seq_len: int = SEQ_LEN,
                  end_id: int = END_ID, path: str | None = None, pattern: str | None = None,
                  carry: tuple[str, ...] = (), position=None) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset): every
    piece of every document with its place. :func:`packed_ids` gives the
    sequences' ids.

    ``position`` orders the sequences: a function of the documents' rows (with
    ``doc_id`` and the columns ``carry``) that adds their ``position``. Pieces
    of a length are then placed in that order, and sequences are numbered by
    the smallest position among their pieces."""
    with arrow_batches(docs.sparkSession, BATCH_ROWS):
        pieces = cut_lineage(tokenize_pieces(docs, id_col, text_col, seq_len, end_id, path, pattern, carry=carry))
    counts = pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"))
    # at most seq_len rows: one per length
    hist = np.zeros(seq_len + 1, dtype=np.int64)
    for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect():
        hist[r["length"]] = r["n"]
    packed = pack_histogram(hist, seq_len)
    places = place_table(packed if position is None else interleaved(packed))
    step = np.int64(1) << 42
    key = (places["length"].to_numpy() * step + places["rank"].to_numpy()).astype(np.int64)
    rank0, first, offset, each = (places[c].to_numpy() for c in ("rank", "first", "offset", "each"))

    ordered = position is not None

    def place(batches):
        for b in batches:
            length = b.column("length").to_numpy(zero_copy_only=False)
            rank = b.column("rank").to_numpy(zero_copy_only=False)
            at = np.searchsorted(key, length * step + rank, side="right") - 1
            inside = rank - rank0[at]
            yield pa.RecordBatch.from_arrays(
                [b.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
                + [pa.array(first[at] + inside // each[at], pa.int64()),
                   pa.array(offset[at] + (inside % each[at]) * length, pa.int64())]
                + ([b.column("position")] if ordered else []),
                names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
                + (["position"] if ordered else []))

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    if ordered:
        where = position(pieces.where("piece = 0").select("part", "row", "doc_id", *carry)).select(
            "part", "row", F.col("position").cast("long").alias("position"))
        lined = with_ordinal(pieces.join(where, ["part", "row"]).select(
            "doc_id", "piece", "start", "length", "ids_crc32", "position"), "_o", ["length", "position", "piece"])
        # at most seq_len rows: the pieces that are shorter
        shorter = docs.sparkSession.createDataFrame(
            [(int(k), int(hist[:k].sum())) for k in np.flatnonzero(hist)], "length long, _before long")
        placed = cut_lineage(lined.join(F.broadcast(shorter), "length").select(
            "doc_id", "piece", "start", "length", "ids_crc32", "position", (F.col("_o") - F.col("_before")).alias("rank"))
            .mapInArrow(place, schema + ", position long"))
        number = with_ordinal(placed.groupBy("sequence_id").agg(F.min("position").alias("_p")), "_n",
                              ["_p", "sequence_id"])
        return placed.join(number, "sequence_id").select(
            "doc_id", "piece", "start", "length", "ids_crc32", F.col("_n").cast("long").alias("sequence_id"), "offset")
    # rows of a length: one per task that made pieces of it
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    ranked = pieces.join(starts, ["part", "length"]).select(
        "doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("nth")).alias("rank"))
    return ranked.mapInArrow(place, schema)


def packed_ids(docs: DataFrame, plan: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               seq_len: int = SEQ_LEN, end_id: int = END_ID, path: str | None = None,
               pattern: str | None = None) -> DataFrame:
    """(sequence_id, offset, ids) of a plan of :func:`best_fit_pack`, sorted by
    offset inside each sequence: what a writer stores. Texts are encoded a
    second time instead of keeping all ids through the planning. ``doc_id``
    must be unique here."""
    pieces = tokenize_pieces(docs, id_col, text_col, seq_len, end_id, path, pattern, keep_ids=True)
    own = plan.select("doc_id", "piece", "sequence_id", "offset")
    return own.join(pieces.select("doc_id", "piece", "ids"), ["doc_id", "piece"]).select(
        "sequence_id", "offset", "ids").repartition("sequence_id").sortWithinPartitions("sequence_id", "offset")
