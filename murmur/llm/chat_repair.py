"""Repair of conversation structure by a run-length dynamic programme.

A repaired conversation has the role initials ``(s?(ua)+)?``. Edits: Keep a row
(0), Rerole it to user or assistant (3), Delete it (4; the only edit of a blank or
repeated row), Insert an empty user or assistant row (3); a truncated row that
is not deleted adds 3. Of the cheapest edits those whose initials are
ASCII-least are taken.

The automaton of that pattern has four states, so a row is a 4 x 4 min-plus
transition between them. Rows are cut into blocks; in a block equal consecutive
(role, fault) symbols are one run, and a run is advanced through cached binary
powers of its symbol's transition. The blocks of a conversation are composed
backwards to the cost left at each block's end. With these costs a block's
choices are unrolled from every state it may be entered in; going forwards over
the blocks then tells the state it is entered in. So no task holds a whole
conversation; only its digest is a stream through one task.

Input cases: rows with a null conversation id are a conversation; ties of a turn
go by role, then text; equal rows (same conversation, turn, role and text) are
one row with a count, and all but one of them are repeats; rows without
characters other than white space are blank; a role whose initial is not s, u
or a can only be reroled or deleted; an empty table gives no rows; very long texts
are moved whole; further input columns are ignored."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from murmur.llm._common import by_value, kept_in_worker, narrow, parts
from murmur.llm._turns import WORD, numbered, text_hash
from murmur.session import cut_lineage

by_value(__name__)

BLOCK_ROWS = 1024
EMPTY_SHA = hashlib.sha256(b"").hexdigest()

# --- the automaton ---------------------------------------------------------------
# states: 0 nothing yet, 1 after the system row, 2 after a user row, 3 after an
# assistant row; 0 and 3 may end
INF = 1 << 60
INSERT = REROLE = TRUNCATED = 3
DELETE = 4
ROLES = "sua"                                     # 3: any other initial
NEXT = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}
WANTED = (2, 2, 3, 2)                             # state after the role that may follow a state
WANTED_ROLE = ("user", "user", "assistant", "user")
GOOD, CUT_OFF, MUST_GO = 0, 1, 2                  # fault class of a symbol
END_COST = (0, 2 * INSERT, INSERT, 0)             # insertions that are left at the end


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Min-plus product."""
    return np.minimum((a[:, :, None] + b[None, :, :]).min(axis=1), INF)


def row_edits(symbol: int) -> list[list[tuple[str, int, int]]]:
    """Per state the edits of a row itself: (letter, cost, next state)."""
    role, fault = divmod(symbol, 3)
    out = []
    for s in range(4):
        own = [("D", DELETE, s)]
        if fault != MUST_GO:
            more = TRUNCATED if fault == CUT_OFF else 0
            if role < 3 and s in NEXT[ROLES[role]]:
                own.append(("K", more, NEXT[ROLES[role]][s]))
            own.append(("R", REROLE + more, WANTED[s]))
        out.append(own)
    return out


def transition(symbol: int) -> np.ndarray:
    """Cheapest insertions before a row and edit of it, from state to state."""
    step = np.full((4, 4), INF, dtype=np.int64)
    for s, own in enumerate(row_edits(symbol)):
        for _, cost, t in own:
            step[s, t] = min(step[s, t], cost)
    insert = np.full((4, 4), INF, dtype=np.int64)
    for s in range(4):
        insert[s, s] = 0
    for _ in range(2):                            # a third insertion only comes back
        for s in range(4):
            for t in range(4):
                if insert[s, t] < INF:
                    insert[s, WANTED[t]] = min(insert[s, WANTED[t]], insert[s, t] + INSERT)
    return times(insert, step)


class Powers:
    """Transitions of every symbol to the powers of two, made when needed."""

    def __init__(self):
        self.of = {symbol: [transition(symbol)] for symbol in range(12)}
        self.edits = {symbol: row_edits(symbol) for symbol in range(12)}

    def power(self, symbol: int, k: int) -> np.ndarray:
        own = self.of[symbol]
        while len(own) <= k:
            own.append(times(own[-1], own[-1]))
        return own[k]

    def advance(self, left: np.ndarray, symbol: int, n: int) -> np.ndarray:
        """``left`` (cost per state, or a matrix of them) before ``n`` rows of a symbol."""
        k = 0
        while n:
            if n & 1:
                left = times(self.power(symbol, k), left)
            n >>= 1
            k += 1
        return left


def compose(runs, powers: Powers) -> np.ndarray:
    """The transition of a block's runs [(symbol, n)]."""
    unit = np.full((4, 4), INF, dtype=np.int64)
    np.fill_diagonal(unit, 0)
    for symbol, n in reversed(runs):
        unit = powers.advance(unit, symbol, n)
    return unit


def unroll(runs, left, states, last: bool, powers: Powers) -> list[tuple[str, int]]:
    """Per state a block may be entered in: the ASCII-least of its cheapest
    edits, ``left`` being the cost per state after it, and the state after it."""
    ends = [np.asarray(left, dtype=np.int64).reshape(4, 1)]
    for symbol, n in reversed(runs):
        ends.append(powers.advance(ends[-1], symbol, n))
    found: list[tuple[list[str], int]] = [([], s) for s in states]
    for (symbol, n), end in zip(runs, reversed(ends[:-1])):
        # cost per state before each row of the run, from its end on
        costs, one = [end], powers.of[symbol][0]
        for _ in range(n):
            costs.append(times(one, costs[-1]))
        rows = [c[:, 0].tolist() for c in costs]
        edits = powers.edits[symbol]
        for i, (out, state) in enumerate(found):
            for at in range(n - 1, -1, -1):
                after, now = rows[at], rows[at + 1]
                letter = "I"
                while letter == "I":
                    choices = [(x, t) for x, cost, t in edits[state] if cost + after[t] == now[state]]
                    if INSERT + now[WANTED[state]] == now[state]:
                        choices.append(("I", WANTED[state]))
                    letter, state = min(choices)
                    out.append(letter)
            found[i] = (out, state)
    for i, (out, state) in enumerate(found):
        while last and END_COST[state]:
            out.append("I")
            state = WANTED[state]
        found[i] = (out, state)
    return [("".join(out), state) for out, state in found]


def apply_edits(rows, audit: str, state: int = 0):
    """The repaired (role, text) rows; ``rows`` holds one (role, text) a row."""
    rows = iter(rows)
    for letter in audit:
        if letter == "I":
            yield WANTED_ROLE[state], ""
            state = WANTED[state]
            continue
        role, text = next(rows)
        if letter == "K":
            yield role, text
            state = NEXT[role[0]][state]
        elif letter == "R":
            yield WANTED_ROLE[state], text
            state = WANTED[state]


# --- rows with their faults --------------------------------------------------------
def damaged(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
            text_col: str = "text") -> DataFrame:
    """(conv, turn, role, text, copies): rows damaged by ``crc32(conv:turn) % 20``.
    0 drops a row, 1 empties its text, 2 removes its sentence ends, 3 repeats it,
    4 makes it the user's. Nulls count as one space."""
    text = {k: F.coalesce(F.col(c).cast("string"), F.lit(" ")) for k, c in
            (("c", conv_col), ("t", turn_col), ("role", role_col), ("text", text_col))}
    k = F.crc32(F.concat(text["c"], F.lit(":"), text["t"]).cast("binary")) % 20
    own = narrow(turns, conv=F.col(conv_col).cast("long"), turn=F.col(turn_col).cast("long"), role=text["role"],
                 text=text["text"], k=k).where("k <> 0")
    return own.select(
        "conv", "turn", F.when(F.col("k") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("k") == 1, "").when(F.col("k") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        F.when(F.col("k") == 3, 2).otherwise(1).cast("long").alias("copies"))


def with_faults(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows in order (g, conv, turn, role, text, copies), and small rows (g,
    conv, block, turn, copies, initial, fault): of the first copy 'blank',
    'duplicate', 'truncated' or null. Whether a role and text came before is
    found by an aggregate and a join on the row number, so neither a long
    conversation nor a common text is a hot key."""
    folded = rows.groupBy("conv", "turn", "role", "text").agg(F.sum("copies").alias("copies"))
    placed = numbered(folded, ["conv", F.asc_nulls_first("turn"), "role", "text"], ["conv", "turn", "role", "text", "copies"])
    blank = ~F.col("text").rlike(WORD)
    # the last character that is no white space, if it is no end of a sentence
    open_end = ~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")
    small = placed.select("g", "conv", "turn", "copies", F.substring("role", 1, 1).alias("initial"), blank.alias("blank"),
                          open_end.alias("open_end"), text_hash("role", "text", salt=1).alias("t1"),
                          text_hash("role", "text", salt=2).alias("t2"))
    first = small.groupBy("conv", "t1", "t2").agg(F.min("g").alias("g")).select("g", F.lit(True).alias("first"))
    fault = (F.when(F.col("blank"), "blank").when(F.col("first").isNull(), "duplicate")
             .when(F.col("open_end"), "truncated"))
    return placed, small.join(first, "g", "left").select(
        "g", "conv", F.floor(F.col("g") / BLOCK_ROWS).alias("block"), "turn", "copies", "initial", fault.alias("fault"))


# --- repair ----------------------------------------------------------------------
def _blocks(small: DataFrame) -> DataFrame:
    """One row per block of a conversation: its runs and what is counted on it.
    Blocks hold at most ``BLOCK_ROWS`` neighbouring rows."""
    kind = {"blank": MUST_GO, "duplicate": MUST_GO, "truncated": CUT_OFF}
    fault = F.lit(GOOD)
    for name, value in kind.items():
        fault = F.when(F.col("fault") == name, value).otherwise(fault)
    role = F.when(F.col("initial") == "s", 0).when(F.col("initial") == "u", 1).when(F.col("initial") == "a", 2).otherwise(3)
    item = F.struct("g", (role * 3 + fault).cast("int").alias("symbol"), "copies", "turn")
    # copies after the first are repeats; of blank rows they are blank
    more = F.when(F.col("fault") == "blank", F.lit(0)).otherwise(F.col("copies") - 1)
    return small.groupBy("conv", "block").agg(
        F.min("g").alias("at"), F.array_sort(F.collect_list(item)).alias("rows"),
        F.sum(F.when(F.col("fault") == "blank", F.col("copies")).otherwise(0)).alias("blank"),
        F.sum(more + F.when(F.col("fault") == "duplicate", 1).otherwise(0)).alias("again"),
        F.count_if(F.col("fault") == "truncated").alias("open"))


_RUNS = ("conv long, block long, at long, symbol array<int>, n array<long>, matrix array<long>, blank long, again long, "
         "open long, illegal long, first_role int, last_role int, turns long, first_turn long, last_turn long, low long")
LEGAL = {(0, 1), (1, 2), (2, 1)}


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def _arrow(ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_(),
             "array<int>": pa.list_(pa.int32()), "array<long>": pa.list_(pa.int64()), "array<string>": pa.list_(pa.string())}
    return pa.schema([(n, kinds[k]) for n, k in (x.strip().split(" ") for x in ddl.split(","))])


def _powers() -> Powers:
    return kept_in_worker("chat_repair_powers", Powers)


def _composed(blocks: DataFrame) -> DataFrame:
    """Blocks with their runs and composed transition."""
    schema = _arrow(_RUNS)

    def run(batches):
        powers = _powers()
        for batch in (some for whole in batches for some in parts(whole, 64)):
            done = []
            for b in batch.to_pylist():
                runs: list[list[int]] = []
                illegal, last, turns = 0, None, []
                for row in b["rows"]:
                    symbol, role = row["symbol"], row["symbol"] // 3
                    illegal += last is not None and (last, role) not in LEGAL
                    illegal += (row["copies"] - 1) * ((role, role) not in LEGAL)
                    last = role
                    turns.append(row["turn"])
                    for s, n in ((symbol, 1), (role * 3 + MUST_GO, row["copies"] - 1)):
                        if n and runs and runs[-1][0] == s:
                            runs[-1][1] += n
                        elif n:
                            runs.append([s, n])
                known = [t for t in turns if t is not None]
                done.append((b["conv"], b["block"], b["at"], [r[0] for r in runs], [r[1] for r in runs],
                             compose(runs, powers).ravel().tolist(), b["blank"], b["again"], b["open"], illegal,
                             b["rows"][0]["symbol"] // 3, last, len(set(known)), turns[0], turns[-1],
                             known[0] if known else None))
            if done:
                yield _batch(done, schema)

    return blocks.mapInArrow(run, _RUNS)


_LEFT = ("at long, conv long, left array<long>, last boolean, first boolean, cost long, gaps long, blank long, "
         "duplicate long, truncated long, illegal long")


def _by_conversation(df: DataFrame, cols: list[str], one, ddl: str) -> DataFrame:
    """``one(rows of a conversation in order of block) -> rows``, streamed over
    conversations; only the named small columns are moved."""
    schema = _arrow(ddl)

    def run(batches):
        rows, done = [], []
        for batch in batches:
            for row in batch.to_pylist():
                if rows and row["conv"] != rows[0]["conv"]:
                    done.extend(one(rows))
                    rows = []
                rows.append(row)
            if done:
                yield _batch(done, schema)
                done = []
        if rows:
            yield _batch(one(rows), schema)

    return df.select("conv", "block", *cols).repartition("conv").sortWithinPartitions("conv", "block").mapInArrow(run, ddl)


def _costs(rows: list[dict]) -> list[tuple]:
    """Cost left after each block, by going backwards; counts go to the first."""
    left, out = np.array(END_COST, dtype=np.int64).reshape(4, 1), []
    for i in range(len(rows) - 1, -1, -1):
        after = left[:, 0].tolist()
        left = times(np.array(rows[i]["matrix"], dtype=np.int64).reshape(4, 4), left)
        out.append([rows[i]["at"], rows[i]["conv"], after, i == len(rows) - 1, i == 0] + [None] * 6)
    illegal, turns = sum(r["illegal"] for r in rows), sum(r["turns"] for r in rows)
    for a, b in zip(rows, rows[1:]):
        illegal += (a["last_role"], b["first_role"]) not in LEGAL
        turns -= a["last_turn"] is not None and a["last_turn"] == b["first_turn"]
    low = next((r["low"] for r in rows if r["low"] is not None), None)
    gaps = 0 if low is None else rows[-1]["last_turn"] - low + 1 - turns
    out[-1][5:] = [int(left[0, 0]), gaps, *(sum(r[c] for r in rows) for c in ("blank", "again", "open")), illegal]
    return [tuple(x) for x in out]


_EDITS = "at long, conv long, block long, ends array<int>, audits array<string>"


def _unrolled(blocks: DataFrame) -> DataFrame:
    """Blocks with their edits, and the state after them, per state before."""
    schema = _arrow(_EDITS)

    def run(batches):
        powers = _powers()
        for batch in batches:
            done = []
            for b in batch.to_pylist():
                runs = list(zip(b["symbol"], b["n"]))
                # a conversation's first block is entered in state 0 only
                got = unroll(runs, b["left"], range(1 if b["first"] else 4), b["last"], powers)
                done.append((b["at"], b["conv"], b["block"], [g[1] for g in got], [g[0] for g in got]))
            if done:
                yield _batch(done, schema)

    return blocks.mapInArrow(run, _EDITS)


def _entered(rows: list[dict]) -> list[tuple]:
    state, out = 0, []
    for r in rows:
        out.append((r["at"], state))
        state = r["ends"][state]
    return out


def repair_plan(small: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv, block, audit, state): the edits of every block and the state it is
    entered in; (conv, cost and counts): per conversation."""
    runs = cut_lineage(_composed(_blocks(small)))
    left = cut_lineage(_by_conversation(
        runs, ["at", "matrix", "blank", "again", "open", "illegal", "first_role", "last_role", "turns", "first_turn",
               "last_turn", "low"], _costs, _LEFT))
    edits = cut_lineage(_unrolled(runs.select("at", "block", "symbol", "n").join(
        left.select("at", "conv", "left", "last", "first"), "at")))
    entered = _by_conversation(edits, ["at", "ends"], _entered, "at long, state int")
    plan = edits.join(entered, "at").select("conv", "block", F.get("audits", F.col("state")).alias("audit"), "state")
    return plan, left.where("first").drop("at", "left", "last", "first")


def repaired_rows(placed: DataFrame, plan: DataFrame, by: tuple[str, ...] = ("conv", "block")) -> DataFrame:
    """(conv, block, seq, role, text): the repaired conversations, in order of
    (block, seq). Rows are dealt out by ``by`` and stream past their edits."""
    schema = _arrow("conv long, block long, seq long, role string, text string")

    def run(batches):
        done, held = [], 0
        audit, at, state, seq, key = "", 0, 0, 0, (None, None)

        def inserted():
            nonlocal at, state, seq
            while at < len(audit) and audit[at] == "I":
                done.append((*key, seq, WANTED_ROLE[state], ""))
                state, at, seq = WANTED[state], at + 1, seq + 1

        for batch in batches:
            for r in batch.to_pylist():
                if r["audit"] is not None:        # a block's edits come before its rows
                    audit, at, state, seq, key = r["audit"], 0, r["state"], 0, (r["conv"], r["block"])
                    inserted()
                    continue
                for _ in range(r["copies"]):
                    letter, at = audit[at], at + 1
                    if letter != "D":
                        role = r["role"] if letter == "K" else WANTED_ROLE[state]
                        state = NEXT[role[0]][state]
                        done.append((*key, seq, role, r["text"]))
                        seq, held = seq + 1, held + len(r["text"])
                    inserted()
                if held > 1 << 22 or len(done) > 10_000:
                    yield _batch(done, schema)
                    done, held = [], 0
        if done:
            yield _batch(done, schema)

    none = F.lit(None)
    texts = placed.select("conv", F.floor(F.col("g") / BLOCK_ROWS).alias("block"), "g", "role", "text", "copies",
                          none.cast("string").alias("audit"), none.cast("int").alias("state"))
    heads = plan.select("conv", "block", F.lit(-1).cast("long").alias("g"), none.cast("string").alias("role"),
                        none.cast("string").alias("text"), none.cast("long").alias("copies"), "audit", "state")
    return texts.unionByName(heads).repartition(*by).sortWithinPartitions("conv", "block", "g").mapInArrow(
        run, "conv long, block long, seq long, role string, text string")


def _joined(df: DataFrame, value: str, sep: str, out: str, digest: bool) -> DataFrame:
    """Per conversation the strings ``value``, joined, or the SHA-256 of that: a
    stream over rows that are together and in order already."""
    schema = pa.schema([("conv", pa.int64()), (out, pa.string())])

    def run(batches):
        conv, pieces, state, some, done = None, [], None, False, []

        def close():
            done.append((conv, state.hexdigest() if digest else sep.join(pieces)))

        for batch in batches:
            for c, v in zip(batch.column("conv").to_pylist(), batch.column(value).to_pylist()):
                if not some or c != conv:
                    if some:
                        close()
                    conv, pieces, state, some = c, [], hashlib.sha256(), True
                elif digest:
                    state.update(sep.encode())
                if digest:
                    state.update(v.encode())
                else:
                    pieces.append(v)
            if done:
                yield _batch(done, schema)
                done = []
        if some:
            close()
            yield _batch(done, schema)

    return df.mapInArrow(run, f"conv long, {out} string")


def repair_chats(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                 text_col: str = "text", damage=None) -> tuple[DataFrame, DataFrame]:
    """(repaired rows, report). Rows: conv, block, seq, role, text. Report, one row
    per conversation of ``turns``: conv, gaps, blank, duplicate, truncated,
    illegal, cost, audit, repaired_sha256. ``damage`` changes the rows first
    (:func:`damaged`)."""
    if damage:
        rows = damage(turns, conv_col, turn_col, role_col, text_col)
    else:
        rows = narrow(turns, conv=F.col(conv_col).cast("long"), turn=F.col(turn_col).cast("long"),
                      role=F.coalesce(F.col(role_col).cast("string"), F.lit(" ")),
                      text=F.coalesce(F.col(text_col).cast("string"), F.lit(" ")), copies=F.lit(1).cast("long"))
    placed, small = with_faults(rows)
    plan, counts = repair_plan(small)
    plan = cut_lineage(plan)
    line = repaired_rows(placed, plan, by=("conv",)).select("conv", F.concat("role", F.lit(":"), "text").alias("line"))
    sha = _joined(line, "line", "\n", "repaired_sha256", digest=True)
    pieces = plan.select("conv", "block", "audit").repartition("conv").sortWithinPartitions("conv", "block")
    audit = _joined(pieces, "audit", "", "audit", digest=False)
    every = narrow(turns, conv=F.col(conv_col).cast("long")).distinct()
    report = every
    for i, part in enumerate((counts, audit, sha)):
        part = part.withColumnRenamed("conv", f"conv{i}")
        report = report.join(part, F.col("conv").eqNullSafe(F.col(f"conv{i}")), "left").drop(f"conv{i}")
    zero = F.lit(0).cast("long")
    return repaired_rows(placed, plan), report.select(
        "conv", *[F.coalesce(c, zero).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
        F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(EMPTY_SHA)).alias("repaired_sha256"))
