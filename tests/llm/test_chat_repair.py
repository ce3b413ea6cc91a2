import hashlib
import itertools
import random
import re
import zlib

from conftest import SF001

from murmur.llm import chat_repair as cr

GRAMMAR = re.compile(r"(s?(ua)+)?")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
ENDS = (None, " \t", "ok.", "no end", "done! \n", "é?")


def faults(rows):
    out, seen = [], set()
    for role, text in rows:
        words = WORD.findall(text)
        out.append("blank" if not words else "duplicate" if (role, text) in seen
                   else "truncated" if words[-1][-1] not in ".!?" else None)
        seen.add((role, text))
    return out


def brute_edits(rows):
    """Every sequence of edits with at most two insertions in a place."""
    bad = faults(rows)
    gaps = [(), ("user",), ("assistant",), ("user", "assistant"), ("assistant", "user")]
    best = None
    per_row = [[("D", 4, None)] + ([] if f in ("blank", "duplicate") else [
        (x, c + 3 * (f == "truncated"), to) for x, c, to in (("K", 0, role), ("R", 3, "user"), ("R", 3, "assistant"))])
        for (role, _), f in zip(rows, bad)]
    for ins in itertools.product(gaps, repeat=len(rows) + 1):
        for own in itertools.product(*per_row):
            cost, audit, new = 3 * len(ins[0]), "I" * len(ins[0]), [(r, "") for r in ins[0]]
            for (x, c, to), (_, text), more in zip(own, rows, ins[1:]):
                cost, audit = cost + c + 3 * len(more), audit + x + "I" * len(more)
                new += ([(to, text)] if to is not None else []) + [(r, "") for r in more]
            if GRAMMAR.fullmatch("".join(r[:1] or " " for r, _ in new)) and (best is None or (cost, audit) < best[:2]):
                best = (cost, audit, new)
    return best


def quick_edits(rows):
    """The same by a table over (row, state), built from the end."""
    bad = faults(rows)
    best = {(len(rows), s): (c, "I" * (c // 3)) for s, c in enumerate((0, 6, 3, 0))}
    follow = {0: "su", 1: "u", 2: "a", 3: "u"}
    state = {"s": 1, "u": 2, "a": 3}
    for i in range(len(rows) - 1, -1, -1):
        role, f = rows[i][0][:1], bad[i]
        plain = {}
        for s in range(4):
            own = [(4 + best[i + 1, s][0], "D" + best[i + 1, s][1])]
            if f in (None, "truncated"):
                more = 3 * (f == "truncated")
                if role and role in follow[s]:
                    c, a = best[i + 1, state[role]]
                    own.append((c + more, "K" + a))
                c, a = best[i + 1, 3 if s == 2 else 2]
                own.append((c + 3 + more, "R" + a))
            plain[s] = min(own)
        for s in range(4):
            t = 3 if s == 2 else 2
            u = 3 if t == 2 else 2
            best[i, s] = min(plain[s], (plain[t][0] + 3, "I" + plain[t][1]), (plain[u][0] + 6, "II" + plain[u][1]))
    return best[0, 0]


def by_runs(rows, block):
    """The operator's arithmetic on a list of rows."""
    powers, kinds = cr.Powers(), {"blank": cr.MUST_GO, "duplicate": cr.MUST_GO, "truncated": cr.CUT_OFF, None: cr.GOOD}
    symbols = [("sua".find(r[:1]) if r[:1] and r[:1] in "sua" else 3) * 3 + kinds[f] for (r, _), f in zip(rows, faults(rows))]
    blocks = [[(s, len(list(g))) for s, g in itertools.groupby(symbols[i:i + block])] for i in range(0, len(symbols), block)]
    lefts = [cr.np.array(cr.END_COST).reshape(4, 1)]
    for runs in reversed(blocks):
        lefts.append(cr.times(cr.compose(runs, powers), lefts[-1]))
    audit, state = "", 0
    for i, (runs, left) in enumerate(zip(blocks, list(reversed(lefts))[1:])):
        piece, state = cr.unroll(runs, left, [state], i == len(blocks) - 1, powers)[0]
        audit += piece
    return int(lefts[-1][0, 0]), audit


def test_cheapest_and_least_edits():
    rng = random.Random(3)
    roles, texts = ["user", "assistant", "system", "tool", "", " "], ["a.", "b.", "open", " ", "c!"]
    for n in range(5):
        for _ in range((1, 30, 60, 25, 4)[n]):
            rows = [(rng.choice(roles), rng.choice(texts)) for _ in range(n)]
            if n < 4:
                cost, audit, new = brute_edits(rows)
                assert list(cr.apply_edits(rows, audit)) == new
                assert quick_edits(rows) == (cost, audit)
            if n:
                assert by_runs(rows, 2) == by_runs(rows, 9) == quick_edits(rows)


def test_long_runs():
    rng = random.Random(4)
    for _ in range(40):
        rows = []
        for _ in range(rng.randint(1, 8)):
            role, end = rng.choice(["user", "assistant", "system", "tool"]), rng.choice([".", "", "!"])
            rows += [(role, f"t{len(rows) + i}{end}") for i in range(rng.randint(1, 40))]
        assert by_runs(rows, 7) == by_runs(rows, 10_000) == quick_edits(rows)


def statement(rows, damage):
    """The contract, conversation by conversation."""
    by = {}
    for c, turn, role, text in rows:
        own = by.setdefault(c, [])
        role, text = " " if role is None else role, " " if text is None else text
        k = zlib.crc32(f"{' ' if c is None else c}:{' ' if turn is None else turn}".encode()) % 20 if damage else 9
        if k == 0:
            continue
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        own += [(turn is not None, turn or 0, "user" if k == 4 else role, text)] * (2 if k == 3 else 1)
    out = set()
    for c, own in by.items():
        own.sort()
        said = [r[2:] for r in own]
        bad, turns = faults(said), {r[1] for r in own if r[0]}
        cost, audit = quick_edits(said)
        new = list(cr.apply_edits(said, audit))
        assert GRAMMAR.fullmatch("".join(r[:1] or " " for r, _ in new))
        out.add((c, max(turns) - min(turns) + 1 - len(turns) if turns else 0, *(bad.count(x) for x in ("blank", "duplicate", "truncated")),
                 sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(said, said[1:])), cost, audit,
                 hashlib.sha256("\n".join(f"{r}:{t}" for r, t in new).encode()).hexdigest()))
    return out


def check(spark, rows, **how):
    df = spark.createDataFrame([(*r, 1, 2, "x") for r in rows],
                               "conv_id long, turn long, role string, text string, block long, g long, audit string")
    for damage in (None, cr.damaged):
        repaired, report = cr.repair_chats(df, damage=damage)
        got = [tuple(r) for r in report.collect()]
        assert len(got) == len(set(got)) and set(got) == statement(rows, damage is not None)
        texts = {}
        for r in repaired.orderBy("block", "seq").collect():
            texts.setdefault(r["conv"], []).append(f"{r['role']}:{r['text']}")
        assert {c: hashlib.sha256("\n".join(t).encode()).hexdigest() for c, t in texts.items()} == {
            g[0]: g[8] for g in got if g[8] != cr.EMPTY_SHA}


def test_edge_rows(spark, monkeypatch):
    rng = random.Random(5)
    roles = [None, "", "user", "assistant", "system", "tool", "user"]
    rows = [(rng.choice([None, *range(-3, 30)]), rng.choice([None, 0, 1, 2, 5, 9]), rng.choice(roles), rng.choice(ENDS))
            for _ in range(300)]
    rows += [(50, t, ("user", "assistant")[t % 2], f"turn {t}" + "." * (t % 9 < 8)) for t in range(90)]
    rows += [(51, 3, "user", "again.")] * 40 + [(52, t, "user", "same.") for t in range(40)] + [(53, 0, "user", "long " * 30_000)]
    check(spark, rows)
    monkeypatch.setattr(cr, "BLOCK_ROWS", 8)
    check(spark, rows)


def test_empty_table(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    repaired, report = cr.repair_chats(df, damage=cr.damaged)
    assert repaired.count() == 0 and report.count() == 0


def test_whole_table(spark):
    from murmur.llm.queries import QUERIES
    rows = [tuple(r) for r in spark.read.parquet(f"{SF001}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    cols = ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
    got = {tuple(r[c] for c in cols) for r in QUERIES["op13_chat_repair"](spark, SF001).collect()}
    assert got == statement(rows, True)
