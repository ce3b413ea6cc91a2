import pytest
from conftest import SF001
from hypothesis import given, settings
from hypothesis import strategies as st

from murmur.llm import mixing as m


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 30), min_size=1, max_size=8))
def test_a_period_stays_within_one_block(weights):
    q, slots = sum(weights), m.pfair_period(weights)
    assert sorted(t for s in slots for t in s) == list(range(q))
    for w, s in zip(weights, slots):
        assert len(s) == w
        for j, t in enumerate(s):
            assert j * q // w <= t < -(-(j + 1) * q // w)      # inside its window


def brute(rows, weights, block):
    """Slot by slot: (source, block number) by earliest deadline, phases
    restarting when a source has given its last block."""
    left = {k: -(-n // block) for k, n in rows.items() if n}
    given_, out = dict.fromkeys(left, 0), []
    while left:
        q, t, done = sum(weights[k] for k in left), 0, {k: 0 for k in left}
        while all(left.values()):
            ready = [(-(-(done[k] + 1) * q // weights[k]), k) for k in sorted(left) if done[k] * q // weights[k] <= t]
            _, k = min(ready)
            out.append((k, given_[k]))
            done[k] += 1
            given_[k] += 1
            left[k] -= 1
            t += 1
        left = {k: n for k, n in left.items() if n}
    return out


@settings(max_examples=80, deadline=None)
@given(st.dictionaries(st.sampled_from("abcdef"), st.integers(1, 200), min_size=1), st.integers(1, 7))
def test_phases_equal_a_simulation(sizes, block):
    weights = m.integer_weights({k: n ** 0.5 for k, n in sizes.items()}, 40)
    assert sum(weights.values()) == max(40, 4 * len(sizes))
    plan = m.pfair_phases(sizes, weights, block)
    got = []
    for k, phases in plan.items():
        for i, p in enumerate(phases):
            end = phases[i + 1]["first"] if i + 1 < len(phases) else -(-sizes[k] // block)
            for b in range(p["first"], end):
                j = b - p["first"]
                got.append((p["slot"] + j // p["w"] * p["q"] + p["at"][j % p["w"]], k, b))
    assert [(k, b) for _, k, b in sorted(got)] == brute(sizes, weights, block)
    assert [t for t, _, _ in sorted(got)] == list(range(len(got)))


def rows_of(df):
    return [r.asDict() for r in df.collect()]


def test_positions_follow_the_schedule(spark):
    df = spark.read.parquet(f"{SF001}/documents.parquet")
    got = rows_of(m.mix_sources(df, bucket_rows=16))
    n = len(got)
    assert n == df.count() and sorted(r["position"] for r in got) == list(range(n))
    sizes, weights = {}, {}
    for r in got:
        sizes[r["source"]] = sizes.get(r["source"], 0) + 1
        weights[r["source"]] = r["weight"]
    order = brute(sizes, weights, m.BLOCK_ROWS)
    assert {(r["source"], r["block"]): r["slot"] for r in got} == {x: i for i, x in enumerate(order)}
    by_position = sorted(got, key=lambda r: r["position"])
    assert [r["slot"] for r in by_position] == sorted(r["slot"] for r in got)
    # while all sources last, each is less than one block from its share
    q, seen, left = sum(weights.values()), dict.fromkeys(sizes, 0), {k: -(-v // m.BLOCK_ROWS) for k, v in sizes.items()}
    for t, (k, _) in enumerate(order):
        seen[k] += 1
        left[k] -= 1
        assert all(abs(seen[s] - (t + 1) * weights[s] / q) < 1 for s in sizes)
        if not left[k]:
            break


def test_edge_rows(spark):
    rows = [(1, "a", None, 1, 1), (1, "a", None, 1, 1), (None, None, "x", None, 2), (2, "", "x", 0, 3), (3, "b", "n", 1, 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long, position int")
    got = rows_of(m.mix_sources(df, block_rows=1))
    assert sorted(r["position"] for r in got) == [0, 1, 2, 3, 4]
    assert sorted((str(r["source"]), r["doc_id"] or 0) for r in got) == sorted((str(r[2]), r[0] or 0) for r in rows)
    stored = m.mixed(df, block_rows=1)
    assert stored.columns == df.columns
    assert sorted(map(str, stored.collect())) == sorted(map(str, df.collect()))
    assert m.mix_sources(df.limit(0)).count() == 0 and m.mixed(df.limit(0)).count() == 0


def test_named_weights(spark):
    df = spark.createDataFrame([(i, "ab"[i % 2], 1) for i in range(400)], "doc_id long, source string, n_chars long")
    got = rows_of(m.mix_sources(df, weights={"a": 3, "b": 1}, block_rows=10))
    first = [r["source"] for r in sorted(got, key=lambda r: r["position"])[:160]]
    assert abs(first.count("a") - 120) < 10
    with pytest.raises(ValueError):
        m.mix_sources(df, weights={"a": 1})
    with pytest.raises(ValueError):
        m.mix_sources(df, max_sources=1)


def test_weights_given_hold_to_the_end(spark):
    """Less than two blocks from the real-valued targets: one of the schedule,
    one of the integer weights."""
    sizes = {"a": 5_000, "b": 10_000, "c": 3}
    weights = {"a": 1 / 3, "b": 2 / 3, "c": 0.0002}
    df = spark.range(15_003).selectExpr(
        "id AS doc_id", "CASE WHEN id < 5000 THEN 'a' WHEN id < 15000 THEN 'b' ELSE 'c' END AS source", "1L AS n_chars")
    got = m.mix_sources(df, weights=weights, block_rows=1).select("position", "source").collect()
    order = [s for _, s in sorted(tuple(r) for r in got)]
    assert sorted(r[0] for r in got) == list(range(15_003))
    seen, total = dict.fromkeys(sizes, 0), sum(weights.values())
    for t, k in enumerate(order):
        seen[k] += 1
        assert all(abs(seen[s] - (t + 1) * weights[s] / total) < 2 for s in sizes), t
        if seen[k] == sizes[k]:
            break
    assert t > 10_000     # until "c" ends


def test_no_python_in_the_plan(spark):
    df = spark.read.parquet(f"{SF001}/documents.parquet")
    plan = m.mix_sources(df)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))
