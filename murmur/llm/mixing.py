"""Mixing sources to target weights by Pfair scheduling.

Every source's rows are dealt into blocks. With integer weights ``w`` of sum
``q``, block ``j`` of a source (from 0) is released at slot ``floor(j q / w)``
and due at ``ceil((j + 1) q / w)``; among the released blocks the earliest
deadline goes first. At every slot, each source is less than one block away
from its integer weight's share. The integer weights are fine enough for the
number of blocks: over a whole phase their shares stay less than one block
from those of the target weights. The schedule repeats every ``q`` slots, so at
most one period, and no more slots than there are blocks, is worked out on the
driver; a block's slot is looked up in it. When a source has given its last block, the others go on
by their weights (a new phase): every row is placed exactly once, none is
dropped or repeated.

Rows find their block natively: each source is dealt by a hash into small
buckets, the buckets' counts give offsets, and a row number inside a bucket
completes the rank. No window ever holds a source.

Bounds: ``max_sources`` (a mixture names its sources); the driver holds one
number a slot of a period, at most one a block of ``block_rows`` rows. Input cases: a null source is a source of its own;
null and repeated ids and repeated rows are placed row by row, in an order
that ties of all listed columns leave open; texts are not read; an empty
table gives no rows; further input columns are kept, whatever their names
(``__``-prefixed names are the operator's own)."""

from __future__ import annotations

import heapq
import json
from bisect import bisect_left

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK_ROWS = 16
PERIOD = 1_000
ALPHA = 0.7
BUCKET_ROWS = 4_096
MAX_SOURCES = 1_000


def integer_weights(weights: dict[str, float], period: int) -> dict[str, int]:
    """Weights as integers of sum ``period`` (largest remainder, each at least 1)."""
    period = max(period, 4 * len(weights))
    total = sum(weights.values())
    share = {k: period * v / total for k, v in weights.items()}
    whole = {k: max(1, int(v)) for k, v in share.items()}
    order = sorted(weights, key=lambda k: (-(share[k] - int(share[k])), k))
    for k in order:
        if sum(whole.values()) < period:
            whole[k] += 1
    return whole


def _drift(share: np.ndarray, whole: np.ndarray, blocks: np.ndarray) -> float:
    """How many blocks the integer weights lead a source away from its target
    share in the phase where that is most."""
    left, most = blocks.astype(np.float64), 0.0
    while len(left):
        real, own = share / share.sum(), whole / whole.sum()
        length = (left / own).min()
        most = max(most, (length + len(left)) * np.abs(real - own).max())
        stay = np.arange(len(left)) != (left / own).argmin()
        left = np.maximum(left - length * own, 0.0)[stay]
        share, whole = share[stay], whole[stay]
    return most


def fitting_weights(weights: dict[str, float], rows: dict[str, int], block_rows: int, period: int) -> dict[str, int]:
    """Integer weights of the sum ``period``, doubled until their shares stay
    less than one block from the target shares for all blocks."""
    names = sorted(weights)
    blocks = np.array([-(-rows[k] // block_rows) for k in names])
    share = np.array([weights[k] for k in names], dtype=np.float64)
    while True:
        whole = integer_weights(weights, period)
        if _drift(share, np.array([whole[k] for k in names], dtype=np.float64), blocks) < 1 or period > 1 << 50:
            return whole
        period *= 2


def pfair_period(weights: list[int], left: list[int] | None = None) -> list[list[int]]:
    """Slots of each weight's blocks in one period, by earliest deadline first
    among the released; no further than to the slot where a source has given
    all its ``left`` blocks."""
    q = sum(weights)
    waiting = sorted(((0, i, 0) for i in range(len(weights))), reverse=True)   # (release, source, block)
    heapq.heapify(waiting)
    ready: list[tuple[int, int, int]] = []
    slots: list[list[int]] = [[] for _ in weights]
    for t in range(q):
        while waiting and waiting[0][0] <= t:
            _, i, j = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(j + 1) * q // weights[i]), i, j))
        _, i, j = heapq.heappop(ready)
        slots[i].append(t)
        if left is not None and j + 1 == left[i]:
            break
        if j + 1 < weights[i]:
            heapq.heappush(waiting, ((j + 1) * q // weights[i], i, j + 1))
    return slots


def pfair_phases(rows: dict[str, int], weights: dict[str, int], block_rows: int) -> dict[str, list[dict]]:
    """Per source, its phases: first block, first slot and row of the phase,
    weight, period and slots in the period. ``rows`` are the sources' sizes."""
    left = {k: -(-n // block_rows) for k, n in rows.items() if n > 0}
    given = dict.fromkeys(left, 0)
    plan: dict[str, list[dict]] = {k: [] for k in left}
    slot = row = 0
    while left:
        names = sorted(left)
        each = [weights[k] for k in names]
        q, slots = sum(each), pfair_period(each, [left[k] for k in names])
        # a source that ends in the first period ends the phase there
        last = {k: s[-1] for k, s in zip(names, slots) if len(s) == left[k]} or {
            k: (left[k] - 1) // w * q + s[(left[k] - 1) % w] for k, w, s in zip(names, each, slots)}
        done = min(last, key=lambda k: last[k])
        length = last[done] + 1
        for k, w, s in zip(names, each, slots):
            used = min(left[k], length // q * w + bisect_left(s, length % q))
            if used:
                plan[k].append({"first": given[k], "slot": slot, "row": row, "w": w, "q": q, "at": s})
            given[k] += used
            left[k] -= used
        slot += length
        row += (length - 1) * block_rows + (rows[done] - (given[done] - 1) * block_rows)
        del left[done]
    return plan


def _key(source_col: str) -> Column:
    return F.when(F.col(source_col).isNull(), F.lit("n")).otherwise(
        F.concat(F.lit("v"), F.col(source_col).cast("string")))


def _placed(docs: DataFrame, source_col: str = "source", order_cols: tuple[str, ...] = ("doc_id", "n_chars"),
                weights: dict[str | None, float] | None = None, block_rows: int = BLOCK_ROWS, period: int = PERIOD,
                alpha: float = ALPHA, bucket_rows: int = BUCKET_ROWS, max_sources: int = MAX_SOURCES) -> DataFrame:
    """The rows of ``docs`` with ``__block``, ``__slot``, ``__position`` and
    ``__w``: see :func:`mix_sources`."""
    spark = docs.sparkSession
    keyed = docs.withColumn("__s", _key(source_col)).withColumn("__h", F.xxhash64(*order_cols))
    sizes = {r["__s"]: r["n"] for r in keyed.groupBy("__s").agg(F.count(F.lit(1)).alias("n"))
             .limit(max_sources + 1).collect()}
    if len(sizes) > max_sources:
        raise ValueError(f"more than {max_sources} sources; raise max_sources or group them")
    if weights is None:
        share = {k: n ** alpha for k, n in sizes.items()}
    else:
        named = {"n" if k is None else f"v{k}": float(v) for k, v in weights.items()}
        if missing := [k for k in sizes if named.get(k, 0.0) <= 0]:
            raise ValueError(f"sources without a target weight: {sorted(missing)[:5]}")
        share = {k: named[k] for k in sizes}
    whole = fitting_weights(share, sizes, block_rows, period) if share else {}
    plan = pfair_phases(sizes, whole, block_rows)
    rows = [{"s": k, "weight": whole[k], "buckets": -(-sizes[k] // bucket_rows), "phases": plan[k]} for k in sorted(plan)]
    schema = ("array<struct<s:string,weight:bigint,buckets:int,phases:array<struct<"
              "first:bigint,slot:bigint,row:bigint,w:bigint,q:bigint,at:array<bigint>>>>>")
    table = spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), schema)))
    # one row a source: at most max_sources rows
    sources = F.broadcast(table.select(
        F.col("s").alias("__s"), F.col("weight").alias("__w"), F.col("buckets").alias("__buckets"),
        F.transform("phases", lambda p: p.dropFields("at")).alias("__phases")))
    # one row a slot of a phase's period
    slots = F.broadcast(table.select(F.col("s").alias("__s"), F.inline("phases")).select(
        "__s", F.col("first").alias("__first"), F.posexplode("at").alias("__i", "__at")))

    dealt = keyed.join(sources.select("__s", "__buckets"), "__s").withColumn(
        "__b", F.pmod("__h", F.col("__buckets").cast("long"))).drop("__buckets")
    before = Window.partitionBy("__s").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy("__s", "__b").agg(F.count(F.lit(1)).alias("__n")).select(
        "__s", "__b", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    inside = Window.partitionBy("__s", "__b").orderBy("__h", *[F.col(c) for c in order_cols])
    ranked = dealt.join(starts, ["__s", "__b"]).withColumn(
        "__rank", F.col("__start") + F.row_number().over(inside) - 1)
    block = F.floor(F.col("__rank") / F.lit(block_rows)).cast("long")
    phase = F.element_at(F.filter("__phases", lambda p: p["first"] <= F.col("__block")), -1)
    j = F.col("__block") - F.col("__p")["first"]
    w, q = F.col("__p")["w"].cast("long"), F.col("__p")["q"].cast("long")
    own_slot = F.floor(j / w).cast("long") * q + F.col("__at")
    out = (ranked.withColumn("__block", block)
           .join(sources.select("__s", "__phases", "__w"), "__s")
           .withColumn("__p", phase).withColumn("__first", F.col("__p")["first"])
           .withColumn("__i", F.pmod(j, w).cast("int"))
           .join(slots, ["__s", "__first", "__i"]).withColumn("__own", own_slot))
    return out.select(
        *[F.col(f"`{c}`") for c in docs.columns], "__block", "__w",
        (F.col("__p")["slot"] + F.col("__own")).alias("__slot"),
        (F.col("__p")["row"] + F.col("__own") * F.lit(block_rows)
         + F.pmod(F.col("__rank"), F.lit(block_rows))).alias("__position"))


def mix_sources(docs: DataFrame, **how) -> DataFrame:
    """The rows of ``docs`` with ``block`` (number in the source), ``slot``
    (place of the block in the mixture), ``position`` (place of the row,
    gapless from 0) and the source's integer ``weight``; these replace input
    columns of the same names. ``weights`` maps sources to target weights;
    without it a source weighs its size to the power ``alpha``, which lifts
    small sources."""
    own = {"block": "__block", "slot": "__slot", "position": "__position", "weight": "__w"}
    return _placed(docs, **how).select(*[F.col(f"`{c}`") for c in docs.columns if c not in own],
                                       *[F.col(v).alias(k) for k, v in own.items()])


def mixed(docs: DataFrame, **how) -> DataFrame:
    """The rows of ``docs``, same columns, stored in the order of the mixture
    (sorted inside and across partitions)."""
    return _placed(docs, **how).orderBy("__position").select(*[F.col(f"`{c}`") for c in docs.columns])
