"""Prefix trie of conversations by vertical bitmaps.

Conversations are numbered by id and dealt to shards of ``shard_convs``
neighbours; their turns are cut into bands of ``band_turns`` positions. A task
holds one shard and band. It indexes every (position, turn) as the bitset of
the shard's conversations that have it there, and walks depth first: a node is
the bitset of its members, and the intersection of that bitset with a posting
of the next position is a child. Popcounts, smallest members and the list of
conversations that end at a node are read off the bitsets. A band starts from
the classes of conversations with one and the same turns before it.

Nodes of different shards meet by a key of their turns: the exclusive or of a
128-bit hash of every (position, role, text). Shards are ranges of ids, so the
end lists of a node, put together in the order of the shards, are in order of
id; they are hashed as a stream.

Sums over subtrees: what a node adds is booked on its smallest member, whose
nodes from some depth on form a chain without a gap. A subtree's sum is its own
chain's, from its depth on, and the whole of the chains of its other members.
The latter is a second walk of the same kind, with weighted popcounts, over the
part of every conversation above its own chain. All work is proportional to
the number of turns, however long a conversation or common a turn is.

Input cases: rows with a null conversation id take no part; a null role or text
is empty; null turn numbers come first, ties of a turn go by role, then text, and
repeated rows are turns of their own; an empty table gives no rows; very long
texts are hashed whole; further input columns are ignored."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from murmur.llm._common import by_value, narrow
from murmur.llm._turns import WORD, numbered, text_hash
from murmur.session import cut_lineage

by_value(__name__)

SHARD_CONVS = 1024
BAND_TURNS = 64
GROUP_TURNS = 4096      # neighbouring turns that look up their conversation together
EMPTY_SHA = hashlib.sha256(b"").hexdigest()
NODE = ["depth", "k1", "k2"]


# --- turns in order, and rebuilt conversations -----------------------------------
def ordered_turns(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                  text_col: str = "text") -> DataFrame:
    """(conv, g, t1, t2, words): every turn's number in the order of
    conversations and turns, the hashes of its role and text, and the words of
    its text. The texts themselves are moved once, to be sorted."""
    rows = narrow(turns, conv=F.col(conv_col).cast("long"), turn=F.col(turn_col).cast("long"),
                  role=F.coalesce(F.col(role_col), F.lit("")), text=F.coalesce(F.col(text_col), F.lit("")))
    return numbered(rows.where("conv is not null"), ["conv", F.asc_nulls_first("turn"), "role", "text"],
                    ["conv", text_hash("role", "text", salt=1).alias("t1"), text_hash("role", "text", salt=2).alias("t2"),
                     F.regexp_count("text", F.lit(WORD)).cast("long").alias("words")])


def conversations_of(rows: DataFrame) -> DataFrame:
    """(conv, ord, n, g0): the conversations by id, with their number of turns
    and the number of their first turn."""
    own = rows.groupBy("conv").agg(F.count(F.lit(1)).alias("n"), F.min("g").alias("g0"))
    return numbered(own, ["conv"], ["conv", "n", "g0"], name="ord")


def _with_conversation(rows: DataFrame, convs: DataFrame, cols: list[str]) -> DataFrame:
    """Turns with columns of their conversation. Both sides meet by groups of
    turn numbers, so a long conversation is no hot key."""
    groups = F.sequence(F.floor(F.col("g0") / GROUP_TURNS), F.floor((F.col("g0") + F.col("n") - 1) / GROUP_TURNS))
    spread = convs.select("conv", "n", "g0", *cols, F.explode(groups).alias("grp"))
    return rows.withColumn("grp", F.floor(F.col("g") / GROUP_TURNS)).join(spread, ["conv", "grp"]).drop("grp").withColumn(
        "at", F.col("g") - F.col("g0"))


def as_they_are(rows: DataFrame, convs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns (conv, ord, pos, t1, t2, words) and conversations (conv, ord, len),
    unchanged; positions count from 1."""
    placed = _with_conversation(rows, convs, ["ord"])
    return (placed.select("conv", "ord", (F.col("at") + 1).alias("pos"), "t1", "t2", "words"),
            convs.select("conv", "ord", F.col("n").alias("len")))


def rebuilt(rows: DataFrame, convs: DataFrame, group: int = 20, most: int = 4) -> tuple[DataFrame, DataFrame]:
    """Conversations that start alike: ``h = crc32(id) % most`` first turns of
    conversation ``id - id % group`` (all if fewer, none if it is absent), then
    the own turns after the first ``h``. Same columns as :func:`as_they_are`."""
    crc = F.crc32(F.col("conv").cast("string").cast("binary"))
    plan = convs.select("*", (crc % F.lit(most)).alias("h"), (F.col("conv") - F.col("conv") % F.lit(group)).alias("lead"))
    heads = convs.select(F.col("conv").alias("lead"), F.col("n").alias("lead_n"))
    plan = plan.join(heads, "lead", "left").withColumn("m", F.least("h", F.coalesce("lead_n", F.lit(0))))
    plan = plan.withColumn("len", F.col("m") + F.greatest(F.col("n") - F.col("h"), F.lit(0)))
    own = _with_conversation(rows, plan, ["ord", "h", "m"]).where(F.col("at") >= F.col("h")).select(
        "conv", "ord", (F.col("at") - F.col("h") + F.col("m") + 1).alias("pos"), "t1", "t2", "words")
    first = _with_conversation(rows, convs, []).where(
        (F.col("at") < most - 1) & (F.col("conv") % group == 0)).select(
        F.col("conv").alias("lead"), (F.col("at") + 1).alias("pos"), "t1", "t2", "words")
    taken = plan.where("m > 0").select("conv", "ord", "lead", F.explode(F.sequence(F.lit(1), F.col("m").cast("int"))).alias("pos"))
    copied = taken.withColumn("pos", F.col("pos").cast("long")).join(first, ["lead", "pos"]).select(*own.columns)
    return own.unionByName(copied), plan.select("conv", "ord", "len")


# --- the walk over one shard and band --------------------------------------------
def _bits(x: int) -> np.ndarray:
    raw = np.frombuffer(x.to_bytes((x.bit_length() + 7) // 8, "little"), dtype=np.uint8)
    return np.flatnonzero(np.unpackbits(raw, bitorder="little"))


def walk(band: int, band_turns: int, conv, bit, length, start, turns, weight):
    """Nodes of one shard and band, as tuples (depth, k1, k2, pk1, pk2, members,
    smallest member, words, ends, weights).

    ``conv``, ``bit``, ``length``, ``start``: per conversation its id, its place
    in the bitsets (in order of id), its number of turns and the key of its
    turns before this band. ``turns``: arrays (bit, pos, p1, p2, words).
    ``weight``: a matrix, one row a conversation, summed over members."""
    ids = dict(zip(bit, conv))
    weights = np.zeros((max(bit) + 1, weight.shape[1]), dtype=np.int64)
    weights[bit] = weight
    # vertical index: the bitset of every posting, and each conversation's posting by position
    index: dict[tuple, int] = {}
    said: dict[int, list] = {}
    for b, pos, p1, p2, words in zip(*turns):
        post = (pos, p1, p2, words)
        index[post] = index.get(post, 0) | 1 << b
        said.setdefault(b, []).append(post)
    for own in said.values():
        own.sort()
    ended: dict[int, int] = {}
    for b, n in zip(bit, length):
        ended[n] = ended.get(n, 0) | 1 << b
    roots: dict[tuple, int] = {}
    for b, key in zip(bit, start):
        roots[key] = roots.get(key, 0) | 1 << b
    first = band * band_turns

    weighted = weights.any()

    def node(depth, key, parent, members, words):
        ends = ended.get(depth, 0) & members
        low = (members & -members).bit_length() - 1
        return (depth, *key, *parent, members.bit_count(), ids[low], words,
                [ids[b] for b in _bits(ends).tolist()] if ends else None,
                weights[_bits(members)].sum(axis=0).tolist() if weighted else (0, 0))

    todo = []
    for key, members in roots.items():
        if band == 0:
            yield node(0, key, (None, None), members, 0)
        todo.append((first, key, members))
    while todo:
        depth, key, members = todo.pop()
        left = members & ~ended.get(depth, 0)
        while left:
            low = (left & -left).bit_length() - 1
            # the lowest member that is left names the next posting to intersect with
            post = said[low][depth - first]
            child = left & index[post]
            left &= ~child
            grown = (key[0] ^ post[1], key[1] ^ post[2])
            yield node(depth + 1, grown, key, child, post[3])
            if depth + 1 < first + band_turns:
                todo.append((depth + 1, grown, child))


_PART = ("depth long, k1 long, k2 long, pk1 long, pk2 long, n long, least long, words long, ends array<long>, "
         "shard long, leaf long, saved long")


def _walked(turns: DataFrame, convs: DataFrame, shard_convs: int, band_turns: int) -> DataFrame:
    """Nodes of every shard. ``turns``: (conv, ord, pos, t1, t2, words) up to
    each conversation's length; ``convs``: (conv, ord, len, leaf, saved)."""
    rows = turns.withColumns({
        "p1": F.xxhash64("pos", "t1", "t2"), "p2": F.xxhash64(F.lit(7), "t2", "pos", "t1"),
        "band": F.floor((F.col("pos") - 1) / F.lit(band_turns))})
    # the key of a conversation's turns before each band: running exclusive or over
    # its bands, first inside groups of 1,024 bands, then over the groups
    chunks = rows.groupBy("ord", "band").agg(F.bit_xor("p1").alias("x1"), F.bit_xor("p2").alias("x2")).withColumn(
        "big", F.floor(F.col("band") / 1024))
    zero = F.lit(0).cast("long")

    def before(df, part, by):
        w = Window.partitionBy(*part).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
        return df.withColumns({f"b{i}": F.coalesce(F.bit_xor(f"x{i}").over(w), zero) for i in (1, 2)})

    groups = before(chunks.groupBy("ord", "big").agg(F.bit_xor("x1").alias("x1"), F.bit_xor("x2").alias("x2")),
                    ["ord"], "big").select("ord", "big", F.col("b1").alias("g1"), F.col("b2").alias("g2"))
    starts = before(chunks, ["ord", "big"], "band").join(groups, ["ord", "big"]).select(
        "ord", "band", F.col("b1").bitwiseXOR(F.col("g1")).alias("s1"), F.col("b2").bitwiseXOR(F.col("g2")).alias("s2"))
    last = F.greatest(F.floor((F.col("len") - 1) / F.lit(band_turns)), F.lit(0))
    bands = convs.withColumn("band", F.explode(F.sequence(F.lit(0).cast("long"), last.cast("long")))).join(
        starts, ["ord", "band"], "left")
    shard = F.floor(F.col("ord") / F.lit(shard_convs))
    none = F.lit(None).cast("long")
    members = bands.select(shard.alias("shard"), "band", "ord", "conv", F.col("len").alias("a"),
                           F.coalesce("s1", zero).alias("h1"), F.coalesce("s2", zero).alias("h2"), none.alias("words"),
                           "leaf", "saved")
    said = rows.select(shard.alias("shard"), "band", "ord", none.alias("conv"), F.col("pos").alias("a"),
                       F.col("p1").alias("h1"), F.col("p2").alias("h2"), "words", none.alias("leaf"), none.alias("saved"))

    def run(table: pa.Table) -> pa.Table:
        c = {n: table.column(n) for n in table.column_names}
        member = np.asarray(c["conv"].is_valid())
        order = np.asarray(c["ord"])
        bit = order % shard_convs
        at, rest = np.flatnonzero(member), np.flatnonzero(~member)
        at = at[np.argsort(order[at], kind="stable")]

        def own(name, rows):
            return c[name].take(pa.array(rows)).to_pylist()

        weight = np.array([own("leaf", at), own("saved", at)], dtype=np.int64).T.reshape(-1, 2)
        nodes = list(walk(
            int(c["band"][0].as_py()), band_turns, own("conv", at), bit[at].tolist(), own("a", at),
            list(zip(own("h1", at), own("h2", at))),
            (bit[rest].tolist(), own("a", rest), own("h1", rest), own("h2", rest), own("words", rest)), weight))
        cols = list(zip(*nodes))
        out = [pa.array(x, pa.int64()) for x in cols[:8]]
        out += [pa.array(cols[8], pa.list_(pa.int64())), pa.array([c["shard"][0].as_py()] * len(nodes), pa.int64())]
        out += [pa.array([w[i] for w in cols[9]], pa.int64()) for i in (0, 1)]
        return pa.table(out, names=["depth", "k1", "k2", "pk1", "pk2", "n", "least", "words", "ends", "shard", "leaf", "saved"])

    return members.unionByName(said).groupBy("shard", "band").applyInArrow(run, _PART)


def _end_digests(parts: DataFrame) -> DataFrame:
    """(depth, k1, k2, ends_sha256): lists of the shards hashed one after the
    other; only a hash is held, however many conversations end at a node."""
    def run(batches):
        key, state, done = None, None, []

        def flush():
            return pa.RecordBatch.from_arrays(
                [pa.array([d[0][i] for d in done], pa.int64()) for i in range(3)] + [pa.array([d[1] for d in done], pa.string())],
                names=[*NODE, "ends_sha256"])

        for batch in batches:
            for *own, ends in zip(*[batch.column(c).to_pylist() for c in (*NODE, "ends")]):
                if own != key:
                    if key is not None:
                        done.append((key, state.hexdigest()))
                    key, state = own, hashlib.sha256()
                else:
                    state.update(b",")
                state.update(",".join(map(str, ends)).encode())
            if done:
                yield flush()
                done = []
        if key is not None:
            done.append((key, state.hexdigest()))
            yield flush()

    own = parts.where("ends is not null").select(*NODE, "shard", "ends")
    return own.repartition(*NODE).sortWithinPartitions(*NODE, "shard").mapInArrow(
        run, "depth long, k1 long, k2 long, ends_sha256 string")


# --- the trie ---------------------------------------------------------------------
def prefix_trie(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                text_col: str = "text", arrange=as_they_are, shard_convs: int = SHARD_CONVS,
                band_turns: int = BAND_TURNS) -> DataFrame:
    """One row per distinct sequence of first turns: ``conv_id`` (smallest
    member), ``depth``, ``parent_conv_id`` (null for the root), ``n_convs``
    (members), ``n_children``, ``n_leaves`` (childless nodes of the subtree),
    ``saved_tokens`` (words that the subtree stores once instead of once a
    member) and ``ends_sha256`` (ids of the members that end there).
    ``arrange`` gives the conversations' turns (:func:`as_they_are`,
    :func:`rebuilt`)."""
    rows = ordered_turns(turns, conv_col, turn_col, role_col, text_col)
    said, convs = arrange(rows, conversations_of(rows))
    said, convs = cut_lineage(said), cut_lineage(convs)
    zero = F.lit(0).cast("long")
    parts = cut_lineage(_walked(said, convs.withColumns({"leaf": zero, "saved": zero}), shard_convs, band_turns))
    nodes = parts.groupBy(*NODE).agg(F.first("pk1").alias("pk1"), F.first("pk2").alias("pk2"), F.sum("n").alias("n"),
                                     F.min("least").alias("conv"), F.first("words").alias("words"))
    children = nodes.where("depth > 0").groupBy(
        (F.col("depth") - 1).alias("depth"), F.col("pk1").alias("k1"), F.col("pk2").alias("k2")).agg(
        F.count(F.lit(1)).alias("n_children"))
    nodes = cut_lineage(nodes.join(children, NODE, "left").withColumns({
        "n_children": F.coalesce("n_children", zero), "adds": (F.col("n") - 1) * F.col("words"),
        "band": F.floor(F.col("depth") / F.lit(band_turns))}))

    # chains: the nodes whose smallest member is one and the same conversation
    chains = nodes.groupBy("conv").agg(
        F.min(F.struct("depth", "k1", "k2", "pk1", "pk2")).alias("first"), F.max((F.col("n_children") == 0).cast("long")).alias("leaf"),
        F.sum("adds").alias("saved"), F.max(F.when(F.col("n") > 1, F.col("band"))).alias("last_band"))
    chains = cut_lineage(chains.withColumn("top", F.col("first.depth")))
    above = convs.join(chains.where("top > 0"), "conv").select(
        "conv", "ord", (F.col("top") - 1).alias("len"), "leaf", "saved")
    cut = above.where("len > 0").withColumn("band", F.explode(F.sequence(
        zero, F.floor((F.col("len") - 1) / F.lit(band_turns)).cast("long")))).select("conv", "band", "len")
    upper = said.withColumn("band", F.floor((F.col("pos") - 1) / F.lit(band_turns))).join(
        cut, ["conv", "band"]).where(F.col("pos") <= F.col("len")).select(*said.columns)
    others = _walked(upper, above, shard_convs, band_turns).groupBy(*NODE).agg(
        F.sum("leaf").alias("other_leaves"), F.sum("saved").alias("other_saved"))

    # the own chain from a node on: inside its band, and the bands below it
    shared = nodes.where("n > 1")
    below = Window.partitionBy("conv", "band").orderBy(F.desc("depth")).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    deeper = Window.partitionBy("conv").orderBy(F.desc("band")).rowsBetween(Window.unboundedPreceding, -1)
    bands = shared.groupBy("conv", "band").agg(F.sum("adds").alias("adds")).withColumn(
        "deeper", F.coalesce(F.sum("adds").over(deeper), zero)).select("conv", "band", "deeper")
    ends_in = chains.where("last_band is not null").select(
        "conv", F.col("leaf").alias("own_leaf"), F.explode(F.sequence(zero, "last_band")).alias("band"))
    own = shared.withColumn("own_saved", F.sum("adds").over(below)).join(bands, ["conv", "band"]).join(
        ends_in, ["conv", "band"]).select(*NODE, "own_leaf", (F.col("own_saved") + F.col("deeper")).alias("own_saved"))

    # a node's parent has the same smallest member but for the top of a chain
    tops = chains.where("top > 0").select("first.*", "conv")
    salts = 16
    branching = nodes.where("n_children > 0 and n > 1").select(
        F.col("depth").alias("pd"), F.col("k1").alias("pk1"), F.col("k2").alias("pk2"), F.col("conv").alias("parent"),
        F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    parents = tops.select(*NODE, "pk1", "pk2", (F.col("depth") - 1).alias("pd"),
                          F.pmod(F.xxhash64("conv"), F.lit(salts)).cast("int").alias("salt")).join(
        branching, ["pd", "pk1", "pk2", "salt"]).select(*NODE, "parent")

    out = nodes.join(own, NODE, "left").join(others, NODE, "left").join(parents, NODE, "left").join(
        _end_digests(parts), NODE, "left")
    alone = F.col("n") == 1
    return out.select(
        F.col("conv").alias("conv_id"), "depth",
        F.when(F.col("depth") > 0, F.coalesce("parent", "conv")).alias("parent_conv_id"), F.col("n").alias("n_convs"), "n_children",
        F.when(alone, F.lit(1)).otherwise(F.col("own_leaf") + F.coalesce("other_leaves", zero)).cast("long").alias("n_leaves"),
        F.when(alone, zero).otherwise(F.col("own_saved") + F.coalesce("other_saved", zero)).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(EMPTY_SHA)).alias("ends_sha256"))
