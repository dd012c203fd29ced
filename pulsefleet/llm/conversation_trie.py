"""Trie of conversations: what their common beginnings are, and how many tokens sharing them saves.

A node is a distinct sequence of first turns. Conversations with equal turns are one path with a count. Paths are
sorted by the hashes of their turns (two of 64 bits), so that each subtree is a run of paths, and cut into shards of a
bounded number of turns. A shard's trie is written as balanced parentheses: findclose gives each node's subtree,
ranks give its nodes and leaf pairs, and cumulative arrays its members, leaves and savings.

Neighbouring shards share the beginning (spine) of the paths at their border. A shard knows how many turns its first
path has in common with the path before it, and its last one with the path after it. It counts the text and the
leaf of a shared node only if no earlier shard has the node; so all figures of a shared node add up over the shards.

A task holds a shard, and the hashes (16 bytes a turn) of one conversation; texts are only hashed and measured.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsefleet.llm.common import stored
from pulsefleet.llm.parentheses import Parentheses, least

#: Turns of the paths of a shard, but for a longer last path.
SHARD_TURNS = 1 << 18
#: Bytes of a path that place it in a range; paths equal in these stay together.
RANGE_BYTES = 1 << 12
#: Ids of a conversation's twins are joined in cells of so many consecutive ids.
CELL = 1 << 12

_TURN = 16
_NONE = np.iinfo(np.int64).max


def shared_turns(conv: Column) -> Column:
    """Turns that conversation c takes over from c - c % 5: crc32(decimal c) % 9."""
    return F.crc32(conv.cast("string").cast("binary")) % 9


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Ids (conv) and turns (conv, depth from 1, role, text) of the rebuilt conversations.

    Turns are in the order of ``turn`` (null first); ties by role, then text. Null roles and texts are empty.
    Rows without conv_id are left out. A conversation begins with the first h turns of c - c % 5 (all if
    fewer, none if absent) and goes on with its own turns after its first h.
    """
    texts = [F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("role", "text")]
    rows = conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv"), "turn", *texts)
    order = Window.partitionBy("conv").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    rows = rows.select("conv", F.row_number().over(order).cast("long").alias("nth"), "role", "text")
    rows = stored(rows)
    sizes = rows.groupBy("conv").agg(F.count(F.lit(1)).alias("size"))
    base = F.col("conv") - F.col("conv") % 5
    convs = sizes.select("conv", base.alias("base"), shared_turns(F.col("conv")).alias("h"))
    lent = sizes.select(F.col("conv").alias("base"), F.col("size").alias("base_size"))
    convs = stored(convs.join(lent, "base", "left").select("conv", "base", "h", F.least("h", F.coalesce("base_size", F.lit(0))).alias("lent")))
    # Few turns are lent, to five conversations at most.
    first = rows.where("nth <= 8").withColumnRenamed("conv", "base").join(convs, "base").where("nth <= h")
    own = rows.join(convs, "conv").where("nth > h").withColumn("nth", F.col("nth") - F.col("h") + F.col("lent"))
    turns = [frame.select("conv", F.col("nth").alias("depth"), "role", "text") for frame in (first, own)]
    return convs.select("conv"), turns[0].union(turns[1])


def _paths(convs: DataFrame, turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Distinct paths (rep: the smallest id, n, turns in order) and every id with its rep."""
    marks = [F.xxhash64(F.lit(seed), "role", "text").alias(name) for seed, name in ((0, "a"), (1, "b"))]
    rows = stored(turns.select("conv", "depth", *marks, F.octet_length("text").cast("long").alias("bytes")))
    # Turn hashes with their depth, combined without order: the same for equal sequences only.
    whole = rows.groupBy("conv").agg(
        F.count(F.lit(1)).alias("size"), *[F.bit_xor(F.xxhash64(F.lit(seed), "depth", "a", "b")).alias(name) for seed, name in ((2, "p"), (3, "q"))]
    )
    ids = stored(convs.join(whole, "conv", "left").select("conv", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("size", "p", "q")]))
    reps = stored(ids.groupBy("size", "p", "q").agg(F.min("conv").alias("rep"), F.count(F.lit(1)).alias("n")))
    listed = rows.join(reps.select(F.col("rep").alias("conv")), "conv", "left_semi").groupBy("conv")
    listed = listed.agg(F.array_sort(F.collect_list(F.struct("depth", "a", "b", "bytes"))).alias("turns"))
    paths = reps.select("rep", "n").join(listed.withColumnRenamed("conv", "rep"), "rep", "left")
    twins = ids.join(reps.where("n > 1"), ["size", "p", "q"]).select("rep", "conv")
    return paths, twins


def _keyed(paths: DataFrame) -> DataFrame:
    """The paths with their turns as bytes (key) and the sizes of their texts."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("turns")
            sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy()
            flat = lists.flatten()
            pairs = np.stack([flat.field(c).to_numpy().view(np.uint64) for c in ("a", "b")], axis=1).astype(">u8").tobytes()
            ends = np.concatenate([[0], np.cumsum(sizes)])
            keys = [pairs[_TURN * a : _TURN * b] for a, b in zip(ends.tolist(), ends[1:].tolist())]
            bytes_ = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), flat.field("bytes"))
            yield pa.RecordBatch.from_arrays([batch.column("rep"), batch.column("n"), pa.array(keys, pa.binary()), bytes_], names=["rep", "n", "key", "sizes"])

    return paths.mapInArrow(of, "rep long, n long, key binary, sizes array<long>")


def _common_turns(x: bytes, y: bytes) -> int:
    size = min(len(x), len(y)) // _TURN
    a, b = (np.frombuffer(v, f"V{_TURN}", size) for v in (x, y))
    differ = np.flatnonzero(a != b)
    return int(differ[0]) if len(differ) else size


def _sharded(keyed: DataFrame) -> DataFrame:
    """Sorted paths with part, shard, place, and the turns in common with the path before and after.

    The turns in common across the border of two partitions come from a small table of their first and
    last paths; -1: there is no path on that side.
    """
    ranged = keyed.withColumn("cut", F.substring("key", 1, RANGE_BYTES)).repartitionByRange("cut").sortWithinPartitions("key").drop("cut")
    schema = "part long, shard long, place long, rep long, n long, key binary, sizes array<long>, before int, after int, edge int"

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, shard, place, turns, last = TaskContext.get().partitionId(), 0, 0, 0, None

        def out(rows: list[dict]) -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist(rows, pa.schema([("part", pa.int64()), ("shard", pa.int64()), ("place", pa.int64()), ("rep", pa.int64()), ("n", pa.int64()), ("key", pa.binary()), ("sizes", pa.list_(pa.int64())), ("before", pa.int32()), ("after", pa.int32()), ("edge", pa.int32())]))

        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                common = _common_turns(last["key"], row["key"]) if last is not None else None
                if last is not None:
                    rows.append(last | {"after": common})
                turns += len(row["key"]) // _TURN + 1
                if turns > SHARD_TURNS:
                    shard, turns = shard + 1, len(row["key"]) // _TURN + 1
                # Edges: 1 is the first path of the partition, 2 its last, 3 both.
                last = row | {"part": part, "shard": shard, "place": place, "before": common, "after": None, "edge": int(place == 0)}
                place += 1
            yield out(rows)
        if last is not None:
            yield out([last | {"edge": last["edge"] + 2}])

    return stored(ranged.mapInArrow(of, schema))


def _borders(sharded: DataFrame) -> DataFrame:
    """Per part: the turns in common across its two borders. Two rows per partition are read."""
    edges = sharded.where("edge > 0").groupBy("part").agg(
        F.max(F.when(F.col("edge").isin(1, 3), F.col("key"))).alias("first"), F.max(F.when(F.col("edge") >= 2, F.col("key"))).alias("last")
    )
    order = Window.orderBy("part")

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = ("first", "last", "prior", "next")
            rows = list(zip(*(batch.column(c).to_pylist() for c in names)))
            before = [-1 if p is None else _common_turns(p, f) for f, _, p, _ in rows]
            after = [-1 if n is None else _common_turns(last, n) for _, last, _, n in rows]
            yield pa.RecordBatch.from_arrays([batch.column("part"), pa.array(before, pa.int32()), pa.array(after, pa.int32())], names=["part", "left", "right"])

    near = edges.select("part", "first", "last", F.lag("last").over(order).alias("prior"), F.lead("first").over(order).alias("next"))
    return near.mapInArrow(of, "part long, left int, right int")


_NODES = (
    "conv long, depth long, parent_conv long, n_convs long, n_children long, n_leaves long, saved long, n_ends long, end_rep long, id binary, parent_id binary"
)
_SCHEMA = pa.schema(
    [(c, pa.int64()) for c in ("conv", "depth", "parent_conv", "n_convs", "n_children", "n_leaves", "saved", "n_ends", "end_rep")]
    + [("id", pa.binary()), ("parent_id", pa.binary())]
)


def _ids(key: bytes, most: int) -> list[bytes]:
    """Names of the nodes of depth 0 to ``most`` on a path."""
    state, out = hashlib.blake2b(digest_size=16), []
    for d in range(most + 1):
        out.append(state.copy().digest())
        state.update(key[_TURN * d : _TURN * (d + 1)])
    return out


def shard_nodes(keys: list[bytes], ns: np.ndarray, reps: np.ndarray, sizes: list[np.ndarray], common: np.ndarray, before: int, after: int) -> pa.Table:
    """Nodes of the trie of sorted, distinct paths; ``common``: turns that each has in common with the one before.

    before, after  turns in common with the paths next to the shard; -1: there is none. Nodes that a
    neighbour may have too get an ``id``, children of these a ``parent_id``; their figures are the
    shard's part.
    """
    depths = np.array([len(k) // _TURN for k in keys])
    common = common.copy()
    common[0] = -1
    opens = depths - common
    closes = np.append(depths[:-1] - common[1:], depths[-1] + 1)
    tree = Parentheses(np.repeat(np.tile([1, 0], len(keys)), np.stack([opens, closes], axis=1).reshape(-1)))
    total = int(opens.sum())
    ends = np.cumsum(opens) - 1

    text = np.zeros(total, np.int64)
    depth = np.empty(total, np.int64)
    parent = np.arange(-1, total - 1)
    path = np.empty(int(depths.max()) + 1, np.int64)
    for i, (low, high, start) in enumerate(zip(common.tolist(), depths.tolist(), (ends - opens + 1).tolist())):
        depth[start : start + high - low] = np.arange(low + 1, high + 1)
        text[start + (low < 0) : start + high - low] = sizes[i][max(low, 0) :]
        if low >= 0:
            parent[start] = path[low]
        path[low + 1 : high + 1] = np.arange(start, start + high - low)

    own = np.ones(total, bool)
    own[: before + 1] = False
    n_ends, end_rep = np.zeros(total, np.int64), np.full(total, _NONE)
    n_ends[ends], end_rep[ends] = ns, reps

    places = tree.opens()
    closed = tree.findclose(places)
    first, last = tree.ranks[places] - 1, tree.ranks[closed] - 1

    def subtree(values: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(values)])
        return sums[last + 1] - sums[first]

    n_convs = subtree(n_ends)
    leaves = tree.leaves[closed] - np.concatenate([[0], tree.leaves])[places]
    if after == depths[-1]:
        # The last path goes on in the next shard: its end is no leaf.
        leaves[path[: after + 1]] -= 1
    saved = subtree(n_convs * text) - subtree(text * own)
    children = np.bincount(parent[1:][own[1:]], minlength=total)
    conv = least(end_rep, first, last)

    ids, parents = np.full(total, None, object), np.full(total, None, object)
    for key, most, nodes in ((keys[0], before, np.arange(before + 1)), (keys[-1], after, path[: after + 1])):
        if most >= 0:
            ids[nodes] = np.array(_ids(key, most) + [None], object)[:-1]
    parents[1:] = ids[parent[1:]]
    parent_conv = np.where(parent >= 0, conv[parent], 0)
    absent = (parent < 0) | np.array([p is not None for p in parents])
    columns = [conv, depth, pa.array(parent_conv, mask=absent), n_convs, children, leaves, saved, n_ends, pa.array(end_rep, mask=n_ends == 0)]
    return pa.Table.from_arrays([pa.array(c) if isinstance(c, np.ndarray) else c for c in columns] + [pa.array(c.tolist(), pa.binary()) for c in (ids, parents)], schema=_SCHEMA)


def _shard(table: pa.Table) -> pa.Table:
    table = table.sort_by("place")
    before, after = (table.column(c).to_numpy() for c in ("before", "after"))
    sizes = [np.array(s, np.int64) for s in table.column("sizes").to_pylist()]
    numbers = [table.column(c).to_numpy() for c in ("n", "rep")]
    return shard_nodes(table.column("key").to_pylist(), *numbers, sizes, before.astype(np.int64), int(before[0]), int(after[-1]))


def _digests(twins: DataFrame) -> DataFrame:
    """Per rep the SHA-256 of all ids of its twins, ascending and joined by commas.

    Ids are joined in cells, and a task reads the cells of a rep in order; it holds one cell.
    """
    cells = twins.groupBy("rep", F.floor(F.col("conv") / CELL).alias("cell"))
    cells = cells.agg(F.array_join(F.array_sort(F.collect_list("conv")).cast("array<string>"), ",").alias("ids"))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rep, state, done = None, None, []
        for batch in batches:
            for own, ids in zip(batch.column("rep").to_pylist(), batch.column("ids").to_pylist()):
                if own != rep:
                    if rep is not None:
                        done.append((rep, state.hexdigest()))
                    rep, state = own, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            yield _rows(done)
            done = []
        yield _rows([(rep, state.hexdigest())] if rep is not None else [])

    def _rows(rows: list[tuple[int, str]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r for r, _ in rows], pa.int64()), pa.array([d for _, d in rows], pa.string())], names=["end_rep", "digest"])

    return cells.repartition("rep").sortWithinPartitions("rep", "cell").mapInArrow(of, "end_rep long, digest string")


def trie(convs: DataFrame, turns: DataFrame) -> DataFrame:
    """Nodes of the trie of conversations given by ids (conv) and turns (conv, depth from 1, role, text; no nulls).

    Returns conv_id (smallest member), depth, parent_conv_id (null at the root), n_convs, n_children, n_leaves,
    saved_tokens (per node of the subtree: members but one, times the bytes of its last text) and ends_sha256 (of the
    ids, ascending and joined by commas, of the members that end here). Conversations without turns are members
    of the root. No conversation: no rows.
    """
    paths, twins = _paths(convs, turns)
    sharded = _sharded(_keyed(paths))
    whole = sharded.join(_borders(sharded), "part").withColumns(
        {"before": F.coalesce("before", "left"), "after": F.coalesce("after", "right")}
    )
    nodes = stored(whole.drop("left", "right", "edge").groupBy("part", "shard").applyInArrow(_shard, _NODES))
    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved", "n_ends")]
    spine = nodes.where("id IS NOT NULL").groupBy("id").agg(F.min("conv").alias("conv"), F.min("depth").alias("depth"), *sums, F.min("end_rep").alias("end_rep"), F.max("parent_id").alias("parent_id"))
    spine = stored(spine)
    figures = ["conv", "depth", "n_convs", "n_children", "n_leaves", "saved", "n_ends", "end_rep", "parent_id"]
    merged = spine.select(*figures, F.lit(None).cast("long").alias("parent_conv")).union(nodes.where("id IS NULL").select(*figures, "parent_conv"))
    below = merged.where("parent_id IS NOT NULL").drop("parent_conv")
    below = below.join(spine.select(F.col("id").alias("parent_id"), F.col("conv").alias("parent_conv")), "parent_id")
    placed = stored(merged.where("parent_id IS NULL").drop("parent_id").unionByName(below.drop("parent_id")))
    single = placed.where("n_ends < 2").withColumn("digest", F.sha2(F.coalesce(F.col("end_rep").cast("string"), F.lit("")), 256))
    many = placed.where("n_ends > 1").join(_digests(twins), "end_rep")
    return single.unionByName(many).select(
        F.col("conv").alias("conv_id"), "depth", F.col("parent_conv").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves",
        F.col("saved").alias("saved_tokens"), F.col("digest").alias("ends_sha256"),
    )


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """The trie of the rebuilt conversations; other columns than conv_id, turn, role and text are not read."""
    return trie(*rebuilt(conversations))
