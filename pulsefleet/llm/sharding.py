"""Sharding by balanced label propagation.

Nodes (documents) belong to groups; nodes of one group are linked. A node's pull to a shard is the number
of its group fellows there, so the links of a group need one count per (group, shard), never its pairs.

A round joins the counts of the groups to their nodes. Each node whose strongest pull is another shard
asks to move there. The requests, at most shards x shards numbers, are granted under capacity quotas:
exchanges between two shards first, as they keep all sizes, then what free room allows. Requests of a
pair are granted in the order of their pull. Rounds end when nothing moves, or when ``STALE`` rounds in turn have
brought no more links inside shards; the best placing so far is the result. Links are finite, so this ends without a bound on rounds.

Shard sizes: the quotas are counts that differ by one at most. Nodes without links feel no pull, so they
take the places that are left at the end, and counts come out exact.
"""

from __future__ import annotations

from collections.abc import Collection

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsefleet.llm.common import counted_before, stored

LEVELS = 32

#: Rounds without more links inside shards after which the propagation has settled.
STALE = 8


def _pulls(nodes: DataFrame, members: DataFrame, shards: int) -> DataFrame:
    """node, shard, order, pulls: per shard the number of fellows in the node's groups, itself included."""
    placed = members.join(nodes.select("node", "shard"), "node")
    per_shard = placed.groupBy("group", "shard").agg(F.count(F.lit(1)).alias("n"))
    counts = per_shard.groupBy("group").agg(F.map_from_entries(F.collect_list(F.struct("shard", "n"))).alias("held"))
    # collect_list holds one entry per shard.
    dense = F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda s: F.coalesce(F.element_at("held", s), F.lit(0)))
    each = members.join(counts.select("group", dense.alias("pulls")), "group")
    summed = F.array(*[F.sum(F.col("pulls")[s]) for s in range(shards)])
    pulls = each.groupBy("node").agg(summed.alias("pulls"), F.min("group").alias("first"))
    return nodes.join(pulls, "node")


def _asks(pulled: DataFrame, shards: int, shut: Collection[int]) -> DataFrame:
    """node, order, shard, own (pull of its shard), want, gain, asks. Nobody asks for the shards in ``shut``.

    Ties go the same way for a whole group, so that fellows don't swap places.
    """
    lowest = F.lit(-(1 << 63)).cast("long")
    options = [
        F.struct(
            F.col("pulls")[s].alias("pull"),
            (lowest if s in shut else F.xxhash64("first", F.lit(s))).alias("tie"),
            F.lit(s).alias("shard"),
        )
        for s in range(shards)
    ]
    open_ = F.array_compact(
        F.array(*[o if s not in shut else F.when(F.col("shard") == s, o) for s, o in enumerate(options)])
    )
    best = F.array_max(open_)
    own = F.element_at("pulls", F.col("shard") + 1)
    gain = best["pull"] - own
    asks = (best["shard"] != F.col("shard")) & (gain >= 0)
    return pulled.select("node", "order", "shard", own.alias("own"), best["shard"].alias("want"), gain.alias("gain"), asks.alias("asks"))


def _grants(asked: np.ndarray, room: np.ndarray) -> np.ndarray:
    """How many requests from shard i to shard j to grant: no shard ends above its room."""
    granted = np.minimum(asked, asked.T)
    left = asked - granted
    room = room.copy()
    for i, j in zip(*np.nonzero(left)):
        step = min(left[i, j], room[j])
        granted[i, j] += step
        room[j] -= step
        room[i] += step
    return granted


def _quotas(total: int, shards: int) -> np.ndarray:
    return np.array([total // shards + (s < total % shards) for s in range(shards)], dtype=np.int64)


def _by_shard(values: np.ndarray, shard: Column) -> Column:
    return F.element_at(F.array(*[F.lit(int(v)) for v in values]), shard + 1)


def propagate(nodes: DataFrame, members: DataFrame, shards: int) -> DataFrame:
    """Assign every node to a shard: node, shard; shard counts differ by one at most.

    nodes    node (unique), order (a long spread evenly; it decides ties)
    members  node, group: one row per membership; equal rows count once
    """
    total = nodes.count()
    quotas = _quotas(total, shards)
    sizes = members.groupBy("group").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("group")
    members = stored(members.join(sizes, "group", "left_semi").distinct())
    linked = nodes.join(members.select("node").distinct(), "node", "left_semi")
    linked = stored(counted_before(linked.select("node", "order"), [], F.col("order"), F.lit(1), "rank"))
    placed = linked.select("node", "order", (F.col("rank") % shards).cast("int").alias("shard"))
    held = np.zeros(shards, dtype=np.int64)
    for row in placed.groupBy("shard").count().collect():
        held[row["shard"]] = row["count"]

    shut: set[int] = set()
    again = True
    most, stale, best = -1, 0, (placed, held.copy())
    while True:
        asks = _asks(stored(_pulls(placed, members, shards)), shards, shut)
        asked = np.zeros((shards, shards), dtype=np.int64)
        inside = 0
        for row in asks.groupBy("shard", "want").agg(F.count_if("asks").alias("n"), F.sum("own").alias("own")).collect():
            asked[row["shard"], row["want"]] = row["n"]
            inside += row["own"]
        if inside > most:
            most, stale, best = inside, 0, (placed, held.copy())
        else:
            stale += 1
            if stale == STALE:
                break
        granted = _grants(asked, quotas - held)
        # Requests to a full shard go to the next best from now on.
        refused = {j for j in range(shards) if held[j] == quotas[j] and (asked - granted)[:, j].any()}
        if granted.any():
            placed = stored(_move(asks, asked, granted, shards))
            held += granted.sum(axis=0) - granted.sum(axis=1)
        elif refused <= shut:
            if not again or not shut:
                break
            shut, again = set(), False
            continue
        shut = shut | refused
    placed, held = best

    # The nodes without links fill the places that are left.
    free = counted_before(nodes.join(linked.select("node"), "node", "left_anti"), [], F.col("order"), F.lit(1), "rank")
    ends = np.cumsum(quotas - held)
    shard = F.lit(0)
    for end in ends[:-1]:
        shard = shard + (F.col("rank") >= int(end)).cast("int")
    return placed.select("node", "shard").union(free.select("node", shard.alias("shard")))


def _move(asks: DataFrame, asked: np.ndarray, granted: np.ndarray, shards: int) -> DataFrame:
    """The nodes with granted moves done; of requests granted in part, those with the largest gain."""
    pair = F.col("shard") * shards + F.col("want")
    part = [int(p) for p in np.flatnonzero((granted < asked) & (granted > 0))]
    whole = [int(p) for p in np.flatnonzero((granted == asked) & (granted > 0))]
    moves = F.col("asks") & pair.isin(whole) if whole else F.lit(False)
    done = asks.select("node", "order", F.when(moves, F.col("want")).otherwise(F.col("shard")).alias("shard"), (F.col("asks") & pair.isin(part) if part else F.lit(False)).alias("ranks"), "want", pair.alias("pair"), "gain")
    if not part:
        return done.select("node", "order", "shard")
    # Levels of gain, then the order: a long whose top bits are the level.
    level = F.least(F.floor(F.log2(F.col("gain") + 1)), F.lit(LEVELS - 1))
    place = F.shiftleft((F.lit(LEVELS - 1) - level).cast("long"), 58) + F.shiftrightunsigned("order", 6)
    ranked = counted_before(done.where("ranks"), ["pair"], place, F.lit(1), "rank")
    limit = _by_shard(granted.reshape(-1), F.col("pair"))
    after = ranked.select("node", "order", F.when(F.col("rank") < limit, F.col("want")).otherwise(F.col("shard")).alias("shard"))
    return done.where("not ranks").select("node", "order", "shard").union(after)


def cut_links(placed: DataFrame, members: DataFrame) -> DataFrame:
    """One row: links (pairs of fellows) and how many of them lie across shards."""
    per = members.join(placed, "node").groupBy("group", "shard").agg(F.count(F.lit(1)).alias("n"))
    groups = per.groupBy("group").agg(F.sum("n").alias("n"), F.sum(F.col("n") * (F.col("n") - 1) / 2).alias("inside"))
    pairs = F.col("n") * (F.col("n") - 1) / 2
    return groups.agg(F.coalesce(F.sum(pairs), F.lit(0.0)).alias("links"), F.coalesce(F.sum(pairs - F.col("inside")), F.lit(0.0)).alias("cut"))


def shard_documents(docs: DataFrame, shards: int) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, size, text_crc32, law, shard, slot, grown_shard.

    Equal texts are linked. The law is ``rows``: shard counts differ by one at most. slot numbers the
    rows of a shard without gaps. A null text counts as an empty one; null doc_ids and repeated rows are
    rows like any other. Other columns are not read. The shards depend on the rows alone, not on their files or order.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        "doc_id",
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.struct(F.xxhash64(text).alias("a"), F.xxhash64(F.lit(1), text).alias("b")).alias("group"),
        F.monotonically_increasing_id().alias("node"),
    )
    rows = stored(rows.withColumn("mark", F.xxhash64("doc_id", "group")))
    # Equal rows are told apart by their number, so that a hot row is spread; which of them has which number is all one.
    repeated = rows.groupBy("mark").count().where("count > 1").select("mark")
    twins = rows.join(repeated, "mark", "left_semi").select("node", "mark")
    numbered = counted_before(twins, ["mark"], F.xxhash64("node"), F.lit(1), "nth").select("node", "nth")
    order = F.xxhash64("mark", F.coalesce("nth", F.lit(0)))
    rows = stored(rows.join(numbered, "node", "left").withColumn("order", order).drop("mark", "nth"))
    placed = propagate(rows.select("node", "order"), rows.select("node", F.xxhash64("group").alias("group")), shards)
    out = counted_before(rows.drop("group").join(stored(placed), "node"), ["shard"], F.col("order"), F.lit(1), "slot")
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", F.col("slot").cast("long"), F.lit(None).cast("int").alias("grown_shard")
    )
