"""Random forest over many rows: counts of binned features, rows in blocks that tasks read side by side.

The features are binned once (a byte each) and the binned rows are dealt to blocks of bounded size. A task holds one block
and grows some of the trees: per level it counts, for each open node and each feature that the node looks at, the rows in
bag by bin and class. With one block these counts are whole and the task grows its trees to the end by itself. With several,
the counts of a level are added up over the blocks by a shuffle, the best splits go to all tasks, and the next level begins.

The draws of a tree depend on seed, tree and the lot that a row was written in, and the features of a node on seed, tree and
level, so a retry repeats them and the trees are the same however lots are dealt to blocks.

As in Spark's forest: bags are Poisson draws, a node looks at the square root of all features, splits are the best by Gini of
weighted classes, both sides have ``min_leaf`` draws at least, leaves of one parent with the same class are merged, and each
tree votes with the class shares of its leaf.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, StorageLevel, TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsefleet.session import shared_folder

#: Rows of a block at most, about; a task holds one block with a byte per feature.
BLOCK_ROWS = 2_000_000
#: Rows that are written together.
LOT_ROWS = 65_536
#: Bins of a feature, as in Spark's forest, and quantiles among which their bounds are chosen.
BINS, QUANTILES = 32, 1024
#: Rows that are counted at a time, nodes whose splits are searched at a time, and open nodes in a row of counts.
COUNTED_ROWS, SEARCHED_NODES, PART_NODES = 8_192, 128, 256
#: The test of a leaf: all rows go to the left.
LEAF = 255

_POISSON = np.searchsorted(np.cumsum([math.exp(-1.0) / math.factorial(k) for k in range(12)]), (np.arange(1 << 16) + 0.5) / (1 << 16)).astype(np.uint8)


@dataclass(frozen=True)
class Forest:
    """Trees as full heaps: node i has the children 2i and 2i + 1; a row goes right if its bin is ``test`` or more.

    cuts      per feature the upper bounds of the bins but the last
    feature   trees x nodes above the last level (node 0 is not used)
    test      the same shape; ``LEAF`` where all rows go left
    leaves    trees x nodes of the last level x classes: class shares
    """

    features: tuple[str, ...]
    cuts: list[np.ndarray]
    feature: np.ndarray
    test: np.ndarray
    leaves: np.ndarray
    importances: np.ndarray
    sent: dict[str, Broadcast] = field(default_factory=dict, compare=False, repr=False)

    @property
    def trees(self) -> int:
        return len(self.feature)

    @property
    def classes(self) -> int:
        return self.leaves.shape[2]

    def __getstate__(self) -> dict:
        return self.__dict__ | {"sent": {}}

    def votes(self, bins: np.ndarray) -> np.ndarray:
        """Class shares of rows given as bins (rows x features): the mean over all trees."""
        n, width = bins.shape
        flat, at, size = bins.reshape(-1), np.arange(n) * width, self.feature.shape[1]
        out = np.zeros((n, self.classes))
        for feature, test, leaves in zip(self.feature, self.test, self.leaves):
            node = np.ones(n, np.int64)
            for _ in range(size.bit_length() - 1):
                right = flat.take(at + feature.take(node)) >= test.take(node)
                node += node
                node += right
            out += leaves.take(node - size, axis=0)
        return out / self.trees

    def probabilities(self, spark: SparkSession) -> Column:
        """Class shares of the feature columns; the trees are sent once per executor, not with every stage."""
        application = spark.sparkContext.applicationId
        if application not in self.sent:
            self.sent[application] = spark.sparkContext.broadcast(self)
        sent = self.sent[application]

        @F.arrow_udf("array<double>")
        def shares(values: pa.Array) -> pa.Array:
            forest = sent.value
            got = forest.votes(binned(_known(values.flatten()), forest.cuts))
            return pa.ListArray.from_arrays(pa.array(np.arange(len(got) + 1) * forest.classes, pa.int32()), pa.array(got.reshape(-1)))

        return shares(F.struct(*[F.col(name).cast("double") for name in self.features]))

    def table(self) -> pa.Table:
        """A row per tree; with ``meta`` all that ``of_table`` needs."""
        cells = {name: [x.tobytes() for x in getattr(self, name)] for name in ("feature", "test", "leaves")}
        return pa.table({"tree": pa.array(range(self.trees), pa.int32()), **{name: pa.array(x, pa.binary()) for name, x in cells.items()}})

    def meta(self) -> dict:
        return {"features": list(self.features), "cuts": [x.tolist() for x in self.cuts], "importances": self.importances.tolist(), "classes": self.classes}

    @classmethod
    def of_table(cls, table: pa.Table, meta: Mapping) -> "Forest":
        rows = table.sort_by("tree")
        cells = {name: np.stack([np.frombuffer(x, kind) for x in rows.column(name).to_pylist()]) for name, kind in (("feature", np.int16), ("test", np.uint8), ("leaves", np.float32))}
        leaves = cells["leaves"].reshape(len(rows), -1, meta["classes"])
        return cls(tuple(meta["features"]), [np.array(x) for x in meta["cuts"]], cells["feature"], cells["test"], leaves, np.array(meta["importances"]))


def _known(columns: Sequence[pa.Array]) -> list[np.ndarray]:
    """The values; as in Spark's assembler, none may be missing."""
    if any(x.null_count for x in columns):
        raise ValueError("a feature is null")
    values = [x.to_numpy(zero_copy_only=False) for x in columns]
    if any(np.isnan(x).any() for x in values):
        raise ValueError("a feature is NaN")
    return values


def binned(columns: Sequence[np.ndarray], cuts: Sequence[np.ndarray]) -> np.ndarray:
    """Rows x features: the first bin whose upper bound is not below the value."""
    out = np.empty((len(columns[0]), len(columns)), np.uint8)
    for i, (values, bounds) in enumerate(zip(columns, cuts)):
        out[:, i] = np.searchsorted(bounds, values)
    return out


def _bounds_of(values: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Upper bounds of the bins of a feature: all values of a feature with few, else quantiles."""
    order = np.argsort(values, kind="stable")
    reached = np.cumsum(weights[order])
    values = values[order][np.searchsorted(reached, np.arange(QUANTILES) / QUANTILES * reached[-1])]
    distinct = np.unique(values)
    return distinct if len(distinct) < BINS else np.unique(values[QUANTILES // BINS :: QUANTILES // BINS])


def cut_points(rows: DataFrame, features: Sequence[str]) -> list[np.ndarray]:
    """Upper bounds of the bins of each feature, from quantiles of all rows: lots are cut at their own quantiles, whose shares are added up."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[np.ndarray] = []

        def lot() -> pa.RecordBatch:
            values = np.concatenate(waiting, axis=1)
            values.sort(axis=1)
            n = values.shape[1]
            picks = ((np.arange(min(n, QUANTILES)) + 0.5) * n / min(n, QUANTILES)).astype(np.int64)
            cells = [range(len(values)), [n] * len(values), [x.tobytes() for x in values[:, picks]]]
            return pa.RecordBatch.from_arrays([pa.array(v, kind) for v, kind in zip(cells, (pa.int32(), pa.int64(), pa.binary()))], names=["feature", "n", "picks"])

        for batch in batches:
            waiting.append(np.stack(_known(batch.columns)))
            if sum(x.shape[1] for x in waiting) >= LOT_ROWS:
                yield lot()
                waiting.clear()
        if sum(x.shape[1] for x in waiting):
            yield lot()

    def merged(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lots = [(n, np.frombuffer(x.as_buffer())) for batch in batches for n, x in zip(batch.column("n").to_pylist(), batch.column("picks"))]
        bounds = _bounds_of(np.concatenate([x for _, x in lots]), np.concatenate([np.full(len(x), n / len(x)) for n, x in lots]))
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([bounds.tobytes()], pa.binary())], names=["feature", "bounds"])

    values = rows.select(*[F.col(name).cast("double").alias(name) for name in features])
    found = values.mapInArrow(of, "feature int, n long, picks binary").groupBy("feature").applyInArrow(merged, "feature int, bounds binary").toArrow()
    return [np.frombuffer(x) for x in found.sort_by("feature").column("bounds").to_pylist()]


# -- what a task does --------------------------------------------------------------------------


def _draws(seed: int, tree: int, lots: Sequence[tuple[int, int]]) -> np.ndarray:
    """How often a tree draws each row, with 1 as the mean."""
    return np.concatenate([_POISSON[np.random.Generator(np.random.PCG64([seed, tree, lot])).integers(0, 1 << 16, n, np.uint16)] for lot, n in lots])


def _subsets(seed: int, tree: int, level: int, width: int) -> np.ndarray:
    """The features that each node of a level looks at."""
    size = math.ceil(math.sqrt(width))
    lots = np.random.Generator(np.random.PCG64([seed, tree, level, 1])).random((1 << level, width), dtype=np.float32)
    return np.sort(np.argpartition(lots, size - 1, axis=1)[:, :size], axis=1)


def _below(x: np.ndarray, base: np.ndarray, node: np.ndarray, feature: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The children that rows of the nodes go to."""
    return 2 * node + (x.take(base + feature.take(node)) >= bounds.take(node))


def _counts(x: np.ndarray, base: np.ndarray, drawn: np.ndarray, place: np.ndarray, subsets: np.ndarray, classes: int) -> np.ndarray:
    """Draws per open node, feature of its subset, bin and class.

    x      the block's cells, flat: bin times classes plus class
    base   per row where its cells begin; drawn: its draws; place: the number of its open node, ascending
    """
    size = subsets.shape[1]
    cells = size * BINS * classes
    out = np.zeros((len(subsets), cells), np.int32)
    begins = np.arange(size) * (BINS * classes)
    for i in range(0, len(base), COUNTED_ROWS):
        own = place[i : i + COUNTED_ROWS]
        first, last = own[0], own[-1]
        cell = x.take(base[i : i + COUNTED_ROWS, None] + subsets.take(own, axis=0)) + (begins + ((own - first) * cells)[:, None])
        got = np.bincount(cell.reshape(-1), np.repeat(drawn[i : i + COUNTED_ROWS], size), (last - first + 1) * cells)
        out[first : last + 1] += got.reshape(-1, cells).astype(np.int32)
    return out.reshape(len(subsets), size, BINS, classes)


def _share(weighted: np.ndarray) -> np.ndarray:
    """Sum of squares over the sum: what Gini leaves of the weight."""
    total = weighted.sum(axis=-1)
    return np.divide(np.square(weighted).sum(axis=-1), total, out=np.zeros_like(total), where=total > 0)


def best_splits(counts: np.ndarray, subsets: np.ndarray, weights: np.ndarray, min_leaf: int) -> tuple[np.ndarray, ...]:
    """Per node the feature (-1: none), the first bin that goes right, the gain times the node's weight, and the draws by class on the left and right."""
    found = []
    for i in range(0, len(counts), SEARCHED_NODES):
        part = counts[i : i + SEARCHED_NODES]
        left = part.cumsum(axis=2)[:, :, :-1]
        total = part[:, 0].sum(axis=1)
        right = total[:, None, None] - left
        whole = total * weights
        gain = _share(left * weights) + _share(right * weights) - _share(whole)[:, None, None]
        gain[(left.sum(axis=-1) < min_leaf) | (right.sum(axis=-1) < min_leaf)] = -1.0
        nodes = np.arange(len(part))
        best = gain.reshape(len(part), -1).argmax(axis=1)
        slot, cut = best // (BINS - 1), best % (BINS - 1)
        gain = gain[nodes, slot, cut]
        feature = np.where(gain > 1e-12 * whole.sum(axis=-1), subsets[i : i + SEARCHED_NODES][nodes, slot], -1)
        found.append((feature, cut + 1, gain, left[nodes, slot, cut], right[nodes, slot, cut]))
    return tuple(np.concatenate(x) for x in zip(*found))


class Growing:
    """A tree while it grows."""

    def __init__(self, depth: int, classes: int) -> None:
        self.depth = depth
        self.feature, self.test = np.zeros(1 << depth, np.int16), np.full(1 << depth, LEAF, np.uint8)
        self.gain, self.counts = np.zeros(1 << depth), np.zeros((2 << depth, classes), np.int64)
        self.open = np.ones(1, np.int64)

    def split(self, best: tuple[np.ndarray, ...], min_leaf: int) -> None:
        """Split the open nodes; children that can be split themselves are open next."""
        feature, test, gain, left, right = best
        if 1 in self.open:
            self.counts[1] = left[0] + right[0]
        parts = feature >= 0
        nodes = self.open[parts]
        self.feature[nodes], self.test[nodes], self.gain[nodes] = feature[parts], test[parts], gain[parts]
        self.counts[2 * nodes], self.counts[2 * nodes + 1] = left[parts], right[parts]
        children = np.sort(np.concatenate([2 * nodes, 2 * nodes + 1]))
        own = self.counts[children]
        self.open = children[(children < 1 << self.depth) & ((own > 0).sum(axis=1) > 1) & (own.sum(axis=1) >= 2 * min_leaf)]

    def finished(self, weights: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """feature, test, the leaves' class shares, and the gain by feature, with leaves of the same class merged."""
        weighted = self.counts * weights
        chosen = weighted.argmax(axis=1)
        whole = np.ones(2 << self.depth, bool)
        for level in range(self.depth - 1, -1, -1):
            nodes = np.arange(1 << level, 2 << level)
            whole[nodes] = self.test[nodes] == LEAF
            alike = ~whole[nodes] & whole[2 * nodes] & whole[2 * nodes + 1] & (chosen[2 * nodes] == chosen[2 * nodes + 1])
            self.test[nodes[alike]], self.feature[nodes[alike]], self.gain[nodes[alike]] = LEAF, 0, 0.0
            whole[nodes[alike]] = True
        for level in range(self.depth):
            nodes = np.arange(1 << level, 2 << level)
            nodes = nodes[whole[nodes]]
            weighted[2 * nodes] = weighted[2 * nodes + 1] = weighted[nodes]
            whole[2 * nodes] = whole[2 * nodes + 1] = True
        last = weighted[1 << self.depth :]
        total = last.sum(axis=1, keepdims=True)
        leaves = np.divide(last, total, out=np.zeros_like(last), where=total > 0).astype(np.float32)
        return self.feature, self.test, leaves, np.bincount(self.feature, self.gain, width)


@dataclass(frozen=True)
class _Job:
    """What all tasks of a fit know."""

    width: int
    classes: int
    trees: int
    groups: int
    depth: int
    min_leaf: int
    seed: int
    weights: np.ndarray

    def block(self, batches: Iterator[pa.RecordBatch]) -> tuple[np.ndarray, list[tuple[int, int]], range]:
        """The cells of a block, flat, its lots, and the trees to grow."""
        lots, group = {}, 0
        for batch in batches:
            for lot, cells, own in zip(batch.column("lot").to_pylist(), batch.column("cells"), batch.column("group").to_pylist()):
                lots[lot], group = np.frombuffer(cells.as_buffer(), np.uint8), own
        order = sorted(lots)
        x = np.concatenate([lots[lot] for lot in order]) if order else np.zeros(0, np.uint8)
        return x, [(lot, len(lots[lot]) // self.width) for lot in order], range(group, self.trees if order else 0, self.groups)

    def drawn(self, tree: int, lots: Sequence[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
        """Where the cells of the rows in bag begin, and how often each is drawn."""
        draws = _draws(self.seed, tree, lots)
        rows = np.flatnonzero(draws)
        return rows * self.width, draws[rows].astype(np.float64)

    def bounds(self, test: np.ndarray) -> np.ndarray:
        """The tests as the cells of a block have them."""
        return np.where(test == LEAF, LEAF, test * np.uint8(self.classes)).astype(np.uint8)

    def in_order(self, node: np.ndarray, level: int, open_: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rows of open nodes in the order of these, and the number of each one's node."""
        number = np.full(1 << level, -1, np.int32)
        number[open_ - (1 << level)] = np.arange(len(open_))
        place = number.take(node - (1 << level))
        kept = np.flatnonzero(place >= 0)
        place = place[kept]
        order = np.argsort(place.astype(np.uint16), kind="stable")
        return kept[order], place[order]

    def subsets(self, tree: int, level: int, open_: np.ndarray) -> np.ndarray:
        return _subsets(self.seed, tree, level, self.width)[open_ - (1 << level)]

    def grow(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Whole trees of the only block."""
        x, lots, trees = self.block(batches)
        for tree in trees:
            base, drawn = self.drawn(tree, lots)
            node, grown = np.ones(len(base), np.int64), Growing(self.depth, self.classes)
            for level in range(self.depth):
                if not len(grown.open):
                    break
                rows, place = self.in_order(node, level, grown.open)
                base, drawn, node = base[rows], drawn[rows], node[rows]
                subsets = self.subsets(tree, level, grown.open)
                grown.split(best_splits(_counts(x, base, drawn, place, subsets, self.classes), subsets, self.weights, self.min_leaf), self.min_leaf)
                node = _below(x, base, node, grown.feature, self.bounds(grown.test))
            cells = [pa.array([part.tobytes()], pa.binary()) for part in grown.finished(self.weights, self.width)]
            yield pa.RecordBatch.from_arrays([pa.array([tree], pa.int32()), *cells], names=["tree", "feature", "test", "leaves", "gains"])

    def count(self, batches: Iterator[pa.RecordBatch], level: int, sent: Broadcast) -> Iterator[pa.RecordBatch]:
        """The counts of a block for the open nodes of a level."""
        x, lots, trees = self.block(batches)
        for tree in trees:
            feature, test, open_ = sent.value[tree]
            if not len(open_):
                continue
            base, drawn = self.drawn(tree, lots)
            node, bounds = np.ones(len(base), np.int64), self.bounds(test)
            for i in range(0, len(base), COUNTED_ROWS):
                own, at = node[i : i + COUNTED_ROWS], base[i : i + COUNTED_ROWS]
                for _ in range(level):
                    own = _below(x, at, own, feature, bounds)
                node[i : i + COUNTED_ROWS] = own
            rows, place = self.in_order(node, level, open_)
            if not len(rows):
                continue
            counts = _counts(x, base[rows], drawn[rows], place, self.subsets(tree, level, open_), self.classes)
            for part in range(0, len(open_), PART_NODES):
                own = counts[part : part + PART_NODES]
                # In as few bytes as the greatest takes.
                own = own.astype(next(kind for kind in _KINDS if own.max() <= np.iinfo(kind).max))
                cells = [pa.array([v], kind) for v, kind in ((tree, pa.int32()), (part, pa.int32()), (own.tobytes(), pa.binary()))]
                yield pa.RecordBatch.from_arrays(cells, names=["tree", "part", "counts"])

    def merged(self, key: tuple, batches: Iterator[pa.RecordBatch], level: int, sent: Broadcast) -> Iterator[pa.RecordBatch]:
        """The best splits of some nodes of a tree from the counts of all blocks."""
        tree, part = (x.as_py() for x in key)
        subsets = self.subsets(tree, level, sent.value[tree][2])[part : part + PART_NODES]
        total = np.zeros((*subsets.shape, BINS, self.classes), np.int32)
        for batch in batches:
            for cells in batch.column("counts"):
                own = cells.as_buffer()
                total += np.frombuffer(own, next(kind for kind in _KINDS if total.size * np.dtype(kind).itemsize == own.size)).reshape(total.shape)
        best = best_splits(total, subsets, self.weights, self.min_leaf)
        cells = [pa.array([x.astype(kind).tobytes()], pa.binary()) for x, kind in zip(best, _BEST.values())]
        yield pa.RecordBatch.from_arrays([pa.array([tree], pa.int32()), pa.array([part], pa.int32()), *cells], names=["tree", "part", *_BEST])


_KINDS = (np.uint8, np.uint16, np.int32)
_BEST = {"feature": np.int16, "test": np.uint8, "gain": np.float64, "left": np.int64, "right": np.int64}


# -- the fit -----------------------------------------------------------------------------------


def _written(rows: DataFrame, features: Sequence[str], label_id: Column, cuts: list[np.ndarray], classes: int, blocks: int) -> str:
    """Write the binned rows in lots, each in the folder of a block; returns the folder of all."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, waiting = TaskContext.get().partitionId(), 0, []

        def lot() -> pa.RecordBatch:
            cells = [[part << 32 | number], [(part + number) % blocks], [b"".join(waiting)]]
            return pa.RecordBatch.from_arrays([pa.array(v, kind) for v, kind in zip(cells, (pa.int64(), pa.int32(), pa.binary()))], names=["lot", "block", "cells"])

        for batch in batches:
            *columns, label = _known(batch.columns)
            cells = binned(columns, cuts) * np.uint8(classes) + label.astype(np.uint8)[:, None]
            waiting.append(cells.tobytes())
            if sum(map(len, waiting)) >= LOT_ROWS * len(columns):
                yield lot()
                number, waiting = number + 1, []
        if any(waiting):
            yield lot()

    folder = shared_folder(rows.sparkSession)
    values = rows.select(*[F.col(name).cast("double").alias(name) for name in features], label_id.alias("__label"))
    values.mapInArrow(of, "lot long, block int, cells binary").write.partitionBy("block").parquet(folder)
    return folder


def train(rows: DataFrame, features: Sequence[str], label_id: Column, weights: Mapping[int, float], trees: int, depth: int, min_leaf: int, seed: int) -> Forest:
    """A forest of ``rows``; weights: of the classes that occur, by label id (a whole number from 0)."""
    spark = rows.sparkSession
    classes = int(max(weights)) + 1
    if min(weights) < 0 or BINS * classes >= LEAF:
        raise ValueError(f"labels must be 0 to {LEAF // BINS - 1}")
    cuts = cut_points(rows, features)
    blocks = -(-rows.count() // BLOCK_ROWS)
    folder = _written(rows, features, label_id, cuts, classes, blocks)
    # As many groups of trees as fill the slots; each has a task per block.
    groups = min(trees, -(-spark.sparkContext.defaultParallelism // blocks))
    job = _Job(len(features), classes, trees, groups, depth, min_leaf, seed, np.array([weights.get(i, 0.0) for i in range(classes)]))
    lots = spark.read.schema("lot long, cells binary, block int").parquet(folder)
    copies = lots.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    tasks = copies.repartitionById(blocks * groups, F.col("block") * groups + F.col("group")).select("lot", "cells", "group")
    if blocks == 1:
        grown = tasks.mapInArrow(job.grow, "tree int, feature binary, test binary, leaves binary, gains binary").toArrow().sort_by("tree")
        cells = [[np.frombuffer(v, kind) for v in grown.column(name).to_pylist()] for name, kind in (("feature", np.int16), ("test", np.uint8), ("leaves", np.float32), ("gains", np.float64))]
    else:
        tasks = tasks.persist(StorageLevel.DISK_ONLY)
        try:
            cells = [list(x) for x in zip(*[tree.finished(job.weights, job.width) for tree in _by_levels(spark, tasks, job)])]
        finally:
            tasks.unpersist()
    feature, test, leaves, gains = (np.stack(x) for x in cells)
    totals = gains.sum(axis=1, keepdims=True)
    shares = np.divide(gains, totals, out=np.zeros_like(gains), where=totals > 0).sum(axis=0)
    return Forest(tuple(features), cuts, feature, test, leaves.reshape(trees, -1, classes), shares / max(shares.sum(), 1e-300))


def _by_levels(spark: SparkSession, tasks: DataFrame, job: _Job) -> list[Growing]:
    """Trees of rows in several blocks: a level at a time, counts added up over the blocks."""
    forest = [Growing(job.depth, job.classes) for _ in range(job.trees)]

    def steps(level: int, sent: Broadcast):
        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            return job.count(batches, level, sent)

        def merged(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            return job.merged(key, batches, level, sent)

        return count, merged

    for level in range(job.depth):
        if not any(len(tree.open) for tree in forest):
            break
        sent = spark.sparkContext.broadcast([(tree.feature, tree.test, tree.open) for tree in forest])
        count, merged = steps(level, sent)
        counted = tasks.mapInArrow(count, "tree int, part int, counts binary")
        kinds = ", ".join(f"{name} binary" for name in _BEST)
        found = counted.groupBy("tree", "part").applyInArrow(merged, f"tree int, part int, {kinds}").toArrow().sort_by([("tree", "ascending"), ("part", "ascending")])
        parts: dict[int, list[dict]] = {}
        for row in found.to_pylist():
            parts.setdefault(row["tree"], []).append(row)
        for tree, rows in parts.items():
            best = [np.concatenate([np.frombuffer(row[name], kind) for row in rows]) for name, kind in _BEST.items()]
            best[3:] = (x.reshape(-1, job.classes) for x in best[3:])
            forest[tree].split(tuple(best), job.min_leaf)
        sent.destroy()
    return forest
