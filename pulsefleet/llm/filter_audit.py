"""Audit of filters that run one after the other: what each removes, alone and in every order.

Each document has a pass or a fail per filter. The documents of a part are counted per combination of fails,
so a part is a contingency tensor with an axis of two (pass, fail) per filter. A step of an order is a choice
per axis: earlier filters pass, the step's filter fails, later filters are summed over; one einsum contracts
the tensors of many parts with the choices of all steps of all orders. Nothing is counted twice, and the work
after the counting does not depend on the number of documents.

Counts are combined before they are shuffled, so a part that holds most documents is no hot group.
"""

from __future__ import annotations

import string
from collections.abc import Iterator, Sequence
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsefleet.llm.common import stored

#: Parts whose tensors are contracted at once.
PARTS = 64

_PASS, _FAIL, _ALL = (1, 0), (0, 1), (1, 1)


def words(text: Column) -> Column:
    """The longest runs without blank and 0x09-0x0D."""
    return F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")


def text_failures(text: Column) -> dict[str, Column]:
    """The filters that look at one text (not null): A short, B repetitive, C upper case, D marks."""
    own = words(text)
    capitals = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]+", ""))
    return {
        "A": F.size(own) < 200,
        "B": 100 * F.size(F.array_distinct(own)) < 50 * F.size(own),
        "C": 100 * capitals > 2 * F.length(text),
        "D": text.rlike("[#$%&*|]"),
    }


def flagged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per document: part, the five fails A to E, quality and toxic (of its labels; 0 without).

    Null text and null source are empty. E fails where a smaller doc_id has the same text (SHA-256); a row
    without doc_id neither fails E nor makes others fail, and has no labels. Rows that share a doc_id are
    documents of their own. Of several labels of a doc_id any 1 counts.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = stored(
        docs.select(
            F.col("doc_id").alias("id"),
            F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"),
            F.sha2(text, 256).alias("digest"),
            *[fail.alias(name) for name, fail in text_failures(text).items()],
        )
    )
    # Only the first document of a text meets this side, so copies of one text are spread by their ids.
    first = rows.groupBy("digest").agg(F.min("id").alias("id")).select("digest", "id", F.lit(True).alias("is_first"))
    known = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("id"))
    known = known.agg(*[F.coalesce(F.max((F.col(c) == 1).cast("int")), F.lit(0)).alias(c) for c in ("quality", "toxic")])
    return (
        rows.join(first, ["digest", "id"], "left")
        .join(known, "id", "left")
        .select(
            "part",
            *"ABCD",
            (F.col("id").isNotNull() & F.col("is_first").isNull()).alias("E"),
            *[F.coalesce(c, F.lit(0)).alias(c) for c in ("quality", "toxic")],
        )
    )


def _choices(orders: Sequence[Sequence[int]], k: int) -> np.ndarray:
    """Per step of each order, then per filter alone, then per filter at all: a choice per axis."""
    rows = [[_PASS if i in order[:step] else _FAIL if i == order[step] else _ALL for i in range(k)] for order in orders for step in range(k)]
    rows += [[_FAIL if i == own else _PASS for i in range(k)] for own in range(k)]
    rows += [[_FAIL if i == own else _ALL for i in range(k)] for own in range(k)]
    return np.array(rows, dtype=np.int64)


def contracted(tensors: np.ndarray, choices: np.ndarray) -> np.ndarray:
    """The tensors (any leading axes, then an axis of two per filter) summed as each choice says; the last axis is the choice."""
    k = choices.shape[1]
    axes = string.ascii_lowercase[:k]
    return np.einsum(f"...{axes},{','.join('z' + a for a in axes)}->...z", tensors, *choices.transpose(1, 0, 2), optimize=True)


def audit(
    rows: DataFrame, part: str, fails: Sequence[str], weights: Sequence[str] = (), orders: Sequence[str] | None = None
) -> DataFrame:
    """Per part, order and step: how the filters interact.

    rows     a row per document: ``part`` (string), a boolean per name in ``fails`` (one letter each; null is
             a pass), a number of 0 or 1 per name in ``weights`` (null is 0)
    orders   orders of the filters to audit; all permutations if None

    Returns part, filter_order, step (from 1), kept (documents after the step), removed (here), redundant (fail
    here, removed earlier), unique_fails (fail this filter only), ``lost_<weight>`` (documents of that weight
    removed here), shapley (removed by the step's filter, summed over all orders). A part is there if it has a
    document, zeros included; an empty table gives no row.
    """
    names, k = list(fails), len(fails)
    listed = list(orders) if orders is not None else ["".join(p) for p in permutations(names)]
    places = np.array([[names.index(c) for c in order] for order in listed], dtype=np.int64).reshape(len(listed), k)
    choices = _choices(places.tolist(), k)
    measures = ["n", *weights]

    mask = sum((F.coalesce(F.col(c), F.lit(False)).cast("int") * (1 << (k - 1 - i)) for i, c in enumerate(names)), F.lit(0))
    counts = rows.groupBy(F.col(part).alias("part"), mask.alias("mask")).agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(F.coalesce(F.col(w).cast("long"), F.lit(0))).alias(w) for w in weights]
    )
    # At most 2^k cells per part.
    cells = counts.groupBy("part").agg(F.collect_list(F.struct("mask", *measures)).alias("cells"))

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        steps = len(listed) * k
        own = places.reshape(-1)
        for batch in batches:
            for low in range(0, batch.num_rows, PARTS):
                piece = batch.slice(low, PARTS)
                table = np.zeros((piece.num_rows, len(measures), 1 << k), dtype=np.int64)
                lists = piece.column("cells")
                at = np.repeat(np.arange(piece.num_rows), lists.value_lengths().to_numpy())
                values = lists.flatten()
                for m, name in enumerate(measures):
                    table[at, m, values.field("mask").to_numpy()] = values.field(name).to_numpy()
                sums = contracted(table.reshape(piece.num_rows, len(measures), *(2,) * k), choices)
                removed, alone, failed = sums[:, 0, :steps], sums[:, 0, steps : steps + k], sums[:, 0, steps + k :]
                total = table[:, 0].sum(axis=1)
                kept = total[:, None] - np.cumsum(removed.reshape(-1, len(listed), k), axis=2).reshape(len(table), steps)
                shapley = np.stack([removed[:, own == i].sum(axis=1) for i in range(k)], axis=1)
                n = len(table)
                columns = {
                    "part": piece.column("part").take(pa.array(np.repeat(np.arange(n), steps))),
                    "filter_order": pa.array(np.tile(np.repeat(np.array(listed, dtype=object), k), n), pa.string()),
                    "step": pa.array(np.tile(np.tile(np.arange(1, k + 1, dtype=np.int32), len(listed)), n)),
                    "kept": pa.array(kept.reshape(-1)),
                    "removed": pa.array(removed.reshape(-1)),
                    "redundant": pa.array((failed[:, own] - removed).reshape(-1)),
                    "unique_fails": pa.array(alone[:, own].reshape(-1)),
                    **{f"lost_{w}": pa.array(sums[:, 1 + i, :steps].reshape(-1)) for i, w in enumerate(weights)},
                    "shapley": pa.array(shapley[:, own].reshape(-1)),
                }
                yield pa.RecordBatch.from_pydict(columns)

    lost = "".join(f", lost_{w} long" for w in weights)
    schema = f"part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long{lost}, shapley long"
    return cells.mapInArrow(step, schema)
