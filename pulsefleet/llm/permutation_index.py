"""Approximate nearest neighbours with a permutation index.

Every vector is represented by the order in which it sees a fixed set of pivots, nearest first. The index
is cut into blocks of vectors; a block holds an inverted file: per pivot the position that each of its
vectors gives to the pivot, and the vectors for reranking. A query adds up, pivot by pivot, how far the
block's positions are from its own (Spearman's footrule), takes the vectors with the least sums, and
reranks them by the inner product in double precision. The best of all blocks are the result.

Pivots are a bounded sample (``pivots`` vectors with the smallest hashes); every vector is indexed. Queries
are dealt in blocks of ``query_rows`` against all index blocks, both of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsefleet.llm.common import stored


#: Queries whose distances are added up together.
AT_ONCE = 16


@dataclass(frozen=True)
class Settings:
    """candidates: least number reranked per block and query; share: or this part of the block, if larger."""

    pivots: int = 128
    block_rows: int = 8192
    query_rows: int = 1024
    candidates: int = 512
    share: float = 0.08
    nearest: int = 20


def usable(vectors: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """vec_id, vec (doubles): without null, zero or non-finite vectors, and of the most common length only."""
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("vec"))
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("vec").isNotNull() & (F.size("vec") > 0))
    rows = rows.where(finite & F.exists("vec", lambda x: x != 0))
    sizes = rows.groupBy(F.size("vec").alias("n")).agg(F.count(F.lit(1)).alias("rows")).orderBy(F.desc("rows"), "n").limit(1)
    return rows.join(F.broadcast(sizes.select("n")), F.size("vec") == F.col("n")).drop("n")


def pivots_of(rows: DataFrame, count: int) -> np.ndarray:
    """The pivots: of the distinct vectors those with the smallest hashes, scaled to length one."""
    picked = rows.select("vec", F.xxhash64("vec").alias("h")).groupBy("h").agg(F.first("vec").alias("vec")).orderBy("h").limit(count)
    found = np.array([row["vec"] for row in picked.select("vec").collect()], dtype=np.float64)
    return found / np.linalg.norm(found, axis=1, keepdims=True) if len(found) else found


def positions(matrix: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Per vector (row) and pivot: its place in the vector's order, nearest first."""
    order = np.argsort(-(matrix @ pivots.T), axis=1, kind="stable")
    out = np.empty(order.shape, dtype=np.int16)
    np.put_along_axis(out, order, np.arange(order.shape[1], dtype=np.int16)[None, :], axis=1)
    return out


def _matrix(cells: pa.Array) -> np.ndarray:
    return cells.flatten().to_numpy(zero_copy_only=False).reshape(len(cells), -1)


def _blocks(rows: DataFrame, number: Column, pivots: np.ndarray, by_pivot: bool) -> DataFrame:
    """A row per block: block, ids, vectors, places (per pivot if ``by_pivot``, else per vector)."""

    def of(key, batches):
        part = pa.Table.from_batches(batches)
        part = part.sort_by("vec_id").combine_chunks()
        ids = part.column("vec_id").to_numpy()
        matrix = np.concatenate([_matrix(c) for c in part.column("vec").chunks])
        places = positions(matrix, pivots)
        cells = [np.ascontiguousarray(x).tobytes() for x in (ids, matrix, places.T if by_pivot else places)]
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int64()), *[pa.array([x], pa.binary()) for x in cells]], names=["block", "ids", "vectors", "places"])

    def whole(key, table):
        return pa.Table.from_batches(of(key, table.to_batches()))

    schema = "block long, ids binary, vectors binary, places binary"
    return rows.select(number.alias("block"), "vec_id", "vec").groupBy("block").applyInArrow(whole, schema)


def _spread(rows: DataFrame, size: int) -> tuple[Column, int]:
    """Block number of a row: an even hash of the id and the vector, so copies are spread as well."""
    blocks = max(1, -(-rows.count() // size))
    return F.pmod(F.xxhash64("vec_id", "vec", F.lit(size)), F.lit(blocks)).cast("long"), blocks


def footrules(inverted: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """Footrule distances (queries x vectors), added up pivot by pivot."""
    pivots, rows = inverted.shape
    total = np.zeros((len(queries), rows), dtype=np.int16 if pivots * pivots < 1 << 15 else np.int32)
    apart = np.empty((len(queries), rows), dtype=np.int16)
    for pivot in range(pivots):
        np.subtract(inverted[pivot][None, :], queries[:, pivot][:, None], out=apart)
        total += np.abs(apart, out=apart)
    return total


def _best(scores: np.ndarray, ids: np.ndarray, count: int) -> np.ndarray:
    """Largest scores first, ties to the smaller id."""
    return np.lexsort((ids, -scores))[:count]


def search(vectors: DataFrame, queries: DataFrame, settings: Settings = Settings(), exact: bool = False) -> DataFrame:
    """Per query its nearest found: query_id, rank, vec_id, score. Both tables have vec_id, vec.

    A query's own row (its vec_id) is no candidate. Fewer candidates than ``nearest``: all of them.
    With ``exact`` every vector is reranked, for measuring recall.
    """
    pivots = pivots_of(vectors, settings.pivots)
    number, blocks = _spread(vectors, settings.block_rows)
    index = stored(_blocks(vectors, number, pivots, True)).withColumnsRenamed({c: f"i_{c}" for c in ("ids", "vectors", "places")})
    number, _ = _spread(queries, settings.query_rows)
    asked = _blocks(queries, number, pivots, False).drop("block")
    asked = stored(asked.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                cell = {c: batch.column(c)[r].as_buffer() for c in batch.schema.names if c != "block"}
                ids, asked_ids = (np.frombuffer(cell[c], np.int64) for c in ("i_ids", "ids"))
                matrix = np.frombuffer(cell["i_vectors"], np.float64).reshape(len(ids), -1)
                wanted = np.frombuffer(cell["vectors"], np.float64).reshape(len(asked_ids), -1)
                inverted = np.frombuffer(cell["i_places"], np.int16).reshape(-1, len(ids))
                own = np.frombuffer(cell["places"], np.int16).reshape(len(asked_ids), -1)
                count = len(ids) if exact else max(settings.candidates, int(settings.share * len(ids)))
                out: list[list[np.ndarray]] = [[], [], []]
                for q, query_id in enumerate(asked_ids):
                    if q % AT_ONCE == 0:
                        apart = footrules(inverted, own[q : q + AT_ONCE])
                    found = np.arange(len(ids)) if count >= len(ids) else np.argpartition(apart[q % AT_ONCE], count)[:count]
                    found = found[ids[found] != query_id]
                    scores = np.einsum("ij,j->i", matrix[found], wanted[q])
                    best = _best(scores, ids[found], settings.nearest)
                    for held, values in zip(out, (np.full(len(best), query_id), ids[found][best], scores[best])):
                        held.append(values)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in out], names=["query_id", "vec_id", "score"])

    schema = "query_id long, vec_id long, score double"
    found = index.join(asked, "block").mapInArrow(of, schema)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= settings.nearest).select("query_id", "rank", "vec_id", "score")


def nearest(embeddings: DataFrame, every: int = 20, settings: Settings = Settings(), exact: bool = False) -> DataFrame:
    """Search of ``embeddings`` (vec_id, embedding) by the rows whose vec_id is divisible by ``every``.

    Null vectors, vectors that are zero, hold null or non-finite components or have another length than
    most, and rows without vec_id take no part. Rows with one vec_id are one vector: the one with the
    largest components in order. Empty tables give no rows. Other columns are not read.
    """
    rows = usable(embeddings, "vec_id", "embedding")
    rows = stored(rows.groupBy("vec_id").agg(F.max("vec").alias("vec")))
    return search(rows, rows.where(F.col("vec_id") % every == 0), settings, exact)
