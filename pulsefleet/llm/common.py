"""Helpers shared by the operators of this subpackage: words of Arrow texts, exact ranks, files, components."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pulsefleet.session import shared_folder

#: Bytes of UTF-8 with A-Z mapped to a-z; bytes of other letters stay as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32

#: ASCII white space: blank and 0x09-0x0D.
SPACES = np.zeros(256, dtype=bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True


@dataclass(frozen=True)
class Words:
    """Words of the texts of one Arrow batch.

    data     the bytes of all words, one after the other
    offsets  word i is data[offsets[i]:offsets[i + 1]]
    first    text d has the words first[d] to first[d + 1] - 1
    """

    data: np.ndarray
    offsets: np.ndarray
    first: np.ndarray

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def array(self) -> pa.Array:
        offsets = pa.py_buffer(np.ascontiguousarray(self.offsets, dtype=np.int64))
        return pa.Array.from_buffers(pa.large_binary(), len(self), [None, offsets, pa.py_buffer(self.data)])

    def encoded(self) -> tuple[pa.Array, np.ndarray]:
        """The distinct words, and each word's place among them."""
        coded = self.array().dictionary_encode()
        return coded.dictionary, coded.indices.to_numpy(zero_copy_only=False)


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts and the offsets of each; null is empty."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    _, offsets, data = texts.buffers()
    ends = np.frombuffer(offsets, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[ends[0] : ends[-1]], ends - ends[0]


def split_words(texts: pa.Array, breaks: np.ndarray, lower: bool = True) -> Words:
    """Words are the longest runs of bytes that are not in ``breaks`` (256 flags)."""
    data, ends = utf8(texts)
    return words_of(LOWER[data] if lower else data, ends, breaks)


def words_of(data: np.ndarray, ends: np.ndarray, breaks: np.ndarray, cuts: np.ndarray | None = None) -> Words:
    """Words of texts given as bytes and offsets; ``cuts`` flags bytes before which a word ends as well."""
    inside = ~breaks[data]
    opens = inside.copy()
    opens[1:] &= ~inside[:-1]
    shuts = inside.copy()
    shuts[:-1] &= ~inside[1:]
    if cuts is not None:
        opens |= cuts & inside
        shuts[:-1] |= (cuts & inside)[1:] & inside[:-1]
    edges = ends[1:-1]
    edges = edges[(edges > 0) & (edges < len(data))]
    opens[edges] = inside[edges]
    shuts[edges - 1] = inside[edges - 1]
    starts, stops = np.flatnonzero(opens), np.flatnonzero(shuts) + 1
    offsets = np.zeros(len(starts) + 1, dtype=np.int64)
    np.cumsum(stops - starts, out=offsets[1:])
    return Words(data[inside], offsets, np.searchsorted(starts, ends))


#: What a worker process keeps between tasks: functions that let it go, by the operator that keeps it.
KEPT: dict[str, Callable[[], None]] = {}


def slices(batch: pa.RecordBatch, column: str, most: int = 4 << 20, keeps: str | None = None):
    """Cut an Arrow batch so that the texts of a piece have ``most`` bytes, or are a single text.

    Workers are used again by later stages: what other operators than ``keeps`` have kept is let go.
    """
    for owner, release in KEPT.items():
        if owner != keeps:
            release()
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    piece = np.cumsum(sizes) // most
    cuts = [0, *(np.flatnonzero(np.diff(piece)) + 1).tolist(), batch.num_rows]
    for low, high in zip(cuts, cuts[1:]):
        if high > low:
            yield batch.slice(low, high - low)
    # Idle workers hand back what the batch has needed.
    pa.default_memory_pool().release_unused()


# -- written tables and files -------------------------------------------------------------------


def stored(df: DataFrame, partition_by: str | None = None, **options: str) -> DataFrame:
    """The frame as a Parquet table in the shared folder: cuts lineage and outlives lost executors."""
    folder = shared_folder(df.sparkSession)
    writer = df.write.options(**options)
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def discard(df: DataFrame) -> None:
    """Delete a frame of ``stored`` whose successor is written. Nothing that is still read may come from it."""
    spark = df.sparkSession
    for folder in {name.rpartition("/")[0] for name in df.inputFiles()}:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files and broadcasts of frames that are gone.

    Its cleaner waits for the driver's collector, which a job of many rounds may not meet for long.
    """
    spark.sparkContext._jvm.System.gc()


def files_folder(spark: SparkSession) -> str:
    """A new folder for files in the shared folder, as a URI that pyarrow's file systems open."""
    folder = shared_folder(spark)
    return folder if "://" in folder or folder.startswith("file:") else f"file://{folder}"


def open_folder(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a URI; ``file:/x`` is Hadoop's way to write ``file:///x``."""
    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri.removeprefix("file:")
    return pafs.FileSystem.from_uri(uri)


def publish(fs: pafs.FileSystem, path: str, write) -> int:
    """Write under a name of this attempt and move it to ``path``: a retried task leaves whole files only."""
    fs.create_dir(path.rpartition("/")[0], recursive=True)
    attempt = f"{path}.{uuid.uuid4().hex}.tmp"
    with fs.open_output_stream(attempt) as out:
        write(out)
        size = out.tell()
    fs.move(attempt, path)
    return size


# -- rows ----------------------------------------------------------------------------------------


def packed(df: DataFrame) -> DataFrame:
    """Columns ``row`` (all columns of df) and ``key``: equal for equal rows only.

    The key is two 64-bit hashes of the row, so that a join finds rows with null or repeated ids, and
    no column of df can clash with a helper.
    """
    whole = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    return df.select(whole.alias("row")).select(
        "row", F.struct(F.xxhash64("row").alias("a"), F.xxhash64(F.lit(1), "row").alias("b")).alias("key")
    )


def counted_before(df: DataFrame, keys: Sequence[str], order: Column, value: Column, name: str, bits: int = 12) -> DataFrame:
    """Add ``name``: the sum of ``value`` over the rows of the same keys that come before.

    order  a long that is spread evenly, such as a hash; ties are in any order

    No key is gathered in one task: rows are summed by key and the top ``bits`` bits of the order, the
    sums of at most 2**bits ranges per key give each range its start, and only a range is sorted.
    """
    cells = [*keys, "__cell"]
    df = df.withColumn("__order", order).withColumn("__value", value)
    df = df.withColumn("__cell", F.shiftright("__order", 64 - bits))
    starts = df.groupBy(*cells).agg(F.sum("__value").alias("__sum"))
    before = Window.partitionBy(*keys).orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = starts.select(
        *[F.col(c).alias(f"__k{i}") for i, c in enumerate(cells)],
        F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__start"),
    )
    same = [F.col(c).eqNullSafe(F.col(f"__k{i}")) for i, c in enumerate(cells)]
    within = Window.partitionBy(*cells).orderBy("__order").rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumn("__within", F.coalesce(F.sum("__value").over(within), F.lit(0)))
    return (
        df.join(starts, same, "left")
        .withColumn(name, F.col("__start") + F.col("__within"))
        .drop("__order", "__value", "__cell", "__within", "__start", *[f"__k{i}" for i in range(len(cells))])
    )


def _is_stars(edges: DataFrame) -> bool:
    """Whether every node of the distinct edges (a, b), b below a, is either one edge's a or only a b."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down"))
    ends = ends.union(edges.select(F.col("b").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    both = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return both.where("up > 1 OR up = 1 AND down = 1").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """Connected components of the edges (a, b): node, root (the smallest node reachable).

    Large-star and small-star rounds in turn until the edges are stars, which a round would leave as they are. A round
    moves edges by joins on one end, where a hub's rows can be split, and keeps one minimum per node.
    """
    spark = edges.sparkSession
    edges = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = stored(edges)
    while not _is_stars(edges):
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        lowest = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(lowest, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        lowest = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (
            large.join(lowest, "a")
            .select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
            .select("e.*")
            .where("a <> b")
            .distinct()
        )
        before, edges = edges, stored(small)
        discard(before)
    release(spark)
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")
