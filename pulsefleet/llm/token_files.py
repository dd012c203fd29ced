"""Token-id files coded by a static range asymmetric numeral system.

Writing: texts become ids once, in a written table, with a histogram of ids per task. The histograms
of all tasks add up to one shared frequency table (its size is that of the vocabulary). Documents are
then dealt into ranges of ascending doc_id; a task codes its range into files of about ``file_tokens``
ids. Reading: one row per file of the manifest; a task opens a file and decodes all stretches between
its checkpoints at once, or any single one.

A file holds, little-endian: magic, sizes, the directory of documents (id, number of ids), and per block
its number of ids, CRC-32 of the ids, lane states and stream positions of the checkpoints, and the words.

Beside the files their folder holds the frequency table (``TABLE``) and, written last, the manifest
(``MANIFEST``, Parquet): ``opened`` needs nothing but the folder.
"""

from __future__ import annotations

import io
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pulsefleet.llm import rans
from pulsefleet.llm.common import files_folder, open_folder, publish, slices, stored
from pulsefleet.llm.tokenizer import tokenizer

MAGIC = b"PFTOKEN1"
TABLE, MANIFEST = "table.frequencies", "manifest"
_TABLE_HEAD = struct.Struct("<8sII")  # magic, bits, symbols
_HEAD = struct.Struct("<8sIIIIQ")  # magic, lanes, steps between checkpoints, documents, blocks, ids


@dataclass(frozen=True)
class Layout:
    """Sizes of the format: ids per block, lanes of a block, steps between checkpoints, ids per file."""

    block: int = 1 << 16
    lanes: int = 256
    every: int = 128
    file_tokens: int = 1 << 22
    at_once: int = 16  # blocks coded together; bounds a task's memory


# -- one file ------------------------------------------------------------------------------------


def file_bytes(ids: np.ndarray, doc_ids: list[int | None], sizes: np.ndarray, table: rans.Frequencies, layout: Layout) -> bytes:
    """The file of documents with these ids, one after the other."""
    lanes, full = layout.lanes, len(ids) // layout.block
    blocks: list[rans.Block] = []
    for low in range(0, full, layout.at_once):
        part = ids[low * layout.block : min(low + layout.at_once, full) * layout.block]
        blocks += rans.encode(part.reshape(-1, layout.block), table, lanes, layout.every)
    rest = ids[full * layout.block :]
    if len(rest):
        padded = np.pad(rest, (0, -len(rest) % lanes), mode="edge")
        blocks += rans.encode(padded[None], table, lanes, layout.every)
    out = io.BytesIO()
    out.write(_HEAD.pack(MAGIC, lanes, layout.every, len(sizes), len(blocks), len(ids)))
    out.write(np.array([d is not None for d in doc_ids], np.uint8).tobytes())
    out.write(np.array([d or 0 for d in doc_ids], "<i8").tobytes())
    out.write(sizes.astype("<i8").tobytes())
    for i, block in enumerate(blocks):
        own = ids[i * layout.block : (i + 1) * layout.block]
        out.write(struct.pack("<IIIII", len(own), block.size, len(block.places), len(block.words), zlib.crc32(own.astype("<u4").tobytes())))
        for part, kind in ((block.places, "<u4"), (block.states, "<u8"), (block.words, "<u4")):
            out.write(part.astype(kind).tobytes())
    return out.getvalue()


@dataclass(frozen=True)
class _Coded:
    size: int
    padded: int
    crc: int
    block: rans.Block


class TokenFile:
    """A file's directory and blocks."""

    def __init__(self, data: bytes) -> None:
        magic, self.lanes, self.every, docs, blocks, self.tokens = _HEAD.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("not a token file")
        place = _HEAD.size

        def take(kind: str, count: int) -> np.ndarray:
            nonlocal place
            got = np.frombuffer(data, kind, count, place)
            place += got.nbytes
            return got

        known, ids = take("u1", docs), take("<i8", docs)
        self.doc_ids = [int(i) if k else None for k, i in zip(known, ids)]
        self.sizes = take("<i8", docs)
        self.blocks: list[_Coded] = []
        for _ in range(blocks):
            size, padded, marks, words, crc = take("<u4", 5).tolist()
            places = take("<u4", marks)
            states = take("<u8", marks * self.lanes).reshape(marks, self.lanes)
            self.blocks.append(_Coded(size, padded, crc, rans.Block(padded, take("<u4", words), states, places)))

    def stretch(self, block: int, mark: int, table: rans.Frequencies) -> np.ndarray:
        """The ids from one checkpoint of a block to the next."""
        coded = self.blocks[block].block
        steps = min(self.every, coded.size // self.lanes - mark * self.every)
        got = rans.decode(coded.words, coded.places[mark : mark + 1], coded.states[mark : mark + 1], steps, table)[0]
        return got[: self.blocks[block].size - mark * self.every * self.lanes]

    def ids(self, table: rans.Frequencies, at_once: int = 64) -> np.ndarray:
        """All ids; stretches of equal length are decoded together and each block's CRC is checked."""
        groups: dict[int, list[tuple[int, int]]] = {}
        for b, coded in enumerate(self.blocks):
            for mark in range(len(coded.block.places)):
                steps = min(self.every, coded.padded // self.lanes - mark * self.every)
                groups.setdefault(steps, []).append((b, mark))
        starts = np.concatenate([[0], np.cumsum([c.padded for c in self.blocks])]).astype(np.int64)
        out = np.empty(int(starts[-1]), dtype=np.uint32)
        for steps, members in groups.items():
            for low in range(0, len(members), at_once):
                part = members[low : low + at_once]
                own = sorted({b for b, _ in part})
                offset = dict(zip(own, np.cumsum([0, *(len(self.blocks[b].block.words) for b in own)]).tolist()))
                got = rans.decode(
                    np.concatenate([self.blocks[b].block.words for b in own]),
                    np.array([offset[b] + int(self.blocks[b].block.places[m]) for b, m in part]),
                    np.stack([self.blocks[b].block.states[m] for b, m in part]),
                    steps,
                    table,
                )
                for (b, m), row in zip(part, got):
                    begin = starts[b] + m * self.every * self.lanes
                    out[begin : begin + len(row)] = row
        keep = [out[starts[b] : starts[b] + c.size] for b, c in enumerate(self.blocks)]
        for coded, own in zip(self.blocks, keep):
            if zlib.crc32(own.astype("<u4").tobytes()) != coded.crc:
                raise ValueError("a block's checksum differs")
        return np.concatenate(keep) if keep else out


# -- Spark ---------------------------------------------------------------------------------------


def tokenized(docs: DataFrame, path: str, end_id: int) -> DataFrame:
    """Written rows: per document doc_id, tie, n_tokens, ids; per task a row with its histogram (hist true).

    tie orders documents of one doc_id. Ids are held in 16 bits where the vocabulary allows it.
    """
    docs = docs.select("doc_id", F.xxhash64("text").alias("tie"), "text")
    schema = "doc_id long, tie long, n_tokens long, ids binary, hist boolean"
    names = ["doc_id", "tie", "n_tokens", "ids", "hist"]

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = tokenizer(path)
        size = max(coder.tokenizer.get_vocab_size(), end_id + 1)
        kind, counts = np.dtype("<u2" if size <= 1 << 16 else "<u4"), np.zeros(size, dtype=np.int64)
        for batch in batches:
            for piece in slices(batch, "text", keeps="tokenizer"):
                ids, ends = coder.encode(piece.column("text"))
                sizes = np.diff(ends)
                whole = np.full(len(ids) + len(sizes), end_id, dtype=np.uint32)
                whole[np.arange(len(ids)) + np.repeat(np.arange(len(sizes)), sizes)] = ids
                counts += np.bincount(whole, minlength=size)
                offsets = ((ends + np.arange(len(ends))) * kind.itemsize).astype(np.int32)
                rows = pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(whole.astype(kind))])
                flags = pa.array(np.zeros(len(sizes), bool))
                yield pa.RecordBatch.from_arrays([piece.column(0), piece.column(1), pa.array(sizes + 1), rows, flags], names=names)
        if counts.any():
            last = [pa.array([None], pa.int64()), pa.array([None], pa.int64()), pa.array([int(counts.sum())]), pa.array([counts.astype("<i8").tobytes()]), pa.array([True])]
            yield pa.RecordBatch.from_arrays(last, names=names)

    return stored(docs.mapInArrow(of, schema), partition_by="hist", compression="zstd")


def shared_table(rows: DataFrame) -> tuple[rans.Frequencies, int]:
    """The frequency table of all ids, and their number. Only (id, count) pairs of the vocabulary are collected."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, dtype=np.int64)
        for batch in batches:
            for cell in batch.column(0):
                own = np.frombuffer(cell.as_buffer(), "<i8")
                total = np.pad(total, (0, max(0, len(own) - len(total))))
                total[: len(own)] += own
        met = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(total[met])], names=["id", "n"])

    pairs = rows.where("hist").select("ids").mapInArrow(counted, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    got = pairs.toArrow()
    counts = got.column("n").to_numpy()
    return rans.Frequencies.of(got.column("id").to_numpy(), counts), int(counts.sum())


@dataclass(frozen=True)
class TokenSet:
    """Written files: the manifest (range, nth, path, n_docs, n_tokens, bytes, start) and the shared table."""

    folder: str
    manifest: DataFrame
    table: rans.Frequencies


def _uri(folder: str) -> str:
    return f"file://{folder}" if folder.startswith("/") else folder


def _claimed(folder: str) -> None:
    """Stop if the folder holds anything: files of two writes would mix."""
    fs, base = open_folder(folder)
    if fs.get_file_info(pafs.FileSelector(base, allow_not_found=True)):
        raise FileExistsError(f"{folder} is not empty")


def _write_table(folder: str, table: rans.Frequencies) -> None:
    fs, base = open_folder(folder)
    data = _TABLE_HEAD.pack(MAGIC, table.bits, len(table.symbols)) + table.symbols.astype("<u4").tobytes() + table.shares.astype("<u4").tobytes()
    publish(fs, f"{base}/{TABLE}", lambda out: out.write(data))


def opened(spark: SparkSession, folder: str) -> TokenSet:
    """The written files of a folder, in any session: table and manifest are read from it."""
    folder = _uri(folder)
    fs, base = open_folder(folder)
    with fs.open_input_file(f"{base}/{TABLE}") as source:
        data = source.read()
    magic, bits, size = _TABLE_HEAD.unpack_from(data)
    if magic != MAGIC:
        raise ValueError("not a table of token files")
    symbols, shares = np.frombuffer(data, "<u4", 2 * size, _TABLE_HEAD.size).astype(np.uint32).reshape(2, size)
    return TokenSet(folder, spark.read.parquet(f"{folder}/{MANIFEST}"), rans.Frequencies(bits, symbols, shares))


def write(docs: DataFrame, path: str, end_id: int, layout: Layout = Layout(), folder: str | None = None) -> TokenSet:
    """Write the ids of ``docs`` (doc_id, text) in ascending doc_id order; nulls come first, null texts are empty.

    folder  an empty or new folder that all executors share, as a path or URI; it stays when the application
            ends. None: a folder that is gone with the application.
    """
    spark = docs.sparkSession
    if folder is not None:
        folder = _uri(folder)
        _claimed(folder)
    rows = tokenized(docs, path, end_id)
    table, total = shared_table(rows)
    folder = folder or files_folder(spark)
    ranges = max(1, -(-total // layout.file_tokens))

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        fs, base = open_folder(folder)
        here, nth = TaskContext.get().partitionId(), 0
        held: list[np.ndarray] = []
        doc_ids: list[int | None] = []

        def close() -> pa.RecordBatch:
            nonlocal nth, held, doc_ids
            sizes = np.array([len(x) for x in held], dtype=np.int64)
            ids = np.concatenate(held).astype(np.uint32)
            name = f"{base}/{here:06d}-{nth:05d}.tokens"
            size = publish(fs, name, lambda out: out.write(file_bytes(ids, doc_ids, sizes, table, layout)))
            row = [here, nth, f"{here:06d}-{nth:05d}.tokens", len(sizes), len(ids), size]
            nth, held, doc_ids = nth + 1, [], []
            return pa.RecordBatch.from_arrays([pa.array([x]) for x in row], names=["range", "nth", "file", "n_docs", "n_tokens", "bytes"])

        filled = 0
        for batch in batches:
            for doc_id, cell, size in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
                data = cell.as_buffer()
                held.append(np.frombuffer(data, "<u2" if data.size == 2 * size else "<u4"))
                doc_ids.append(doc_id)
                filled += size
                if filled >= layout.file_tokens:
                    yield close()
                    filled = 0
        if held:
            yield close()

    ordered = rows.where("not hist").select("doc_id", "tie", "ids", "n_tokens").repartitionByRange(ranges, "doc_id", "tie")
    ordered = ordered.sortWithinPartitions("doc_id", "tie").select("doc_id", "ids", "n_tokens")
    files = stored(ordered.mapInArrow(coded, "range long, nth long, file string, n_docs long, n_tokens long, bytes long"))
    # Starts: the sums of the ranges (one row per range), then of the files inside a range.
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    of_range = files.groupBy("range").agg(F.sum("n_tokens").alias("n")).select("range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("range_start"))
    inside = Window.partitionBy("range").orderBy("nth").rowsBetween(Window.unboundedPreceding, -1)
    manifest = files.withColumn("inside", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))).join(of_range, "range")
    manifest = manifest.withColumn("start", F.col("range_start") + F.col("inside")).drop("range_start", "inside")
    _write_table(folder, table)
    manifest.write.parquet(f"{folder}/{MANIFEST}")
    return opened(spark, folder)


def read(tokens: TokenSet, with_ids: bool = True) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens, ids_crc32, and ids (little-endian 32-bit)."""
    folder, table = tokens.folder, tokens.table

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = open_folder(folder)
        for batch in batches:
            for name, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with fs.open_input_file(f"{base}/{name}") as source:
                    file = TokenFile(source.read())
                flat = memoryview(file.ids(table).astype("<u4").tobytes())
                ends = np.concatenate([[0], np.cumsum(file.sizes)]).astype(np.int64)
                own = [flat[4 * a : 4 * b] for a, b in zip(ends.tolist(), ends[1:].tolist())]
                columns = {
                    "doc_id": pa.array(file.doc_ids, pa.int64()),
                    "start": pa.array(start + ends[:-1]),
                    "n_tokens": pa.array(file.sizes),
                    "ids_crc32": pa.array([zlib.crc32(x) for x in own], pa.int64()),
                }
                if with_ids:
                    columns["ids"] = pa.array([bytes(x) for x in own], pa.binary())
                yield pa.RecordBatch.from_pydict(columns)

    # One task per file: a file is the unit of work, whatever the size of its manifest row.
    spread = tokens.manifest.select("file", "start").repartition(max(1, tokens.manifest.count()))
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids
    return spread.mapInArrow(decoded, schema)


def encoded_and_read(docs: DataFrame, path: str, end_id: int, layout: Layout = Layout(), folder: str | None = None) -> DataFrame:
    """Write the files of ``docs`` (to ``folder``, as ``write`` does) and read them back: doc_id, start, n_tokens, ids_crc32.

    A null or empty text has the end id only. Rows of one doc_id (repeated rows too) are coded each, in
    the order of a hash of the text. No rows: no files, no result rows. Other columns are not read.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return read(write(docs, path, end_id, layout, folder), with_ids=False)
