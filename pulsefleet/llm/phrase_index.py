"""Benchmark decontamination with a distributed positional inverted index of the training texts.

The index is split by documents: a row is one block of whole documents (about ``block_words`` words) with
its own sorted term dictionary and, per term, the ascending word positions as variable-length gaps. It
holds every word of every text and can be searched by any number of test sets.

A search looks up a window's terms in each block, takes the list of the rarest one, moves it by the
term's place in the window, and keeps the starts that the next rarer lists, moved likewise, confirm.
With ``slack`` a term may stand up to that many words from its place (proximity); 0 asks for the exact
phrase. Postings of a term are decoded only when a search reaches them. No postings are shuffled.

The windows of the test set are a table in the shared folder, in parts of bounded size. A task reads them from there, one
part after the other, so that neither the driver nor a worker ever holds the test set, however large it is.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsefleet.llm.common import open_folder, packed, slices, split_words, stored

WINDOW = 10

#: Bytes that end a word: 0x00-0x2F, 0x3A-0x60, 0x7B-0x7F (texts are in lower case by then).
WORD_BREAKS = np.zeros(256, dtype=bool)
WORD_BREAKS[[*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = True

#: Windows of one part of the test set: a task holds one part of it at a time.
PART_WINDOWS = 1 << 16

#: Blocks that a task searches before it goes on to the next part.
AT_ONCE = 8


# -- variable-length integers --------------------------------------------------------------------


def pack_gaps(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Seven bits a byte, the last byte of a value marked; and the number of bytes of each value."""
    size = 1 + sum((values >= (1 << (7 * k))).astype(np.int64) for k in range(1, 6))
    ends = np.cumsum(size)
    out = np.empty(int(ends[-1]) if len(ends) else 0, dtype=np.uint8)
    for k in range(6):
        has = size > k
        out[ends[has] - 1 - k] = (values[has] >> (7 * k)) & 0x7F
    out[ends - 1] |= 0x80
    return out, size


def unpack_gaps(data: np.ndarray) -> np.ndarray:
    last = np.flatnonzero(data & 0x80)
    size = np.diff(last, prepend=-1)
    values = (data[last] & 0x7F).astype(np.int64)
    for k in range(1, int(size.max()) if len(size) else 0):
        has = size > k
        values[has] |= data[last[has] - k].astype(np.int64) << (7 * k)
    return values


# -- blocks --------------------------------------------------------------------------------------

_PARTS = ("first", "terms", "term_ends", "counts", "list_ends", "gaps")


def _block(texts: pa.Array) -> dict[str, bytes]:
    """Term dictionary and postings of the texts; first[d] is the position of text d's first word."""
    words = split_words(texts, WORD_BREAKS)
    distinct, codes = words.encoded()
    order = pc.array_sort_indices(distinct).to_numpy()
    rank = np.empty(len(order), dtype=np.int64)
    rank[order] = np.arange(len(order))
    terms = distinct.take(pa.array(order))
    # Postings in the order of terms, then positions.
    cells = np.sort((rank[codes] << 32) | np.arange(len(codes)))
    term, position = cells >> 32, cells & 0xFFFFFFFF
    counts = np.bincount(term, minlength=len(terms))
    gaps = np.diff(position, prepend=0)
    heads = (np.cumsum(counts) - counts)[counts > 0]
    gaps[heads] = position[heads]
    data, size = pack_gaps(gaps)
    bytes_to = np.concatenate([[0], np.cumsum(size)])
    raw = terms.to_pylist()
    return {
        "first": words.first.astype("<i8").tobytes(),
        "terms": b"".join(raw),
        "term_ends": np.cumsum([0, *map(len, raw)]).astype("<i8").tobytes(),
        "counts": counts.astype("<i8").tobytes(),
        "list_ends": bytes_to[np.concatenate([[0], np.cumsum(counts)])].astype("<i8").tobytes(),
        "gaps": data.tobytes(),
    }


def build(docs: DataFrame, key: str, text: str, block_words: int = 1 << 21) -> DataFrame:
    """The written index of all rows of ``docs``: one row per block, with the keys of its documents."""
    docs = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind = docs.schema["key"].dataType.simpleString()
    # A word and its break take two bytes at least, so a block of these bytes keeps the bound on words.
    most = 2 * block_words

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, "text", most):
                parts = _block(piece.column("text"))
                keys = piece.column("key")
                held = pa.ListArray.from_arrays(pa.array([0, len(keys)], pa.int32()), keys)
                yield pa.RecordBatch.from_arrays([held, *[pa.array([parts[p]], pa.binary()) for p in _PARTS]], names=["keys", *_PARTS])

    blocks = docs.mapInArrow(of, f"keys array<{kind}>, " + ", ".join(f"{p} binary" for p in _PARTS))
    return stored(blocks, **{"parquet.block.size": str(16 << 20)})


@dataclass
class Block:
    """A block opened for searches."""

    first: np.ndarray
    terms: pa.Array
    counts: np.ndarray
    list_ends: np.ndarray
    gaps: np.ndarray
    opened: dict[int, np.ndarray] = field(default_factory=dict)

    @classmethod
    def of(cls, row: dict[str, pa.Buffer]) -> "Block":
        ends = np.frombuffer(row["term_ends"], "<i8")
        terms = pa.Array.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(ends), row["terms"]])
        first, counts, lists = (np.frombuffer(row[p], "<i8") for p in ("first", "counts", "list_ends"))
        return cls(first, terms, counts, lists, np.frombuffer(row["gaps"], np.uint8))

    def places(self, terms: pa.Array) -> np.ndarray:
        """Each term's place in the dictionary, -1 where it is absent."""
        return pc.fill_null(pc.index_in(terms, value_set=self.terms), -1).to_numpy(zero_copy_only=False)

    def postings(self, place: int) -> np.ndarray:
        got = self.opened.get(place)
        if got is None:
            got = np.cumsum(unpack_gaps(self.gaps[self.list_ends[place] : self.list_ends[place + 1]]))
            self.opened[place] = got
        return got

    def starts(self, places: np.ndarray, slack: int = 0) -> np.ndarray:
        """Positions at which the window of these terms begins, inside one document."""
        order = np.argsort(self.counts[places], kind="stable")
        found = self.postings(int(places[order[0]])) - order[0]
        for offset in order[1:]:
            if not len(found):
                break
            listed = self.postings(int(places[offset]))
            nearest = np.searchsorted(listed, found + offset - slack)
            inside = nearest < len(listed)
            found, nearest = found[inside], nearest[inside]
            found = found[listed[nearest] <= found + offset + slack]
        found = found[(found >= 0) & (found + len(places) <= self.first[-1])]
        same = np.searchsorted(self.first, found, "right") == np.searchsorted(self.first, found + len(places) - 1, "right")
        return found[same]


# -- test items ----------------------------------------------------------------------------------


@dataclass(frozen=True)
class Windows:
    """Distinct windows of some test items: their terms, the windows as places of terms, and whose they are."""

    terms: pa.Array
    windows: list[np.ndarray]  # by length: one row per window
    owners: list[list[list[str]]]  # by length: item ids of each window

    @classmethod
    def of(cls, rows: pa.Table) -> "Windows":
        places: dict[str, int] = {}
        owners: dict[tuple[int, ...], list[str]] = {}
        for words, item in zip(rows.column("words").to_pylist(), rows.column("item").to_pylist()):
            owners.setdefault(tuple(places.setdefault(w, len(places)) for w in words.split(" ")), []).append(item)
        grouped = [[w for w in owners if len(w) == n] for n in sorted({len(w) for w in owners})]
        return cls(
            pa.array([w.encode() for w in places], pa.large_binary()),
            [np.array(group, dtype=np.int64) for group in grouped],
            [[owners[w] for w in group] for group in grouped],
        )


def windows_of(benchmark: DataFrame, item_id: str, text: str, size: int = WINDOW) -> DataFrame:
    """words (joined by a space), item: windows of ``size`` words; an item of fewer, but not none, is one window.

    Written in files of at most ``PART_WINDOWS`` distinct rows, the parts of a search.
    """

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, "text"):
                words = split_words(piece.column("text"), WORD_BREAKS)
                distinct, codes = words.encoded()
                terms = [t.decode() for t in distinct.to_pylist()]
                for item, low, high in zip(piece.column("item").to_pylist(), words.first.tolist(), words.first[1:].tolist()):
                    starts = range(low, max(low + 1, high - size + 1)) if high > low else ()
                    for few in range(0, len(starts), PART_WINDOWS):
                        made = [" ".join(terms[c] for c in codes[at : min(at + size, high)]) for at in starts[few : few + PART_WINDOWS]]
                        yield pa.RecordBatch.from_arrays([pa.array(made, pa.string()), pa.array([item] * len(made), pa.string())], names=["words", "item"])

    items = benchmark.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("item"), F.col(text).alias("text"))
    rows = items.mapInArrow(of, "words string, item string").distinct()
    return stored(rows, maxRecordsPerFile=str(PART_WINDOWS))


# -- search --------------------------------------------------------------------------------------


def search(index: DataFrame, benchmark: DataFrame, item_id: str = "item_id", text: str = "text", size: int = WINDOW, slack: int = 0) -> DataFrame:
    """Per indexed document: key, n_words, n_hit, items (sorted ids, as strings), spans of hit words.

    n_hit counts the words inside any found window; with ``slack`` a window covers as many words as it
    has terms. spans are [from, to) word numbers in the document, merged. Items with null or wordless
    text have no window; a null item id stands as the empty string; rows with one id are one item.
    """
    parts = windows_of(benchmark, item_id, text, size).inputFiles()
    key = index.schema["keys"].dataType.elementType.simpleString()
    names = ["key", "n_words", "n_hit", "items", "spans"]

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Windows] = {}
        for batch in batches:
            for low in range(0, batch.num_rows, AT_ONCE):
                few = batch.slice(low, AT_ONCE)
                blocks = [Block.of({p: few.column(p)[r].as_buffer() for p in _PARTS}) for r in range(few.num_rows)]
                edges = [np.zeros(int(block.first[-1]) + 1, dtype=np.int32) for block in blocks]
                hits: list[dict[int, set[str]]] = [{} for _ in blocks]
                for part in parts:
                    windows = _opened(part, held)
                    for r, block in enumerate(blocks):
                        _mark(block, windows, slack, edges[r], hits[r])
                        block.opened.clear()
                for r, block in enumerate(blocks):
                    yield pa.RecordBatch.from_arrays([few.column("keys")[r].values, *_found(block, edges[r], hits[r])], names=names)

    schema = f"key {key}, n_words long, n_hit long, items array<string>, spans array<struct<from:long,to:long>>"
    return index.mapInArrow(of, schema)


def _found(block: Block, edges: np.ndarray, hits: dict[int, set[str]]) -> list[pa.Array]:
    """Per document of the block: n_words, n_hit, items, spans."""
    inside = np.cumsum(edges[:-1]) > 0
    before = np.concatenate([[0], np.cumsum(inside)])
    none: list = []
    spans = [none] * (len(block.first) - 1)
    for d in hits:
        low, high = int(block.first[d]), int(block.first[d + 1])
        turns = np.flatnonzero(np.diff(inside[low:high].astype(np.int8), prepend=0, append=0))
        spans[d] = [{"from": int(a), "to": int(b)} for a, b in turns.reshape(-1, 2)]
    return [
        pa.array(np.diff(block.first)),
        pa.array(np.diff(before[block.first])),
        pa.array([sorted(hits.get(d, none)) for d in range(len(spans))], pa.list_(pa.string())),
        pa.array(spans, pa.list_(pa.struct({"from": pa.int64(), "to": pa.int64()}))),
    ]


def _opened(part: str, held: dict[str, Windows]) -> Windows:
    """A part of the test set, read from the shared folder; the last one read is kept."""
    if part not in held:
        held.clear()
        fs, path = open_folder(part)
        with fs.open_input_file(path) as file:
            held[part] = Windows.of(pq.read_table(file))
    return held[part]


def _mark(block: Block, part: Windows, slack: int, edges: np.ndarray, hits: dict[int, set[str]]) -> None:
    """Add where windows begin and end to ``edges``, and the items to the documents that hold them."""
    places = block.places(part.terms)
    for windows, owners in zip(part.windows, part.owners):
        local = places[windows]
        for w in np.flatnonzero((local >= 0).all(axis=1)).tolist():
            starts = block.starts(local[w], slack)
            if len(starts):
                np.add.at(edges, starts, 1)
                np.add.at(edges, starts + windows.shape[1], -1)
                for d in np.unique(np.searchsorted(block.first, starts, "right") - 1).tolist():
                    hits.setdefault(d, set()).update(owners[w])


def contamination(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    Null and empty texts have no words and no hits. Repeated rows are returned each. An empty benchmark
    hits nothing. Other columns are not read.
    """
    found = search(build(docs, "doc_id", "text"), benchmark, size=size)
    return found.select(
        F.col("key").alias("doc_id"),
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def decontaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", size: int = WINDOW) -> DataFrame:
    """``docs`` without the rows that hold a window of the benchmark."""
    rows = packed(docs)
    index = build(rows.select("key", F.col(f"row.`{text}`").alias("text")), "key", "text")
    hit = stored(search(index, benchmark, size=size).where("n_hit > 0").select("key").distinct())
    return rows.join(hit, "key", "left_anti").select("row.*")
