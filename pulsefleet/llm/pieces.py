"""Sentence pieces of whole texts through a table of distinct chunks.

The library writes a blank as a marker and puts one before the text. If no piece has a marker after another
character, no piece reaches over the place where a run of markers begins, so a text is cut there into marked
words, and its ids are those of its marked words, one after the other. That is checked for every model.

The texts of a batch become places in the batch's list of distinct chunks. A worker keeps a table of the chunks it
has met, with the ids and the decoded text of each; only chunks that the table lacks are segmented. Ids and
decoded text of a document are gathered from the table by position. Texts are never shuffled: a table of the whole
corpus, joined to the documents, moves several times the input, because rare words are most of the distinct ones.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructType

from pulsefleet.llm.common import KEPT, Words, slices, utf8
from pulsefleet.llm.tokenizer import ragged

#: Chunks a worker's table holds at most, but for those of one batch; it starts anew above that.
KEPT_CHUNKS = 1_000_000

_MARKER = "▁"


def check_model(path: str) -> None:
    """Raise ValueError unless chunks of this model can be segmented apart."""
    from sentencepiece import sentencepiece_model_pb2 as proto

    model = proto.ModelProto()
    with open(path, "rb") as file:
        model.ParseFromString(file.read())
    rules = model.normalizer_spec
    if rules.precompiled_charsmap or rules.remove_extra_whitespaces or not rules.add_dummy_prefix or not rules.escape_whitespaces:
        raise ValueError("the model changes characters or white space before it segments")
    if model.trainer_spec.treat_whitespace_as_suffix:
        raise ValueError("the model has markers at the ends of words")
    for piece in model.pieces:
        if _MARKER in piece.piece.lstrip(_MARKER):
            raise ValueError(f"piece {piece.piece!r} reaches over a marker")


def chunks(texts: pa.Array) -> Words:
    """The marked words of each text, without their first marker; null is empty.

    A text is cut at a blank after a character that is no blank and no literal marker; runs of blanks stay
    whole, and so does a blank at the end, which has no word to mark.
    """
    data, ends = utf8(texts)
    size = len(data)
    cut = np.zeros(size, dtype=bool)
    if size:
        blank = data == 0x20
        cut[1:] = blank[1:] & ~blank[:-1]
        if size > 3:
            cut[3:] &= ~((data[:-3] == 0xE2) & (data[1:-2] == 0x96) & (data[2:-1] == 0x81))
        full = ends[:-1] < ends[1:]
        cut[ends[:-1][full]] = False
        cut[ends[1:][full] - 1] = False
    places = np.flatnonzero(cut)
    # A chunk starts after a cut, or where a text does.
    opens = ends[:-1][ends[:-1] < ends[1:]]
    starts = np.sort(np.concatenate([places + 1, opens]))
    text_of = np.searchsorted(ends, starts, side="right")
    stops = np.append(starts[1:], size)
    # The next start is a byte after its cut, unless a text ends between.
    stops = np.minimum(stops, ends[text_of]) - (stops < ends[text_of])
    offsets = np.concatenate([[0], np.cumsum(stops - starts)])
    return Words(data[~cut], offsets, np.searchsorted(starts, ends))


class ChunkTable:
    """Chunks met so far, each with its ids and its decoded text behind the blank of its marker."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self._clear()

    def _clear(self) -> None:
        self.place: dict[bytes, int] = {}
        self.ids, self.id_ends = np.zeros(0, np.int32), np.zeros(1, np.int64)
        self.marked, self.mark_ends = np.zeros(0, np.uint8), np.zeros(1, np.int64)

    def places(self, listed: list[bytes]) -> np.ndarray:
        """Rows of the distinct chunks; those that the table lacks are segmented."""
        if len(self.place) > KEPT_CHUNKS:
            self._clear()
        new = [c for c in listed if c not in self.place]
        if new:
            rows = self.model.encode([c.decode("utf-8", "replace") for c in new], num_threads=1)
            texts = [b" " + d.encode() for d in self.model.decode(rows, num_threads=1)]
            self.place.update(zip(new, range(len(self.place), len(self.place) + len(new))))
            sizes = np.fromiter(map(len, rows), np.int64, len(rows))
            flat = np.fromiter((i for row in rows for i in row), np.int32, int(sizes.sum()))
            self.ids, self.id_ends = np.append(self.ids, flat), np.append(self.id_ends, self.id_ends[-1] + np.cumsum(sizes))
            sizes = np.fromiter(map(len, texts), np.int64, len(texts))
            self.marked = np.append(self.marked, np.frombuffer(b"".join(texts), np.uint8))
            self.mark_ends = np.append(self.mark_ends, self.mark_ends[-1] + np.cumsum(sizes))
        return np.fromiter((self.place[c] for c in listed), np.int64, len(listed))

    def encode(self, texts: pa.Array) -> tuple[pa.Array, pa.Array]:
        """Ids and decoded text of each text; null is empty."""
        words = chunks(texts)
        distinct, codes = words.encoded()
        place, ends = self.places(distinct.to_pylist())[codes], words.first
        begins = self.id_ends[place]
        sizes = self.id_ends[place + 1] - begins
        flat = self.ids[ragged(begins, sizes)]
        starts = np.concatenate([[0], np.cumsum(sizes)])[ends]
        ids = pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), pa.array(flat))
        begins = self.mark_ends[place]
        sizes = self.mark_ends[place + 1] - begins
        # The marker of a text's first chunk is the library's own.
        first = ends[:-1][ends[:-1] < ends[1:]]
        begins[first] += 1
        sizes[first] -= 1
        data = self.marked[ragged(begins, sizes)]
        starts = np.concatenate([[0], np.cumsum(sizes)])[ends]
        whole = pa.Array.from_buffers(pa.large_string(), len(texts), [None, pa.py_buffer(starts.astype(np.int64)), pa.py_buffer(data)])
        return ids, whole.cast(pa.string())


@lru_cache(maxsize=1)
def _table(path: str) -> ChunkTable:
    """One per worker process."""
    return ChunkTable(path)


KEPT["pieces"] = _table.cache_clear


def encoded(docs: DataFrame, model: str, keep: Sequence[str] = ("doc_id",), text: str = "text") -> DataFrame:
    """Per row of ``docs``: the columns ``keep``, ``ids`` (the library's ids of the whole text, without begin and
    end) and ``decoded`` (the library's text of all ids).

    model  file of a sentencepiece model, on every machine; ValueError if its pieces can reach over a marker

    Null and empty texts have no ids and an empty ``decoded``. Every row stays, repeated ones too; the other
    columns may have any names and values.
    """
    check_model(model)
    row = F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row")
    rows = docs.select(row, F.col(f"`{text}`").cast("string").alias("text"))
    schema = StructType().add(rows.schema["row"]).add("ids", ArrayType(IntegerType())).add("decoded", StringType())

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _table(model)
        for batch in batches:
            for piece in slices(batch, "text", keeps="pieces"):
                ids, decoded = table.encode(piece.column("text"))
                yield pa.RecordBatch.from_arrays([piece.column("row"), ids, decoded], names=["row", "ids", "decoded"])

    return rows.mapInArrow(of, schema).select("row.*", "ids", "decoded")
