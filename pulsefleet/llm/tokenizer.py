"""Token ids of whole texts, through a tokenizer that works on pieces of words in lower case.

A tokenizer whose pre-tokenizer drops white space and splits letters from marks gives the ids of a text
as the ids of its pieces, one after the other. So a batch's distinct pieces are encoded once, and each
takes its ids from there. Only what is safe for every text is done ahead of the tokenizer:

* texts are cut at blank, tab, line feed and carriage return, and between an ASCII letter or digit and
  one of ``, . ; : ! ?``; everything else stays inside a piece;
* A-Z becomes lower case unless a byte above 0x7F follows, which may be a mark that joins the letter;
* a text that may hold one of the tokenizer's own special tokens is encoded as it is.
"""

from __future__ import annotations

import os
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from pulsefleet.llm.common import KEPT, LOWER, Words, utf8, words_of

_BREAKS = np.zeros(256, dtype=bool)
_BREAKS[[0x20, 0x09, 0x0A, 0x0D]] = True
_MARKS = np.isin(np.arange(256), np.frombuffer(b",.;:!?", np.uint8))
_LETTERS = np.isin(LOWER, np.frombuffer(b"0123456789abcdefghijklmnopqrstuvwxyz", np.uint8))

#: Words a worker keeps at most; the store starts anew above it.
KEPT_WORDS = 1_000_000


def ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places starts[i], ..., starts[i] + sizes[i] - 1 for all i, one after the other."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(int(ends[-1]) if len(ends) else 0)


def pieces(texts: pa.Array) -> Words:
    data, ends = utf8(texts)
    before_ascii = np.append(data[1:] < 0x80, True) if len(data) else np.zeros(0, bool)
    data = np.where(before_ascii, LOWER[data], data)
    mark, letter = _MARKS[data], _LETTERS[data]
    cuts = np.zeros(len(data), dtype=bool)
    cuts[1:] = (mark[1:] & letter[:-1]) | (letter[1:] & mark[:-1])
    return words_of(data, ends, _BREAKS, cuts)


class WordTokenizer:
    """Tokenizer of a ``tokenizers`` file, with the ids of the words met so far."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        shared = os.path.commonprefix(special)
        self.special = [shared] if shared else special
        self._clear()

    def _clear(self) -> None:
        self.place: dict[bytes, int] = {}
        self.ids = np.zeros(0, dtype=np.uint32)
        self.starts = np.zeros(0, dtype=np.int64)
        self.sizes = np.zeros(0, dtype=np.int64)

    def _places(self, words: list[bytes]) -> np.ndarray:
        if len(self.place) > KEPT_WORDS:
            self._clear()
        new = [w for w in words if w not in self.place]
        if new:
            coded = self.tokenizer.encode_batch_fast([w.decode() for w in new], add_special_tokens=False)
            rows = [x.ids for x in coded]
            sizes = np.fromiter(map(len, rows), np.int64, len(rows))
            flat = np.fromiter((i for row in rows for i in row), np.uint32, int(sizes.sum()))
            self.place.update(zip(new, range(len(self.sizes), len(self.sizes) + len(new))))
            self.starts = np.append(self.starts, len(self.ids) + np.cumsum(sizes) - sizes)
            self.sizes = np.append(self.sizes, sizes)
            self.ids = np.append(self.ids, flat)
        return np.fromiter((self.place[w] for w in words), np.int64, len(words))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, and where each text's ids begin (one more than texts). Null is empty."""
        odd = np.zeros(len(texts), dtype=bool)
        for mark in self.special:
            found = pc.match_substring(texts, mark, ignore_case=mark.lower() != mark.upper())
            odd |= pc.fill_null(found, False).to_numpy(zero_copy_only=False)
        if odd.any():
            return self._encode_odd(texts, odd)
        words = pieces(texts)
        if not len(words):
            return np.zeros(0, np.uint32), np.zeros(len(texts) + 1, np.int64)
        distinct, codes = words.encoded()
        place = self._places(distinct.to_pylist())[codes]
        sizes = self.sizes[place]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        return self.ids[ragged(self.starts[place], sizes)], ends[words.first]

    def _encode_odd(self, texts: pa.Array, odd: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        ids, ends = self.encode(pc.if_else(pa.array(odd), pa.scalar("", texts.type), texts))
        rows = np.split(ids, ends[1:-1])
        for place in np.flatnonzero(odd):
            rows[place] = np.array(self.tokenizer.encode(texts[place].as_py(), add_special_tokens=False).ids, np.uint32)
        return np.concatenate(rows), np.concatenate([[0], np.cumsum([len(row) for row in rows])])


@lru_cache(maxsize=2)
def tokenizer(path: str) -> WordTokenizer:
    """One per worker process."""
    return WordTokenizer(path)


KEPT["tokenizer"] = tokenizer.cache_clear
