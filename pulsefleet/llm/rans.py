"""Static range asymmetric numeral system over token ids.

One frequency table serves all blocks. A block is a matrix of symbols, one row per step and one column
per lane; each lane has its own coder state, and all lanes of a block write to one stream of 32-bit
words in the order in which the decoder reads them. A checkpoint every ``every`` steps holds the lane
states and the stream position, so a decoder may start at any of them. numpy codes the lanes of many
blocks, and decodes the stretches between checkpoints of many blocks, at once.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

LOW = np.uint64(1 << 31)  # states stay in [2**31, 2**63)
_32 = np.uint64(32)
_WORD = np.uint64(0xFFFFFFFF)


@dataclass(frozen=True)
class Frequencies:
    """Symbols in ascending order with shares of 2**bits; every symbol has at least one part."""

    bits: int
    symbols: np.ndarray
    shares: np.ndarray

    @classmethod
    def of(cls, symbols: np.ndarray, counts: np.ndarray, bits: int = 18) -> "Frequencies":
        """Shares in proportion to the counts; ``bits`` grows with the number of symbols if need be."""
        order = np.argsort(symbols)
        symbols, counts = symbols[order].astype(np.uint32), counts[order].astype(np.float64)
        bits = max(bits, int(len(symbols)).bit_length() + 2)
        total = 1 << bits
        if not len(symbols):
            return cls(bits, symbols, np.zeros(0, np.uint32))
        shares = np.maximum(np.floor(counts / counts.sum() * total), 1).astype(np.int64)
        over = int(shares.sum()) - total
        # Settle the rest at the largest shares, where it costs the least.
        for place in np.argsort(-shares, kind="stable"):
            if over == 0:
                break
            step = min(over, int(shares[place]) // 2) if over > 0 else over
            shares[place] -= step
            over -= step
        return cls(bits, symbols, shares.astype(np.uint32))

    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start of each symbol's range, and for each slot the symbol's place."""
        starts = np.concatenate([[0], np.cumsum(self.shares.astype(np.uint64))]).astype(np.uint64)
        return starts[:-1], self.shares.astype(np.uint64), np.repeat(np.arange(len(self.shares)), self.shares)


@dataclass(frozen=True)
class Block:
    """A coded block: its number of symbols, words, and per checkpoint the lane states and the position."""

    size: int
    words: np.ndarray
    states: np.ndarray
    places: np.ndarray


def encode(ids: np.ndarray, table: Frequencies, lanes: int, every: int) -> list[Block]:
    """Code rows of ids (blocks x size; size a multiple of ``lanes``)."""
    starts, shares, _ = table.tables()
    blocks, size = ids.shape
    steps = size // lanes
    place = np.zeros(int(table.symbols[-1]) + 1, dtype=np.int64)
    place[table.symbols] = np.arange(len(table.symbols))
    share, start = (x[place][ids.reshape(blocks, steps, lanes)] for x in (shares, starts))
    bits, top = np.uint64(table.bits), np.uint64(63 - table.bits)
    state = np.full((blocks, lanes), LOW, dtype=np.uint64)
    words = np.zeros((blocks, steps, lanes), dtype=np.uint32)
    wrote = np.zeros((blocks, steps, lanes), dtype=bool)
    marks = -(-steps // every)
    states = np.zeros((blocks, marks, lanes), dtype=np.uint64)
    for step in range(steps - 1, -1, -1):
        f = share[:, step]
        full = state >= (f << top)
        words[:, step][full] = (state[full] & _WORD).astype(np.uint32)
        wrote[:, step] = full
        state = np.where(full, state >> _32, state)
        quotient = state // f
        state = (quotient << bits) + (state - quotient * f) + start[:, step]
        if step % every == 0:
            states[:, step // every] = state
    # A decoder reads the word of a step right after the step's symbol.
    per_step = wrote.sum(axis=2).cumsum(axis=1)
    out = []
    for b in range(blocks):
        places = np.concatenate([[0], per_step[b, every - 1 :: every]])[:marks]
        out.append(Block(size, words[b][wrote[b]], states[b], places.astype(np.uint32)))
    return out


def decode(words: np.ndarray, places: np.ndarray, states: np.ndarray, steps: int, table: Frequencies) -> np.ndarray:
    """Decode ``steps`` steps of stretches at once: ids as (stretches, steps * lanes).

    words   the words of all stretches' streams, one after the other
    places  where each stretch starts to read
    states  lane states of each stretch
    """
    starts, shares, slots = table.tables()
    stretches, lanes = states.shape
    bits, mask = np.uint64(table.bits), np.uint64((1 << table.bits) - 1)
    state, place = states.copy(), places.astype(np.int64).copy()
    out = np.empty((stretches, steps, lanes), dtype=np.uint32)
    words = np.append(words, np.uint32(0))
    for step in range(steps):
        slot = state & mask
        symbol = slots[slot.astype(np.int64)]
        out[:, step] = table.symbols[symbol]
        state = shares[symbol] * (state >> bits) + slot - starts[symbol]
        short = state < LOW
        nth = np.cumsum(short, axis=1)
        at = np.minimum(place[:, None] + nth - 1, len(words) - 1)
        state = np.where(short, (state << _32) | words[at].astype(np.uint64), state)
        place += nth[:, -1]
    return out.reshape(stretches, steps * lanes)
