"""Words of many texts at once: where they stand, and their 64-bit hashes.

Texts are handled as one buffer of UTF-8 bytes, so that splitting and hashing
are a few vector operations. A word ends at ASCII white space (\\x20, \\x09 to
\\x0D). Its hash is a polynomial of shared random numbers of its bytes, scrambled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
_BASE = 0x2545F4914F6CDD1D
#: Bytes of the texts that are handled at once; a longer text is handled alone.
BLOCK = 1 << 20


def mixed(x: np.ndarray) -> np.ndarray:
    """A one-to-one scrambling of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


def _space() -> np.ndarray:
    out = np.zeros(256, bool)
    out[[0x20, *range(0x09, 0x0E)]] = True
    return out


def _numbers(lowered: bool) -> np.ndarray:
    out = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    out[_space()] = 0
    if lowered:
        out[ord("A") : ord("Z") + 1] = out[ord("a") : ord("z") + 1]
    return out


SPACE = _space()
_EXACT, _LOWERED = _numbers(False), _numbers(True)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _of_length(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, ``n`` of them at least."""
    if len(_powers[0]) < n:
        size = max(n, BLOCK) + 1
        for at, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            factors = np.full(size, base, np.uint64)
            factors[0] = 1
            _powers[at] = np.multiply.accumulate(factors)
    return _powers[0], _powers[1]


class Words:
    """The words of a block of texts.

    ``hashes`` has a number for each word, ``start`` its first byte in ``data``;
    ``texts`` says at which word each text begins, with the total at the end.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lowered: bool = False):
        self.data, self.offsets = data, offsets
        n = len(data)
        space = SPACE[data]
        begins = ~space
        if n:
            begins[1:] &= space[:-1]
            cut = offsets[:-1]
            cut = cut[cut < n]
            begins[cut] = ~space[cut]
        self.start = np.flatnonzero(begins)
        powers, inverse = _of_length(n)
        if len(self.start):
            sums = np.add.reduceat((_LOWERED if lowered else _EXACT)[data] * powers[:n], self.start)
            self.hashes = mixed(sums * inverse[self.start])
        else:
            self.hashes = np.empty(0, np.uint64)
        self.texts = np.searchsorted(self.start, offsets)

    def ends(self) -> np.ndarray:
        """The byte after each word."""
        space = SPACE[self.data]
        last = ~space
        if len(space):
            last[:-1] &= space[1:]
            cut = self.offsets[1:]
            cut = cut[cut > 0] - 1
            last[cut] = ~space[cut]
        return np.flatnonzero(last) + 1

    def lines(self) -> tuple[np.ndarray, np.ndarray]:
        """(the first line of each text and their total, the line of each word);
        lines are counted through the block, and each text has one at least."""
        breaks = np.flatnonzero(self.data == 10)
        count = np.diff(np.searchsorted(breaks, self.offsets)) + 1
        first = np.concatenate([[0], np.cumsum(count)])
        text = np.repeat(np.arange(len(count)), np.diff(self.texts))
        return first, np.searchsorted(breaks, self.start) + text


def blocks(batches: Iterator[pa.RecordBatch], body: str = "body", lowered: bool = False, most: int = BLOCK) -> Iterator[tuple[pa.RecordBatch, Words]]:
    """The batches in pieces whose texts (column ``body``, without nulls) have
    about ``most`` bytes, with their words; empty batches give nothing."""
    for batch in batches:
        column = batch.column(body)
        if not len(column):
            continue
        kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
        _, bounds, values = column.buffers()
        offsets = np.frombuffer(bounds, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
        data = np.frombuffer(values, np.uint8) if values is not None else np.empty(0, np.uint8)
        at = 0
        while at < len(column):
            upto = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
            upto = min(upto, len(column))
            own = offsets[at : upto + 1]
            yield batch.slice(at, upto - at), Words(data[own[0] : own[-1]], own - own[0], lowered)
            at = upto
