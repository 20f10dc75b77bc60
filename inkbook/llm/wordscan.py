"""Words of an Arrow text column as numpy arrays, for any set of separators.

``scan`` walks a column in pieces of about ``common.CHUNK`` bytes that cut no
word, so its memory does not depend on the length of a text."""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from inkbook.llm import common

#: Bytes with A-Z lower-cased; all others as they are.
LOWER = common._LOWER
SAME = np.arange(256, dtype=np.uint8)
#: Separators of the contracts that split at white space.
WHITE = common._SEP


@dataclass
class Words:
    """Words of one piece of a column: ``data`` holds its bytes, ``start`` and
    ``end`` the words' places in them, ``row`` each word's row; the piece
    begins at ``base`` in the column's buffer."""
    data: np.ndarray
    row: np.ndarray
    start: np.ndarray
    end: np.ndarray
    base: int = 0

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word's bytes."""
        n = len(self.data)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(common._TABLE[self.data] * common._pow(common._P, n), out=sums[1:])
        return common.mix((sums[self.end] - sums[self.start]) * common._pow(common._PINV, n + 1)[self.start])


def scan(col: pa.Array, separator: np.ndarray, fold: np.ndarray = SAME) -> Iterator[Words]:
    """Maximal runs of bytes that are no ``separator`` (a table of 256 flags in
    which white space is always one), after ``fold`` (a table of 256 bytes)."""
    offsets, raw = common.text_buffers(col)
    for lo, hi in common._spans(offsets, raw):
        if hi <= lo:
            continue
        data = fold[raw[lo:hi]]
        word = ~separator[data]
        cuts = offsets[np.searchsorted(offsets, lo):np.searchsorted(offsets, hi)] - lo
        first, last = word.copy(), word.copy()
        first[1:] &= ~word[:-1]
        first[cuts] = word[cuts]
        last[:-1] &= ~word[1:]
        cuts = cuts[cuts > 0] - 1
        last[cuts] = word[cuts]
        start = np.flatnonzero(first)
        row = (np.searchsorted(offsets, start + lo, "right") - 1).astype(np.int64)
        yield Words(data, row, start, np.flatnonzero(last) + 1, lo)


def joined(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words joined by one space: (bytes, starts, ends)."""
    length = words.end - words.start
    end = np.cumsum(length + 1) - 1
    start = end - length
    out = np.full(int(end[-1]) if len(end) else 0, 0x20, np.uint8)
    if len(end):
        shift = np.repeat(words.start - start, length)
        at = np.arange(len(shift)) + np.repeat(np.arange(len(length)), length)
        out[at] = words.data[at + shift]
    return out, start, end
