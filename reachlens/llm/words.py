"""Words and word-sequence hashes of many texts at once, on the bytes of an Arrow string array.

A word is a run of bytes that are no separators. Its hash is a polynomial over its bytes; the hash of a sequence is
a polynomial over the hashes of its words. Both come from prefix sums, so no text is ever split into Python objects.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 18
_RANDOM = np.random.Generator(np.random.PCG64(20240229))
_BYTE_VALUES = _RANDOM.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_BYTE_BASE, _WORD_BASE = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95

#: The separators of the contracts: space and \t \n \v \f \r.
WHITE_SPACE = np.zeros(256, dtype=bool)
WHITE_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Everything in ASCII that is neither a lower-case letter nor a digit.
NO_LETTER_OR_DIGIT = np.array([not (chr(b).isdigit() or "a" <= chr(b) <= "z" or b >= 0x80) for b in range(256)])
NO_LETTER_OR_DIGIT[0x80:] = False


@cache
def _powers(base: int, size: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.concatenate([[np.uint64(1)], np.full(size - 1, base, dtype=np.uint64)]).cumprod(dtype=np.uint64)


def _power_pair(base: int, needed: int) -> tuple[np.ndarray, np.ndarray]:
    size = max(CHUNK_BYTES, 1 << max(0, needed - 1).bit_length())
    return _powers(base, size), _powers(pow(base, -1, 1 << 64), size)


def mix(values: np.ndarray) -> np.ndarray:
    """Spread all bits of 64-bit values (the finalizer of SplitMix64)."""
    values = values ^ (values >> np.uint64(30))
    values *= np.uint64(0xBF58476D1CE4E5B9)
    values ^= values >> np.uint64(27)
    values *= np.uint64(0x94D049BB133111EB)
    values ^= values >> np.uint64(31)
    return values


@dataclass
class Words:
    """The words of some texts: their bytes are ``data[starts[i]:ends[i]]``, text t has words first[t]..first[t+1]."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray
    rows: range

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def texts(self) -> np.ndarray:
        """The text each word stands in."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts())

    def hashes(self) -> np.ndarray:
        power, inverse = _power_pair(_BYTE_BASE, len(self.data))
        sums = np.zeros(len(self.data) + 1, dtype=np.uint64)
        np.cumsum(_BYTE_VALUES[self.data] * power[: len(self.data)], out=sums[1:])
        return mix((sums[self.ends] - sums[self.starts]) * inverse[self.starts])


def sequence_sums(hashes: np.ndarray) -> np.ndarray:
    power, _ = _power_pair(_WORD_BASE, len(hashes))
    sums = np.zeros(len(hashes) + 1, dtype=np.uint64)
    np.cumsum(hashes * power[: len(hashes)], out=sums[1:])
    return sums


def sequence_hashes(sums: np.ndarray, starts: np.ndarray, lengths) -> np.ndarray:
    """Hashes of the sequences of ``lengths`` words from ``starts``."""
    _, inverse = _power_pair(_WORD_BASE, len(sums))
    return mix((sums[starts + lengths] - sums[starts]) * inverse[starts])


def chunks(column: pa.Array, separators: np.ndarray, chunk_bytes: int = CHUNK_BYTES) -> Iterator[Words]:
    """The words of a string column, some text at a time; nulls are empty texts."""
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        end = max(row + 1, int(np.searchsorted(offsets, int(offsets[row]) + chunk_bytes, side="right")) - 1)
        part = data[offsets[row] : offsets[end]]
        bounds = (offsets[row : end + 1] - offsets[row]).astype(np.int64)
        inside = ~separators[part]
        before, after = np.zeros_like(inside), np.zeros_like(inside)
        before[1:], after[:-1] = inside[:-1], inside[1:]
        cuts = bounds[(bounds > 0) & (bounds < len(part))]
        before[cuts], after[cuts - 1] = False, False
        starts = np.flatnonzero(inside & ~before)
        ends = np.flatnonzero(inside & ~after) + 1
        yield Words(part, starts, ends, np.searchsorted(starts, bounds), range(row, end))
        row = end
