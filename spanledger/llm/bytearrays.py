"""Texts of an Arrow batch as byte arrays: words and hashes of spans without Python loops.

:class:`Hashed` hashes spans of any kind: a difference of prefix sums of byte
values times powers of an odd number modulo 2**64, moved to place 0 by the
inverse power, then mixed. Spans of a regular pattern can be made to collide.
:func:`word_hashes` mixes block by block and has no such patterns.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes that are worked on at once; a longer text is worked on alone.
PIECE = 1 << 19
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_rng = np.random.Generator(np.random.PCG64(20_240_229))
_VALUES = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts, offsets); null is an empty text."""
    whole = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = whole.buffers()
    at = np.frombuffer(offsets, np.int64)[whole.offset : whole.offset + len(whole) + 1]
    # Empty buffers may be missing.
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), at


def pieces(offsets: np.ndarray, size: int = PIECE) -> Iterator[tuple[int, int]]:
    """Ranges of texts with about ``size`` bytes together."""
    n, start = len(offsets) - 1, 0
    while start < n:
        end = int(np.searchsorted(offsets, offsets[start] + size, side="right")) - 1
        end = min(max(end, start + 1), n)
        yield start, end
        start = end


class Hashed:
    """Prefix hashes of one byte array."""

    def __init__(self, data: np.ndarray) -> None:
        powers = np.full(len(data) + 1, _BASE, np.uint64)
        powers[0] = 1
        powers = np.cumprod(powers, dtype=np.uint64)
        self._sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_VALUES[data] * powers[:-1], dtype=np.uint64, out=self._sums[1:])
        inverse = np.full(len(data) + 1, _INVERSE, np.uint64)
        inverse[0] = 1
        self._inverse = np.cumprod(inverse, dtype=np.uint64)

    def spans(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Unsigned 64-bit hash of each span [start, end); depends on its bytes only."""
        return mix((self._sums[ends] - self._sums[starts]) * self._inverse[starts] + (ends - starts).astype(np.uint64))

    def windows(self, width: int) -> np.ndarray:
        """Hash of every span of ``width`` bytes."""
        if len(self._sums) <= width:
            return np.zeros(0, np.uint64)
        return mix((self._sums[width:] - self._sums[:-width]) * self._inverse[:-width] + np.uint64(width))


def mix(values: np.ndarray) -> np.ndarray:
    """Bijective mixing, so that all bits depend on all bits."""
    values = values ^ (values >> np.uint64(31))
    values = values * np.uint64(0xBF58476D1CE4E5B9)
    values = values ^ (values >> np.uint64(29))
    values = values * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(32))


#: Bytes from which a word is hashed on its own.
_LONG_WORD = 512
#: Keeps the first k bytes of a little-endian block.
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Unsigned 64-bit hash of each span [start, end), eight bytes at a time.

    A block is mixed in before the next one is added, so that no arithmetic
    pattern among the bytes makes two spans meet.
    """
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eights = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    lengths = ends - starts
    out = mix(lengths.astype(np.uint64) + np.uint64(_BASE))
    # Short numbers are sorted by their digits.
    order = np.argsort(-np.minimum(lengths, 1 << 14).astype(np.int16), kind="stable")
    sizes = -lengths[order]
    long = int(np.searchsorted(sizes, -_LONG_WORD, side="right"))
    for i in order[:long]:
        digest = hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=8).digest()
        out[i] = np.frombuffer(digest, np.uint64)[0]
    order, sizes = order[long:], sizes[long:]
    at, state = starts[order], out[order]
    for k in range(0, -int(sizes[0]) if len(sizes) else 0, 8):
        # Lengths fall, so the spans that still have a byte come first.
        n = int(np.searchsorted(sizes, -k, side="left"))
        block = np.take(eights, at[:n] + k) & np.take(_FIRST, np.minimum(-sizes[:n] - k, 8))
        state[:n] = mix(state[:n] ^ (block * np.uint64(0xD6E8FEB86659FD93)))
    out[order] = state
    return out


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, words before each text and in all); no word crosses a text."""
    inside = ~SPACE[data]
    before = np.zeros(len(data), bool)
    before[1:] = inside[:-1]
    edges = offsets[:-1][offsets[:-1] < len(data)]
    before[edges] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.zeros(len(data), bool)
    after[:-1] = inside[1:]
    last = offsets[1:] - 1
    after[last[last >= 0]] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)
