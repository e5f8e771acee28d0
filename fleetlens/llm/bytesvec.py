"""Words, lines and hashes of many texts at once, over the UTF-8 bytes of an Arrow string column.

White space is the six bytes 0x20 and 0x09 to 0x0D, which never occur inside a longer UTF-8 sequence, so
all of it works on bytes. Hashes have 64 bits: equal sequences have equal hashes, and unequal ones, unless
they were constructed with these constants in hand, differ but for chances of about 2**-64 a pair.
"""

from __future__ import annotations

from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
#: Ranges beyond so many bytes are hashed one by one.
LONG_RANGE = 64
_LOW_BYTES = np.array([(1 << (8 * k)) - 1 for k in range(9)], U)

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts in a row, and where each begins (one more entry for the end). Null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, where, data = column.buffers()
    offsets = np.frombuffer(where, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the splitmix64 finalizer)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def factor(position: int) -> np.uint64:
    """An odd factor for each position of a sequence, unrelated to the others."""
    return mix(np.array([position + 1], U))[0] | U(1)


def _eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as a number, zeros beyond the end."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ndarray(len(data) + 1, "<u8", padded.data, strides=(1,))


def range_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of the bytes of each range: eight bytes at a time, each step a bijection of the state; blake2b for long ones."""
    sizes = ends - starts
    out = mix(sizes.astype(U) * U(0x9E3779B97F4A7C15) + U(77))
    eights, todo, at = _eights(data), np.flatnonzero((sizes > 0) & (sizes <= LONG_RANGE)), 0
    while len(todo):
        left = sizes[todo] - at
        out[todo] = mix((out[todo] * U(0xD1342543DE82EF95)) ^ (eights[starts[todo] + at] & _LOW_BYTES[np.minimum(left, 8)]))
        at += 8
        todo = todo[left > 8]
    for i in np.flatnonzero(sizes > LONG_RANGE).tolist():
        out[i] = int.from_bytes(blake2b(data[starts[i] : ends[i]], digest_size=8).digest(), "little")
    return out


def short_ranges(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first and the second eight bytes of ranges as numbers, zeros beyond their ends: all there is of those up to sixteen."""
    eights = _eights(data)
    return eights[starts] & _LOW_BYTES[np.minimum(sizes, 8)], eights[np.minimum(starts + 8, len(data))] & _LOW_BYTES[np.clip(sizes - 8, 0, 8)]


def same_ranges(data: np.ndarray, starts: np.ndarray, others: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Whether the ``sizes`` bytes from ``starts`` on are those from ``others`` on."""
    same, eights, todo, at = np.ones(len(starts), bool), _eights(data), np.flatnonzero((sizes > 0) & (starts != others)), 0
    while len(todo) and at < LONG_RANGE:
        left = sizes[todo] - at
        alike = (eights[starts[todo] + at] ^ eights[np.minimum(others[todo] + at, len(data))]) & _LOW_BYTES[np.minimum(left, 8)] == 0
        same[todo] = alike
        at += 8
        todo = todo[(left > 8) & alike]
    for i in todo.tolist():
        same[i] = np.array_equal(data[starts[i] : starts[i] + sizes[i]], data[others[i] : others[i] + sizes[i]])
    return same


class Words:
    """Where the words of each text stand."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets, n = data, offsets, len(data)
        self.space = SPACE[data]
        inside = ~self.space
        first, last = inside.copy(), inside.copy()
        first[1:] &= self.space[:-1]
        last[:-1] &= self.space[1:]
        edges = offsets[(offsets > 0) & (offsets < n)]
        first[edges] = inside[edges]
        last[edges - 1] = inside[edges - 1]
        self.starts, self.ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        #: For text i, words bounds[i] to bounds[i + 1]
        self.bounds = np.searchsorted(self.starts, offsets)

    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)

    def hashes(self) -> np.ndarray:
        return range_hashes(self.data, self.starts, self.ends)


def windows(hashes: np.ndarray, bounds: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``width`` words that stay within a text, and their bounds by text."""
    n = max(0, len(hashes) - width + 1)
    total = np.zeros(n, U)
    for j in range(width):
        total += hashes[j : j + n] * factor(j)
    total = mix(total + U(width))
    counts = np.maximum(np.diff(bounds) - width + 1, 0)
    inside = np.zeros(len(hashes) + 1, np.int32)
    has = counts > 0
    np.add.at(inside, bounds[:-1][has], 1)
    np.add.at(inside, (bounds[:-1] + counts)[has], -1)
    return total[np.cumsum(inside)[:n] > 0], np.concatenate([[0], np.cumsum(counts)])


def lines_of(data: np.ndarray, offsets: np.ndarray, words: Words) -> tuple[np.ndarray, ...]:
    """The lines (split at \\n) that hold a word: their text's number, first and last byte, first word and that after their last."""
    breaks = np.flatnonzero(data == 0x0A)
    starts = np.unique(np.concatenate([offsets[:-1], breaks + 1]))
    starts = starts[starts < len(data)]
    ends = np.append(starts[1:], len(data))
    ends = np.where((ends > starts) & (data[ends - 1] == 0x0A), ends - 1, ends)
    lo, hi = np.searchsorted(words.starts, starts), np.searchsorted(words.starts, ends)
    has = hi > lo
    starts, ends, lo, hi = starts[has], ends[has], lo[has], hi[has]
    return np.searchsorted(offsets, starts, side="right") - 1, starts, ends, lo, hi


def seen_before(owner: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which items are equal to an earlier one of the same owner."""
    _, first, which = np.unique(mix(hashes ^ mix(owner.astype(U))), return_index=True, return_inverse=True)
    return first[which] != np.arange(len(hashes))


def sums_between(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sums of small numbers, no larger in all than a text has bytes."""
    total = np.zeros(len(values) + 1, np.int32 if len(values) < 1 << 31 else np.int64)
    np.cumsum(values, out=total[1:])
    return (total[ends] - total[starts]).astype(np.int64)
