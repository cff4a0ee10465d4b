"""Words and their hashes for whole Arrow batches of texts, without a Python step per word.

Texts are handled as UTF-8 bytes.  The sets of word characters used by the operators are
decided by single bytes below 0x80, so bytes and code points give the same words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from motorlens.functions.shipping import by_value

by_value(__name__)

# bytes of text that are worked on together; a longer text is worked on alone
PIECE_BYTES = 1 << 20

_MULTIPLIER = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_MULTIPLIER, -1, 2**64)


def byte_table(keep: Iterator[int] | range | list[int]) -> np.ndarray:
    """What every byte counts as inside a word: 0 for separators, A-Z as a-z."""
    table = np.zeros(256, dtype=np.uint8)
    for byte in keep:
        table[byte] = byte + 32 if 0x41 <= byte <= 0x5A else byte
    return table


# words without the characters 0x09-0x0D and 0x20, and words of letters, digits and everything above 0x7F
UNSPACED = byte_table([b for b in range(256) if b != 0x20 and not 0x09 <= b <= 0x0D])
ALPHANUMERIC = byte_table([*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 256)])
# a zero byte is a word character like any other
UNSPACED[0] = 1


def mixed(x: np.ndarray, key: int = 0) -> np.ndarray:
    """A 64-bit mix of whole numbers."""
    x = x ^ np.uint64(key)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE_CODES = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for k, base in enumerate((_MULTIPLIER, _INVERSE)):
            steps = np.full(max(n, PIECE_BYTES + 1), base, dtype=np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps)
    return _powers[0], _powers[1]


def pieces(column: pa.Array, limit: int = PIECE_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Runs of texts as ``(first row, bytes, offsets)``; a null text has no bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    if not n:
        return
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    everything = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = int(np.searchsorted(ends, ends[first] + limit, side="right")) - 1
        last = min(max(last, first + 1), n)
        yield first, everything[ends[first] : ends[last]], ends[first : last + 1] - ends[first]
        first = last


def spans(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and for every text (and one more) the number of words before it."""
    inside = table[data] != 0
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    before, after = np.empty_like(inside), np.empty_like(inside)
    before[0], before[1:] = False, inside[:-1]
    after[-1], after[:-1] = False, inside[1:]
    edges = offsets[(offsets > 0) & (offsets < len(data))]
    before[edges] = False
    after[edges - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, table: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every word, the same wherever the word stands."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    powers, inverses = _power_tables(len(data) + 1)
    sums = np.empty(len(data) + 1, np.uint64)
    sums[0] = 0
    codes = _BYTE_CODES[table].take(data)
    codes *= powers[: len(data)]
    np.cumsum(codes, out=sums[1:])
    return mixed((sums[ends] - sums[starts]) * inverses[starts], 0x632BE59BD9B4E019)


def owners(bounds: np.ndarray) -> np.ndarray:
    """For every word the text it belongs to."""
    return np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
