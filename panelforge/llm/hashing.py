"""Hashes of byte and code point runs, computed for whole batches with numpy.

The polynomial hash of any run comes from two prefix sums modulo 2**64, so all words or
phrases of a batch are hashed at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Odd base of the polynomial hash modulo 2**64, and its inverse.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
#: Bytes of text that are taken to words at a time.
PIECE_BYTES = 500_000


class _Powers:
    """Powers of a base modulo 2**64, kept as far as they have been needed."""

    def __init__(self, base: int):
        self.base, self.kept = base, np.ones(1, np.uint64)

    def upto(self, n: int) -> np.ndarray:
        if len(self.kept) < n:
            factors = np.full(max(n, 2 * len(self.kept)), self.base, np.uint64)
            factors[0] = 1
            self.kept = np.cumprod(factors, dtype=np.uint64)
        return self.kept[:n]


UP, DOWN = _Powers(BASE), _Powers(INVERSE)


def mixed(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values evenly (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def odd_numbers(n: int, seed: int) -> np.ndarray:
    return mixed(np.arange(n, dtype=np.uint64) + np.uint64(seed << 32)) | np.uint64(1)


def run_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of ``values[start:end]`` for each pair; equal runs have equal hashes wherever they stand."""
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * DOWN.upto(len(values)), out=sums[1:])
    runs = (sums[ends] - sums[starts]) * UP.upto(len(values) + 1)[ends]
    return mixed(runs ^ mixed((ends - starts).astype(np.uint64)))


BYTE_VALUES = odd_numbers(256, 1)


def word_table(separators: bytes) -> np.ndarray:
    """Maps a byte to 0 if it separates words, A-Z to a-z, and others to themselves.

    Byte 0, where it belongs to words, takes the number of a separator, which is free.
    """
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    if 0 not in separators:
        table[0] = separators[0]
    table[list(separators)] = 0
    return table


#: Words are what white space of ASCII separates.
SPACED = word_table(bytes([0x20, *range(0x09, 0x0E)]))
#: Words are runs of 0-9, a-z and all beyond ASCII.
ALNUM = word_table(bytes([*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]))


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string array without nulls and the bounds of its rows in them."""
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    bounds = np.frombuffer(texts.buffers()[1], kind)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64) \
        if len(texts) else np.zeros(1, np.int64)
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[bounds[0]:bounds[-1]], bounds - bounds[0]


def sliced(batch: pa.RecordBatch, column: str = "text", most: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """A batch in parts whose texts hold about ``most`` bytes at most, or one long text."""
    _, bounds = text_bytes(batch.column(column))
    start = 0
    while start < batch.num_rows:
        stop = max(start + 1, int(np.searchsorted(bounds, bounds[start] + most, side="right")) - 1)
        yield batch.slice(start, min(stop, batch.num_rows) - start)
        start = stop


def _pieces(data: np.ndarray, bounds: np.ndarray, table: np.ndarray) -> Iterator[tuple[int, int]]:
    """Cuts at row bounds, or at separators within long rows."""
    start, end = 0, len(data)
    while start < end:
        stop = start + PIECE_BYTES
        if stop < end:
            at = int(np.searchsorted(bounds, stop, side="right")) - 1
            if bounds[at] > start:
                stop = int(bounds[at])
            else:
                row_end = int(bounds[at + 1])
                while stop < row_end:
                    found = np.flatnonzero(table[data[stop:min(row_end, stop + 65_536)]] == 0)
                    if len(found):
                        stop += int(found[0])
                        break
                    stop = min(row_end, stop + 65_536)
        yield start, min(stop, end)
        start = min(stop, end)


def word_hashes(texts: pa.Array, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of each word of a string array without nulls, in order."""
    data, bounds = text_bytes(texts)
    hashes, rows = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for start, stop in _pieces(data, bounds, table):
        low = table[data[start:stop]]
        word = low != 0
        cuts = bounds[np.searchsorted(bounds, start, side="right"):np.searchsorted(bounds, stop)] - start
        before = np.empty_like(word)
        before[0], before[1:] = False, word[:-1]
        before[cuts] = False
        after = np.empty_like(word)
        after[-1], after[:-1] = False, word[1:]
        after[cuts - 1] = False
        starts, ends = np.flatnonzero(word & ~before), np.flatnonzero(word & ~after) + 1
        hashes.append(run_hashes(BYTE_VALUES[low], starts, ends))
        rows.append(np.searchsorted(bounds, starts + start, side="right") - 1)
    return np.concatenate(hashes), np.concatenate(rows)


def shingles(words: np.ndarray, rows: np.ndarray, n_rows: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ``width``-word shingles of each row, in order, and the row bounds in them.

    A row with fewer words has the whole sequence as its one shingle; one without words has none.
    """
    factors = odd_numbers(width, 2)
    counts = np.bincount(rows, minlength=n_rows)
    ends = np.cumsum(counts)
    runs = np.zeros(max(0, len(words) - width + 1), np.uint64)
    for k in range(width if len(runs) else 0):
        runs += words[k:len(runs) + k] * factors[k]
    runs = mixed(runs)
    out, sizes = [], np.zeros(n_rows + 1, np.int64)
    for i in np.flatnonzero(counts):
        n, end = counts[i], ends[i]
        if n >= width:
            own = np.unique(runs[end - n:end - width + 1])
        else:
            own = mixed((words[end - n:end] * factors[:n]).sum(keepdims=True) ^ mixed(np.array([n], np.uint64)))
        out.append(own)
        sizes[i + 1] = len(own)
    return np.concatenate(out) if out else np.zeros(0, np.uint64), np.cumsum(sizes)
