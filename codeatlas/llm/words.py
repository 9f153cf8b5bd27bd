"""Vectorised word and shingle hashes over the bytes of many texts at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

MASK = (1 << 64) - 1
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_rng = np.random.default_rng(20240229)
BYTE_VALUE = _rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = 0x9E3779B97F4A7C15
BASE_INVERSE = pow(BASE, -1, 1 << 64)
STEP = np.uint64(0xD6E8FEB86659FD93)
_powers: dict[str, np.ndarray] = {}
SLICE = 1 << 19


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that scatters them."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and its inverse modulo 2**64, i < n."""
    if len(_powers.get("p", ())) < n:
        size = 1 << max(16, (n - 1).bit_length())
        for name, base in (("p", BASE), ("q", BASE_INVERSE)):
            out = np.full(size, base, dtype=np.uint64)
            out[0] = 1
            _powers[name] = np.multiply.accumulate(out)
    return _powers["p"], _powers["q"]


def text_slices(column: pa.Array, most: int = SLICE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of rows of about `most` bytes; null texts are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    _, offsets, data = column.buffers()
    n = len(column)
    offsets = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, dtype=np.uint8)
    row = 0
    while row < n:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + most, side="right")) - 1)
        end = min(end, n)
        yield row, end, raw[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def tokens(data: np.ndarray, offsets: np.ndarray, between: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Begins and ends of runs of bytes outside `between`, each text's first run, and sums for hash_of."""
    n = len(data)
    if not n:
        none = np.zeros(0, dtype=np.int64)
        return none, none, np.zeros(len(offsets), dtype=np.int64), np.zeros(1, dtype=np.uint64)
    low = LOWER[data]
    inside = ~between[low]
    edge = np.zeros(n + 1, dtype=bool)
    edge[offsets] = True
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | edge[1:n]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | edge[1:n]
    begin, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    p, _ = powers(n + 1)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(BYTE_VALUE[low] * p[:n], out=sums[1:])
    return begin, end, np.searchsorted(begin, offsets), sums


def hash_of(begin: np.ndarray, end: np.ndarray, sums: np.ndarray) -> np.ndarray:
    """Hashes of the lower-cased bytes from begin to end, equal wherever the bytes are."""
    _, q = powers(len(sums))
    return mix((sums[end] - sums[begin]) * q[begin] + (end - begin).astype(np.uint64))


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased words `[^\\x20\\x09-\\x0D]+` of each text, and where each text's words begin."""
    if len(offsets) == 2 and len(data) > 2 * SLICE:  # one long text: worked in parts, cut between words
        hashes = np.concatenate([word_hashes(part, np.array([0, len(part)]))[0] for part in parts_of(data, SPACE)])
        return hashes, np.array([0, len(hashes)])
    begin, end, first, sums = tokens(data, offsets)
    return hash_of(begin, end, sums), first


def parts_of(data: np.ndarray, between: np.ndarray) -> list[np.ndarray]:
    """A long text in parts of about SLICE bytes, cut where a byte of `between` stands; a word without end stays whole."""
    cuts, at = [0], 0
    while len(data) - at > 2 * SLICE:
        here = at + SLICE
        while here < len(data):
            stop = np.flatnonzero(between[data[here : here + 4096]])
            if len(stop):
                here += int(stop[0])
                break
            here += 4096
        at = min(here, len(data))
        cuts.append(at)
    cuts.append(len(data))
    return [data[a:b] for a, b in zip(cuts, cuts[1:], strict=False) if b > a]


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> list[np.ndarray]:
    """The sorted distinct hashes of each text's k-word shingles; all words as one if there are fewer."""
    hashes, first = word_hashes(data, offsets)
    rolled = np.zeros(max(0, len(hashes) - k + 1), dtype=np.uint64)
    for j in range(k):
        rolled = rolled * STEP + hashes[j : j + len(rolled)]
    rolled = mix(rolled + np.uint64(k))
    out = []
    for a, b in zip(first[:-1], first[1:], strict=True):
        if b - a >= k:
            out.append(np.unique(rolled[a : b - k + 1]))
        elif b > a:
            h = 0
            for x in hashes[a:b]:
                h = (h * int(STEP) + int(x)) & MASK
            out.append(mix(np.array([(h + int(b - a)) & MASK], dtype=np.uint64)))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out
