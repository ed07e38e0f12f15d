"""Words of Arrow text columns as arrays of 64-bit hashes, without per-word Python."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_RANDOM = np.random.default_rng(20240229)
_BYTE = _RANDOM.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)

#: Bytes that end a word: ASCII white space.
WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True
#: A byte's number in a word's hash; ``FOLDED`` takes A-Z as a-z.
PLAIN = _BYTE
FOLDED = _BYTE.copy()
FOLDED[0x41:0x5B] = _BYTE[0x61:0x7B]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> np.ndarray:
    return np.cumprod(np.full(n, _STEP, np.uint64), dtype=np.uint64)


def raw_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts (no nulls), one after another, and their bounds."""
    texts = texts.cast(pa.large_string())
    if isinstance(texts, pa.ChunkedArray):
        texts = pa.concat_arrays(texts.chunks) if texts.num_chunks else pa.array([], pa.large_string())
    bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = texts.buffers()[2] if len(texts) else None
    octets = np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]] if data is not None and len(data) else np.zeros(0, np.uint8)
    return octets, bounds - bounds[0]


def hashed_words(octets: np.ndarray, bounds: np.ndarray, ends_word: np.ndarray = WHITE, table: np.ndarray = PLAIN) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first byte, end byte) of every word, and each text's bounds in them."""
    space = ends_word[octets]
    opens = ~space
    opens[1:] &= space[:-1] | False
    inner = bounds[(bounds > 0) & (bounds < len(octets))]
    opens[inner] = ~space[inner]
    starts = np.flatnonzero(opens)
    if not len(starts):
        none = np.zeros(0, np.int64)
        return none.astype(np.uint64), none, none, np.zeros(len(bounds), np.int64)
    closes = ~space
    closes[:-1] &= space[1:]
    closes[inner - 1] = ~space[inner - 1]
    ends = np.flatnonzero(closes) + 1
    lengths = ends - starts
    at = np.flatnonzero(~space)
    first = np.cumsum(lengths) - lengths
    values = table[octets[at]]
    at = np.arange(len(at)) - np.repeat(first, lengths)
    values *= _powers(int(lengths.max()))[at]
    hashes = mixed(np.add.reduceat(values, first) + lengths.astype(np.uint64))
    return hashes, starts, ends, np.searchsorted(starts, bounds)


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """A hash of each run of ``k`` words, by its first word; the last k-1 places,
    where no run fits, hold nothing of meaning."""
    out = hashes.copy()
    for j in range(1, k):
        out *= _STEP
        out[: len(out) - j] += hashes[j:]
    return mixed(out)


def small_tables(t: pa.Table, column: str = "text", max_bytes: int = 512 << 10) -> Iterator[pa.Table]:
    """Slices of ``t`` with at most ``max_bytes`` of text, or one row."""
    _, bounds = raw_bytes(t.column(column))
    i = 0
    while i < t.num_rows:
        j = max(i + 1, int(np.searchsorted(bounds, bounds[i] + max_bytes, side="right")) - 1)
        yield t.slice(i, j - i)
        i = j
