"""Words and hashes of many texts at once, over the bytes of an Arrow column."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text worked on at a time; a longer text is worked on alone.
CHUNK = 1 << 19
#: Longer strings aren't known by a polynomial modulo 2**64: there are texts of 1,024 bytes and more that it can't tell apart.
SHORT = 32
_rng = np.random.Generator(np.random.PCG64(20240229))
#: A random number for each byte, and the odd base of the polynomial and its inverse modulo 2**64.
BYTE = _rng.integers(0, 1 << 64, 256, dtype=np.uint64)
BASE = 0x9E3779B97F4A7C15 | 5
UNBASE = pow(BASE, -1, 1 << 64)
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; kept for texts of up to a few chunks."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, CHUNK + 1), base, np.uint64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        if n <= 4 * CHUNK:
            _powers[base] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: near-equal numbers come out unrelated."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text or binary column and its len + 1 offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), at


def chunked(column: pa.Array, size: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, their bytes, their offsets from 0) for runs of rows of about size bytes."""
    data, at = buffers(column)
    i, n = 0, len(at) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + size, "right")) - 1)
        j = min(j, n)
        yield i, j, data[at[i] : at[j]], at[i : j + 1] - at[i]
        i = j


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """H with H[e] - H[s] = the sum of BYTE[data[i]] * BASE**i over s <= i < e."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE[data] * powers(BASE, len(data)), out=out[1:])
    return out


def span_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each data[start:end] that doesn't depend on its place."""
    return mix((prefix[ends] - prefix[starts]) * powers(UNBASE, len(prefix))[starts] + (ends - starts).astype(np.uint64))


def digests(data: np.ndarray | bytes, starts: np.ndarray, ends: np.ndarray, size: int = 8) -> np.ndarray:
    """(n, size // 8) numbers of 64 bits, a BLAKE2b digest of each data[start:end]."""
    raw = data if isinstance(data, bytes) else data.tobytes()
    found = b"".join([hashlib.blake2b(raw[a:b], digest_size=size).digest() for a, b in zip(starts.tolist(), ends.tolist(), strict=True)])
    return np.frombuffer(found, "<u8").astype(np.uint64).reshape(-1, size // 8)


def word_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each data[start:end]: by a polynomial, whose lower bits tell short strings apart only, up to SHORT
    bytes; of longer ones a digest."""
    out = span_hash(prefix_hash(data), starts, ends)
    if len(long := np.flatnonzero(ends - starts > SHORT)):
        out[long] = digests(data, starts[long], ends[long])[:, 0]
    return out


class Words:
    """Words `[^\\x20\\x09-\\x0D]+` of a chunk: starts, ends, doc (row of each), first (len + 1 places of each row's first word)."""

    def __init__(self, data: np.ndarray, at: np.ndarray) -> None:
        space = SPACE[data]
        inside = ~space
        first, last = inside.copy(), inside.copy()
        first[1:] &= space[:-1]
        last[:-1] &= space[1:]
        breaks = at[1:-1]
        breaks = breaks[(breaks > 0) & (breaks < len(data))]
        first[breaks] = inside[breaks]
        last[breaks - 1] = inside[breaks - 1]
        self.inside, self.starts, self.ends = inside, np.flatnonzero(first), np.flatnonzero(last) + 1
        self.first = np.searchsorted(self.starts, at)
        self.doc = np.repeat(np.arange(len(at) - 1), np.diff(self.first))
        self.counts = np.diff(self.first)

    def hashes(self, data: np.ndarray) -> np.ndarray:
        return word_hash(data, self.starts, self.ends)


def windows(hashes: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(first words, hashes) of the n-word windows that lie in one document."""
    if len(hashes) < n:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    whole = len(hashes) - n + 1
    out = hashes[:whole].copy()
    for i in range(1, n):
        out = out * np.uint64(BASE) + hashes[i : i + whole]
    here = np.flatnonzero(doc[:whole] == doc[n - 1 :])
    return here, mix(out[here])


def per_row(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sums of values over each run at[i]:at[i + 1]."""
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[at[1:]] - total[at[:-1]]
