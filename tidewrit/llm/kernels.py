"""Vectorised text kernels over Arrow string columns.

Every kernel works on one chunk of a batch: the UTF-8 bytes of some whole texts and the offsets of the texts in
them. Hashes of words come from one polynomial prefix sum over the bytes (arithmetic modulo 2**64), so a chunk costs
a few passes of numpy over its bytes and no Python object per word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
CHUNK_BYTES = 1 << 18
_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[str, np.ndarray] = {}

#: Bytes that belong to a token of letters and digits: ASCII letters and digits, and all bytes of other letters.
TOKEN_BYTES = np.array([chr(b).isalnum() if b < 128 else True for b in range(256)])
#: Bytes that belong to a word between white space.
WORD_BYTES = np.arange(256) > 32


def powers(name: str, base: int, n: int) -> np.ndarray:
    """base**0 .. base**n modulo 2**64."""
    have = _powers.get(name)
    if have is None or len(have) <= n:
        size = 1 << max(12, int(n).bit_length())
        have = np.full(size + 1, base, U64)
        have[0] = 1
        _powers[name] = have = np.cumprod(have, dtype=U64)
    return have


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads their bits."""
    h = h ^ (h >> U64(30))
    h = h * U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(27)
    h *= U64(0x94D049BB133111EB)
    h ^= h >> U64(31)
    return h


def ascending(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The stable order of 64-bit hashes and, but for the first, whether each in it differs from the one before. Their high
    bits are sorted with the places in the low bits, which needs no sort of indices; should that not do, they are sorted whole."""
    low = U64((1 << len(h).bit_length()) - 1)
    key = np.sort(h & ~low | np.arange(len(h), dtype=U64))
    order = (key & low).astype(np.int64)
    new = h[order[1:]] != h[order[:-1]]
    if (new & ((key[1:] ^ key[:-1]) <= low)).any():
        order = np.argsort(h, kind="stable")
        new = h[order[1:]] != h[order[:-1]]
    return order, new


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offset of each text in them (one more than texts); nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    if column.null_count:
        column = pc.fill_null(column, "" if not pa.types.is_binary(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    offs = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    offs = offs.astype(np.int64)
    data = column.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[offs[0] : offs[-1]], offs - offs[0]


def lower(column: pa.Array) -> pa.Array:
    return pc.utf8_lower(column)


def chunks(offs: np.ndarray, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts of at most so many bytes together; a longer text stands alone."""
    i, n = 0, len(offs) - 1
    while i < n:
        j = int(np.searchsorted(offs, offs[i] + most, "right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def lowered(column: pa.Array, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int, pa.Array]]:
    """Chunks of a column, lower-cased one at a time, so that a worker holds one chunk's work and no copy of the batch."""
    for i, j in chunks(raw(column)[1], most):
        yield i, j, lower(column.slice(i, j - i))
    pa.default_memory_pool().release_unused()


def tokens(buf: np.ndarray, offs: np.ndarray, belongs: np.ndarray = WORD_BYTES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each token, and the offset of each text among the tokens."""
    if not len(buf):
        e = np.zeros(0, np.int64)
        return e, e, np.zeros(len(offs), np.int64)
    inside = belongs[buf]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    at = offs[:-1][offs[:-1] < len(buf)]
    first[at] = inside[at]
    at = offs[1:][offs[1:] > 0] - 1
    last[at] = inside[at]
    s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
    return s, e, np.searchsorted(s, offs)


def prefix_sums(buf: np.ndarray) -> np.ndarray:
    """Of (byte + 1) * base**position."""
    n = len(buf)
    out = np.zeros(n + 1, U64)
    v = buf.astype(U64)
    v += U64(1)
    v *= powers("base", _BASE, n)[:n]
    np.cumsum(v, out=out[1:])
    return out


def slice_hashes(sums: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each slice [s, e), wherever it stands."""
    return mix((sums[e] - sums[s]) * powers("inverse", _BASE_INVERSE, len(sums))[s])


def words(buf: np.ndarray, offs: np.ndarray, belongs: np.ndarray = WORD_BYTES) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the tokens of all texts, and the offset of each text among them."""
    s, e, woff = tokens(buf, offs, belongs)
    return slice_hashes(prefix_sums(buf), s, e), woff


def _coefficients(n: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=U64) * U64(0xD6E8FEB86659FD93)) | U64(1)


def shingles(h: np.ndarray, woff: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of n words of each text (a shorter text has one, of all its words; an empty one none)."""
    count = np.diff(woff)
    many = np.where(count >= n, count - n + 1, (count > 0).astype(np.int64))
    goff = np.concatenate([[0], np.cumsum(many)])
    at = np.repeat(woff[:-1] - goff[:-1], many) + np.arange(goff[-1])
    c, padded = _coefficients(n), np.concatenate([h, np.zeros(n, U64)])
    g = padded[at] * c[0]
    for j in range(1, n):
        g += padded[at + j] * c[j]
    short = np.flatnonzero((count > 0) & (count < n))
    if len(short):
        total = np.zeros(len(short), U64)
        for j in range(n - 1):
            total += np.where(j < count[short], padded[np.minimum(woff[short] + j, len(h) - 1)] * c[j], U64(0))
        g[goff[short]] = total
    return mix(g), goff


def sequences(h: np.ndarray, woff: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit fingerprints of each text's sequence of words."""
    n = len(h)
    out = []
    for name, base in (("first", 0xC2B2AE3D27D4EB4F), ("second", 0x165667B19E3779F9)):
        sums = np.concatenate([[U64(0)], np.cumsum(h * powers(name, base, n)[:n], dtype=U64)])
        inv = powers(f"{name} inverse", pow(base, -1, 1 << 64), n)
        out.append(mix((sums[woff[1:]] - sums[woff[:-1]]) * inv[woff[:-1]] + np.diff(woff).astype(U64)))
    return out[0], out[1]


def minhash(g: np.ndarray, goff: np.ndarray, k: int, seed: int = 1, masks: bool = True) -> np.ndarray:
    """Signatures of k values of 32 bits for each text with shingles (rows of the others are all ones). Without masks hashes are
    permuted by odd factors alone, in two thirds of the time."""
    out = np.full((len(goff) - 1, k), 0xFFFFFFFF, np.uint32)
    some = np.flatnonzero(np.diff(goff) > 0)
    if len(some):
        at, g = goff[:-1][some], (g >> U64(32)).astype(np.uint32)
        rng, x = np.random.default_rng(seed), np.empty_like(g)
        found = np.empty((k, len(some)), np.uint32)
        for i, (a, b) in enumerate(zip(rng.integers(0, 1 << 31, k, np.uint32) * np.uint32(2) + np.uint32(1), rng.integers(0, 1 << 32, k, np.uint32))):
            np.multiply(np.bitwise_xor(g, b, out=x) if masks else g, a, out=x)
            np.minimum.reduceat(x, at, out=found[i])
        out[some] = found.T
    return out


def band_keys(sig: np.ndarray, rows: int) -> np.ndarray:
    """A 64-bit key for each band of so many rows; the band's number is part of it."""
    n, k = sig.shape
    parts = sig.reshape(n, k // rows, rows).astype(U64)
    c = _coefficients(rows)
    key = np.broadcast_to(np.arange(k // rows, dtype=U64) * U64(0x9FB21C651E98DF25), (n, k // rows)).copy()
    for j in range(rows):
        key += mix(parts[:, :, j] + c[j])  * c[j]
    return mix(key)


def band_sketches(sig: np.ndarray, rows: int) -> np.ndarray:
    """32 bits for each band of so many rows, each bit of one of the values that follow the band's own: two texts of a
    similarity s differ in about 16 * (1 - s) of them."""
    n, k = sig.shape
    bit = (sig * np.uint32(0x9E3779B1) >> np.uint32(31)).astype(np.uint8)
    bit = np.concatenate([bit, bit[:, : 32 + rows]], axis=1)
    out = np.empty((n, k // rows), np.uint32)
    for b in range(k // rows):
        at = (b + 1) * rows
        out[:, b] = np.packbits(bit[:, at : at + 32], axis=1).view(np.uint32)[:, 0]
    return out


def fixed_binary(values: np.ndarray) -> pa.Array:
    """A binary column with each row's bytes."""
    values = np.ascontiguousarray(values)
    width = values.dtype.itemsize * (values.shape[1] if values.ndim > 1 else 1)
    offs = (np.arange(len(values) + 1, dtype=np.int64) * width).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(values), [None, pa.py_buffer(offs), pa.py_buffer(values.tobytes())])


def binary_matrix(column: pa.Array, dtype) -> np.ndarray:
    """The inverse of fixed_binary()."""
    data, offs = raw(column)
    return data.view(dtype).reshape(len(offs) - 1, -1) if len(data) else np.zeros((len(offs) - 1, 0), dtype)
