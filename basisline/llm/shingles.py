"""Word shingles of whole Arrow batches, as numpy arrays: words, five-word shingle sets, MinHash values."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SHINGLE = 5
BANDS, ROWS = 28, 4  # a pair at 0.8 shares no band with probability (1 - 0.8**4)**28 = 4e-7
N_HASHES = BANDS * ROWS
CHUNK = 1 << 20  # bytes of text handled at once; longer texts are handled alone

_rng = np.random.default_rng(20240229)
_LOWER = np.arange(256, dtype="uint8")
_LOWER[65:91] += 32
_IS_WORD = np.zeros(256, bool)
_IS_WORD[48:58] = _IS_WORD[97:123] = _IS_WORD[128:] = True
NOT_BLANK = np.ones(256, bool)  # words between the blanks 0x20 and 0x09 to 0x0D
NOT_BLANK[[32, 9, 10, 11, 12, 13]] = False
_BYTE = _rng.integers(0, 1 << 63, 256, dtype="uint64") | np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_UNSTEP = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_PLACE = _rng.integers(0, 1 << 63, SHINGLE, dtype="uint64") * np.uint64(2) + np.uint64(1)
_HASHES = _rng.integers(0, 1 << 63, N_HASHES, dtype="uint64") * np.uint64(2) + np.uint64(1)
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Spread all bits of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the step and of its inverse, mod 2**64, for n bytes."""
    if len(_powers.get("up", ())) < n + 1:
        for name, base in (("up", _STEP), ("down", _UNSTEP)):
            p = np.full(n + 1, base, "uint64")
            p[0] = 1
            _powers[name] = np.multiply.accumulate(p)
    return _powers["up"], _powers["down"]


def text_chunks(column: pa.Array, limit: int = CHUNK) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of consecutive rows of at most `limit` bytes together, or of one longer row. Null: empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    if not len(column):
        return
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, "int64")[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, "uint8") if data is not None else np.zeros(0, "uint8")
    i = 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(at, at[i] + limit, "right")) - 1)
        j = min(j, len(column))
        yield i, data[at[i] : at[j]], at[i : j + 1] - at[i]
        i = j


def hash_runs(data: np.ndarray, inside: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the runs of bytes that are `inside`, broken at the row bounds; first run of each row (and the end)."""
    if not len(data):
        return np.zeros(0, "uint64"), np.zeros(len(bounds), "int64")
    edge = np.zeros(len(data) + 1, bool)
    edge[bounds] = True
    start, end = inside.copy(), inside.copy()
    start[1:] &= ~inside[:-1] | edge[1:-1]
    end[:-1] &= ~inside[1:] | edge[1:-1]
    a, b = np.flatnonzero(start), np.flatnonzero(end) + 1
    up, down = powers(max(CHUNK, len(data)))
    total = np.zeros(len(data) + 1, "uint64")
    np.cumsum(_BYTE[data] * up[: len(data)], out=total[1:])
    return mix((total[b] - total[a]) * down[a] + (b - a).astype("uint64")), np.searchsorted(a, bounds)


def shingle_sets(column: pa.Array, is_word: np.ndarray = _IS_WORD) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes): five consecutive lower-cased words; fewer words are one shingle together.

    is_word marks the bytes that words are made of.
    """
    for row, data, bounds in text_chunks(column):
        low = _LOWER[data]
        words, first = hash_runs(low, is_word[low], bounds)
        n = max(0, len(words) - SHINGLE + 1)
        grams = np.zeros(n, "uint64")
        for k in range(SHINGLE):
            grams += words[k : k + n] * _PLACE[k]
        grams = mix(grams)
        for i, (a, b) in enumerate(zip(first[:-1].tolist(), first[1:].tolist(), strict=True)):
            if b - a >= SHINGLE:
                yield row + i, np.unique(grams[a : b - SHINGLE + 1])
            else:
                short = (words[a:b] * _PLACE[: b - a]).sum(dtype="uint64", keepdims=True) + np.uint64(b - a)
                yield row + i, mix(short) if b > a else words[:0]


def minhash(shingles: np.ndarray) -> np.ndarray:
    """MinHash values (uint32) of a non-empty shingle set."""
    best = np.full(N_HASHES, np.iinfo("uint64").max, "uint64")
    for i in range(0, len(shingles), 2048):
        np.minimum(best, np.multiply.outer(_HASHES, shingles[i : i + 2048]).min(axis=1), out=best)
    return (best >> np.uint64(32)).astype("uint32")


def band_keys(values: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band of MinHash values."""
    v = values.reshape(BANDS, ROWS).astype("uint64")
    return mix(mix((v * _PLACE[:ROWS]).sum(axis=1, dtype="uint64")) + np.arange(1, BANDS + 1, dtype="uint64") * _STEP).view("int64")


def set_id(shingles: np.ndarray) -> bytes:
    """128-bit identity of a shingle set."""
    return hashlib.blake2b(np.ascontiguousarray(shingles).tobytes(), digest_size=16).digest()
