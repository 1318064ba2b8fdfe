"""Sets of hashed word shingles, computed for many texts at once in numpy."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import mixed, string_bytes

STEP = np.uint64(0x9E3779B97F4A7C15)  # odd, so that it has an inverse modulo 2**64
BACK = np.uint64(pow(int(STEP), -1, 1 << 64))
BYTE = mixed(np.arange(1, 257, dtype=np.uint64))  # a 64-bit value for each byte
BYTE[65:91] = BYTE[97:123]  # A-Z as a-z
SPACE = np.zeros(256, dtype=bool)
SPACE[[32, *range(9, 14)]] = True
#: Words of more bytes are named by a digest: sums modulo 2**64 are equal for some long words of two letters, whatever the factors.
LONG = 16
#: Bytes that are hashed at once: the 64-bit values of a piece are all that is held beside the text.
PIECE = 1 << 17


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n + 1, base, dtype=np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


UP, DOWN = powers(STEP, PIECE), powers(BACK, PIECE)


def word_bounds(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the words (runs without [\\x20\\x09-\\x0D]) of all texts start and stop; a text's end parts words."""
    starts, stops = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
    edges = np.unique(at)
    for low in range(0, len(raw), 8 * PIECE):
        high = min(len(raw), low + 8 * PIECE)
        full = ~SPACE[raw[max(low - 1, 0) : high + 1]]
        before = full[: high - low] if low else np.concatenate([[False], full[: high - 1]])
        own = full[1 : high - low + 1] if low else full[:high]
        after = full[2 if low else 1 :]
        begins, ends = own & ~before, own.copy()
        ends[: len(after)] &= ~after[: high - low]
        edge = edges[np.searchsorted(edges, low) : np.searchsorted(edges, high + 1)]
        inside = edge[edge < high] - low
        begins[inside] |= own[inside]
        inside = edge[edge > low] - low - 1
        ends[inside] |= own[inside]
        starts.append(np.flatnonzero(begins) + low)
        stops.append(np.flatnonzero(ends) + low + 1)
    return np.concatenate(starts), np.concatenate(stops)


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words (A-Z lower-cased) of all texts, and where each text's begin (one more than texts)."""
    raw, at = string_bytes(pc.fill_null(texts, ""))
    start, stop = word_bounds(raw, at)
    hashes = np.empty(len(start), dtype=np.uint64)
    i = 0
    while i < len(start):
        base = start[i]
        j = max(i + 1, int(np.searchsorted(stop, base + PIECE, side="right")))
        if stop[j - 1] - base <= PIECE:
            part = raw[base : stop[j - 1]]
            sums = np.zeros(len(part) + 1, dtype=np.uint64)
            np.cumsum(BYTE[part] * UP[: len(part)], out=sums[1:], dtype=np.uint64)
            hashes[i:j] = (sums[stop[i:j] - base] - sums[start[i:j] - base]) * DOWN[start[i:j] - base]
        i = j
    hashes = mixed(hashes + (stop - start).astype(np.uint64))
    long = np.flatnonzero(stop - start > LONG)
    for i, a, b in zip(long.tolist(), start[long].tolist(), stop[long].tolist(), strict=True):
        hashes[i] = int.from_bytes(hashlib.blake2b(raw[a:b].tobytes().lower(), digest_size=8).digest(), "little")
    return hashes, np.searchsorted(start, at)


def shingle_sets(texts: pa.Array, size: int) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its runs of `size` words; of fewer words, the whole as one; empty without words."""
    words, at = word_hashes(texts)
    key = np.zeros(len(words), dtype=np.uint64)
    for k in range(size):
        most = max(len(words) - k, 0)
        key[:most] = key[:most] * STEP + words[k:]
    key = mixed(key + np.uint64(size))
    out = []
    for a, b in zip(at[:-1], at[1:], strict=True):
        if b - a >= size:
            out.append(np.unique(key[a : b - size + 1]))
        elif b > a:
            whole = np.uint64(b - a)
            for w in words[a:b]:
                whole = np.uint64((int(whole) * int(STEP) + int(w)) & 0xFFFFFFFFFFFFFFFF)
            out.append(mixed(np.array([whole])))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out
