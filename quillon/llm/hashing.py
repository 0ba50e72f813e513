"""Vectorised fingerprints of byte spans, word sequences and fixed-length windows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
#: Items of a sequence that are hashed together.
STRETCH = 1 << 18


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit; changes x in place."""
    x ^= x >> U(31)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(29)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(32)
    return x


class Rolling:
    """Hashes of any spans of a sequence of integers: prefix sums of values times powers of an odd base, modulo 2**64."""

    def __init__(self, seed: int):
        rng = np.random.default_rng(seed)
        self.base = U(int(rng.integers(1 << 62, 1 << 63)) | 5)
        self.table = rng.integers(0, 1 << 64, 256, dtype=U)
        self.powers = self.inverse = np.ones(1, U)

    def _grow(self, n: int) -> None:
        if len(self.powers) < n:
            for name, base in (("powers", self.base), ("inverse", U(pow(int(self.base), -1, 1 << 64)))):
                p = np.full(max(n, 1 << 16), base, U)
                p[0] = 1
                setattr(self, name, np.cumprod(p))

    def spans(self, values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """A hash of values[s:e] for each s, e; equal contents give equal hashes wherever they stand. uint8 values are looked up in a random table."""
        if len(values) > 2 * STRETCH and len(starts):
            # a stretch of the sequence at a time, so that powers and sums stay small
            order = np.argsort(starts, kind="stable")
            s, e = starts[order], ends[order]
            out, i = np.empty(len(s), U), 0
            while i < len(s):
                j = int(np.searchsorted(s, s[i] + STRETCH))
                out[order[i:j]] = self._direct(values[s[i] : int(e[i:j].max())], s[i:j] - s[i], e[i:j] - s[i])
                i = j
            return out
        return self._direct(values, starts, ends)

    def _direct(self, values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        n = len(values)
        self._grow(n + 1)
        at = np.zeros(n + 1, U)
        np.cumsum((self.table[values] if values.dtype == np.uint8 else values) * self.powers[:n], out=at[1:])
        return mix((at[ends] - at[starts]) * self.inverse[starts] + np.asarray(ends - starts).astype(U))


BYTES, WORDS, OTHER = Rolling(11), Rolling(12), Rolling(13)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (one more than rows) of a string or binary array; nulls are empty."""
    column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "").cast(pa.large_binary())
    _, offsets, data = column.buffers()
    o = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return (whole[o[0] : o[-1]], o - o[0]) if len(o) else (np.zeros(0, np.uint8), np.zeros(1, np.int64))


def words(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words [^\\x20\\x09-\\x0D]+ of all texts as one array, and for each word the row it is in; nulls have none."""
    split = pc.ascii_split_whitespace(column.fill_null(""))
    flat = split.flatten()
    rows = np.repeat(np.arange(len(column)), pc.list_value_length(split).to_numpy(zero_copy_only=False))
    full = pc.greater(pc.binary_length(flat), 0)
    return flat.filter(full), rows[full.to_numpy(zero_copy_only=False)]


def rank_pairs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The rank of a doubled prefix: a fingerprint of the ranks of its two halves."""
    x = a * U(0x9E3779B97F4A7C15)
    x ^= x >> U(32)
    x += b
    x *= U(0xD6E8FEB86659FD93)
    x ^= x >> U(32)
    x *= U(0xC2B2AE3D27D4EB4F)
    x ^= x >> U(29)
    return x


def prefixes8(data: np.ndarray) -> np.ndarray:
    """For each position the 8 bytes from there on as one integer: the exact rank of the 8-byte prefix."""
    n = len(data) - 7
    if n <= 0:
        return np.zeros(0, U)
    out = np.empty(n, U)
    for r in range(min(8, n)):
        k = (len(data) - r) // 8
        out[r::8] = np.frombuffer(data[r : r + 8 * k].tobytes(), "<u8")[: len(out[r::8])]
    return out


_P = [U(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5)]  # fixed values of XXH64


def _turned(x: np.ndarray, bits: int) -> np.ndarray:
    return (x << U(bits)) | (x >> U(64 - bits))


def _round(acc: np.ndarray, lane: np.ndarray) -> np.ndarray:
    return _turned(acc + lane * _P[1], 31) * _P[0]


def xxh64(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int) -> np.ndarray:
    """XXH64 of data[s:e] for each s, e: all spans advance together by stripes, lanes and bytes, each as long as it has some left."""
    word = prefixes8(np.concatenate([data, np.zeros(8, np.uint8)]))  # eight bytes from each position on
    size = (ends - starts).astype(np.int64)
    at, stripes, p = starts.astype(np.int64), size >> 5, list(map(int, _P))
    h = np.full(len(at), (seed + p[4]) % 2**64, U)
    long = np.flatnonzero(stripes)
    if len(long):
        acc = [np.full(len(long), x, U) for x in ((seed + p[0] + p[1]) % 2**64, (seed + p[1]) % 2**64, seed, (seed - p[0]) % 2**64)]
        for k in range(int(stripes.max())):
            on = np.flatnonzero(stripes[long] > k)
            for i in range(4):
                acc[i][on] = _round(acc[i][on], word[at[long[on]] + 32 * k + 8 * i])
        x = _turned(acc[0], 1) + _turned(acc[1], 7) + _turned(acc[2], 12) + _turned(acc[3], 18)
        for a in acc:
            x = (x ^ _round(np.zeros_like(a), a)) * _P[0] + _P[3]
        h[long] = x
    h += size.astype(U)
    at, left = at + 32 * stripes, size & 31
    for k in range(3):
        on = np.flatnonzero(left >= 8 * (k + 1))
        x = h[on] ^ _round(np.zeros(len(on), U), word[at[on] + 8 * k])
        h[on] = _turned(x, 27) * _P[0] + _P[3]
    at, left = at + (left & 24), left & 7
    on = np.flatnonzero(left & 4)
    h[on] = _turned(h[on] ^ ((word[at[on]] & U(0xFFFFFFFF)) * _P[0]), 23) * _P[1] + _P[2]
    at, left = at + (left & 4), left & 3
    for k in range(3):
        on = np.flatnonzero(left > k)
        h[on] = _turned(h[on] ^ ((word[at[on] + k] & U(0xFF)) * _P[4]), 11) * _P[0]
    h ^= h >> U(33)
    h *= _P[1]
    h ^= h >> U(29)
    h *= _P[2]
    h ^= h >> U(32)
    return h
