"""Vectorised word splitting and hashing over UTF-8 bytes (numpy).

Words are runs of bytes outside ASCII white space (0x20, 0x09-0x0D); A-Z is lower-cased first.
Hashes are 64-bit: a word's bytes go through an avalanche mix eight at a time, longer words through
XXH3, each of two families under its own seed. Nothing of a hash is linear in the bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

BASE = 0x9E3779B97F4A7C15
PIECE = 1 << 20  # bytes that are hashed at once; a longer text goes alone
LANES = 8  # eight bytes each: longer words are hashed one by one
FAMILIES = (0x243F6A8885A308D3, 0x13198A2E03707344)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def seeded(n: int, seed: int, odd: bool = False) -> np.ndarray:
    """n fixed 64-bit constants of a seed."""
    with np.errstate(over="ignore"):
        x = mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(BASE) + np.uint64(seed * 0x632BE59BD9B4E019 % 2**64))
    return x | np.uint64(1) if odd else x


def space_table() -> np.ndarray:
    t = np.zeros(256, bool)
    t[[0x20, 9, 10, 11, 12, 13]] = True
    return t


def lower_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint8)
    t[65:91] += 32
    return t


class Powers:
    """A base's powers and their inverses for prefix-sum hashing, grown on demand."""

    def __init__(self, base: int = BASE) -> None:
        self.base = base
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, PIECE + 1)
            up, down = np.full(size, self.base, np.uint64), np.full(size, pow(self.base, -1, 2**64), np.uint64)
            up[0] = down[0] = 1
            with np.errstate(over="ignore"):
                self.up, self.down = np.multiply.accumulate(up), np.multiply.accumulate(down)
        return self.up, self.down


def texts_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of a string or binary column without copying; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pa.compute.fill_null(column, "" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return off, raw


def runs(off: np.ndarray, piece: int = PIECE) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about `piece` bytes each."""
    lo, n = 0, len(off) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + piece, side="right")) - 1)
        yield lo, hi
        lo = hi


class WordHasher:
    def __init__(self) -> None:
        self.low, self.space = lower_table(), space_table()
        with np.errstate(over="ignore"):
            self.mask = np.uint64(2**64 - 1) >> (np.uint64(64) - np.arange(9, dtype=np.uint64) * np.uint64(8))
        self.mask[0] = 0

    def spans(self, raw: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of words; no word crosses a position in `starts`."""
        word = ~self.space[raw]
        begin, end = word.copy(), word.copy()
        begin[1:] &= ~word[:-1]
        end[:-1] &= ~word[1:]
        inner = starts[(starts > 0) & (starts < len(raw))]
        begin[inner] = word[inner]
        end[inner - 1] = word[inner - 1]
        return np.flatnonzero(begin), np.flatnonzero(end) + 1

    def hashes(self, raw: np.ndarray, lo: np.ndarray, hi: np.ndarray, family: int = 0) -> np.ndarray:
        size = hi - lo
        padded = np.concatenate([self.low[raw], np.zeros(8, np.uint8)])
        eight = np.lib.stride_tricks.as_strided(padded, (len(raw) + 1, 8), (1, 1))
        with np.errstate(over="ignore"):
            out = mix(size.astype(np.uint64) * np.uint64(BASE) + np.uint64(FAMILIES[family]))
            at = None
            for lane in range(LANES):
                at = np.flatnonzero(size > 8 * lane) if lane else np.flatnonzero(size > 0)
                if not len(at):
                    break
                x = eight[lo[at] + 8 * lane].view(np.uint64)[:, 0] & self.mask[np.minimum(size[at] - 8 * lane, 8)]
                out[at] = mix((out[at] ^ x) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(FAMILIES[1 - family]))
        for i in np.flatnonzero(size > 8 * LANES).tolist():
            out[i] = xxhash.xxh3_64_intdigest(padded[lo[i] : hi[i]], FAMILIES[family])
        return out

    def words(self, off: np.ndarray, raw: np.ndarray, families: tuple = (0,)) -> Iterator[tuple[int, list[np.ndarray], np.ndarray]]:
        """For runs of rows: first row, word hashes of them all by family, and each row's first word (one more at the end)."""
        for lo, hi in runs(off):
            part = raw[off[lo] : off[hi]]
            own = off[lo : hi + 1] - off[lo]
            if hi == lo + 1 and len(part) > 4 * PIECE:
                parts = [*self._long(part, families)]
                hashed = [np.concatenate([p[f] for p in parts] or [np.zeros(0, np.uint64)]) for f in range(len(families))]
                yield lo, hashed, np.array([0, len(hashed[0])])
                continue
            a, b = self.spans(part, own[:-1])
            yield lo, [self.hashes(part, a, b, f) for f in families], np.searchsorted(a, own)

    def _long(self, raw: np.ndarray, families: tuple) -> Iterator[list[np.ndarray]]:
        """A very long text in pieces that end at white space."""
        lo = 0
        while lo < len(raw):
            hi = min(len(raw), lo + PIECE)
            while hi < len(raw):
                gap = np.flatnonzero(self.space[raw[hi : hi + PIECE]])
                if len(gap):
                    hi += int(gap[0])
                    break
                hi = min(len(raw), hi + PIECE)
            part = raw[lo:hi]
            a, b = self.spans(part, np.zeros(1, np.int64))
            yield [self.hashes(part, a, b, f) for f in families]
            lo = hi


def shingle_sets(column: pa.Array, width: int = 5) -> Iterator[tuple[np.ndarray, tuple[int, int] | None]]:
    """Per row, the sorted distinct 64-bit hashes of its word shingles (fewer words: the whole as one),
    and a 128-bit key of the set as two signed numbers, one of each family of hashes (None: empty)."""
    hasher, coefs = WordHasher(), [seeded(width, seed, odd=True) for seed in (5, 6)]
    off, raw = texts_of(column)

    def total(x: np.ndarray) -> int:
        return int(mix(x).sum(dtype=np.uint64).astype(np.int64))

    with np.errstate(over="ignore"):
        for _, words, first in hasher.words(off, raw, (0, 1)):
            n = max(0, len(words[0]) - width + 1)
            rolled = [np.zeros(n, np.uint64) for _ in words]
            for out, own, coef in zip(rolled, words, coefs):
                for k in range(width if n else 0):
                    out += own[k : k + n] * coef[k]
                out[:] = mix(out)
            for a, b in zip(first[:-1], first[1:]):
                if b - a >= width:
                    one, other = (x[a : b - width + 1] for x in rolled)
                    items = np.unique(one)
                    if len(items) < len(one):
                        other = other[np.unique(one, return_index=True)[1]]
                    yield items, (total(items), total(other))
                elif b > a:
                    items, other = (mix((w[a:b] * c[: b - a]).sum(keepdims=True) + np.uint64(b - a)) for w, c in zip(words, coefs))
                    yield items, (total(items), total(other))
                else:
                    yield np.zeros(0, np.uint64), None
