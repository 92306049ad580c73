"""Vectorised text kernel: words, their 64-bit hashes and n-gram hashes.

A batch of texts is one byte buffer with offsets (Arrow's own layout); every
step is a handful of numpy passes over that buffer, so no Python code runs per
word.  Texts are handled whole; a text, line or word longer than a block is hashed
block by block.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U64 = np.uint64

#: bytes that belong to a word, for the three word definitions in use
SPACE_WORD = np.ones(256, bool)
SPACE_WORD[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
ALNUM_WORD = np.zeros(256, bool)
ALNUM_WORD[0x30:0x3A] = ALNUM_WORD[0x61:0x7B] = ALNUM_WORD[0x80:] = True

LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20

_RNG = np.random.Generator(np.random.PCG64(20240607))
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)
_P = 0x9E3779B97F4A7C15 | 1
_P_INV = pow(_P, -1, 2**64)
_NGRAM = _RNG.integers(1, 2**63, 64, dtype=np.uint64) * U64(2) + U64(1)
#: bytes hashed at once: two tables of powers and three temporaries of eight times that size
_BLOCK = 1 << 18
_powers: list[np.ndarray] = [np.ones(1, U64), np.ones(1, U64)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers up to n, which is a block at most."""
    if len(_powers[0]) < n:
        size = max(n, 1 << 16)
        for k, base in enumerate((_P, _P_INV)):
            out = np.full(size, base, U64)
            out[0] = 1
            _powers[k] = np.cumprod(out)
    return _powers[0], _powers[1]


def _long_span(data: np.ndarray) -> int:
    """The sum for one span longer than a block, carried from block to block."""
    total, up = 0, _power(_BLOCK + 1)[0]
    for at in range(0, len(data), _BLOCK):
        own = data[at : at + _BLOCK]
        total += int((_BYTE[own] * up[: len(own)]).sum(dtype=U64)) * pow(_P, at, 2**64)
    return total % 2**64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on uint64."""
    x = (x ^ (x >> U64(32))) * U64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> U64(29))) * U64(0xBF58476D1CE4E5B9)
    return x ^ (x >> U64(32))


def buffer(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and n + 1 offsets of a string or binary column; null is empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    if col.null_count:
        col = col.fill_null("" if pa.types.is_string(col.type) or pa.types.is_large_string(col.type) else b"")
    _, offs, data = col.buffers()
    n = len(col)
    if not n or offs is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    at = np.frombuffer(offs, np.int64 if wide else np.int32)[col.offset : col.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def spans(inside: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of True that stay in one text."""
    n = len(inside)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = inside[1:]
    cut = offs[1:-1]
    cut = cut[(cut > 0) & (cut < n)]
    before[cut] = False
    after[cut - 1] = False
    return np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each span; spans are in order and apart."""
    out = np.empty(len(starts), U64)
    i = 0
    while i < len(starts):
        j = int(np.searchsorted(ends, starts[i] + _BLOCK, "right"))
        if j <= i:
            out[i] = _long_span(data[starts[i] : ends[i]])
            i += 1
            continue
        lo, hi = int(starts[i]), int(ends[j - 1])
        up, down = _power(hi - lo + 1)
        total = np.empty(hi - lo + 1, U64)
        total[0] = 0
        np.cumsum(_BYTE[data[lo:hi]] * up[: hi - lo], out=total[1:])
        a = starts[i:j] - lo
        out[i:j] = (total[ends[i:j] - lo] - total[a]) * down[a]
        i = j
    return mix(out + U64(1) * (ends - starts).astype(U64))


class Words:
    """The words of a batch of texts: byte spans, text index and hash."""

    def __init__(self, data: np.ndarray, offs: np.ndarray, inside: np.ndarray, lower: bool = True):
        self.data = LOWER[data] if lower else data
        self.offs = offs
        self.starts, self.ends = spans(inside[self.data], offs)
        self.hash = hash_spans(self.data, self.starts, self.ends)
        self.first = np.searchsorted(self.starts, offs).astype(np.int64)
        self.count = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(offs) - 1), self.count)

    @classmethod
    def of(cls, col: pa.Array, inside: np.ndarray = SPACE_WORD, lower: bool = True) -> "Words":
        return cls(*buffer(col), inside, lower)


def ngrams(tokens: np.ndarray, n: int) -> np.ndarray:
    """The hash of each window of n tokens, by its first token."""
    size = max(0, len(tokens) - n + 1)
    out = np.full(size, U64(n), U64)
    for k in range(n):
        out += tokens[k : k + size] * _NGRAM[k]
    return mix(out)


def sequence_hash(tokens: np.ndarray) -> int:
    """The hash of a short sequence of tokens, apart from those of n-grams."""
    total = 0xABCDEF + len(tokens)
    for k, t in enumerate(tokens.tolist()):
        total = (total + t * int(_NGRAM[32 + k % 32])) & (2**64 - 1)
    return int(mix(np.array([total], U64))[0])


def code_points(data: np.ndarray) -> np.ndarray:
    """n + 1 numbers: code points that begin before each byte."""
    out = np.empty(len(data) + 1, np.int64)
    out[0] = 0
    np.cumsum((data & 0xC0) != 0x80, out=out[1:])
    return out


def blob(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x).tobytes()


def unblob(col: pa.Array | pa.ChunkedArray, kind: type) -> np.ndarray:
    """All values of a binary column of packed numbers, in row order."""
    return np.frombuffer(buffer(col)[0].tobytes(), kind)


class Bits:
    """A Bloom filter in 2**parts equal segments, so that each segment can be
    built by one task and the whole has a fixed size.

    A key's segment is given by its top bits; k bits of the segment are set for
    a key and level.  Levels hold quantised counts: a key with level q answers
    yes to levels 1 to q.
    """

    def __init__(self, parts: int, log2_bits: int, k: int, data: np.ndarray | None = None):
        self.parts, self.log2_bits, self.k = parts, log2_bits, k
        self.seg = log2_bits - parts
        self.data = data

    def _seed(self, keys: np.ndarray, level: int | np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        g = mix(keys + np.asarray(level).astype(U64) * U64(0xA0761D6478BD642F))
        return g, (g * U64(0xE7037ED1A0B428DB) >> U64(9)) | U64(1)

    def _spot(self, g: np.ndarray, step: np.ndarray, i: int) -> np.ndarray:
        return ((g + U64(i) * step) >> U64(7)) & U64((1 << self.seg) - 1)

    def segment(self, keys: np.ndarray, levels: np.ndarray) -> bytes:
        """The bytes of one segment that holds the keys up to their levels."""
        bits = np.zeros(1 << self.seg, bool)
        order = np.argsort(-levels.astype(np.int64), kind="stable")
        keys, levels = keys[order], levels[order]
        for level in range(1, int(levels[0]) + 1 if len(levels) else 1):
            n = int(np.searchsorted(-levels.astype(np.int64), -level, "right"))
            g, step = self._seed(keys[:n], level)
            for i in range(self.k):
                bits[self._spot(g, step, i).astype(np.int64)] = True
        return np.packbits(bits, bitorder="little").tobytes()

    def has(self, keys: np.ndarray, level: int | np.ndarray = 1) -> np.ndarray:
        yes = np.zeros(len(keys), bool)
        left, (g, step) = np.arange(len(keys)), self._seed(keys, level)
        base = (keys >> U64(64 - self.parts)) << U64(self.seg) if self.parts else np.zeros(len(keys), U64)
        for i in range(self.k):
            at = self._spot(g, step, i) + base
            hit = np.flatnonzero((self.data[(at >> U64(3)).astype(np.int64)] >> (at & U64(7)).astype(np.uint8)) & 1)
            left = left[hit]
            if i < self.k - 1:
                g, step, base = g[hit], step[hit], base[hit]
        yes[left] = True
        return yes

    def level(self, keys: np.ndarray, most: int) -> np.ndarray:
        """The level that each key is held with: probes at levels 1, 2, 4, ... until
        a miss, then between the last two."""
        out = np.zeros(len(keys), np.int64)
        left, top = np.arange(len(keys)), 1
        while len(left) and top <= most:
            left = left[self.has(keys[left], top)]
            out[left] = top
            top *= 2
        step = top // 2
        while step > 1:
            step //= 2
            some = np.flatnonzero((out > step) & (out + step <= most))
            # a key whose last hit is at 2**n may gain less than 2**n
            some = some[out[some] + step < 2 * (1 << np.log2(out[some]).astype(np.int64))]
            some = some[self.has(keys[some], out[some] + step)]
            out[some] += step
        return out
