"""Vectorised 64-bit hashes of words, word shingles and character shingles over a buffer of many texts.

A hash of a byte range is a polynomial in an odd base modulo 2**64, taken as a difference of prefix sums and
moved to position 0 by the base's inverse, then mixed. Every function gets bytes and n+1 offsets.
"""

from __future__ import annotations

import numpy as np

U = np.uint64
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)
SEGMENT = 1 << 17
WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
_powers = {"up": np.ones(1, U), "down": np.ones(1, U)}


def _power(kind: str, n: int) -> np.ndarray:
    have = _powers[kind]
    if len(have) < n:
        size = max(n, 2 * len(have), 4096)
        steps = np.full(size, BASE if kind == "up" else INVERSE, U)
        steps[0] = 1
        have = _powers[kind] = np.cumprod(steps)
    return have


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the finaliser of splitmix64)."""
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _ranges(data: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Hashes of byte ranges of one segment."""
    n = len(data)
    sums = np.zeros(n + 1, U)
    np.cumsum((data.astype(U) + U(1)) * _power("up", n)[:n], out=sums[1:])
    return mix((sums[stop] - sums[start]) * _power("down", n + 1)[start])


def words(data: np.ndarray, at: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word (run of bytes outside 09-0D and 20) and the number of words of each text."""
    n = len(data)
    if lower:
        data = LOWER[data]
    white = WHITE[data]
    before = np.ones(n + 1, bool)
    before[1:] = white
    cut = at[(at > 0) & (at < n)]
    before[cut] = True
    after = np.ones(n, bool)
    after[:-1] = white[1:]
    after[cut - 1] = True
    solid = ~white
    start = np.flatnonzero(solid & before[:-1])
    stop = np.flatnonzero(solid & after) + 1
    counts = np.diff(np.searchsorted(start, at))
    out = np.empty(len(start), U)
    low = 0
    while low < len(start):  # segments that begin and end with a word
        high = max(low + 1, int(np.searchsorted(stop, start[low] + SEGMENT, side="right")))
        a, b = start[low], stop[high - 1]
        out[low:high] = _ranges(data[a:b], start[low:high] - a, stop[low:high] - a)
        low = high
    return out, counts


def word_shingles(hashes: np.ndarray, counts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every k-word shingle, in order; a text of fewer words has its whole sequence as one, none without words."""
    n = len(hashes)
    first = np.cumsum(counts) - counts
    odd = [U(pow(0xD1342543DE82EF95, j + 1, 1 << 64) | 1) for j in range(k)]
    total = hashes * odd[0]
    for j in range(1, min(k, n)):
        total[: n - j] += hashes[j:] * odd[j]
    short = np.flatnonzero((counts > 0) & (counts < k))
    made = np.maximum(counts - k + 1, (counts > 0).astype(counts.dtype))
    value = np.zeros(len(short), U)
    for j in range(k - 1):
        more = counts[short] > j
        value[more] += hashes[first[short][more] + j] * odd[j]
    keep = np.arange(n) - np.repeat(first, counts) < np.repeat(made, counts)
    total[first[short]] = value + counts[short].astype(U)
    return mix(total[keep]), made


def mix32(x: np.ndarray) -> np.ndarray:
    """A bijection of 32-bit numbers that spreads every bit (the finaliser of murmur3)."""
    x = x ^ (x >> np.uint32(16))
    x *= np.uint32(0x85EBCA6B)
    x ^= x >> np.uint32(13)
    x *= np.uint32(0xC2B2AE35)
    x ^= x >> np.uint32(16)
    return x


def windows(codes: np.ndarray, k: int, kind: type = np.uint32) -> np.ndarray:
    """Polynomial of every k consecutive codes (the last k-1 results are of no use), by doubling."""
    base = 0x9E3779B1 if kind is np.uint32 else BASE
    wide = 1 << (32 if kind is np.uint32 else 64)

    def of(width: int) -> np.ndarray:
        if width == 1:
            return codes.astype(kind) + kind(1)
        half = width // 2
        low = of(half)
        high = low if half * 2 == width else of(width - half)
        if len(low) <= half:
            return low
        out = np.empty_like(low)
        np.multiply(high[half:], kind(pow(base, half, wide)), out=out[:-half])
        out[:-half] += low[:-half]
        out[-half:] = low[-half:]
        return out

    return of(k)


def char_shingles(codes: np.ndarray, at: np.ndarray, k: int, kind: type = np.uint32, padded: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every run of k codes of each group, in order; a shorter group is one shingle, an empty one has none.

    Padded, a group keeps all its places, and those beyond its last shingle repeat its first one: the same set, not copied.
    """
    counts = np.diff(at)
    made = np.maximum(counts - k + 1, (counts > 0).astype(counts.dtype))
    value = windows(codes, k, kind)
    base = 0x9E3779B1 if kind is np.uint32 else BASE
    wide = 1 << (32 if kind is np.uint32 else 64)
    short = np.flatnonzero((counts > 0) & (counts < k))
    alone = counts[short].astype(kind)
    for j in range(k - 1):
        more = counts[short] > j
        alone[more] += (codes[at[short][more] + j].astype(kind) + kind(1)) * kind(pow(base, j + k, wide))
    value[at[short]] = alone
    # Of a group's places those beyond its last shingle go: at most k - 1, at its end.
    if padded:
        for j in range(1, k):
            more = counts >= j + 1
            value[at[1:][more] - j] = value[at[:-1][more]]
        return (mix32 if kind is np.uint32 else mix)(value), counts
    keep = np.ones(len(codes), bool)
    for j in range(1, k):
        keep[at[1:][counts >= j + 1] - j] = False
    value = value[keep]
    return (mix32 if kind is np.uint32 else mix)(value), made


def bounds_of(counts: np.ndarray) -> np.ndarray:
    out = np.zeros(len(counts) + 1, np.int64)
    np.cumsum(counts, out=out[1:])
    return out


def distinct(values: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct values of each group, and their numbers."""
    at, out = bounds_of(counts), values.copy()
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        out[a:b].sort()
    new = np.ones(len(out), bool)
    new[1:] = out[1:] != out[:-1]
    new[at[:-1][counts > 0]] = True
    return out[new], np.diff(np.append(0, np.cumsum(new))[at])


#: A Mersenne prime; x -> (a x + b) mod it are universal permutations of the numbers below it.
PRIME = (1 << 31) - 1


def universal(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Multipliers (not 0) and addends of n universal hash permutations of the numbers below PRIME."""
    rng = np.random.default_rng(seed)
    return rng.integers(1, PRIME, n, dtype=U), rng.integers(0, PRIME, n, dtype=U)


def universal_minhash(values: np.ndarray, counts: np.ndarray, n: int, seed: int, block: int = 1 << 15) -> np.ndarray:
    """The minima of n universal permutations over each group of 32-bit hashes, of which 31 bits count; all ones for none."""
    mult, add = universal(n, seed)
    out = np.full((len(counts), n), 0xFFFFFFFF, np.uint32)
    at = bounds_of(counts)
    low = 0
    while low < len(counts):
        high = max(low + 1, int(np.searchsorted(at, at[low] + block, side="right")) - 1)
        full = low + np.flatnonzero(counts[low:high])
        for a in range(int(at[low]), int(at[high]), block):
            x = (values[a : min(a + block, int(at[high]))] >> np.uint32(1)).astype(U)
            heads = np.maximum(at[full] - a, 0)
            for j in range(n):
                y = x * mult[j] + add[j]  # below 2**62
                y = (y & U(PRIME)) + (y >> U(31))
                y = (y & U(PRIME)) + (y >> U(31))  # at most PRIME, which stands for 0 of one number
                out[full, j] = np.minimum(out[full, j], np.minimum.reduceat(y, heads).astype(np.uint32))
        low = high
    return out


def family(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Odd multipliers and addends of n hash permutations of the 32-bit numbers."""
    rng = np.random.default_rng(seed)
    return rng.integers(0, 1 << 32, n, dtype=np.uint32) | np.uint32(1), rng.integers(0, 1 << 32, n, dtype=np.uint32)


def minhash(values: np.ndarray, counts: np.ndarray, n: int, seed: int, block: int = 1 << 16) -> np.ndarray:
    """The minima of n permutations over each group of 32-bit shingle hashes; all ones for an empty group.

    Blocks of about ``block`` values are permuted at once, and groups' minima taken by one reduction; a longer group is
    reduced block by block.
    """
    mult, add = family(n, seed)
    out = np.full((len(counts), n), 0xFFFFFFFF, np.uint32)
    at = bounds_of(counts)
    work = np.empty(max(block, 1), np.uint32)
    low = 0
    while low < len(counts):
        high = max(low + 1, int(np.searchsorted(at, at[low] + block, side="right")) - 1)
        full = low + np.flatnonzero(counts[low:high])
        for a in range(int(at[low]), int(at[high]), block):
            x = values[a : min(a + block, int(at[high]))]
            heads = np.maximum(at[full] - a, 0) if len(full) else full
            for j in range(n):
                part = np.multiply(x, mult[j], out=work[: len(x)])
                part += add[j]
                out[full, j] = np.minimum(out[full, j], np.minimum.reduceat(part, heads))
        low = high
    return out


def top32(x: np.ndarray) -> np.ndarray:
    return (x >> U(32)).astype(np.uint32)


def band_keys(signature: np.ndarray, rows: int) -> np.ndarray:
    """A 64-bit key of each band of so many consecutive signature columns; the band's number is part of it."""
    n, bands = len(signature), signature.shape[1] // rows
    key = np.broadcast_to(mix(np.arange(1, bands + 1, dtype=U)), (n, bands)).copy()
    parts = signature[:, : bands * rows].reshape(n, bands, rows).astype(U)
    for j in range(rows):
        key = mix(key * U(3) + parts[:, :, j] + U(1))
    return key
