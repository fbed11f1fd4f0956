"""Hashes of words, shingles and byte strings over batches of texts, vectorised with numpy."""

from __future__ import annotations

import numpy as np

U64 = np.uint64
BLANK = np.zeros(256, bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit numbers that spreads every bit over all others."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def keys(n: int, seed: int) -> np.ndarray:
    """n odd pseudo-random 64-bit numbers."""
    with np.errstate(over="ignore"):
        return mixed((np.arange(n, dtype=U64) + U64(1)) * U64(0x9E3779B97F4A7C15) + U64(seed)) | U64(1)


SHINGLE_KEYS = keys(64, 77)


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """A hash for each word (lower-cased A-Z) of all texts in turn, and the number of words of each text."""
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b" ".join(raw) + b" ", np.uint8)
    blank = BLANK[data]
    edge = np.flatnonzero(np.diff(blank, prepend=True))
    first, last = edge[0::2], edge[1::2]
    if not len(first):
        return np.zeros(0, U64), np.zeros(len(texts), np.int64)
    place = np.cumsum(np.bincount(first, minlength=len(data)), dtype=np.int64) - 1
    within = np.arange(len(data), dtype=np.int64) - first[np.maximum(place, 0)]
    table = keys(int((last - first).max()), 11)
    with np.errstate(over="ignore"):
        values = (LOWER[data].astype(U64) + U64(1)) * table[np.where(blank, 0, within)]
        values[blank] = 0
        out = mixed(np.add.reduceat(values, first) + (last - first).astype(U64) * U64(0xD6E8FEB86659FD93))
    starts = np.cumsum([0] + [len(r) + 1 for r in raw])
    return out, np.diff(np.searchsorted(first, starts))


def shingles(texts: list[str], width: int) -> list[np.ndarray]:
    """The sorted distinct hashes of each text's word shingles; of fewer than width words, of the whole sequence."""
    words, counts = word_hashes(texts)
    with np.errstate(over="ignore"):
        n = max(0, len(words) - width + 1)
        joined = np.zeros(n, U64)
        for k in range(width):
            joined += words[k : k + n] * SHINGLE_KEYS[k]
        joined = mixed(joined)
        out, at = [], 0
        for c in counts.tolist():
            if c >= width:
                out.append(np.unique(joined[at : at + c - width + 1]))
            elif c:
                short = (words[at : at + c] * SHINGLE_KEYS[:c]).sum(dtype=U64) + U64(c)
                out.append(mixed(np.array([short], U64)))
            else:
                out.append(np.zeros(0, U64))
            at += c
    return out
