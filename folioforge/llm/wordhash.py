"""Vectorised hashes of words and of runs of words, for many documents at once. numpy only."""

from __future__ import annotations

import numpy as np

U = np.uint64
#: Odd multipliers of two independent polynomial hashes of a word's bytes.
BYTE_BASES = (U(0x9E3779B97F4A7C15), U(0xC2B2AE3D27D4EB4F))
#: Masks of the first 0 to 8 bytes of a little-endian number.
FIRST_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], U)
#: Odd multiplier of the hash of a run of words, and its inverse modulo 2**64.
RUN_BASE = U(0xD6E8FEB86659FD93)
RUN_INVERSE = U(pow(int(RUN_BASE), -1, 1 << 64))
_POWERS: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser: every bit of the result depends on every bit of x."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; the table grows as needed."""
    have = _POWERS.get(int(base))
    if have is None or len(have) < n:
        size = max(1024, 1 << (n - 1).bit_length())
        table = np.ones(size, U)
        table[1:] = base
        have = _POWERS[int(base)] = np.multiply.accumulate(table)
    return have[:n]


class Words:
    """The words of some documents, end to end: ``hashes[k]`` by word, ``starts``/``counts`` by document."""

    def __init__(self, docs: list[list[bytes]], hashes: int = 2):
        self.counts = np.fromiter(map(len, docs), np.int64, len(docs))
        self.ends = np.cumsum(self.counts)
        self.starts = self.ends - self.counts
        self.n = int(self.ends[-1]) if len(docs) else 0
        flat = [w for d in docs for w in d]
        sizes = np.fromiter(map(len, flat), np.int64, self.n)
        raw = np.frombuffer(b"".join(flat), np.uint8).astype(U) + U(1)
        firsts = np.cumsum(sizes) - sizes
        inside = np.arange(len(raw)) - np.repeat(firsts, sizes)
        longest = int(sizes.max()) if self.n else 1
        self.hashes = []
        for base in BYTE_BASES[:hashes]:
            if self.n:
                self.hashes.append(mix(np.add.reduceat(raw * powers(base, longest)[inside], firsts) + sizes.astype(U) * base))
            else:
                self.hashes.append(np.zeros(0, U))

    def doc_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.counts)), self.counts)


def run_hashes(words: np.ndarray, first: np.ndarray, last: np.ndarray, salt: int = 0) -> np.ndarray:
    """Hash of the words first..last (both included) of each run, equal for equal sequences wherever they stand."""
    n = len(words)
    total = np.zeros(n + 1, U)
    np.cumsum(words * powers(RUN_BASE, max(1, n)), out=total[1:])
    inverse = powers(RUN_INVERSE, max(1, n))
    return mix((total[last + 1] - total[first]) * inverse[first] + (last - first + 1).astype(U) * U(0xA0761D6478BD642F) + U(salt))


def grams(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k consecutive words; n - k + 1 of them (also across documents: the caller masks those)."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, U)
    out = np.zeros(n, U)
    for j in range(k):
        out = out * RUN_BASE + words[j : j + n]
    return mix(out)
