"""Sets of hashed word shingles."""

from __future__ import annotations

import numpy as np

from rolefit.llm.common import mix64

WORDS = 5
_BASE = 0xD1342543DE82EF95
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], np.uint64)
_LETTERS = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, n at least."""
    size = 1 << max(12, int(n - 1).bit_length())
    if size > 1 << 16:  # workers live long: the tables of rare long texts are not kept
        return _powers(n)
    if size not in _POWERS:
        _POWERS[size] = _powers(size)
    return _POWERS[size]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    def run(base: int) -> np.ndarray:
        out = np.full(n, base, np.uint64)
        out[:1] = 1
        return np.multiply.accumulate(out)

    return run(_BASE), run(_BASE_INVERSE)


def words_of(text: str) -> list[bytes]:
    """Words of the text with A-Z in lower case; they are parted by the ASCII blanks that bytes.split knows: space and 9 to 13."""
    return text.encode("utf-8", "surrogatepass").lower().split()


def word_hashes(words: list[bytes]) -> np.ndarray:
    """A 64-bit hash of each word: a polynomial over its bytes, scrambled."""
    if not words:
        return np.zeros(0, np.uint64)
    raw = np.frombuffer(b" ".join(words), np.uint8)
    up, down = powers(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_LETTERS[raw] * up[:len(raw)], out=sums[1:])
    blanks = np.flatnonzero(raw == 32)
    starts = np.concatenate(([0], blanks + 1))
    ends = np.concatenate((blanks, [len(raw)]))
    return mix64((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64) * np.uint64(0x2545F4914F6CDD1D))


def shingle_set(text: str) -> np.ndarray:
    """Distinct hashes of WORDS adjacent words, ascending; with fewer words the whole sequence is one; without words there is none."""
    h = word_hashes(words_of(text))
    if not len(h):
        return h
    span = min(WORDS, len(h))
    n = len(h) - span + 1
    total = np.full(n, span, np.uint64)
    for k in range(span):
        total += h[k:k + n] * _MULTIPLIERS[k]
    return np.unique(mix64(total))
