"""Word streams of whole texts as bytes, and 64-bit hashes of words and word n-grams."""

from __future__ import annotations

import numpy as np
import xxhash

WHITE = b" \t\n\x0b\x0c\r"
#: A-Z to a-z, every other byte as it is; split() then cuts at 0x20 and 0x09 to 0x0D.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: A-Z to a-z, letters, digits and bytes beyond ASCII kept, every other byte a blank.
LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))

#: A worker forgets the word hashes it has cached beyond this many, so its memory does not grow with the vocabulary.
CACHED_WORDS = 500_000
ODD = np.uint64(0x9E3779B97F4A7C15)


def spaced_words(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z only) words between white space; none for null."""
    return text.encode().translate(LOWER).split() if text else []


def letter_words(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z only) runs of digits, ASCII letters and characters beyond ASCII; none for null."""
    return text.encode().translate(LETTERS).split() if text else []


class WordHashes(dict):
    """word -> 64-bit hash, computed on first use."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHED_WORDS:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (xor-shift and multiply)."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(32))


def gram_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """One hash per run of ``width`` words; the whole sequence as one run if it is shorter, none if it is empty."""
    n = len(hashes)
    if n == 0:
        return hashes
    width = min(width, n)
    out = np.zeros(n - width + 1, dtype=np.uint64)
    for k in range(width):
        out = out * ODD + hashes[k : n - width + 1 + k]
        out ^= out >> np.uint64(31)
    return mixed(out + np.uint64(width))
