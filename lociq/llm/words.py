"""Words and 64-bit word hashes of texts, as the Python operators need them."""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa
import xxhash

_UP = bytes(range(65, 91))
_LOW = bytes(range(97, 123))
#: A-Z lower-cased, all other bytes kept.
LOWER = bytes.maketrans(_UP, _LOW)
#: A-Z lower-cased, ASCII other than letters and digits turned into spaces.
PLAIN = bytes(b if b >= 128 else ord(chr(b).lower()) if chr(b).isalnum() else 32 for b in range(256))
SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"
MASK = (1 << 64) - 1


def let_go() -> None:
    """Gives freed memory back to the system; a worker that waits for its next task would keep it otherwise."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def encoded(text: str | None) -> bytes:
    return b"" if text is None else text.encode("utf-8", "surrogatepass")


def space_words(text: str | None, lower: bool = False) -> list[bytes]:
    """Words between spaces and the characters 9 to 13; bytes.split() parts at just these."""
    data = encoded(text)
    return (data.translate(LOWER) if lower else data).split()


def plain_words(text: str | None) -> list[bytes]:
    """Lower-cased runs of ASCII letters and digits and of all characters past ASCII."""
    return encoded(text).translate(PLAIN).split()


class WordHashes(dict):
    """64-bit hashes of words, kept up to a bound."""

    def __init__(self, most: int = 150_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit numbers whose bits all depend on each other."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the k consecutive words from each word on; len(h) - k + 1 of them, or none."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i in range(k):
        out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + h[i : i + n])
    return out


def distinct(a: np.ndarray) -> np.ndarray:
    """Sorted distinct values, by sorting; np.unique without counts goes by a hash table, which takes many times as long."""
    a = np.sort(a)
    return a[np.append(np.ones(min(1, len(a)), bool), a[1:] != a[:-1])]


def places_in(keys: np.ndarray, a: np.ndarray) -> np.ndarray:
    """Where each of `a` stands among the sorted keys; values are looked up in order, which memory serves faster."""
    order = np.argsort(a)
    out = np.empty(len(a), np.int64)
    out[order] = np.searchsorted(keys, a[order])
    return out


def window_min(a: np.ndarray, w: int) -> np.ndarray:
    """Least of the w values from each position on; len(a) - w + 1 of them, or none."""
    if len(a) < w:
        return a[:0]
    step = 1
    while step * 2 <= w:
        a = np.minimum(a[:-step], a[step:])
        step *= 2
    rest = w - step
    return np.minimum(a[:-rest], a[rest:]) if rest else a
