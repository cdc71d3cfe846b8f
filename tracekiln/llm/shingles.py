"""Word hashes and word n-gram hashes of whole texts, in numpy.

A word is a maximal run of letters, digits and underscores (``\\w``) of the
lower-cased text.  Texts of a batch are hashed together: a polynomial prefix
hash over the bytes gives each word's hash from its two ends.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np

BASE = 0x9E3779B97F4A7C15
MASK = (1 << 64) - 1
BUFFER = 1 << 20
NGRAM = 5

ODD = re.compile(r"[^\x00-\x7f\w]")       # beyond ASCII, but no part of a word
NO_WORD = re.compile(r"\W+")
WORD_BYTE = np.zeros(256, bool)
WORD_BYTE[[*range(48, 58), *range(65, 91), 95, *range(97, 123), *range(128, 256)]] = True

_POWERS: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**k and BASE**-k modulo 2**64 for k < n."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, BUFFER + (1 << 16))
        _POWERS[:] = [np.concatenate((np.ones(1, np.uint64), np.cumprod(np.full(size, x, np.uint64))))
                      for x in (BASE, pow(BASE, -1, 1 << 64))]
    return _POWERS[0], _POWERS[1]


def mix(h: np.ndarray) -> np.ndarray:
    """Bijective finalizer of 64-bit values."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def word_text(text: str | None) -> bytes:
    """Lower-cased UTF-8 in which exactly the words' bytes are word bytes."""
    if not text:
        return b""
    low = text.lower()
    if not low.isascii() and ODD.search(low):
        low = NO_WORD.sub(" ", low)
    return low.encode("utf-8", "surrogatepass")


def _spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.flatnonzero(np.diff(WORD_BYTE[data], prepend=False, append=False))
    return edge[::2], edge[1::2]


def _hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    up, down = powers(len(data) + 1)
    prefix = np.empty(len(data) + 1, np.uint64)
    prefix[0] = 0
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:len(data)], out=prefix[1:])
    return mix((prefix[ends] - prefix[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def _parts(data: bytes) -> Iterator[bytes]:
    """A long text in pieces that end between words."""
    at = 0
    while len(data) - at > BUFFER:
        end = at + BUFFER
        while end < len(data) and WORD_BYTE[data[end - 1]]:
            end += 1
        yield data[at:end]
        at = end
    yield data[at:]


def words_of(texts: list[str | None]) -> Iterator[tuple[int, list[np.ndarray]]]:
    """(index of the first text, word hashes of it and the following ones), as
    many short texts at a time as fill a buffer."""
    held: list[bytes] = []
    size = first = 0
    for n, text in enumerate(texts):
        data = word_text(text)
        if held and size + len(data) > BUFFER:
            yield first, _hash_texts(held)
            held, size, first = [], 0, n
        held.append(data)
        size += len(data) + 1
    if held:
        yield first, _hash_texts(held)


def _hash_texts(held: list[bytes]) -> list[np.ndarray]:
    if len(held) == 1 and len(held[0]) > BUFFER:
        return [np.concatenate([_hash_all([p])[0] for p in _parts(held[0])])]
    return _hash_all(held)


def _hash_all(held: list[bytes]) -> list[np.ndarray]:
    data = np.frombuffer(b" ".join(held) + b" ", np.uint8)
    starts, ends = _spans(data)
    offsets = np.cumsum([len(h) + 1 for h in held])
    return np.split(_hash_spans(data, starts, ends), np.searchsorted(starts, offsets[:-1]))


def ngrams(words: np.ndarray, n: int = NGRAM) -> np.ndarray:
    """Hash of every run of ``n`` words; of a shorter text's words together, if any."""
    n = min(n, len(words))
    if not n:
        return np.zeros(0, np.uint64)
    total = np.zeros(len(words) - n + 1, np.uint64)
    for j in range(n):
        total += words[j:len(words) - n + 1 + j] * np.uint64(pow(BASE, 2 * j + 3, 1 << 64))
    return mix(total + np.uint64(n))


def word_list(text: str | None) -> list[str]:
    """The words themselves, for exact comparisons."""
    return re.findall(r"\w+", (text or "").lower())
