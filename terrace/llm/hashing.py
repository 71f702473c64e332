"""Word and n-gram hashes of many texts at once, without a Python loop over words.

The texts of a batch are laid end to end in one byte buffer.  A word's hash is
the polynomial sum of its bytes (each first drawn from a table of random 64-bit
values) modulo 2**64, taken as a difference of prefix sums and moved back to
position 0 by the inverse power, then mixed.  Two different words agree with a
chance of about 2**-64.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd

SPACES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_RNG = np.random.default_rng(20240229)
_DRAWN = _RNG.integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = int(_RNG.integers(2**61, 2**62)) * 2 + 1
_INVERSE = pow(_BASE, -1, 2**64)
_STEP = [np.uint64(int(x) * 2 + 1) for x in _RNG.integers(2**60, 2**62, 64)]
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(SPACES)] = True
_POWERS: dict[str, np.ndarray] = {}


def pieces(frame: pd.DataFrame, size: int = 1 << 19) -> Iterator[tuple[pd.DataFrame, list[bytes]]]:
    """The frame in parts of about ``size`` bytes of ``text``, each encoded only when it is its turn; null is empty."""
    at, texts, total = 0, [], 0
    for k, text in enumerate(frame.text):
        texts.append(b"" if text is None else text.encode("utf-8", "surrogatepass"))
        total += len(texts[-1])
        if total >= size or k == len(frame) - 1:
            yield frame.iloc[at : k + 1], texts
            at, texts, total = k + 1, [], 0


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (xor-shift and multiply)."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9FB21C651E98DF25)
    x = x ^ (x >> np.uint64(28))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    have = _POWERS.get("up")
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _POWERS[name] = np.cumprod(steps, dtype=np.uint64)
    return _POWERS["up"], _POWERS["down"]


def buffer_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The texts' bytes with one space after each, and where each begins (one more entry for the end)."""
    lengths = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    begins = np.zeros(len(texts) + 1, np.int64)
    np.cumsum(lengths, out=begins[1:])
    return np.frombuffer(b" ".join(texts) + b" ", np.uint8) if texts else np.zeros(0, np.uint8), begins


def spans_of(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the runs of non-space bytes begin and end."""
    space = _IS_SPACE[buf]
    edge = np.diff(space.astype(np.int8), prepend=1)
    return np.flatnonzero(edge == -1), np.flatnonzero(edge[1:] == 1) + 1


def hashes_of(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, piece: int = 1 << 19) -> np.ndarray:
    """A 64-bit hash of each span; the buffer is worked through in pieces cut between spans, so memory stays bounded."""
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        low = starts[at]
        to = max(at + 1, int(np.searchsorted(ends, low + piece, side="right")))
        s, e = starts[at:to] - low, ends[at:to] - low
        up, down = _powers(int(e[-1]))
        sums = np.zeros(int(e[-1]) + 1, np.uint64)
        np.cumsum(_DRAWN[buf[low : low + e[-1]]] * up[: e[-1]], out=sums[1:])
        out[at:to] = mix((sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64))
        at = to
    return out


def words_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words and, for each text, the index of its first (one more entry for the end)."""
    buf, begins = buffer_of(texts)
    starts, ends = spans_of(buf)
    return hashes_of(buf, starts, ends), np.searchsorted(starts, begins)


def ngrams(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of ``n`` words, texts' borders ignored; empty if there are fewer."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    total = np.zeros(len(words) - n + 1, np.uint64)
    for i in range(n):
        total += words[i : len(words) - n + 1 + i] * _STEP[i]
    return mix(total)


def shingle_sets(texts: list[bytes], n: int) -> list[np.ndarray]:
    """For each text its sorted distinct ``n``-word shingles; of fewer words, the whole sequence as one; of none, nothing."""
    words, first = words_of(texts)
    grams = ngrams(words, n)
    out = []
    for a, b in zip(first[:-1], first[1:]):
        if b - a >= n:
            out.append(np.unique(grams[a : b - n + 1]))
        elif b > a:
            out.append(ngrams(words[a:b], int(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
