"""64-bit hashes of word shingles for batches of whole texts, with numpy inside tasks.

Words are runs of bytes other than space and \\t..\\r, with A-Z lower-cased; a shingle is ``width``
consecutive words. A text with fewer words has its whole sequence as one shingle, one without words none.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

#: Texts are hashed in runs of about so many bytes; a longer text makes a run of its own.
RUN_BYTES = 1 << 20

_rng = np.random.Generator(np.random.PCG64(20240229))
_odd = lambda n: _rng.integers(0, 1 << 64, n, dtype=np.uint64) | np.uint64(1)
_BYTE = _odd(256)
_PLACE = _odd(64)
_BASE = int(_odd(1)[0])
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]

_B = np.arange(256)
_SPACE = (_B == 32) | ((_B >= 9) & (_B <= 13))
_LOWER = np.where((_B >= 65) & (_B <= 90), _B + 32, _B)
_CODE = _BYTE[_LOWER]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit (splitmix64's finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power_table(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        size = 1 << (n - 1).bit_length()
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _powers[k] = np.cumprod(p, dtype=np.uint64)
    return _powers


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of bytes that end with white space."""
    edge = np.flatnonzero(np.diff(_SPACE[data], prepend=True))
    return edge[::2], edge[1::2]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, codes: np.ndarray = _BYTE) -> np.ndarray:
    """A 64-bit hash of each span of bytes, wherever it stands; codes holds a random word for each byte."""
    up, down = _power_table(len(data))
    total = np.cumsum(codes[data] * up[: len(data)], dtype=np.uint64)
    before = np.where(starts > 0, total[starts - 1], np.uint64(0))
    return mix((total[ends - 1] - before) * down[starts] + (ends - starts).astype(np.uint64))


def _run(texts: list[bytes], width: int) -> list[np.ndarray]:
    data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    starts, ends = word_spans(data)
    words = span_hashes(data, starts, ends, _CODE)
    borders = np.cumsum([0, *(len(t) + 1 for t in texts)])
    first = np.searchsorted(starts, borders)
    out = []
    rolled = np.zeros(max(0, len(words) - width + 1), np.uint64)
    for j in range(width):
        rolled += words[j : j + len(rolled)] * _PLACE[j]
    for a, b in zip(first[:-1], first[1:], strict=True):
        if b - a >= width:
            h = mix(rolled[a : b - width + 1])
        elif b > a:
            w = np.append(words[a:b] * _PLACE[: b - a], _PLACE[40 + int(b - a) % 8])
            h = mix(np.array([w.sum(dtype=np.uint64)], np.uint64))
        else:
            h = np.empty(0, np.uint64)
        out.append(np.unique(h))
    return out


def shingle_sets(texts: Iterable[bytes | None], width: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text, in order; null is like an empty text."""
    if not 1 <= width <= 32:
        raise ValueError("width must be from 1 to 32")
    run, size = [], 0
    for t in texts:
        run.append(t or b"")
        size += len(run[-1])
        if size >= RUN_BYTES:
            yield from _run(run, width)
            run, size = [], 0
    if run:
        yield from _run(run, width)
