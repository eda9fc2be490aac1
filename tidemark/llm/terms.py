"""Terms of whole texts as 64-bit hashes: runs of ASCII letters, digits and bytes of other characters, A-Z lower-cased."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

from tidemark.llm.shingles import _CODE, RUN_BYTES, span_hashes

_B = np.arange(256)
_TERM = ((_B >= 48) & (_B <= 57)) | ((_B >= 65) & (_B <= 90)) | ((_B >= 97) & (_B <= 122)) | (_B >= 128)


def _run(texts: list[bytes], heads: tuple[int, ...]) -> Iterator[np.ndarray]:
    data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    edge = np.flatnonzero(np.diff(_TERM[data], prepend=False))
    starts, ends = edge[::2], edge[1::2]
    rows = [span_hashes(data, starts, stops, _CODE) for stops in (ends, *(np.minimum(starts + k, ends) for k in heads))] if len(starts) else [np.empty(0, np.uint64)] * (1 + len(heads))
    terms = np.stack(rows) if heads else rows[0]
    borders = np.searchsorted(starts, np.cumsum([0, *(len(t) + 1 for t in texts)])).tolist()
    for a, b in zip(borders[:-1], borders[1:], strict=True):
        yield terms[..., a:b]


def term_lists(texts: Iterable[bytes | None], heads: tuple[int, ...] = ()) -> Iterator[np.ndarray]:
    """The terms of each text in their order, repeats included; null is like an empty text.

    With heads, numbers of bytes, there is one row of terms and one of their first bytes for each number.
    """
    run, size = [], 0
    for t in texts:
        run.append(t or b"")
        size += len(run[-1])
        if size >= RUN_BYTES:
            yield from _run(run, heads)
            run, size = [], 0
    if run:
        yield from _run(run, heads)


def term_counts(texts: Iterable[bytes | None]) -> Iterator[int]:
    """How many terms each text has, repeats included."""
    for t in texts:
        yield int(np.count_nonzero(np.diff(_TERM[np.frombuffer(t, np.uint8)], prepend=False, append=False))) // 2 if t else 0
