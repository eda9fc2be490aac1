"""Encoding of whole texts with a memo of pieces, for tokenizers that never join what white space separates."""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np

from tidemark.llm.shingles import span_hashes, word_spans

#: Pieces that one worker remembers; a full memo starts anew.
MEMO_PIECES = 1_500_000
#: New pieces gather so many before they are merged into the memo.
RECENT_PIECES = 50_000
#: Texts are split into pieces so many bytes at a time, and new pieces encoded so many at a time.
RUN_BYTES, ENCODE_PIECES = 1 << 18, 2048

_B = np.arange(256)
_LETTER = ((_B >= 65) & (_B <= 90)) | ((_B >= 97) & (_B <= 122))
_ENDING = np.isin(_B, np.frombuffer(b".,!?;:$%*#&", np.uint8))


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache
def tokenizer_version(path: str) -> str:
    """Digest of the tokenizer's file and the library that reads it."""
    import tokenizers

    with open(path, "rb") as f:
        return hashlib.sha256(f.read() + tokenizers.__version__.encode()).hexdigest()[:16]


class _Memo:
    """Places and numbers of ids by a piece's hash, sorted."""

    def __init__(self) -> None:
        self.keys, self.at, self.n = np.empty(0, np.uint64), np.empty(0, np.uint32), np.empty(0, np.int32)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which keys are known, and where."""
        if not len(self.keys):
            return np.zeros(len(keys), bool), np.zeros(len(keys), np.int64)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return self.keys[at] == keys, at

    def add(self, keys: np.ndarray, at: np.ndarray, n: np.ndarray) -> None:
        """Takes new keys, sorted."""
        place = np.searchsorted(self.keys, keys)
        self.keys, self.at, self.n = np.insert(self.keys, place, keys), np.insert(self.at, place, at), np.insert(self.n, place, n)


def _gather(ids: np.ndarray, at: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The runs of n ids from each at on, one after the other."""
    ends = np.cumsum(n, dtype=np.int64)
    return ids[np.repeat(at - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)]


class WordEncoder:
    """Ids of texts under a BPE whose pre-tokens never span white space nor the border from a letter to a mark of
    punctuation, as the library gives them for the whole text.

    A text is cut at its white space, and words from the last ASCII letter to one of a few marks, neither of which is
    inside a special token. Its ids are those of the pieces in order; a piece that a worker has seen is not encoded
    again. Pieces are told apart by 64-bit hashes. Checked against the library on whole texts in the tests.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.kind = np.uint16 if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else np.uint32
        self._forget()

    def _forget(self) -> None:
        self.memo, self.recent = _Memo(), _Memo()
        self.ids, self.used = np.empty(1 << 16, self.kind), 0

    def _learn(self, keys: np.ndarray, pieces: list[str]) -> None:
        n, ids = [], []
        for i in range(0, len(pieces), ENCODE_PIECES):
            for e in self.tokenizer.encode_batch_fast(pieces[i : i + ENCODE_PIECES], add_special_tokens=False):
                own = e.ids
                n.append(len(own))
                ids += own
        if self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids[: self.used], np.empty(self.used + 2 * len(ids), self.kind)])
        self.ids[self.used : self.used + len(ids)] = ids
        n = np.array(n, np.int64)
        self.recent.add(keys, (self.used + np.cumsum(n) - n).astype(np.uint32), n.astype(np.int32))
        self.used += len(ids)

    def _run(self, texts: list[bytes]) -> Iterator[np.ndarray]:
        if len(self.recent.keys) > RECENT_PIECES:
            if len(self.memo.keys) > MEMO_PIECES or self.used > 16 * MEMO_PIECES:
                self._forget()
            else:
                self.memo.add(self.recent.keys, self.recent.at, self.recent.n)
                self.recent = _Memo()
        raw = b" ".join(texts) + b" "
        data = np.frombuffer(raw, np.uint8)
        starts, ends = word_spans(data)
        inner = np.flatnonzero(_LETTER[data[:-1]] & _ENDING[data[1:]]) + 1
        starts, ends = np.sort(np.concatenate([starts, inner])), np.sort(np.concatenate([ends, inner]))
        keys, first, back = np.unique(span_hashes(data, starts, ends), return_index=True, return_inverse=True)
        known, place = self.memo.find(keys)
        new = np.flatnonzero(~known)
        new = new[~self.recent.find(keys[new])[0]]
        if len(new):
            self._learn(keys[new], [raw[a:b].decode() for a, b in zip(starts[first[new]].tolist(), ends[first[new]].tolist(), strict=True)])
        n, at = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        n[known], at[known] = self.memo.n[place[known]], self.memo.at[place[known]]
        later, place = self.recent.find(keys)
        later &= ~known
        n[later], at[later] = self.recent.n[place[later]], self.recent.at[place[later]]
        counts = n[back]
        ids = _gather(self.ids, at[back], counts)
        borders = np.searchsorted(starts, np.cumsum([0, *(len(t) + 1 for t in texts)]))
        cuts = np.concatenate([[0], np.cumsum(counts)])[borders]
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            yield ids[a:b]

    def encode(self, texts: Iterable[bytes | None]) -> Iterator[np.ndarray]:
        """The ids of each text, in order, of which the bytes are UTF-8; null is like an empty text."""
        run, size = [], 0
        for t in texts:
            run.append(t or b"")
            size += len(run[-1])
            if size >= RUN_BYTES:
                yield from self._run(run)
                run, size = [], 0
        if run:
            yield from self._run(run)


@lru_cache
def encoder(path: str) -> WordEncoder:
    return WordEncoder(path)
