"""Secret scan: Aho-Corasick keyword hits, regular expressions anchored near them, then embedded checksums.

One automaton pass over the ASCII-lower-cased text finds every keyword that a secret can begin with; the
expression of its kind is tried only where a keyword starts. Runs of lower-case hex digits have no keyword
and are found by length. Kinds with a checksum inside the secret are reported only if it holds.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.llm.scratch import ship

# The base kinds in the order in which equal starts are listed, their patterns and least lengths.
BASE_KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = re.compile(rb"[0-9a-f]{32,}")
ASSIGN_VALUE, ACCESS_LENGTH = 8, 16
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")

# Further kinds, each with its keywords and its pattern; their checksums follow.
CHECKED = {
    "github": (("ghp_", "gho_", "ghu_", "ghs_", "ghr_"), re.compile(rb"gh[pousr]_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")),
    "npm": (("npm_",), re.compile(rb"npm_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")),
    "jwt": (("eyj",), re.compile(rb"(eyJ[A-Za-z0-9_-]+)\.(eyJ[A-Za-z0-9_-]+)\.[A-Za-z0-9_-]{16,}")),
}
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
KINDS = (*BASE_KINDS, *CHECKED)


def base62_crc32(body: bytes) -> bytes:
    """The six digits that such tokens end with: the CRC-32 of what precedes, in base 62."""
    n, out = binascii.crc32(body), ""
    for _ in range(6):
        n, digit = divmod(n, 62)
        out = BASE62[digit] + out
    return out.encode()


def _is_header(part: bytes) -> bool:
    try:
        found = json.loads(base64.urlsafe_b64decode(part + b"=" * (-len(part) % 4)))
    except ValueError:
        return False
    return isinstance(found, dict) and "alg" in found


def _holds(kind: str, m: re.Match) -> bool:
    return _is_header(m[1]) if kind == "jwt" else base62_crc32(m[1]) == m[2]


@lru_cache
def _automaton() -> ahocorasick.Automaton:
    found: dict[str, list[str]] = {"akia": ["access"]}
    for word in ASSIGN_WORDS:
        found.setdefault(word, []).append("assign")
    for kind, (words, _) in CHECKED.items():
        for word in words:
            found.setdefault(word, []).append(kind)
    a = ahocorasick.Automaton()
    for word, kinds in found.items():
        a.add_word(word, (len(word), tuple(kinds)))
    a.make_automaton()
    return a


def byte_spans(text: bytes) -> list[tuple[int, int, str]]:
    """(start, end, kind) by start, then kind, in bytes. Matches of a kind do not overlap, the leftmost first."""
    out = [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    ends = dict.fromkeys(KINDS, 0)
    hits = sorted((end + 1 - n, kinds) for end, (n, kinds) in _automaton().iter(text.lower().decode("latin-1")))
    for start, kinds in hits:
        for kind in kinds:
            if start < ends[kind]:
                continue
            pattern = ASSIGN if kind == "assign" else ACCESS if kind == "access" else CHECKED[kind][1]
            if not (m := pattern.match(text, start)):
                continue
            ends[kind] = m.end()  # what fails below has still been matched
            if kind == "assign":
                ok = len(m[2]) >= ASSIGN_VALUE
            elif kind == "access":
                ok = m.end() - start >= ACCESS_LENGTH
            else:
                ok = _holds(kind, m)
            if ok:
                out.append((start, m.end(), kind))
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


def spans(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) of every secret in code points, end exclusive."""
    data = (text or "").encode()
    found = byte_spans(data)
    if len(data) == len(text or ""):
        return [(k, a, b) for a, b, k in found]
    out, at, points = [], 0, 0
    place = {}
    for p in sorted({x for a, b, _ in found for x in (a, b)}):
        points += len(data[at:p].decode())
        at = place[p] = p
        place[p] = points
    for a, b, k in found:
        out.append((k, place[a], place[b]))
    return out


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"]
    for batch in batches:
        rows = []
        for text in batch.column("text").to_pylist():
            found = spans(text)
            joined = lambda kinds, found=found: ",".join(f"{k}:{a}:{b}" for k, a, b in found if k in kinds)
            rows.append([*(sum(k == kind for k, _, _ in found) for kind in BASE_KINDS), hashlib.sha256(joined(BASE_KINDS).encode()).hexdigest(), joined(KINDS)])
        columns = list(zip(*rows, strict=True)) or [()] * 5
        kinds = [pa.int64()] * 3 + [pa.string()] * 2
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], names)


def scan_secrets(docs: DataFrame) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) for every row of docs (doc_id long, text string).

    spans lists kind:start:end of all kinds by start and then kind, base_sha256 is the digest of the same list
    of base kinds only. Letters of the assignment's keyword match in either ASCII case. A null text is like an
    empty one: no spans, the digest of an empty string. Other columns are ignored, repeated rows stay, an empty
    table gives no rows. One pass over each partition, without a shuffle.
    """
    ship(docs.sparkSession)
    docs = docs.selectExpr("cast(doc_id AS long) AS doc_id", "cast(text AS string) AS text")
    return docs.mapInArrow(_scan, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def redact_secrets(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """docs with every span of its text replaced by mark; null texts stay null, other columns stay as they are."""
    ship(docs.sparkSession)
    schema = docs.schema

    def clean(text: str | None) -> str | None:
        if text is None:
            return None
        out, at = [], 0
        for _, a, b in spans(text):
            if a >= at:
                out += [text[at:a], mark]
            at = max(at, b)
        return "".join([*out, text[at:]])

    def redact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("text")
            yield batch.set_column(at, batch.schema.field(at), pa.array([clean(t) for t in batch.column(at).to_pylist()], batch.schema.field(at).type))

    return docs.mapInArrow(redact, schema)
