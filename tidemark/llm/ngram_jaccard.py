"""N-gram Jaccard join by parity sketches.

A text's distinct word shingles are XOR-hashed into parity sketches, one for each size band it can have
partners in. Within a band a sketch has K segments and each shingle belongs to one of them, so two sets that
differ in D shingles differ in at most D segments: a segment's XOR is a parity of what lies in it, and a
shingle that both sets hold cancels. Sets of s and t shingles with a Jaccard similarity of at least p/100
differ in at most (s + t)(100 - p)/(100 + p) shingles, which bounds D in the band; with more segments than
that, linked sets share the XOR of one (pigeonhole). Equal XORs of segments that are empty say nothing; a
set with too few filled segments for the bound also emits the shingles of its Jaccard prefix, and two such
sets meet there. Candidates pass a size test and the Hamming distance of a flat parity sketch, which never
exceeds the symmetric difference, and are then verified on the sets themselves.

Buckets are read as streams that keep one hub for each key: members are compared with the hub first and linked
members are joined into components. Buckets with members in different components after that are compared in cells
of two bounded blocks, where what links is joined at once; a cell gives fewer rows than it has members, never its
pairs. Before, each set leaves out as many of the largest of these buckets as the bound on D lets it do without,
so what very many unlike texts share makes no large bucket. Every pair of different texts that could link is thus
either in one component or was compared. Shingles are compared as 64-bit hashes, and sets with an equal 64-bit
hash of all their shingles are one.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.cells import by_cell, roots
from tidemark.llm.components import components, merged
from tidemark.llm.scratch import Scratch
from tidemark.llm.shingles import mix, shingle_sets

#: Bytes of segment rows that one reduce task is meant to read.
REDUCE_BYTES = 12 << 20
#: A reduce task merges its input in steps of so many segment rows.
MERGE_ROWS = 1 << 20
#: A map task sorts its segment rows after so many.
EMIT_ROWS = 1 << 19
#: A key with more rows than this in one map task's block is hot.
HOT_ROWS = 64
#: Sets of a bucket, and about so many shingles of them, that are compared with each other at a time.
BLOCK, BLOCK_SHINGLES = 512, 1 << 19
#: Cells are verified in turns of so many bytes of sets, as a part of the texts' bytes, and of so many at least.
SLICE, SLICE_BYTES = 0.25, 64 << 20
#: Least and most columns of a flat sketch, whose number is the power of two from the set's size on.
COLUMNS = (512, 1 << 17)

_META, _PAIR, _MEMBER = 0, 1, 2


@lru_cache
def band_edges(limit: int = 1 << 40) -> tuple[int, ...]:
    """First sizes of the bands: 1 to 5, then half as large again each time."""
    edges = [1, 2, 3, 4, 5]
    while edges[-1] < limit:
        edges.append(edges[-1] + (edges[-1] + 1) // 2)
    return tuple(edges)


def most_different(s: int, t: int, percent: int) -> int:
    """Largest symmetric difference of linked sets of s and t elements."""
    return (s + t) * (100 - percent) // (100 + percent)


@lru_cache(maxsize=4096)
def instances(size: int, percent: int) -> tuple[tuple[int, int, int], ...]:
    """(band, most different, segments) for each band in which a set of this size has partners, its own first."""
    edges = band_edges()
    own = int(np.searchsorted(edges, size, "right")) - 1
    last = int(np.searchsorted(edges, size * 100 // percent, "right")) - 1
    out = []
    for band in range(own, last + 1):
        high = edges[band + 1] - 1
        d = most_different(high, high, percent)
        out.append((band, d, d + 1 + (3 * d + 9) // 10 + (d > 0)))
    return tuple(out)


def _seed(band: int) -> np.uint64:
    return np.uint64((band * 0x9E3779B97F4A7C15 + 0x1234567) & 0xFFFFFFFFFFFFFFFF)


#: The last bits of a key name its band; those of a Jaccard prefix have the last number.
BAND_BITS, PREFIX_TAG = 7, 127
#: A number of keys that a set can do without takes so many bits, for at most so many bands.
SPARE_BITS, SPARE_BANDS = 14, 4


def _tagged(key: np.ndarray, tag: int) -> np.ndarray:
    return (key & ~np.uint64(PREFIX_TAG)) | np.uint64(min(tag, PREFIX_TAG))


def signatures(u: np.ndarray, percent: int) -> tuple[np.ndarray, int]:
    """Keys under which a sorted set of shingle hashes meets every set that it may link with, and its spare keys.

    Linked sets share at least f - d keys of a band in which one of them has f filled segments and d may differ, so in
    any order of all keys they still meet if each leaves out its last f - d - 1. That number is packed for each band
    behind the number of the set's own band.
    """
    keys, size, spare = [], len(u), 0
    spread, top = mix(u ^ np.uint64(0x5851F42D4C957F2D)), u >> np.uint64(32)
    for k_band, (band, d, k) in enumerate(instances(size, percent)):
        seg = (top * np.uint64(k)) >> np.uint64(32)  # u is sorted, so a segment is a run
        starts = np.flatnonzero(np.diff(seg, prepend=np.uint64(k)))
        keys.append(_tagged(mix(np.bitwise_xor.reduceat(spread, starts) + seg[starts] * np.uint64(0xD6E8FEB86659FD93) + _seed(band)), band))
        if k_band == 0:
            spare |= band
        if len(starts) <= d:
            prefix = size - (size * percent + 99) // 100 + 1
            keys.append(_tagged(mix(u[:prefix] * np.uint64(0xA0761D6478BD642F) + _seed(band + 1000)), PREFIX_TAG))
        elif k_band < SPARE_BANDS:
            spare |= min(len(starts) - d - 1, (1 << SPARE_BITS) - 1) << (BAND_BITS + k_band * SPARE_BITS)
    return np.concatenate(keys), spare


def flat_sketch(u: np.ndarray) -> bytes:
    """Parity of the shingles in each column: one XOR of a bit per shingle. Halves can be folded by XOR."""
    wide = min(COLUMNS[1], max(COLUMNS[0], 1 << max(0, len(u) - 1).bit_length()))
    column = mix(u ^ np.uint64(0x2545F4914F6CDD1D)) & np.uint64(wide - 1)
    return np.packbits((np.bincount(column.astype(np.int64), minlength=wide) & 1).astype(np.uint8)).tobytes()


def folded(sketch: bytes, size: int) -> np.ndarray:
    """A sketch with its halves XORed until it has size bytes, as 64-bit words."""
    x = np.frombuffer(sketch, np.uint64)
    while len(x) * 8 > size:
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return x


def _texts(batch: pa.RecordBatch) -> list[bytes | None]:
    return batch.column("text").cast(pa.binary()).to_pylist()


def _blocks(keys: list[np.ndarray], owners: list[np.ndarray], parts: int) -> Iterator[tuple[int, bytes]]:
    """Sorted (key, owner) rows for each reduce task. Of a key with very many rows all but three go to a task of their own.

    The third row goes to both, so that their hubs are compared with one set at least.
    """
    k, o = np.concatenate(keys), np.concatenate(owners)
    order = np.argsort(k, kind="stable")
    k, o = k[order], o[order]
    part = ((k >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
    starts = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1])))
    run = np.diff(np.append(starts, len(k)))
    if (run > HOT_ROWS).any():
        place = np.arange(len(k)) - np.repeat(starts, run)
        hot = np.repeat(run > HOT_ROWS, run)
        other = mix(k ^ mix(np.repeat(o[starts], run).view(np.uint64)))
        part = np.where(hot & (place > 2), ((other >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32), part)
        both = np.flatnonzero(hot & (place == 2))
        k, o = np.concatenate([k, k[both]]), np.concatenate([o, o[both]])
        part = np.concatenate([part, part[both + 1]])
        order = np.lexsort((k, part))
        k, o, part = k[order], o[order], part[order]
    cuts = np.flatnonzero(np.diff(part, prepend=np.uint64(parts)))
    for i, j in zip(cuts, [*cuts[1:], len(k)], strict=True):
        yield int(part[i]), b"S" + k[i:j].tobytes() + o[i:j].tobytes()


def _identity(u: np.ndarray) -> int:
    """A 64-bit number for a set, as a signed one; equal sets are one node of the search."""
    if not len(u):
        return 0
    both = np.array([mix(u).sum(dtype=np.uint64), np.bitwise_xor.reduce(mix(u + np.uint64(77)))], np.uint64)
    return int(mix(both + np.array([len(u), 0], np.uint64))[::-1].cumsum(dtype=np.uint64)[-1].view(np.int64))


def _emit(batches: Iterator[pa.RecordBatch], parts: int, width: int, percent: int) -> Iterator[pa.RecordBatch]:
    """Blocks (p, data) for reduce task p: sorted (key, node) pairs, and facts of texts with their sketches."""

    def table(blocks: list[tuple[int, bytes]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([b[0] for b in blocks], pa.int32()), pa.array([b[1] for b in blocks], pa.binary())], ["p", "data"])

    for batch in batches:
        docs = batch.column("doc_id").to_numpy()
        facts, sketches, keys, owners, seen, rows = [], [], [], [], set(), 0

        def full() -> list[tuple[int, bytes]]:
            out = []
            if facts:
                own = np.array(facts, np.int64)
                out.append((int(mix(own[:1, 0].view(np.uint64))[0] % np.uint64(parts)), b"F" + np.int64(len(own)).tobytes() + own.tobytes() + b"".join(sketches)))
            if keys:
                out += _blocks(keys, owners, parts)
            for x in (facts, sketches, keys, owners):
                x.clear()
            seen.clear()
            return out

        for doc, u in zip(docs, shingle_sets(_texts(batch), width), strict=True):
            node, spare, sketch = _identity(u), 0, b""
            if len(u) and node not in seen:  # a copy nearby is the same node and needs nothing of its own
                seen.add(node)
                sketch = flat_sketch(u)
                if most_different(len(u), len(u) * 100 // percent, percent) > 0:
                    own, spare = signatures(u, percent)
                    keys.append(own)
                    owners.append(np.full(len(own), node, np.int64))
                    rows += len(own)
            sketches.append(sketch)
            facts.append((doc, len(u), node, spare, len(sketch)))
            if rows >= EMIT_ROWS:
                yield table(full())
                rows = 0
        yield table(full())


class _Hubs:
    """The first document of each key so far, with the second while there are two only."""

    def __init__(self) -> None:
        self.keys = np.empty(0, np.uint64)
        self.hub = self.second = self.count = np.empty(0, np.int64)

    def add(self, keys: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct (hub, doc) pairs, and (key, doc) rows of the keys that three or more documents share."""
        order = np.lexsort((docs, keys))
        keys, docs = keys[order], docs[order]
        fresh = np.ones(len(keys), bool)
        fresh[1:] = (keys[1:] != keys[:-1]) | (docs[1:] != docs[:-1])
        keys, docs = keys[fresh], docs[fresh]
        starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        run = np.diff(np.append(starts, len(keys)))
        own = keys[starts]
        at = np.searchsorted(self.keys, own)
        safe = np.minimum(at, max(0, len(self.keys) - 1))
        known = (self.keys[safe] == own) if len(self.keys) else np.zeros(len(own), bool)
        hub, before = docs[starts].copy(), np.zeros(len(own), np.int64)
        hub[known], before[known] = self.hub[safe[known]], self.count[safe[known]]
        hubs = np.repeat(hub, run)
        apart = hubs != docs
        pairs = np.unique(np.stack([hubs[apart], docs[apart]], 1), axis=0) if apart.any() else np.empty((0, 2), np.int64)
        second = np.where(run > 1, docs[np.minimum(starts + 1, len(docs) - 1)], -1)
        second = np.where(known, np.where(before >= 2, self.second[safe] if len(self.keys) else -1, docs[starts]), second)
        after = before + run
        large = after >= 3
        rows = np.repeat(large, run)
        old_hub, old_second = large & known & (before < 3), large & known & (before == 2)
        members = np.stack([np.concatenate([keys[rows].view(np.int64), own[old_hub].view(np.int64), own[old_second].view(np.int64)]), np.concatenate([docs[rows], hub[old_hub], second[old_second]])], 1)
        if known.any():
            self.count[safe[known]] = after[known]
            self.second[safe[known]] = second[known]
        new = ~known
        if new.any():
            all_keys = np.concatenate([self.keys, own[new]])
            order = np.argsort(all_keys, kind="stable")
            self.keys = all_keys[order]
            self.hub, self.second, self.count = (np.concatenate(x)[order] for x in ((self.hub, hub[new]), (self.second, second[new]), (self.count, after[new])))
        return pairs, members


_FOUND = "kind int, a long, b long, c long, d long, sketch binary"


def _reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (kind, a, b, c, d, sketch): facts of a text, candidate pairs, and members of buckets of three or more."""

    def table(kind: int, columns: list[np.ndarray], sketches: list[bytes] | None = None) -> pa.RecordBatch:
        n = len(columns[0])
        full = [*columns, *[np.zeros(n, np.int64)] * (4 - len(columns))]
        return pa.RecordBatch.from_arrays([pa.array(np.full(n, kind, np.int32)), *[pa.array(np.ascontiguousarray(c)) for c in full], pa.array(sketches or [None] * n, pa.binary())], ["kind", "a", "b", "c", "d", "sketch"])

    hubs, held, size = _Hubs(), [], 0

    def merge() -> Iterator[pa.RecordBatch]:
        if held:
            pairs, members = hubs.add(np.concatenate([x[0] for x in held]), np.concatenate([x[1] for x in held]))
            if len(pairs):
                yield table(_PAIR, [pairs[:, 0], pairs[:, 1]])
            if len(members):
                yield table(_MEMBER, [members[:, 0], members[:, 1]])

    for batch in batches:
        for data in batch.column("data"):
            data = data.as_py()
            if data[:1] == b"F":
                n = int(np.frombuffer(data, np.int64, 1, 1)[0])
                f = np.frombuffer(data, np.int64, 5 * n, 9).reshape(n, 5)
                ends = 9 + 40 * n + np.cumsum(f[:, 4])
                yield table(_META, [f[:, i] for i in range(4)], [data[e - k : e] if k else None for e, k in zip(ends, f[:, 4], strict=True)])
                continue
            body = np.frombuffer(data, np.int64, offset=1)
            n = len(body) // 2
            held.append((body[:n].view(np.uint64), body[n:]))
            size += n
            if size >= MERGE_ROWS:
                yield from merge()
                held, size = [], 0
    yield from merge()


def _sets(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """(node, items) of rows (node, text) whose text has the node's set, once; a repeated doc_id can bring others."""
    seen: set[int] = set()
    for batch in batches:
        nodes, items = [], []
        for node, u in zip(batch.column("node").to_pylist(), shingle_sets(_texts(batch), width), strict=True):
            if node not in seen and _identity(u) == node:
                seen.add(node)
                nodes.append(node)
                items.append(u.tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(items, pa.binary())], ["node", "items"])


def _sizes(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array([len(u) for u in shingle_sets(_texts(batch), width)], pa.int64())], ["n"])


def _linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    both = np.concatenate([x, y])
    both.sort()
    shared = int(np.count_nonzero(both[1:] == both[:-1]))
    return 100 * shared >= percent * (len(x) + len(y) - shared)


def _verify(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sides = [[np.frombuffer(v, np.uint64) for v in batch.column(c).to_pylist()] for c in ("items_a", "items_b")]
        keep = pa.array([_linked(x, y, percent) for x, y in zip(*sides, strict=True)], pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep)], ["u", "v"])


def _possible(far: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, percent: int) -> np.ndarray:
    """Which pairs pass the bound on the Hamming distance of their flat sketches and the ratio of their sizes."""
    ratio = np.minimum(n_a, n_b) * 100 >= percent * np.maximum(n_a, n_b)
    return ratio & (far * (100 + percent) <= (n_a + n_b) * (100 - percent))


def _prune(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        far = []
        for x, y in zip(*(batch.column(c).to_pylist() for c in ("sketch_a", "sketch_b")), strict=True):
            size = min(len(x), len(y))
            far.append(int(np.bitwise_count(folded(x, size) ^ folded(y, size)).sum()))
        keep = pa.array(_possible(np.array(far, np.int64), *(batch.column(c).to_numpy().astype(np.int64) for c in ("n_a", "n_b")), percent))
        yield pa.RecordBatch.from_arrays([batch.column(c).filter(keep) for c in ("a", "b", "keys")], ["a", "b", "keys"])


def _close(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """The rows of each cell, without their sketches, that could link with one of another component in it."""
    for rows, cuts in by_cell(batches):
        comp, n, right = (rows.column(c).to_numpy() for c in ("comp", "n", "right"))
        sketches = rows.column("sketch").to_pylist()
        keep = np.zeros(len(comp), bool)
        for i, j in cuts:
            least = min(map(len, sketches[i:j]))
            sketch = np.stack([folded(x, least) for x in sketches[i:j]])
            l, r = (np.flatnonzero(right[i:j] != side) + i for side in (2, 1))  # noqa: E741
            for lo in range(0, len(l), 256):
                a = l[lo : lo + 256]
                for ro in range(0, len(r), 256):
                    b = r[ro : ro + 256]
                    far = np.zeros((len(a), len(b)), np.int64)
                    for w in range(0, sketch.shape[1], 16):
                        far += np.bitwise_count(sketch[a - i, None, w : w + 16] ^ sketch[None, b - i, w : w + 16]).sum(2, dtype=np.int64)
                    ok = _possible(far, n[a][:, None], n[b][None, :], percent) & (comp[a][:, None] != comp[b][None, :])
                    keep[a] |= ok.any(1)
                    keep[b] |= ok.any(0)
        left = rows.select(["cell_id", "node", "comp", "n", "right"]).filter(pa.array(keep))
        yield from left.combine_chunks().to_batches()


def shared_items(sets: list[np.ndarray], l: np.ndarray, r: np.ndarray) -> np.ndarray:  # noqa: E741
    """Sizes of the intersections of sets l with sets r, as products of 0/1 columns of the items that two sets hold."""
    owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    number = np.cumsum(count > 1) - 1
    again = count[column] > 1
    owner, column = owner[again], number[column[again]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    out = np.zeros((len(l), len(r)), np.float32)
    n_columns = int((count > 1).sum())
    step = min(n_columns, max(256, (1 << 20) // len(sets)))
    for lo in range(0, n_columns, max(1, step)):
        a, b = np.searchsorted(column, [lo, lo + step])
        holds = np.zeros((len(sets), step), np.float32)
        holds[owner[a:b], column[a:b] - lo] = 1
        out += holds[l] @ holds[r].T
    return out.astype(np.int64)


def _join(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """(u, v) for each row of a cell that links, by way of others, with a first one: fewer than the cell has rows."""
    for rows, cuts in by_cell(batches):
        node, comp, n, right = (rows.column(c).to_numpy() for c in ("node", "comp", "n", "right"))
        items = rows.column("items").to_pylist()
        out_u, out_v = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for i, j in cuts:
            l, r = (np.flatnonzero(right[i:j] != side) for side in (2, 1))  # noqa: E741
            both = shared_items([np.frombuffer(x, np.uint64) for x in items[i:j]], l, r)
            size, own = n[i:j], comp[i:j]
            linked = (100 * both >= percent * (size[l][:, None] + size[r][None, :] - both)) & (own[l][:, None] != own[r][None, :])
            x, y = np.nonzero(linked)
            root = roots(j - i, l[x], r[y])
            moved = np.flatnonzero(root != np.arange(j - i))
            out_u.append(node[i:j][moved])
            out_v.append(node[i:j][root[moved]])
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out_u)), pa.array(np.concatenate(out_v))], ["u", "v"])


def _check(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    side = lambda c: sets.select(F.col("node").alias(c), F.col("items").alias(f"items_{c}"))
    both = pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "items_a", "items_b")
    return both.mapInArrow(lambda it: _verify(it, percent), "u long, v long")


def _label(rows: DataFrame, c: str, comps: DataFrame, name: str) -> DataFrame:
    return rows.join(comps.select(F.col("node").alias(c), F.col("component").alias(name)), c, "left").withColumn(name, F.coalesce(name, c))


class _Search:
    """What the steps of one call share: the texts, the classes of equal sets, and the scratch folder."""

    def __init__(self, docs: DataFrame, classes: DataFrame, size: int, width: int, percent: int, scratch: Scratch):
        self.docs, self.classes, self.size, self.width, self.percent, self.scratch = docs, classes, size, width, percent, scratch

    def sets(self, nodes: DataFrame) -> DataFrame:
        """(node, items) of nodes (node), read from one text of each."""
        width = self.width
        wanted = nodes.join(self.classes.select("node", F.col("rep").alias("doc_id")), "node")
        texts = self.docs.join(wanted.hint("shuffle_hash"), "doc_id").select("node", "text")
        return self.scratch.keep(texts.mapInArrow(lambda it: _sets(it, width), "node long, items binary"))

    def beside(self, rows: DataFrame, c: str) -> DataFrame:
        return rows.join(self.classes.select(F.col("node").alias(c), F.col("n").alias(f"n_{c}"), F.col("sketch").alias(f"sketch_{c}")), c)

    def with_mixed(self, rows: DataFrame) -> DataFrame:
        """rows (key, node, comp) of the keys with several components, with the key's number of rows and shingles."""
        rows = rows.join(self.classes.select("node", "n", "spare"), "node")
        mixed = rows.groupBy("key").agg(F.count("*").alias("rows"), F.sum("n").alias("shingles"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi")
        return rows.join(self.scratch.keep(mixed.select("key", "rows", "shingles")), "key")

    def in_buckets(self, members: DataFrame, comps: DataFrame) -> DataFrame:
        """(u, v) that join the components of members (key, node) that links within a bucket join.

        A node leaves out its spare keys, those with the most rows first.
        """
        scratch, percent = self.scratch, self.percent
        rows = scratch.keep(self.with_mixed(_label(members, "node", comps, "comp")).distinct())
        band = F.col("key").bitwiseAND(PREFIX_TAG).cast("int")
        at = band - F.col("spare").bitwiseAND(PREFIX_TAG).cast("int")
        spare = sum((F.when(at == k, F.shiftright("spare", BAND_BITS + k * SPARE_BITS).bitwiseAND((1 << SPARE_BITS) - 1)).otherwise(0) for k in range(SPARE_BANDS)), F.lit(0))
        most = Window.partitionBy("node", "band").orderBy(F.desc("rows"), "key")
        left = rows.withColumn("band", band).withColumn("place", F.row_number().over(most)).where(F.col("place") > spare)
        left = scratch.keep(left.select("key", "node", "comp"))
        cells = self.beside(self.with_mixed(left).select("key", "node", "comp", "rows", "shingles"), "node")
        cells = cells.withColumn("blocks", F.greatest(F.ceil(F.col("rows") / BLOCK), F.ceil(F.col("shingles") / BLOCK_SHINGLES)).cast("int"))
        cells = cells.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        cells = cells.select(
            F.xxhash64("key", F.least("block", "other"), F.greatest("block", "other")).alias("cell_id"), "node", "comp", F.col("n_node").alias("n"), F.col("sketch_node").alias("sketch"),
            F.when(F.col("block") == F.col("other"), 0).when(F.col("block") < F.col("other"), 1).otherwise(2).alias("right"),
        )
        dealt = cells.repartition("cell_id").sortWithinPartitions("cell_id")
        close = scratch.keep(dealt.mapInArrow(lambda it: _close(it, percent), "cell_id long, node long, comp long, n long, right int"))
        if close.isEmpty():
            return close.select(F.col("node").alias("u"), F.col("node").alias("v"))
        sets = self.sets(close.select("node").distinct())
        # A set goes to every cell it is in: cells are taken in turns of about SLICE of the texts' bytes, which bounds the disk.
        turns = max(1, round(8 * close.agg(F.sum("n")).first()[0] / max(SLICE_BYTES, SLICE * self.size)))
        found = []
        for k in range(turns):
            own = close.where(F.pmod(F.xxhash64("cell_id"), F.lit(turns)) == k)
            full = own.join(sets, "node").repartition("cell_id").sortWithinPartitions("cell_id")
            found.append(scratch.keep(full.mapInArrow(lambda it: _join(it, percent), "u long, v long")))
        scratch.drop(sets)
        return reduce(DataFrame.union, found)


def jaccard_components(docs: DataFrame, width: int = 5, percent: int = 80, scratch: Scratch | None = None) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of docs (doc_id long, text string).

    Two texts link when 100 * |intersection| >= percent * |union| of their distinct shingles; component_id is
    the smallest doc_id reachable by links. Texts that are null, empty or without words have no shingles and
    link with nothing; rows without a doc_id link with nothing and have no component_id. Rows with equal sets are
    one node of the search. Rows that repeat a doc_id stay, and each has the component of its own text. Other columns are
    ignored, an empty table gives no rows.
    """
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "jaccard")
    every = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    docs = every.where("doc_id IS NOT NULL")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, int(size * 1.7 / REDUCE_BYTES))
    blocks = docs.mapInArrow(lambda it: _emit(it, parts, width, percent), "p int, data binary")
    found = scratch.keep(blocks.repartition(parts, "p").mapInArrow(_reduce, _FOUND), by="kind")
    facts = found.where(F.col("kind") == _META).select(F.col("a").alias("doc_id"), F.col("b").alias("n"), F.col("c").alias("node"), F.col("d").alias("spare"), "sketch")
    classes = facts.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.max("n").alias("n"), F.max("spare").alias("spare"), F.max("sketch").alias("sketch"))
    classes = scratch.keep(classes)
    search = _Search(docs, classes, size, width, percent, scratch)

    pairs = found.where(F.col("kind") == _PAIR).groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.count("*").alias("keys"))
    pairs = scratch.keep(search.beside(search.beside(pairs, "a"), "b").mapInArrow(lambda it: _prune(it, percent), "a long, b long, keys long"))
    # First the pair of each node with the most common keys, then the pairs that this leaves apart.
    sets = search.sets(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct())
    best = scratch.keep(pairs.groupBy("b").agg(F.max_by("a", F.struct("keys", "a")).alias("a")).select("a", "b"))
    links = scratch.keep(_check(best, sets, percent))
    comps = components(links, scratch)
    rest = _label(_label(pairs, "a", comps, "a_comp"), "b", comps, "b_comp").where("a_comp <> b_comp").select("a", "b")
    comps = merged(comps, scratch.keep(_check(rest, sets, percent)), scratch)
    scratch.drop(sets)

    # Then the buckets that still hold more than one component.
    members = found.where(F.col("kind") == _MEMBER).select(F.col("a").alias("key"), F.col("b").alias("node"))
    joined = search.in_buckets(members, comps)
    if not joined.isEmpty():
        comps = merged(comps, joined, scratch)

    own = _label(classes.select("node", "rep", "copies"), "node", comps, "root")
    least = scratch.keep(own.groupBy("root").agg(F.min("rep").alias("component_id"), F.sum("copies").alias("rows")).where("rows > 1"))
    named = scratch.keep(own.join(least, "root").select("node", "component_id"))
    out = facts.select("doc_id", "n", F.when(F.col("n") > 0, F.col("node")).alias("node")).join(named, "node", "left")
    without = every.where("doc_id IS NULL").select("text").mapInArrow(lambda it: _sizes(it, width), "n long")
    out = out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))
    return out.union(without.select(F.lit(None).cast("long").alias("doc_id"), F.col("n").alias("n_shingles"), F.lit(None).cast("long").alias("component_id")))


def one_of_each(docs: DataFrame, width: int = 5, percent: int = 80, scratch: Scratch | None = None) -> DataFrame:
    """The rows of docs (doc_id, text) that stay when one of each group of near duplicates does, with all their columns.

    Of a group, linked as in jaccard_components, the row with the smallest doc_id stays, rows without one last, ties by a
    hash of doc_id and text. Rows are told apart by that 64-bit hash, not by doc_id: of rows that repeat a doc_id each goes
    with the group of its own text, rows with equal doc_id and text are copies of which one stays, and rows without a
    doc_id stay unless they are near another one. Texts without words link with nothing, and all their rows stay.
    """
    scratch = scratch or Scratch(docs.sparkSession, "one_of_each")
    row = F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    worded = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    rows = docs.where(worded)
    groups = jaccard_components(rows.select(row.alias("doc_id"), "text"), width, percent, scratch)
    groups = groups.groupBy(F.col("doc_id").alias("_key")).agg(F.min("component_id").alias("component"), F.count("*").alias("copies"))
    # Only rows of groups of two or more need more than their own key.
    known = rows.groupBy(row.alias("_key")).agg(F.min(F.col("doc_id").cast("long")).alias("id"))
    groups = scratch.keep(groups.join(known, "_key"))
    first = groups.groupBy("component").agg(F.min(F.struct(F.col("id").isNull(), "id", "_key", "copies")).alias("first"))
    stay = scratch.keep(first.select("first._key", "first.copies"))
    keyed = rows.withColumn("_key", row)
    single = keyed.join(stay.where("copies = 1").hint("shuffle_hash"), "_key", "left_semi")
    several = keyed.join(stay.where("copies > 1"), "_key", "left_semi").dropDuplicates(["_key"])
    return single.union(several).select(*docs.columns).union(docs.where(~worded))
