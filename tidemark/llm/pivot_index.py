"""Embedding near-duplicates by a pivot-permutation index.

Pivots are vectors that lie apart, chosen from a bounded sample of distinct vectors. Every vector is described by its
nearest pivots in order; vectors that share at least SHARED of their PREFIX nearest pivots are candidates. The index
has one inverted list for each set of SHARED pivots, under which a vector stands if all of them are among its nearest,
so a pair's count of shared pivots reaches SHARED exactly if some list holds both. Lists are compared in square cells
of bounded blocks with cosines in double precision; a pair that several lists hold counts in the one of its first
shared pivots. Equal vectors are one class with a multiplicity and enter the index once.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.cells import by_cell, roots
from tidemark.llm.components import components
from tidemark.llm.scratch import Scratch

#: The index is fitted on at most so many distinct vectors of each length, those with the smallest hash of their content.
SAMPLE = 4096
PREFIX, SHARED = 8, 3
#: Pivots: this many times the cube root of the number of vectors, so that a list of three grows slowly, up to a bound
#: beyond which recall would fall below 0.9 at the threshold.
PIVOT_RATE, MOST_PIVOTS = 17, 768
#: Vectors in a block of a list; a cell compares two blocks at most. Fewer vectors of a length are all one list.
BLOCK = 256
#: Pairs of cells of at most so many vectors are compared for many cells at once.
SMALL = 16
#: Bits of a list's key that hold its pivots; those above hold the length.
KEY_BITS = 40


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1 in double precision, by way of their largest component so that no square overflows."""
    x = x.astype(np.float64)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def pivots_for(n: int) -> int:
    """How many pivots n vectors of one length get."""
    return 1 if n <= BLOCK else max(SHARED, min(MOST_PIVOTS, round(PIVOT_RATE * n ** (1 / 3))))


def choose_pivots(sample: np.ndarray, n: int) -> np.ndarray:
    """Farthest-first choice by cosine: each pivot is the vector least similar to those before it; ties by order."""
    if not len(sample):
        return np.zeros((0, 0))
    unit = _unit(sample)
    chosen, most = [0], unit @ unit[0]
    while len(chosen) < min(n, len(unit)):
        k = int(np.argmin(most))
        if most[k] > 1 - 1e-9:
            break
        chosen.append(k)
        most = np.maximum(most, unit @ unit[k])
    return unit[chosen]


def nearest_pivots(unit: np.ndarray, pivots: np.ndarray, prefix: int = PREFIX) -> np.ndarray:
    """Indices of each row's nearest pivots, in order of index."""
    far = -(unit @ pivots.T)
    return np.sort(np.argpartition(far, prefix - 1, axis=1)[:, :prefix] if prefix < len(pivots) else np.argsort(far, axis=1), 1).astype(np.int64)


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def _by_length(rows: pa.Table | pa.RecordBatch) -> Iterator[tuple[int, pa.Table | pa.RecordBatch]]:
    lengths = pc.list_value_length(rows.column("embedding"))
    for n in pc.unique(lengths).to_pylist():
        yield n, rows.filter(pc.equal(lengths, n))


def _index(batches: Iterator[pa.RecordBatch], pivots: dict[int, np.ndarray], prefix: int, shared: int) -> Iterator[pa.RecordBatch]:
    """A row (key, rep) for each set of shared pivots among a vector's nearest."""
    for batch in batches:
        for length, rows in _by_length(batch):
            own = pivots[length]
            near = nearest_pivots(_unit(_matrix(rows.column("embedding"))), own, prefix)
            take = list(combinations(range(near.shape[1]), min(shared, near.shape[1])))
            keys = np.zeros((len(near), len(take)), np.int64)
            for k, places in enumerate(take):
                for p in places:
                    keys[:, k] = keys[:, k] * (len(own) + 1) + near[:, p] + 1
            rep = rows.column("rep").to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel() + (length << KEY_BITS)), pa.array(np.repeat(rep, len(take)))], ["key", "rep"])


def _first_shared(a: np.ndarray, b: np.ndarray, base: int, shared: int) -> np.ndarray:
    """The list of the first pivots that each row of a shares with that of b; rows are sorted pivots."""
    both = (a[:, :, None] == b[:, None, :]).any(2)
    both &= np.cumsum(both, axis=1) <= shared
    key = np.zeros(len(a), np.int64)
    for k in range(a.shape[1]):
        key = np.where(both[:, k], key * (base + 1) + a[:, k] + 1, key)
    return key


def _pairs(unit: np.ndarray, cell: np.ndarray, cuts: list[tuple[int, int]], right: np.ndarray, rep: np.ndarray, least: float) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """Row numbers (x, y) of the pairs of a cell whose cosine is least or more, and whether they are of one large cell."""
    size = np.array([j - i for i, j in cuts])
    small = np.repeat(size <= SMALL, size) & (right == 0)
    for k in range(1, SMALL):
        at = np.flatnonzero(small[:-k] & (cell[k:] == cell[:-k]))
        for lo in range(0, len(at), 1 << 16):
            x = at[lo : lo + (1 << 16)]
            x = x[(unit[x] * unit[x + k]).sum(1) >= least]
            yield x, x + k, False
    for i, j in cuts:
        if j - i <= SMALL and right[i] == 0:
            continue
        l, r = (np.flatnonzero(right[i:j] != side) + i for side in (2, 1))  # noqa: E741
        x, y = np.nonzero(unit[l] @ unit[r].T >= least - 1e-9)
        x, y = l[x], r[y]
        keep = rep[x] < rep[y] if (right[i:j] == 0).all() else rep[x] != rep[y]
        x, y = x[keep], y[keep]
        exact = (unit[x] * unit[y]).sum(1) >= least
        yield x[exact], y[exact], True


def _compare(batches: Iterator[pa.RecordBatch], pivots: dict[int, np.ndarray], prefix: int, shared: int, least: float) -> Iterator[pa.RecordBatch]:
    """(rep, links, root) of rows sorted by cell: the weight of new links of a vector, and one that it is linked with.

    A large cell gives a row a vector at most, with the smallest vector of its component; a small one a few a pair.
    """
    for table, _ in by_cell(batches):
        for length, rows in _by_length(table):
            cell, key, rep, weight, right = (rows.column(c).to_numpy() for c in ("cell_id", "key", "rep", "weight", "right"))
            edge = [0, *(np.flatnonzero(np.diff(cell)) + 1).tolist(), len(cell)]
            cuts = list(zip(edge[:-1], edge[1:], strict=True))
            own = pivots[length]
            unit = _unit(np.concatenate([_matrix(c) for c in rows.column("embedding").chunks if len(c)]))
            out = [[], [], []]
            for x, y, large in _pairs(unit, cell, cuts, right, rep, least):
                if not len(x):
                    continue
                ends, inverse = np.unique(np.concatenate([x, y]), return_inverse=True)
                near = nearest_pivots(unit[ends], own, prefix)
                new = _first_shared(near[inverse[: len(x)]], near[inverse[len(x) :]], len(own), min(shared, near.shape[1])) + (length << KEY_BITS) == key[x]
                links = np.bincount(inverse, np.concatenate([weight[y] * new, weight[x] * new]), len(ends)).astype(np.int64)
                if large:
                    order = np.argsort(rep[ends], kind="stable")
                    place = np.empty_like(order)
                    place[order] = np.arange(len(ends))
                    root = np.empty(len(ends), np.int64)
                    root[order] = rep[ends][order][roots(len(ends), place[inverse[: len(x)]], place[inverse[len(x) :]])]
                    found = (rep[ends], links, root)
                else:
                    low = np.minimum(rep[x], rep[y])
                    found = (np.concatenate([rep[x], rep[y]]), np.concatenate([weight[y] * new, weight[x] * new]).astype(np.int64), np.concatenate([low, low]))
                for c, v in zip(out, found, strict=True):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c) if c else np.empty(0, np.int64)) for c in out], ["rep", "links", "root"])


def fit_pivots(vectors: DataFrame, n_pivots: int | None = None, sample: int = SAMPLE) -> dict[int, np.ndarray]:
    """Pivots for each length of the distinct vectors (rep, embedding), from a bounded sample of each."""
    sized = vectors.select("rep", "embedding", F.size("embedding").alias("length"))
    counts = {r["length"]: r["n"] for r in sized.groupBy("length").agg(F.count("*").alias("n")).collect()}  # a number a length
    order = Window.partitionBy("length").orderBy(F.xxhash64("embedding"), "rep")
    rows = sized.withColumn("place", F.row_number().over(order)).where(F.col("place") <= sample).orderBy("length", "place").select("length", "embedding").toPandas()
    return {n: choose_pivots(np.array(own["embedding"].tolist(), np.float64), n_pivots or pivots_for(counts[n])) for n, own in rows.groupby("length")}


def near_vectors(table: DataFrame, least: float = 0.9, n_pivots: int | None = None, prefix: int = PREFIX, shared: int = SHARED, scratch: Scratch | None = None) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of table (vec_id long, embedding array of float or double).

    Pairs that the index retrieves link if their cosine is least or more; n_links counts the other rows that a row links
    with, component_id is the smallest vec_id reachable, kept says that it is the row's own. With more pivots (by default
    pivots_for the vectors of a length) lists are shorter and recall is lower, with a longer prefix it is higher. Vectors of
    different lengths never link; those that are null, empty or zero, or hold a null or non-finite component, link with none.
    Equal rows link with each other. Rows without a vec_id have the links of the rows equal to them, if any has one, and are
    not kept; rows that repeat a vec_id stay and share their links. Other columns are ignored, an empty table gives no rows.
    """
    spark = table.sparkSession
    scratch = scratch or Scratch(spark, "pivots")
    rows = table.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    good = F.coalesce(~F.exists("embedding", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))) & F.exists("embedding", lambda v: v != 0), F.lit(False))
    classes = rows.where(good).groupBy("embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("weight"))
    classes = scratch.keep(classes)
    usable = classes.where("rep IS NOT NULL")
    pivots = fit_pivots(usable, n_pivots)
    if any((len(p) + 1) ** shared >= 1 << KEY_BITS for p in pivots.values()):
        raise ValueError("so many pivots do not fit a key")
    index = scratch.keep(usable.select("rep", "embedding").mapInArrow(lambda it: _index(it, pivots, prefix, shared), "key long, rep long"))
    lists = index.groupBy("key").agg(F.count("*").alias("rows")).where("rows > 1")
    cells = index.join(lists, "key").withColumn("blocks", F.ceil(F.col("rows") / BLOCK).cast("int")).withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    cells = cells.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    side = F.when(F.col("block") == F.col("other"), 0).when(F.col("block") < F.col("other"), 1).otherwise(2)
    cells = cells.select(F.xxhash64("key", F.least("block", "other"), F.greatest("block", "other")).alias("cell_id"), "key", "rep", side.alias("right"))
    cells = cells.join(usable, "rep").select("cell_id", "key", "rep", "weight", "right", "embedding").repartition("cell_id").sortWithinPartitions("cell_id")
    found = scratch.keep(cells.mapInArrow(lambda it: _compare(it, pivots, prefix, shared, least), "rep long, links long, root long"))
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    comps = components(found.where("rep <> root").select(F.col("rep").alias("u"), F.col("root").alias("v")), scratch)
    classes = classes.join(links, "rep", "left").join(comps.withColumnRenamed("node", "rep"), "rep", "left")
    classes = classes.where("rep IS NOT NULL").select("embedding", (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    out = rows.withColumn("_good", good).join(classes, "embedding", "left")
    linked = F.col("_good") & F.col("component_id").isNotNull()
    component = F.when(linked, F.col("component_id")).otherwise(F.col("vec_id"))
    return out.select("vec_id", F.when(linked, F.col("n_links")).otherwise(F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(False)).alias("kept"))
