"""Cells of bounded blocks: rows of one group that a task compares with each other, streamed cell by cell."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def by_cell(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, list[tuple[int, int]]]]:
    """Tables of whole cells from batches sorted by cell_id, with the first row and the end of each cell."""

    def cut(rows: pa.Table) -> tuple[pa.Table, list[tuple[int, int]]]:
        cells = rows.column("cell_id").to_numpy()
        cuts = np.flatnonzero(np.diff(cells)) + 1
        return rows, list(zip([0, *cuts.tolist()], [*cuts.tolist(), len(cells)], strict=True))

    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        if held[0].column("cell_id")[0].as_py() == batch.column("cell_id")[-1].as_py():
            continue
        rows = pa.Table.from_batches(held)
        cells = rows.column("cell_id").to_numpy()
        end = int(np.argmax(cells == cells[-1]))
        yield cut(rows.slice(0, end))
        held = rows.slice(end).to_batches()
    if held:
        yield cut(pa.Table.from_batches(held))


def roots(n: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The smallest index of each index's component under pairs (x, y)."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[x], root[y])
        new = root.copy()
        np.minimum.at(new, x, low)
        np.minimum.at(new, y, low)
        new = new[new]
        if (new == root).all():
            return root
        root = new
