"""Chains as paths through a graph: counted before any is made, then made one after the other, as they are asked for."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.config import DEFAULT

#: Chains in one batch of rows.
BATCH = 4096


def ways(hits: list[list[int]], max_gap: int) -> list[list[int]]:
    """For each place of each list the number of paths from it to the last list.

    A path takes one place of each list, each behind the one before it by ``max_gap`` at most. Counts are whole
    numbers of any size, got from running sums of the next list's counts.
    """
    out = [[1] * len(hits[-1])] if hits else []
    for k in range(len(hits) - 2, -1, -1):
        behind, sums = hits[k + 1], [0]
        for n in out[0]:
            sums.append(sums[-1] + n)
        out.insert(0, [sums[bisect_right(behind, p + max_gap)] - sums[bisect_right(behind, p)] for p in hits[k]])
    return out


def paths(hits: list[list[int]], max_gap: int) -> Iterator[list[int]]:
    """The paths in lexicographic order; places from which no path leads to the end are never entered.

    Holds one path at a time, whatever their number.
    """
    counts = ways(hits, max_gap)
    if not hits:
        return
    at, path = [0], []
    while at:
        level, k = len(at) - 1, at[-1]
        if k == len(hits[level]) or (path and hits[level][k] > path[-1] + max_gap):
            at.pop()
            if path:
                path.pop()
            continue
        at[-1] += 1
        if not counts[level][k] or (path and hits[level][k] <= path[-1]):
            continue
        if level == len(hits) - 1:
            yield [*path, hits[level][k]]
        else:
            path.append(hits[level][k])
            at.append(bisect_right(hits[level + 1], hits[level][k]))


def streamed_chains(rows: DataFrame, keys: list[str], hits: str, max_gap: int = DEFAULT.max_gap) -> DataFrame:
    """keys, chain_idx (from 0, in lexicographic order), chain for every chain through the sorted ``hits`` of a row.

    As ``functions.sequence.chains`` gives them, but made one after the other: a task holds one batch of them. A tile
    without hits has place -1; a row without any hit has the one chain of no places, and a null one none.
    """
    names = [*keys, "chain_idx", "chain"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            of = [batch.column(batch.schema.get_field_index(k)).to_pylist() for k in keys]
            for i, tiles in enumerate(batch.column(batch.schema.get_field_index(hits)).to_pylist()):
                if tiles is None:
                    continue
                found = [k for k, t in enumerate(tiles) if t]
                for idx, path in enumerate(paths([tiles[k] for k in found], max_gap) if found else [[]]):
                    chain = [-1] * len(tiles)
                    for k, p in zip(found, path):
                        chain[k] = p
                    held.append((*[c[i] for c in of], idx, chain))
                    if len(held) == BATCH:
                        yield table(held, batch)
                        held = []
            if held:
                yield table(held, batch)
                held = []

    def table(found: list[tuple], like: pa.RecordBatch) -> pa.RecordBatch:
        kinds = [*[like.schema.field(k).type for k in keys], pa.int64(), pa.list_(pa.int32())]
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in found], t) for k, t in enumerate(kinds)], names)

    schema = ", ".join(f"{c} {t}" for c, t in rows.select(*keys).dtypes)
    return rows.select(*keys, F.col(hits)).mapInArrow(run, f"{schema}, chain_idx long, chain array<int>")
