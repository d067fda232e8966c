"""Dealing variable-length rows into bins, parts and batches. The sequential rules run per batch key."""

from __future__ import annotations

import heapq
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def largest_differencing(sizes: list[int], k: int, equal: bool = False) -> list[list[int]]:
    """Karmarkar-Karp for k parts: the two partitions that differ most inside are merged, large onto small.

    equal: parts of one number of items, for which len(sizes) must be a multiple of k. Parts hold places in
    ascending order and come in order of their first place.
    """
    if k < 1 or len(sizes) < k or equal and len(sizes) % k:
        raise ValueError("too few items, or not a multiple of the parts")

    def state(parts):  # parts: (sum, places), largest first
        parts = sorted(parts, key=lambda p: (-p[0], p[1]))
        return (-(parts[0][0] - parts[-1][0]), tuple(parts))

    order = sorted(range(len(sizes)), key=lambda i: (sizes[i], i))
    if equal:
        heap = [state([(sizes[i], (i,)) for i in order[at : at + k]]) for at in range(0, len(order), k)]
    else:
        heap = [state([(sizes[i], (i,))] + [(0, ())] * (k - 1)) for i in order]
    heapq.heapify(heap)
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[1], heapq.heappop(heap)[1]
        heapq.heappush(heap, state([(x[0] + y[0], x[1] + y[1]) for x, y in zip(a, reversed(b))]))
    parts = [sorted(p[1]) for p in heap[0][1]]
    empty = [p for p in parts if not p]
    for p in empty:  # every part gets an item
        full = max(parts, key=len)
        p.append(full.pop())
    return sorted(parts)


def least_loaded(sizes: list[int], k: int) -> list[list[int]]:
    """Items in their order, each to the part with the smallest sum so far (of equal ones the first)."""
    heap, parts = [(0, j) for j in range(k)], [[] for _ in range(k)]
    for i, s in enumerate(sizes):
        load, j = heapq.heappop(heap)
        parts[j].append(i)
        heapq.heappush(heap, (load + s, j))
    return parts


def first_fit(sizes: list[int], most: int) -> list[list[int]]:
    """Items in their order, each to the first bin with room; one above `most` has a bin of its own."""
    bins, free = [], []
    for i, s in enumerate(sizes):
        j = next((j for j, f in enumerate(free) if s <= f), None)
        if j is None:
            bins.append([i])
            free.append(most - s)
        else:
            bins[j].append(i)
            free[j] -= s
    return bins


def size_chunks(sizes: list[int], least: int) -> list[list[int]]:
    """Items in their order; a chunk closes as soon as its sum reaches `least`."""
    out, now, load = [], [], 0
    for i, s in enumerate(sizes):
        now.append(i)
        load += s
        if load >= least:
            out.append(now)
            now, load = [], 0
    return out + [now] * bool(now)


def deal(rows: DataFrame, batch: str, item: str, size: str, rule: Callable[[list[int]], list[list[int]]]) -> DataFrame:
    """(batch, item, size, part): rule on each batch's sizes in order of item.

    The rule needs a whole batch at once; batch keys must bound that, as a step's batch does.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(item, kind="stable").reset_index(drop=True)
        part = pd.Series(0, index=pdf.index, dtype="int64")
        for k, places in enumerate(rule([int(s) for s in pdf[size]])):
            part.iloc[places] = k
        return pdf.assign(part=part)

    cols = rows.select(batch, F.col(item).cast("long").alias(item), F.col(size).cast("long").alias(size))
    return cols.groupBy(batch).applyInPandas(run, cols.withColumn("part", F.lit(0).cast("long")).schema)


def micro_batch(ordinal: Column, size: int) -> Column:
    return F.floor(ordinal / size).cast("long")


def contiguous(ordinal: Column, n: Column, ways: int) -> Column:
    """Of `ways` contiguous slices of ceil(n / ways) rows, the row's."""
    return F.floor(ordinal / F.ceil(n / ways)).cast("long")
