"""Packing documents into windows of `capacity` words by Karmarkar-Karp multiway differencing.

Documents of more words are cut: pieces of capacity words are windows of their own, what is left is packed with the rest.
Buckets of pieces are packed apart. In each, as many partial partitions as pieces are merged, two of the greatest imbalance
at a time, the fullest window of one with the emptiest of the other, so that windows come out nearly equal. There are as many
windows as the words need at least, and as the pieces need of which no j + 1 fit in a window; while one exceeds the capacity,
there are as many more as what is over would fill, one at least, and all is done again.

Words are runs without ASCII white space. Nulls count as empty texts; documents without words have no piece. Rows that repeat
a doc_id are packed each, also rows without doc_id. Columns besides doc_id and text are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindlegraph.llm.shared import staged, text_chunks
from spindlegraph.llm.words import counted

PIECES = 512


def differencing(sizes: np.ndarray, k: int) -> np.ndarray:
    """The window, 0 to k - 1, of each size."""
    n = len(sizes)
    if k == 1 or n <= 1:
        return np.zeros(n, np.int64)
    left, right = np.full(2 * n + n, -1), np.full(2 * n + n, -1)  # nodes: 1 to n are pieces, then pairs; 0 is nothing
    nodes = n + 1
    heap = []
    for i, size in enumerate(sizes.tolist()):
        s, node = np.zeros(k), np.zeros(k, np.int64)
        s[0], node[0] = size, i + 1
        heap.append((-size, i, s, node))
    heapq.heapify(heap)
    tick = n
    while len(heap) > 1:
        _, _, a, x = heapq.heappop(heap)
        _, _, b, y = heapq.heappop(heap)
        s, y = a + b[::-1], y[::-1]
        both = np.flatnonzero((x > 0) & (y > 0))
        node = x + y
        if len(both):
            new = np.arange(nodes, nodes + len(both))
            left[new], right[new] = x[both], y[both]
            node[both] = new
            nodes += len(both)
        by = np.argsort(-s, kind="stable")
        s = s[by]
        s -= s[-1]
        heapq.heappush(heap, (-s[0], tick, s, node[by]))
        tick += 1
    where = np.zeros(nodes, np.int64)
    final = heap[0][3]
    where[final[final > 0]] = np.flatnonzero(final > 0)
    for v in range(nodes - 1, n, -1):
        where[left[v]] = where[right[v]] = where[v]
    return where[1 : n + 1]


def fewest(sizes: np.ndarray, capacity: int) -> int:
    """Windows that any packing needs: by the sum, and for j = 1, 2, ... by the pieces of which a window holds no more than j."""
    order = np.sort(sizes)
    j = np.arange(1, 33)
    large = len(order) - np.searchsorted(order, capacity // (j + 1), side="right")
    return max(1, math.ceil(sizes.sum() / capacity), int(np.ceil(large / j).max()))


def windows(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The window of each size, none of which is over the capacity."""
    k = fewest(sizes, capacity)
    while True:
        at = differencing(sizes, k)
        over = np.maximum(np.bincount(at, sizes) - capacity, 0).sum() if len(at) else 0
        if not over:
            return at
        k = min(len(sizes), k + max(1, math.ceil(over / capacity)))


def _pack(capacity: int):
    def run(group: pa.Table) -> pa.Table:
        size, doc, start = (group[c].to_numpy() for c in ("n_words", "doc_key", "start_word"))
        by = np.lexsort((start, doc, -size))
        whole = by[size[by] == capacity]
        rest = by[size[by] < capacity]
        window = np.zeros(len(size), np.int64)
        window[whole] = np.arange(len(whole))
        used, parts = len(whole), max(1, math.ceil(len(rest) / PIECES))
        for j in range(parts):
            some = rest[j::parts]
            if len(some):
                at = windows(size[some], capacity)
                _, at = np.unique(at, return_inverse=True)
                window[some] = at + used
                used += int(at.max()) + 1
        order = np.lexsort((start, doc, -size, window))
        first = np.searchsorted(window[order], window[order])
        ids = group["bucket"].to_numpy()[order] * (1 << 24) + window[order]
        return pa.table({"window_id": ids, "position": np.arange(len(order)) - first, "doc_id": group["doc_id"].take(pa.array(order)), "start_word": start[order], "n_words": size[order]})

    return run


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for chunk in text_chunks(batches):
        yield pa.RecordBatch.from_arrays([chunk.column(0), chunk.column(1), pa.array(counted(chunk.column(2)).astype(np.int64))], names=["doc_id", "doc_key", "n"])


def packed(docs: DataFrame, capacity: int = 2048) -> DataFrame:
    """(window_id, position, doc_id, start_word, n_words) of every piece."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("doc_id", "text").alias("doc_key"), F.col("text").cast("string").alias("text"))
    sizes = staged(rows.mapInArrow(_count, "doc_id long, doc_key long, n long").where("n > 0"))
    cap = F.lit(capacity).cast("long")
    total = sizes.agg(F.sum(F.ceil(F.col("n") / cap))).first()[0] or 0
    pieces = sizes.select("doc_id", "doc_key", F.pmod("doc_key", F.lit(max(1, math.ceil(total / PIECES)))).alias("bucket"), "n", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, cap)).alias("start_word"))
    pieces = pieces.select("bucket", "doc_id", "doc_key", "start_word", F.least(cap, F.col("n") - F.col("start_word")).alias("n_words"))
    return pieces.groupBy("bucket").applyInArrow(_pack(capacity), "window_id long, position long, doc_id long, start_word long, n_words long")
