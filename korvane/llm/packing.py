"""Items of varying length into containers of fixed capacity, by multiway differencing.

Each task takes its items in lots of a documented size. In a lot, the items are partial partitions of as many windows as the
total needs; the two partitions with the largest imbalance are combined again and again, the fullest window of one with the
emptiest of the other, until one partition is left, with near-equal windows. Windows that are full are containers, the items of the
others are divided again in other company; what is left at the end is divided into more windows until none exceeds the capacity.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from korvane.llm import bpe

#: Items of a lot, at least, where the task has as many; a lot has fewer than twice that. The lot bounds memory, not the input.
LOT = 16_000
#: Items that are divided together.
DRAW = 64


def difference(sizes: np.ndarray, windows: int) -> np.ndarray:
    """Window number of each item: near-equal windows by repeatedly combining the two partial partitions of largest imbalance."""
    n = len(sizes)
    if windows <= 1 or n == 0:
        return np.zeros(n, dtype=np.int64)
    # A partition: sums of its windows that hold anything, descending, and for each the node that tells its items.
    left, right = np.full(2 * n, -1), np.full(2 * n, -1)
    nodes = n
    heap: list[tuple[int, int]] = []
    parts: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for i in range(n):
        parts[i] = (sizes[i : i + 1], np.array([i]))
        heap.append((-int(sizes[i]), i))
    heapq.heapify(heap)
    tag = n
    while len(heap) > 1:
        _, x = heapq.heappop(heap)
        _, y = heapq.heappop(heap)
        (a, na), (b, nb) = parts.pop(x), parts.pop(y)
        if len(a) < len(b):
            a, na, b, nb = b, nb, a, na
        free = windows - len(a)  # empty windows of a: they get the fullest of b
        if (both := len(b) - free) > 0:  # the rest of b meets a's emptiest, fullest on emptiest
            fresh = np.arange(nodes, nodes + both)
            left[fresh], right[fresh] = na[-both:], nb[free:][::-1]
            nodes += both
            a, na = np.concatenate([a[:-both], a[-both:] + b[free:][::-1]]), np.concatenate([na[:-both], fresh])
            b, nb = b[:free], nb[:free]
        s, i = np.concatenate([a, b]), np.concatenate([na, nb])
        order = np.argsort(-s, kind="stable")
        s, i = s[order], i[order]
        parts[tag] = (s, i)
        heapq.heappush(heap, (int(s[-1] * (len(s) == windows) - s[0]), tag))
        tag += 1
    out = np.empty(n, dtype=np.int64)
    for w, root in enumerate(parts[heap[0][1]][1]):
        stack = [int(root)]
        while stack:
            v = stack.pop()
            if v < n:
                out[v] = w
            else:
                stack += (int(left[v]), int(right[v]))
    return out


def pack(sizes: np.ndarray, capacity: int, slack: float = 0.001, widest: float = 0.1) -> np.ndarray:
    """Container number of each item, none of which exceeds the capacity.

    The items are dealt into draws of DRAW, and each draw is divided into near-equal windows, as many as fill them to within the slack.
    Windows that came out full but not over the capacity are containers; the items of the others meet new partners in the next
    draws. Where few windows fit the slack grows. Beyond the widest slack all that is left is divided at once; while a window exceeds
    the capacity the window count rises and they are divided again. Every container is a window of a division.
    """
    out, rest, used = np.empty(len(sizes), dtype=np.int64), np.arange(len(sizes)), 0
    deal = np.random.default_rng(len(sizes))
    while len(rest) and slack <= widest:
        dealt, again, fit, tried = deal.permutation(rest), [], 0, 0
        for i in range(0, len(dealt), DRAW):
            own = dealt[i : i + DRAW]
            windows = max(1, round(int(sizes[own].sum()) / (capacity * (1 - slack / 2))))
            at = difference(sizes[own], windows)
            sums = np.bincount(at, weights=sizes[own], minlength=windows)
            good = (sums <= capacity) & (sums >= capacity * (1 - slack))
            chosen = good[at]
            out[own[chosen]] = (np.cumsum(good) - 1 + used)[at[chosen]]
            used += int(good.sum())
            again.append(own[~chosen])
            fit, tried = fit + int(good.sum()), tried + windows
        rest = np.concatenate(again)
        if fit < 0.05 * tried:
            slack *= 1.25
    if len(rest):
        own = sizes[rest]
        windows = max(1, -(-int(own.sum()) // capacity))
        while np.bincount(at := difference(own, windows), weights=own).max() > capacity:
            windows += 1
        _, at = np.unique(at, return_inverse=True)
        out[rest] = at + used
    return out


def pack_documents(df: DataFrame, capacity: int = 2048, key: str = "doc_id", text: str = "text", vocabulary: str | None = None, lot: int = LOT) -> DataFrame:
    """(key, part_no, n_tokens, container_id): the parts of each document with text and the containers that hold them.

    A document is one part, whole in one container, unless it alone exceeds the capacity: then full containers of its own take part
    after part and what is left is packed like any other document. Null and empty texts have no tokens and give no row; repeated
    rows are items of their own; an empty table gives none; further columns are not read. Each task packs the documents it reads in
    lots, so nothing is shuffled; container ids are unique over all tasks.
    """
    path = vocabulary or bpe.vocabulary_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = bpe.transducer(path).encode
        task = TaskContext.get()
        ids = (task.partitionId() if task else 0) << 36
        names: list = []
        sizes: list[int] = []

        def emit(n: int) -> pa.RecordBatch:
            nonlocal ids
            own, total = names[:n], np.array(sizes[:n], dtype=np.int64)
            del names[:n], sizes[:n]
            full = np.where(total > capacity, total // capacity, 0)
            left = total - full * capacity
            row = np.repeat(np.arange(n), full)
            part = np.arange(len(row)) - np.repeat(np.cumsum(full) - full, full)
            some = np.flatnonzero(left)
            at = pack(left[some], capacity) + len(row)
            rows = np.concatenate([row, some])
            out = pa.RecordBatch.from_arrays(
                [
                    pa.array(own, type=kind).take(pa.array(rows)),
                    pa.array(np.concatenate([part, full[some]]).astype(np.int32)),
                    pa.array(np.concatenate([np.full(len(row), capacity), left[some]]).astype(np.int32)),
                    pa.array(ids + np.concatenate([np.arange(len(row)), at])),
                ],
                names=["key", "part_no", "n_tokens", "container_id"],
            )
            ids += len(row) + (int(at.max()) + 1 - len(row) if len(at) else 0)
            return out

        kind = None
        for b in batches:
            kind = b.column(0).type
            for name, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if x:
                    names.append(name)
                    sizes.append(len(encode(x)) // 4)
            while len(names) >= 2 * lot:
                yield emit(lot)
        if names:
            yield emit(len(names))

    kind = dict(df.dtypes)[key]
    rows = df.select(F.col(key).alias("key"), F.col(text).alias("text")).where(F.length("text") > 0)
    return rows.mapInArrow(run, f"key {kind}, part_no int, n_tokens int, container_id bigint").withColumnRenamed("key", key)
