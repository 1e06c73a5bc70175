"""Packing by Karmarkar-Karp multiway differencing (operator 1).

Every task packs the documents of its own partition, so nothing is shuffled and
no hot source or group of copies can gather in one place. Full windows are cut
off first; what is left of the documents collects into bounded groups. A group
of pieces is divided into ``k`` windows by differencing: each piece starts as a
partial partition of ``k`` sums, and the two partial partitions with the widest
spread are merged again and again, the largest sums of one with the smallest of
the other, so that opposing imbalances cancel. If the fullest window exceeds the
capacity, the group is divided anew into one window more. A sequence is padded
to the capacity unless its length is a power of two, so what a partition's last
group has beyond its windows becomes sequences of such lengths, without padding.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.bpe_trie import encoder, slices
from quire.llm.tables import text_or_empty

CAPACITY = 4096
#: Windows that a group is divided into; more give less padding and take longer.
WINDOWS = 64
#: Share of a window that a group leaves free, so that differencing finds room.
SLACK = 0.008
#: Pieces cut from the rest of a document have at most this part of a window.
PARTS = 4
#: The same for what remains at the end of a partition, where few pieces must fit.
LAST_PARTS = 32
#: The id that ends each document.
END_ID = 2
#: Sequences of one partition have ids from ``partition << PARTITION_BITS``.
PARTITION_BITS = 32


def differencing(sizes: list[int], k: int) -> tuple[list[int], list[list[int]]]:
    """Karmarkar-Karp for ``k`` windows: sums in descending order, and the item numbers of each.

    Ties are broken by the order of the items, so equal input gives equal output.
    """
    heap = [(-size, i, [size] + [0] * (k - 1), [[i]] + [[] for _ in range(k - 1)]) for i, size in enumerate(sizes)]
    heapify(heap)
    count = len(heap)
    while len(heap) > 1:
        _, _, sums, items = heappop(heap)
        _, _, other, others = heappop(heap)
        total = [a + b for a, b in zip(sums, reversed(other))]
        order = sorted(range(k), key=total.__getitem__, reverse=True)
        joined = [items[j] + others[k - 1 - j] for j in order]
        total = [total[j] for j in order]
        heappush(heap, (total[-1] - total[0], count, total, joined))
        count += 1
    return (heap[0][2], heap[0][3]) if heap else ([0] * k, [[] for _ in range(k)])


def divide(sizes: list[int], capacity: int) -> list[list[int]]:
    """Windows of item numbers, none over ``capacity``: the least number of windows that holds the sum, raised until differencing fits."""
    k = max(1, -(-sum(sizes) // capacity))
    while True:
        sums, items = differencing(sizes, k)
        if sums[0] <= capacity:
            return [x for x in items if x]
        k += 1


class Packer:
    """Packs a stream of documents; gives pieces (key, ids, start, tokens of the document, sequence, offset)."""

    def __init__(self, capacity: int, first: int):
        self.capacity, self.sequence = capacity, first
        self.group: list[tuple] = []
        self.total, self.full, self.longest = 0, int(WINDOWS * capacity * (1 - SLACK)), max(1, capacity // PARTS)

    def add(self, key, ids: bytes) -> Iterator[tuple]:
        n, at = len(ids) // 4, 0
        while n - at >= self.capacity:
            yield (key, ids[4 * at : 4 * (at + self.capacity)], at, n, self.sequence, 0)
            self.sequence, at = self.sequence + 1, at + self.capacity
        while at < n:  # small pieces leave room for others beside them
            size = min(n - at, self.longest, self.full - self.total)
            self.group.append((key, ids[4 * at : 4 * (at + size)], at, n))
            at, self.total = at + size, self.total + size
            if self.total == self.full:
                yield from self.close()

    def close(self) -> Iterator[tuple]:
        for window in divide([len(p[1]) // 4 for p in self.group], self.capacity) if self.group else ():
            yield from self.filled([self.group[i] for i in window])
        self.group, self.total = [], 0

    def filled(self, pieces: list[tuple]) -> Iterator[tuple]:
        """One sequence of these pieces."""
        offset = 0
        for p in pieces:
            yield (*p, self.sequence, offset)
            offset += len(p[1]) // 4
        self.sequence += 1

    def finish(self) -> Iterator[tuple]:
        """The last group: as many windows as it nearly fills, and sequences of powers of two for the rest."""
        fill, left = max(1, int(self.capacity * (1 - SLACK))), self.group
        rest = self.total % fill
        for size in (1 << bit for bit in reversed(range(rest.bit_length())) if rest >> bit & 1):
            own, left = cut_off(left, size)
            yield from self.filled(own)
        small, finer = max(1, self.capacity // LAST_PARTS), []
        for key, ids, start, n in left:
            finer += [(key, ids[4 * at : 4 * (at + small)], start + at, n) for at in range(0, len(ids) // 4, small)]
        self.group = finer
        yield from self.close()


def cut_off(pieces: list[tuple], size: int) -> tuple[list[tuple], list[tuple]]:
    """The last ``size`` tokens of the pieces, and the pieces before them."""
    left, own = list(pieces), []
    while size:
        key, ids, start, n = left.pop()
        most = len(ids) // 4
        if most > size:
            left.append((key, ids[: 4 * (most - size)], start, n))
            ids, start, most = ids[4 * (most - size) :], start + most - size, size
        own.append((key, ids, start, n))
        size -= most
    return own, left


def pack(docs: DataFrame, text: str = "text", key: str = "doc_id", capacity: int = CAPACITY, end_id: int = END_ID, path: str | None = None, with_ids: bool = True) -> DataFrame:
    """Pack all documents into sequences of at most ``capacity`` tokens.

    Returns one row per piece: ``key``, ``start``, ``length``, ``ids_crc32``,
    ``doc_tokens``, ``sequence_id``, ``offset``, and the piece's ``ids`` if
    ``with_ids``. Null and empty texts are the end id alone. Repeated rows are
    packed each by itself (their pieces carry the same key). An empty table
    gives no rows. Very long texts are cut into full windows as they come.
    Columns other than ``key`` and ``text`` are ignored. A partition holds
    the windows of its own documents; what its last group leaves over stands in
    sequences whose lengths are powers of two, a dozen at most.
    """
    if capacity < 2:
        raise ValueError("capacity: 2 at least")
    rows = docs.select(F.col(key).alias("__key"), text_or_empty(text).alias("__text"))
    kind = rows.schema["__key"].dataType.simpleString()
    schema = f"`{key}` {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids array<int>" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        from pyspark import TaskContext

        own, end = encoder(path), np.array([end_id], dtype="<u4").tobytes()
        packer = Packer(capacity, TaskContext.get().partitionId() << PARTITION_BITS)
        key_type = None

        def batch_of(pieces: list[tuple]) -> pa.RecordBatch:
            columns = [
                pa.array([p[0] for p in pieces], key_type),
                *(pa.array(x, pa.int64()) for x in ([p[2] for p in pieces], [len(p[1]) // 4 for p in pieces], [zlib.crc32(p[1]) for p in pieces], [p[3] for p in pieces], [p[4] for p in pieces], [p[5] for p in pieces])),
            ]
            if with_ids:
                ends = np.cumsum([0, *(len(p[1]) // 4 for p in pieces)], dtype="i4")
                columns.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(p[1] for p in pieces), dtype="<u4").astype("i4"), pa.int32())))
            return pa.RecordBatch.from_arrays(columns, names=[key, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *["ids"] * with_ids])

        for part in slices(batches, "__text"):
            key_type = part.column("__key").type
            encoded = own.encode(part.column("__text").to_pylist())
            pieces = [p for k, ids in zip(part.column("__key").to_pylist(), encoded) for p in packer.add(k, ids + end)]
            if pieces:
                yield batch_of(pieces)
        if pieces := list(packer.finish()):
            yield batch_of(pieces)

    return rows.mapInArrow(run, schema)
