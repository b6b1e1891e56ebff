"""Packing of token sequences by Karmarkar-Karp multiway differencing.

A document of n tokens gives floor(n / capacity) full pieces, each a sequence of
its own, and a rest, which is cut further only where it is longer than
``max_piece``.  Rests are dealt into blocks of at most ``BLOCK`` pieces, and each
block is partitioned into k windows: every piece starts as a partial partition
with one filled window; the two partial partitions with the largest imbalance
(largest minus smallest window) are merged with opposing order, largest onto
smallest, until one is left.  k starts at ceil(sum / capacity) and rises by one
whenever the largest window exceeds the capacity.  Windows come out nearly equal,
so almost all have nearly the mean length.

Blocks are formed inside a partition from sorted rows, so a sequence never waits
for more than BLOCK pieces, no group is unbounded, and a repeated task forms the
same blocks.  Rows are dealt by a hash of id, text checksum and start; only piece
descriptions are shuffled, never ids or texts.

Defined cases: a null or empty text is one piece, the end id alone; null or
repeated ids are kept and packed like others; pieces of equal length are merged in
the order of their rows, which equal rows share; an empty table gives no piece;
other columns are ignored.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.llm.arrow_groups import lean

CAPACITY = 2048
BLOCK = 256
MAX_PIECE = 683


def differencing(sizes: list[int], k: int) -> tuple[list[int], list[list[int]]]:
    """Karmarkar-Karp: sums and members of k windows over ``sizes``."""
    n = len(sizes)
    if k == 1:
        return [sum(sizes)], [list(range(n))]
    # Window contents are trees: node x < n is piece x, -1 is empty, others join two nodes.
    left, right = [np.full(n, -1)], [np.full(n, -1)]
    nodes = n
    heap: list[tuple] = []
    for i, size in enumerate(sizes):
        sums, held = np.zeros(k, np.int64), np.full(k, -1)
        sums[0], held[0] = size, i
        heap.append((-size, i, sums, held))
    heapq.heapify(heap)
    turn = n
    while len(heap) > 1:
        _, _, a, held_a = heapq.heappop(heap)
        _, _, b, held_b = heapq.heappop(heap)
        sums, flipped = a + b[::-1], held_b[::-1]
        both = (held_a >= 0) & (flipped >= 0)
        held = np.where(held_a >= 0, held_a, flipped)
        joined = int(both.sum())
        if joined:
            left.append(held_a[both])
            right.append(flipped[both])
            held[both] = np.arange(nodes, nodes + joined)
            nodes += joined
        order = np.argsort(-sums, kind="stable")
        sums, held = sums[order], held[order]
        heapq.heappush(heap, (int(sums[-1] - sums[0]), turn, sums, held))
        turn += 1
    _, _, sums, held = heap[0]
    lefts, rights = np.concatenate(left).tolist(), np.concatenate(right).tolist()
    members = []
    for node in held.tolist():
        found, stack = [], [node] if node >= 0 else []
        while stack:
            x = stack.pop()
            if x < n:
                found.append(x)
            else:
                stack += (rights[x], lefts[x])
        members.append(sorted(found))
    return sums.tolist(), members


def windows(sizes: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    """Members of near-equal windows of at most ``capacity``; no window is empty."""
    if not sizes:
        return []
    if max(sizes) > capacity:
        raise ValueError("a piece is longer than the capacity")
    k = -(-sum(sizes) // capacity)
    while True:
        sums, members = differencing(sizes, k)
        if max(sums) <= capacity:
            return [m for m in members if m]
        k += 1


def cuts(tokens: int, capacity: int = CAPACITY, max_piece: int = MAX_PIECE) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document: full ones, then its rest in equal parts."""
    whole, rest = divmod(tokens, capacity)
    out = [(i * capacity, capacity) for i in range(whole)]
    parts = -(-rest // max_piece)
    at = whole * capacity
    for i in range(parts):
        size = rest // parts + (i < rest % parts)
        out.append((at, size))
        at += size
    return out


def _cutter(path: str, capacity: int, max_piece: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from lodestrata.llm.tokens import encoder

        encode = encoder(path)
        for batch in batches:
            where, start, length, crc, tokens = [], [], [], [], []
            for row, ids in enumerate(encode.column(batch.column("text"))):
                for at, size in cuts(len(ids), capacity, max_piece):
                    where.append(row)
                    start.append(at)
                    length.append(size)
                    crc.append(zlib.crc32(ids[at : at + size]))
                    tokens.append(len(ids))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(where, pa.int64())), *(pa.array(x, pa.int64()) for x in (start, length, crc, tokens))],
                ["doc_id", "start", "length", "ids_crc32", "doc_tokens"],
            )
        encode.forget()
    return cut


def _packer(capacity: int, block: int):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sequence = TaskContext.get().partitionId() << 40

        def emit(rows: pa.Table) -> pa.RecordBatch:
            nonlocal sequence
            sizes = rows.column("length").to_pylist()
            number, offset = [0] * len(sizes), [0] * len(sizes)
            rests = [i for i, n in enumerate(sizes) if n < capacity]
            groups = [[i] for i, n in enumerate(sizes) if n == capacity]
            groups += [[rests[i] for i in m] for m in windows([sizes[i] for i in rests], capacity)]
            for members in groups:
                at = 0
                for i in members:
                    number[i], offset[i] = sequence, at
                    at += sizes[i]
                sequence += 1
            out = rows.append_column("sequence_id", pa.array(number, pa.int64())).append_column("offset", pa.array(offset, pa.int64()))
            return out.combine_chunks().to_batches()[0]

        held: list[pa.RecordBatch] = []
        rests = 0
        for batch in batches:
            short = (batch.column("length").to_numpy() < capacity).cumsum()
            begin = 0
            while begin < batch.num_rows:
                base = short[begin - 1] if begin else 0
                end = min(int(np.searchsorted(short, base + block - rests)) + 1, batch.num_rows)
                held.append(batch.slice(begin, end - begin))
                rests += int(short[end - 1] - base)
                begin = end
                if rests >= block:
                    yield emit(pa.Table.from_batches(held))
                    held, rests = [], 0
        if held:
            yield emit(pa.Table.from_batches(held))
    return pack


def pack(docs: DataFrame, tokenizer: str, text: str = "text", doc_id: str = "doc_id", capacity: int = CAPACITY, max_piece: int = MAX_PIECE, block: int = BLOCK) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    kind = docs.schema[doc_id].dataType.simpleString()
    base = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    fields = f"doc_id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint"
    pieces = base.mapInArrow(lean(_cutter(tokenizer, capacity, max_piece)), fields)
    order = ["doc_id", "start", "ids_crc32", "doc_tokens", "length"]
    dealt = pieces.repartition("doc_id", "start", "ids_crc32").sortWithinPartitions(*order)
    return dealt.mapInArrow(lean(_packer(capacity, block)), f"{fields}, sequence_id bigint, offset bigint")
