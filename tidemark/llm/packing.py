"""Cost-balanced packing of documents into token sequences (operator 4)."""

from __future__ import annotations

import heapq
import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .byte_bpe import ByteBpe
from .shared import arrow_map

SCHEMA = "{id} long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def assign(lengths: list[int], size: int, linear: float, quadratic: float) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Pieces (document, start, length, sequence, offset) and the number of sequences.

    The sequences have exactly as many places as there are tokens: as many of `size` as are full, and for what is
    left one for each power of two in it, so nothing is padded. Whole runs of `size` of a long document take a
    sequence each. The rest go in descending length to the sequence of lowest cost that can hold them, where a piece of
    n tokens costs linear*n + quadratic*n*n. What fits none is cut at the end of the cheapest. The search is exact: a tree
    over the places left holds the cheapest sequence of each range.
    """
    total = sum(lengths)
    out, seq, rest = [], 0, []
    for doc, n in enumerate(lengths):
        start = 0
        while n - start >= size:
            out.append((doc, start, size, seq, 0))
            seq, start = seq + 1, start + size
        if n > start:
            rest.append((start - n, doc, start))
    left = total - seq * size
    heapq.heapify(rest)
    room = {seq + i: size for i in range(left // size)}
    leaves = 1 << (size - 1).bit_length()
    none = (float("inf"), -1)
    costs: list[list[tuple[float, int]]] = [[] for _ in range(size + 1)]  # a heap for each number of places left
    tree = [none] * (2 * leaves)

    def renew(places: int) -> None:
        i = leaves + places - 1
        tree[i] = costs[places][0] if costs[places] else none
        while i := i >> 1:
            tree[i] = min(tree[2 * i], tree[2 * i + 1])

    def cheapest(places: int) -> tuple[float, int]:
        i = leaves + places - 1
        best = tree[i]
        while i > 1:
            if not i & 1:
                best = min(best, tree[i + 1])
            i >>= 1
        return best

    costs[size] = [(0.0, s) for s in room]
    renew(size)
    while rest and tree[1] != none:
        minus, doc, start = heapq.heappop(rest)
        n = -minus
        cost, s = found if (found := cheapest(n)) != none else tree[1]
        free = room[s]
        heapq.heappop(costs[free])
        renew(free)
        put = min(n, free)
        out.append((doc, start, put, s, size - free))
        room[s] -= put
        if room[s]:
            heapq.heappush(costs[room[s]], (cost + linear * put + quadratic * put * put, s))
            renew(room[s])
        if put < n:
            heapq.heappush(rest, (put - n, doc, start + put))
    seq += left // size
    tails = [1 << b for b in range(size.bit_length() - 1, -1, -1) if (left % size) >> b & 1]
    used = 0
    while rest:
        minus, doc, start = heapq.heappop(rest)
        n = -minus
        while n:
            put = min(n, tails[0] - used)
            out.append((doc, start, put, seq, used))
            start, n, used = start + put, n - put, used + put
            if used == tails[0]:
                tails.pop(0)
                seq, used = seq + 1, 0
    return out, seq


def pack(docs: DataFrame, vocabulary: str, *, id_col: str = "doc_id", text_col: str = "text", max_tokens: int = 2048, end_id: int = 1, linear: float = 1.0, quadratic: float = 1 / 2048, group_tokens: int = 1 << 21) -> DataFrame:
    """One row per piece of a document: its place in the document and in its sequence, and its ids.

    max_tokens is a power of two. Every document ends with end_id, so each has at least one piece. Tokens are made once, where the
    documents lie, and documents are dealt out in groups of about group_tokens within a partition: no shuffle, and memory is bounded by
    one group and one document. Null texts count as empty, an empty table gives no rows, repeated rows are packed once each, other
    columns of docs are ignored. A sequence id holds its partition's number, so ids are unique; ties in length go by order of arrival.
    """
    if max_tokens & (max_tokens - 1):
        raise ValueError("max_tokens must be a power of two")
    names = SCHEMA.format(id=id_col)
    fields = pa.schema([(x.split()[0], pa.binary() if "binary" in x else pa.int64()) for x in names.split(", ")])

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, bytes]]:
        bpe = ByteBpe(vocabulary)
        for b in batches:
            for i, text in zip(b.column(0).to_pylist(), b.column(1)):
                ids = bpe.encode(text.as_py() or "")
                ids.append(end_id)
                if sys.byteorder == "big":
                    ids.byteswap()
                yield i, ids.tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 36
        group: list[tuple[int, bytes]] = []
        held = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal base
            pieces, used = assign([len(x) // 4 for _, x in group], max_tokens, linear, quadratic)
            for k in range(0, len(pieces), 2000):
                part = pieces[k : k + 2000]
                cols = [
                    [group[d][0] for d, *_ in part],
                    [s for _, s, *_ in part],
                    [n for _, _, n, *_ in part],
                    [group[d][1][4 * s : 4 * (s + n)] for d, s, n, *_ in part],
                    [len(group[d][1]) // 4 for d, *_ in part],
                    [base + q for *_, q, _ in part],
                    [o for *_, o in part],
                ]
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(cols, fields)], schema=fields)
            base += used

        for x in tokens(batches):
            group.append(x)
            held += len(x[1]) // 4
            if held >= group_tokens:
                yield from flush()
                group, held = [], 0
        if group:
            yield from flush()

    return arrow_map(docs.select(docs[id_col].cast("long").alias(id_col), docs[text_col].cast("string").alias("_text")), run, names)
