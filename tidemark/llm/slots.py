"""Best-fit packing planned over a histogram of lengths (operator 11)."""

from __future__ import annotations

import sys
from collections import defaultdict
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .byte_bpe import ByteBpe
from .shared import arrow_map, stored

#: Rows of the table of first ranks up to which it is broadcast (some 10 MB); beyond it the join is a merge.
BROADCAST_ROWS = 100_000


def planned(counts: Mapping[int, int], size: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Runs (length, first rank, first sequence, pieces a sequence, offset) and the number of sequences.

    Best-fit decreasing over counts: lengths descend, and pieces of one length go to the fullest sequences that can take them, all sequences with the same
    room at once. Such a sequence takes as many as fit before the next is begun, as it is the fuller one from then on. Piece number q of a
    run, from its first rank on, is in sequence first + q div pieces, at offset + (q mod pieces) * length. A length adds at most three groups of sequences
    with one room, so there are at most 3 * size groups and the plan's size does not grow with the documents.
    """
    room: dict[int, list[tuple[int, int]]] = defaultdict(list)  # (first sequence, sequences) with so many places left
    runs, used = [], 0
    for n in sorted((n for n, c in counts.items() if c), reverse=True):
        left, rank = counts[n], 0
        for free in [*(f for f in range(n, size) if room.get(f)), size]:
            each = free // n
            if free == size and left:
                room[size].append((used, -(-left // each)))
                used += -(-left // each)
            while left and room[free]:
                first, sequences = room[free].pop()
                full = min(sequences, left // each)
                for many, take in ((full, each), (1 if full < sequences and left > full * each else 0, left - full * each)):
                    if many:
                        runs.append((n, rank, first, take, size - free))
                        room[free - take * n].append((first, many))
                        rank, left, first, sequences = rank + many * take, left - many * take, first + many, sequences - many
                if sequences:
                    room[free].append((first, sequences))
            if not left:
                break
    return runs, used


def pack(docs: DataFrame, vocabulary: str, *, id_col: str = "doc_id", text_col: str = "text", max_tokens: int = 1024, end_id: int = 2, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """One row a piece of a document: its number and place in the document, its ids (little-endian unsigned 32-bit), and its place in a sequence of at most max_tokens.

    Only documents of more than max_tokens are cut, into pieces of max_tokens with what is over in the first. Tokens are made once, where the documents lie, and each piece is written
    with its rank among the pieces of its length within its task. Counts by task and length give the first rank of each task, and the histogram that planned() packs; a piece's
    rank within its length then names its slot. The join on task and length takes first ranks that number at most max_tokens a task: up to broadcast_rows
    they are broadcast, beyond that it is a merge whose keys hold at most one task's pieces. The plan is bounded by max_tokens alone.

    Every document ends with end_id, so each has a piece. Null texts count as empty, null ids stay null, repeated rows are packed once each, an empty table gives no rows, other columns of docs
    are ignored. Which of several pieces of one length takes which slot goes by task and order of arrival.
    """
    spark = docs.sparkSession

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, task, ranks = ByteBpe(vocabulary), TaskContext.get().partitionId(), np.zeros(max_tokens + 1, np.int64)
        for b in batches:
            cols: list[list] = [[] for _ in range(7)]
            for doc, text in zip(b.column(0).to_pylist(), b.column(1)):
                ids = bpe.encode(text.as_py() or "")
                ids.append(end_id)
                cuts = [0, *range(len(ids) % max_tokens or max_tokens, len(ids) + 1, max_tokens)]
                if sys.byteorder == "big":
                    ids.byteswap()
                for k, (start, stop) in enumerate(zip(cuts, cuts[1:])):
                    for c, v in zip(cols, (doc, k, start, stop - start, ids[start:stop].tobytes(), task, int(ranks[stop - start]))):
                        c.append(v)
                    ranks[stop - start] += 1
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=[id_col, "piece", "start", "length", "ids", "task", "own_rank"])

    narrow = docs.select(docs[id_col].cast("long").alias(id_col), docs[text_col].cast("string").alias("_text"))
    cut = stored(arrow_map(narrow, pieces, f"`{id_col}` long, piece int, start long, length long, ids binary, task int, own_rank long"))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)  # at most one row a task
    by_task = cut.groupBy("task", "length").agg(F.count(F.lit(1)).alias("n"))
    firsts = stored(by_task.select("task", "length", "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first_rank")))
    counts = {r["length"]: r["n"] for r in firsts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most max_tokens rows
    runs, _ = planned(counts, max_tokens)
    table = np.array(runs or [(0, 0, 0, 1, 0)], np.int64)
    table = table[np.lexsort((table[:, 1], table[:, 0]))]
    plan = spark.sparkContext.broadcast((table, np.searchsorted(table[:, 0], np.arange(max_tokens + 2))))

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, begins = plan.value
        for b in batches:
            length, rank = b.column(3).to_numpy(), b.column(5).to_numpy()
            at = np.empty(len(rank), np.int64)
            for n in np.unique(length):
                own = length == n
                at[own] = begins[n] + np.searchsorted(table[begins[n] : begins[n + 1], 1], rank[own], side="right") - 1
            _, first, sequence, each, offset = table[at].T
            q = rank - first
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(sequence + q // each), pa.array(offset + q % each * length)], names=[*b.schema.names[:5], "sequence_id", "offset"])

    small = firsts.limit(broadcast_rows + 1).count() <= broadcast_rows
    starts = firsts.select("task", "length", "first_rank")
    ranked = cut.join(F.broadcast(starts) if small else starts.hint("merge"), ["task", "length"])
    ranked = ranked.select(id_col, "piece", "start", "length", "ids", (F.col("first_rank") + F.col("own_rank")).alias("rank"))
    return arrow_map(ranked, placed, f"`{id_col}` long, piece int, start long, length long, ids binary, sequence_id long, offset long")
