"""Ranked lexical search with WAND over shards of documents (operator 12)."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import arrow_map, stored

#: Upper-case letters to lower-case ones, and every ASCII character that is neither letter nor digit to a space.
TABLE = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def terms(text: bytes | None) -> list[bytes]:
    """The terms of a text in UTF-8, in order: runs of ASCII letters, digits and of anything beyond ASCII."""
    return text.translate(TABLE).split() if text else []


def weight(documents: int, holding: int) -> int:
    """Weight of a term that `holding` of the documents hold."""
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * holding + 1)))


@dataclass
class Best:
    """The k highest scores so far of one item, ties to the smaller id; a missing id comes last."""

    k: int
    score: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    doc: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    null: np.ndarray = field(default_factory=lambda: np.zeros(0, bool))

    @property
    def threshold(self) -> int:
        """A document of a lower score cannot enter."""
        return int(self.score[-1]) if len(self.score) == self.k else 1

    def add(self, score: np.ndarray, doc: np.ndarray, null: np.ndarray) -> None:
        score, doc, null = (np.concatenate(x) for x in ((self.score, score), (self.doc, doc), (self.null, null)))
        best = np.lexsort((doc, null, -score))[: self.k]
        self.score, self.doc, self.null = score[best], doc[best], null[best]


class Shard:
    """Inverted lists of some documents: for each term its documents by place, its impacts, and the largest of them."""

    def __init__(self, docs: np.ndarray, null: np.ndarray, norm: np.ndarray, place: np.ndarray, term: np.ndarray, tf: np.ndarray, weights: np.ndarray, window: int):
        order = np.argsort(term, kind="stable")
        place, term, tf = place[order], term[order], tf[order]
        self.docs, self.null, self.place, self.window = docs, null, place, window
        self.impact = weights[term] * ((1_000_000_000 * tf) // (1000 * tf + 20 * norm[place]))
        edges = np.arange(0, len(docs) + window, window)
        first = np.searchsorted(term, np.arange(len(weights)))
        # where each window of each list begins: the position of (term, edge) among the pairs (term, place), which are in order
        self.begins = np.searchsorted(term.astype(np.int64) * (len(docs) + window) + place, np.arange(len(weights))[:, None] * (len(docs) + window) + edges)
        self.most = np.zeros(len(weights), np.int64)
        held = np.flatnonzero(np.diff(np.append(first, len(term))))
        if len(held):
            self.most[held] = np.maximum.reduceat(self.impact, first[held])

    def search(self, query: np.ndarray, best: Best) -> None:
        """Add to best what can enter it. The next pivot is the first window at which the largest impacts of the lists that have documents there
        add up to the threshold; lists jump over all windows before. Within it only documents whose own lists' largest impacts reach the threshold are scored."""
        begins = self.begins[query]
        most = self.most[query]
        bound = ((np.diff(begins, axis=1) > 0) * most[:, None]).sum(0)
        at = 0
        while True:
            ahead = np.flatnonzero(bound[at:] >= best.threshold)
            if not len(ahead):
                return
            at += int(ahead[0])
            live = np.flatnonzero(begins[:, at + 1] > begins[:, at])
            spans = [slice(a, b) for a, b in zip(begins[live, at].tolist(), begins[live, at + 1].tolist())]
            place = np.concatenate([self.place[s] for s in spans]) - at * self.window
            upper = np.zeros(self.window, np.int64)
            np.add.at(upper, place, np.repeat(most[live], [s.stop - s.start for s in spans]))
            pivots = upper >= best.threshold
            if pivots.any():
                own = pivots[place]
                score = np.zeros(self.window, np.int64)
                np.add.at(score, place[own], np.concatenate([self.impact[s] for s in spans])[own])
                found = np.flatnonzero(score >= best.threshold)
                if len(found):
                    chosen = found + at * self.window
                    best.add(score[found], self.docs[chosen], self.null[chosen])
            at += 1


def blocks(items: DataFrame, rows: int, size: int) -> Iterator[list[tuple[int | None, list[bytes]]]]:
    """Items with their different terms, in blocks of at most so many rows and about so many bytes of text: the driver holds one at a time."""
    block, held = [], 0
    for r in items.toLocalIterator():
        own = sorted(set(terms(None if r[1] is None else bytes(r[1]))))
        if own:
            block.append((r[0], own))
            held += sum(map(len, own))
        if len(block) >= rows or held >= size:
            yield block
            block, held = [], 0
    if block:
        yield block


def search(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", k: int = 50, shard_postings: int = 4_000_000, shard_docs: int = 65_536, window: int = 1024, block_items: int = 1000, block_bytes: int = 4 << 20) -> DataFrame:
    """item_id, rank, doc_id, score: for each item the k documents of highest score above 0, equal scores by ascending id.

    Scores are whole numbers: the weight of a term times a saturated frequency, summed over an item's different terms. Whole texts are read once for each block of items: a document leaves its number of
    terms and the frequencies of those that some item asks for. Counts of documents, terms and documents by term are sums of one row a task and term. Each
    task then inverts its documents in shards of bounded size and runs every item over them by WAND; an item's heap goes on from shard to shard, so its threshold
    rises, and leaves k rows a task. These heaps merge in two steps, so no task reads more than k rows for each of about the square root of the tasks.

    Null texts have no terms; neither they nor items without terms have results. Null ids are ids after all others. Rows that share a doc_id are documents of their own, and rows that share an item_id are
    items of their own, answered each, also if all else is equal. Empty tables give no rows; other columns are ignored. One long text is one document and is held whole in a task.
    """
    spark = docs.sparkSession
    out_schema = "item_id long, rank int, doc_id long, score long"
    texts = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").cast("binary").alias("text"))
    asked = items.select(items[item_col].cast("long").alias("item_id"), items[item_text_col].cast("string").cast("binary").alias("text"))
    out = None
    for block in blocks(asked, block_items, block_bytes):
        found = _block(texts, block, k, shard_postings, shard_docs, window)
        out = found if out is None else out.unionByName(found)
    return spark.createDataFrame([], out_schema) if out is None else out.select("item_id", "rank", "doc_id", "score")


def _block(texts: DataFrame, block: list[tuple[int | None, list[bytes]]], k: int, shard_postings: int, shard_docs: int, window: int) -> DataFrame:
    spark = texts.sparkSession
    number = {t: i for i, t in enumerate(sorted({t for _, own in block for t in own}))}
    known = spark.sparkContext.broadcast(number)  # bounded by the block

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = known.value
        for b in batches:
            n, ids, tfs = [], [], []
            for text in b.column(1):
                words = terms(text.as_py())
                held = {number[t]: c for t, c in Counter(words).items() if t in number}
                n.append(len(words))
                ids.append(list(held))
                tfs.append(list(held.values()))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.list_(pa.int32())), pa.array(tfs, pa.list_(pa.int64()))], names=["doc_id", "n", "terms", "tfs"])

    counted = stored(arrow_map(texts, count, "doc_id long, n long, terms array<int>, tfs array<bigint>"))
    total = counted.agg(F.count_if(F.col("n") > 0).alias("documents"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
    n_terms = len(number)

    def holding(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(n_terms, np.int64)
        for b in batches:
            df += np.bincount(b.column(0).flatten().to_numpy(), minlength=n_terms)
        own = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), pa.array(df[own])], names=["term", "df"])

    by_term = arrow_map(counted.select("terms"), holding, "term int, df long").groupBy("term").agg(F.sum("df").alias("df"))
    weights = np.zeros(n_terms, np.int64)
    for r in by_term.collect():  # at most the block's terms
        weights[r["term"]] = weight(total["documents"], r["df"])
    shared = spark.sparkContext.broadcast((weights, [np.array([number[t] for t in own], np.int64) for _, own in block]))
    documents, all_terms = total["documents"], max(1, total["terms"])

    def wand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, queries = shared.value
        heaps = [Best(k) for _ in queries]
        held: list[pa.RecordBatch] = []

        def run() -> None:
            rows = pa.Table.from_batches(held).combine_chunks()
            ids, n = rows.column("doc_id"), rows.column("n").to_numpy()
            lists = rows.column("terms").combine_chunks()
            sizes = np.diff(lists.offsets.to_numpy())
            place = np.repeat(np.arange(len(n)), sizes)
            norm = 50 + (50 * n * documents) // all_terms
            shard = Shard(ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(), norm, place, lists.flatten().to_numpy(), rows.column("tfs").combine_chunks().flatten().to_numpy(), weights, window)
            for query, heap in zip(queries, heaps):
                shard.search(query, heap)
            held.clear()

        docs = postings = 0
        for b in batches:
            held.append(b)
            docs, postings = docs + b.num_rows, postings + len(b.column(2).flatten())
            if docs >= shard_docs or postings >= shard_postings:
                run()
                docs = postings = 0
        if held:
            run()
        for i, h in enumerate(heaps):
            if len(h.score):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h.score), i, np.int32)), pa.array(h.doc, mask=h.null), pa.array(h.score)], names=["query", "doc_id", "score"])

    some = counted.where(F.size("terms") > 0)
    heaps = stored(arrow_map(some, wand, "query int, doc_id long, score long").withColumn("task", F.spark_partition_id()))
    tasks = (heaps.agg(F.max("task")).first()[0] or 0) + 1
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    ranked = lambda df, *by: df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= k)
    merged = ranked(heaps.withColumn("group", F.col("task") % max(1, math.isqrt(tasks))), "query", "group")
    names = spark.createDataFrame([(i, item) for i, (item, _) in enumerate(block)], "query int, item_id long")
    return ranked(merged.drop("rank"), "query").join(F.broadcast(names), "query").select("item_id", "rank", "doc_id", "score")
