"""SimHash fingerprints and near-duplicate groups by pigeonring filtering (operator 1)."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import arrow_map, salted, stored

BITS, SEED = 64, 42


def fingerprint(text: str, shingle: int = 4) -> int:
    """SimHash of the words' shingles with A-Z lower-cased; no words give 0. Unsigned."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    n = max(1, len(words) - shingle + 1)
    gaps = np.flatnonzero(np.frombuffer(line, np.uint8) == 32)
    starts = np.r_[0, gaps + 1][:n].tolist()
    ends = np.r_[gaps, len(line)][min(shingle, len(words)) - 1 :].tolist()
    counts = np.zeros(BITS, np.int64)
    hash_ = xxhash.xxh64_intdigest
    for k in range(0, n, 1 << 16):
        h = np.array([hash_(line[a:b], SEED) for a, b in zip(starts[k : k + (1 << 16)], ends[k : k + (1 << 16)])], "<u8")
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, tag: Column | None = None) -> DataFrame:
    """id, fp (the 64 bits as a signed long) per row of docs, and tag (a long) where one is given; null texts count as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t.as_py() or "", shingle) for t in b.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps), *b.columns[2:]], names=[id_col, "fp", "tag"][: b.num_columns])

    more = [] if tag is None else [tag.alias("tag")]
    return arrow_map(docs.select(docs[id_col].cast("long").alias(id_col), docs[text_col].cast("string").alias("_text"), *more), run, f"{id_col} long, fp long" + ", tag long" * len(more))


class Ring:
    """The bits of a fingerprint as a ring of 3*budget segments.

    If two fingerprints differ in at most `budget` bits then, for some segment, every chain of consecutive segments that starts
    there differs in at most a third as many bits as it has segments. So the m-th differing segment of the chain lies at place 3m-1 or later
    (from 0): a key for each start and each way to leave out the segments that may differ finds all such pairs. A chain of 5 leaves out one
    of the last three and keeps about 21 bits; 8 leave out two and keep 32; 11 leave out three and keep 43.
    """

    def __init__(self, budget: int = 4):
        if not 1 <= budget <= 21:
            raise ValueError("budget must be 1 to 21")
        self.budget, self.n = budget, 3 * budget
        edges = [BITS * k // self.n for k in range(self.n + 1)]
        self.segments = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:])]
        self.chains = [3 * m + 2 for m in range(min(1, budget - 1), budget)]

    def masks(self, start: int, chain: int) -> list[int]:
        """The bits of each key of the chain from `start`."""
        left_out = [c for c in combinations(range(chain), chain // 3) if all(p >= 3 * m + 2 for m, p in enumerate(c))]
        return [sum(self.segments[(start + k) % self.n] for k in range(chain) if k not in c) for c in left_out]

    def keys(self, fp: Column, start: Column, chain: int) -> Column:
        """Array of the keys of the chain from `start`: a hash of the masked bits, with the start in the low bits."""
        signed = [[m - (1 << 64) if m >> 63 else m for m in self.masks(s, chain)] for s in range(self.n)]
        masks = F.element_at(F.array(*[F.array(*map(F.lit, row)) for row in signed]), start + 1)
        hashed = F.transform(masks, lambda m, k: F.xxhash64(k, start, fp.bitwiseAND(m)))
        return F.transform(hashed, lambda h: F.shiftleft(h, 6).bitwiseOR(start.cast("long")))

    def near(self, x: np.ndarray, start: np.ndarray) -> np.ndarray:
        """Places of those differences x that keep to the budget along the whole ring from `start`."""
        at, total = np.arange(len(x)), np.zeros(len(x), np.int64)
        segments = np.array(self.segments, np.uint64)
        for k in range(self.n):
            total = total + np.bitwise_count(x[at] & segments[(start[at] + k) % self.n])
            ok = total <= (k + 1) // 3
            at, total = at[ok], total[ok]
        return at


@dataclass(frozen=True)
class Bounds:
    """What one task compares by itself; a run of equal keys beyond it gets longer chains, so nothing is dropped.

    block_rows: rows held at a time. A run that is not yet one group after `lags` neighbours of each row is left to longer chains if it
    still has over `groups` groups or over `run_rows` rows.
    """

    block_rows: int = 400_000
    lags: int = 64
    groups: int = 2048
    run_rows: int = 32768


def link_runs(key: np.ndarray, fp: np.ndarray, ring: Ring, bounds: Bounds | None) -> tuple[list[tuple[int, int]], np.ndarray]:
    """Links that join what is near within the runs of equal key (sorted), as a forest: a pair already joined is not compared.

    Also marks the rows of runs beyond the bounds (none without bounds).
    """
    nodes, at = np.unique(fp, return_inverse=True)
    parent = list(range(len(nodes)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    edge = np.r_[True, key[1:] != key[:-1]]
    runs, run_of = np.flatnonzero(edge), np.cumsum(edge) - 1
    label, out, beyond = np.arange(len(nodes)), [], np.zeros(len(runs), bool)
    left, lag = np.flatnonzero(key[1:] == key[:-1]), 1
    while len(left):
        pairs = left[label[at[left]] != label[at[left + lag]]]
        if len(pairs):
            near = pairs[ring.near(fp[pairs] ^ fp[pairs + lag], (key[pairs] & np.uint64(63)).astype(np.int64))]
            joined = False
            for a, b in zip(at[near].tolist(), at[near + lag].tolist()):
                ra, rb = root(a), root(b)
                if ra != rb:
                    parent[max(ra, rb)] = min(ra, rb)
                    out.append((int(nodes[a]), int(nodes[b])))
                    joined = True
            if joined:
                label = np.array(parent)
                while not np.array_equal(label, label[label]):
                    label = label[label]
        lag += 1
        left = left[left + lag < len(key)]
        left = left[key[left] == key[left + lag]]
        if not len(left):
            break
        if lag % 8 == 0:  # runs that are one group by now need no more
            lab = label[at]
            mixed = np.minimum.reduceat(lab, runs) != np.maximum.reduceat(lab, runs)
            left = left[mixed[run_of[left]]]
        if bounds and lag == bounds.lags and len(left):
            groups = np.bincount(np.unique(np.c_[run_of, label[at]], axis=0)[:, 0], minlength=len(runs))
            beyond[run_of[left]] = True
            beyond &= (groups > bounds.groups) | (np.bincount(run_of, minlength=len(runs)) > bounds.run_rows)
            left = left[~beyond[run_of[left]]]
    return out, beyond[run_of]


def _links(rows: DataFrame, ring: Ring, chain: int, bounds: Bounds | None, block_rows: int) -> DataFrame:
    """a, b, start of links (start -1) and of fingerprints a that need a longer chain from start (b null), from rows of fp and start."""
    keyed = rows.select("fp", F.explode(ring.keys(F.col("fp"), F.col("start"), chain)).alias("key"))
    keyed = keyed.repartition("key").sortWithinPartitions("key")
    names = ["a", "b", "start"]

    def longer(key: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(fp.view(np.int64)), pa.nulls(len(fp), pa.int64()), pa.array((key & np.uint64(63)).astype(np.int32))], names=names)

    def done(key: np.ndarray, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
        found, beyond = link_runs(key, fp, ring, bounds)
        ends = np.array(found, np.uint64).reshape(-1, 2).view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(ends[:, 0]), pa.array(ends[:, 1]), pa.array(np.full(len(ends), -1, np.int32))], names=names)
        if beyond.any():
            yield longer(key[beyond], fp[beyond])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = fp = np.zeros(0, np.uint64)
        passed = None  # the key of a run that outgrew a block
        for b in batches:
            f, k = (c.to_numpy(zero_copy_only=False).view(np.uint64) for c in b.columns)
            if passed is not None:
                same = k == passed
                if same.any():
                    yield longer(k[same], f[same])
                k, f = k[~same], f[~same]
            key, fp = np.concatenate([key, k]), np.concatenate([fp, f])
            if len(key) < block_rows:
                continue
            cut = int(np.searchsorted(key.view(np.int64), key.view(np.int64)[-1]))
            if cut:
                yield from done(key[:cut], fp[:cut])
                key, fp = key[cut:], fp[cut:]
            if bounds and len(key) >= block_rows:
                yield longer(key, fp)
                passed, key, fp = key[0], key[:0], fp[:0]
        if len(key):
            yield from done(key, fp)

    return keyed.mapInArrow(run, "a long, b long, start int")


def near_links(distinct_fps: DataFrame, ring: Ring, bounds: Bounds = Bounds()) -> DataFrame:
    """a, b: links between fingerprints at most the budget apart that keep every group of such links together.

    Rows with one key meet in one sorted stream, of which a task holds a block. Runs beyond the bounds, as of hot keys or of very many
    fingerprints, go on to chains of three more segments from the same start. What shares a key of the longest chain differs only in the
    four segments outside it (22 bits at a budget of four), so that run is bounded by itself.
    """
    rows = distinct_fps.select("fp", F.explode(F.sequence(F.lit(0), F.lit(ring.n - 1))).alias("start"))
    links = None
    for chain in ring.chains:
        last = chain == ring.chains[-1]
        found = stored(_links(rows, ring, chain, None if last else bounds, bounds.block_rows))
        of_chain = found.where("start < 0").select("a", "b")
        links = of_chain if links is None else links.unionByName(of_chain)
        rows = found.where("start >= 0").select(F.col("a").alias("fp"), "start").distinct()
        if last or rows.isEmpty():
            break
    return links


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, budget: int = 4, tag: Column | None = None) -> DataFrame:
    """id, fingerprint (16 hex digits), component_id (the smallest id that links reach) for every row of docs, and the row's tag where one is given.

    Two rows are linked if their fingerprints differ in at most `budget` bits. Null and empty texts have fingerprint zero and are linked like
    others; repeated ids give repeated rows; an empty table gives none; other columns are ignored. Copies are first reduced to one
    row for each fingerprint, so a group of equal texts, however large, is one node, and only distinct fingerprints are compared.
    """
    prints = stored(fingerprints(docs, id_col=id_col, text_col=text_col, shingle=shingle, tag=tag))
    nodes = stored(prints.groupBy("fp").agg(F.min(id_col).alias("least"), F.count(F.lit(1)).alias("n")))
    groups = components(near_links(nodes, Ring(budget)))
    placed = stored(nodes.join(groups.withColumnRenamed("node", "fp").hint("merge"), "fp", "left").select("fp", "least", F.coalesce("component", "fp").alias("component")))
    smallest = placed.groupBy("component").agg(F.min("least").alias("component_id"))
    of = salted(placed, "component", smallest, "fp", merge=True).select("fp", "component_id")
    of = salted(prints, "fp", of, id_col, counts=nodes.select("fp", "n"), merge=True)
    return of.select(id_col, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", *prints.columns[2:])
