"""Maximum inner product search with score-aware quantisation (operator 10)."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import arrow_map, stored


@dataclass
class Codebooks:
    """Cell centres and, for each subspace of `width` dimensions, 16 words for what the centres leave."""

    centres: np.ndarray  # cells x dims
    words: np.ndarray  # subspaces x 16 x width
    eta: float

    @property
    def width(self) -> int:
        return self.words.shape[2]

    def cells(self, x: np.ndarray) -> np.ndarray:
        """The cell of each row: the centre nearest to it."""
        c = self.centres
        return np.argmin((c * c).sum(1) - 2 * x @ c.T, axis=1) if len(x) else np.zeros(0, np.int64)

    def codes(self, x: np.ndarray, cells: np.ndarray, sweeps: int = 3) -> np.ndarray:
        """Four-bit codes that lower |r|^2 + (eta - 1) <r, x/|x|>^2, r the residual error, one subspace at a time."""
        n, (m, _, w) = len(x), self.words.shape
        rest = (x - self.centres[cells]).reshape(n, m, w)
        unit = (x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-30)).reshape(n, m, w)
        square = ((rest[:, :, None, :] - self.words) ** 2).sum(-1)  # n x m x 16
        along = np.einsum("nmw,mkw->nmk", unit, self.words)
        base = (rest * unit).sum(-1)
        codes = square.argmin(-1)
        at = np.arange(n)
        parallel = base.sum(1) - np.take_along_axis(along, codes[:, :, None], 2)[:, :, 0].sum(1)
        for _ in range(sweeps):
            for j in range(m):
                without = parallel + along[at, j, codes[:, j]]
                best = (square[:, j] + (self.eta - 1) * (without[:, None] - along[:, j]) ** 2).argmin(1)
                parallel = without - along[at, j, best]
                codes[:, j] = best
        return codes.astype(np.uint8)


def fit(sample: np.ndarray, cells: int, width: int, eta: float, rounds: int = 8, seed: int = 7) -> Codebooks:
    """Codebooks from a sample: k-means cells, then words by turns of coding and of solving the weighted least squares for all words."""
    rng = np.random.default_rng(seed)
    n, dims = sample.shape
    pad = -dims % width
    x = np.pad(sample, ((0, 0), (0, pad))).astype(np.float64)
    cells = max(1, min(cells, n))
    centres = x[rng.choice(n, cells, replace=False)].copy()
    for _ in range(12):
        near = np.argmin((centres * centres).sum(1) - 2 * x @ centres.T, axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        size = np.bincount(near, minlength=cells)
        centres[size > 0] = sums[size > 0] / size[size > 0, None]
    m = x.shape[1] // width
    book = Codebooks(centres, np.zeros((m, 16, width)), eta)
    near = book.cells(x)
    rest = (x - centres[near]).reshape(n, m, width)
    book.words = rest[rng.choice(n, 16, replace=n < 16)].transpose(1, 0, 2).copy()
    unit = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-30)
    for _ in range(rounds):
        codes = book.codes(x, near, sweeps=2)
        place = (np.arange(m) * 16 + codes)[:, :, None] * width + np.arange(width)  # of each component in the flattened words
        flat = m * 16 * width
        left, right, gram = np.zeros(flat), np.zeros(flat), np.zeros((flat, flat))
        np.add.at(left, place.reshape(-1), 1)
        np.add.at(right, place.reshape(-1), rest.reshape(-1))
        along = (rest.reshape(n, -1) * unit).sum(1)
        for k in range(0, n, 1024):  # the unit vectors, spread over the words of their codes
            part = slice(k, k + 1024)
            z = np.zeros((len(along[part]), flat), np.float32)
            z[np.arange(len(z))[:, None], place[part].reshape(len(z), -1)] = unit[part]
            gram += z.T @ z
            right += (eta - 1) * (z.T @ along[part])
        gram = (eta - 1) * gram + np.diag(left + 1e-6)
        book.words = np.linalg.solve(gram, right + 1e-6 * book.words.reshape(-1)).reshape(m, 16, width)
    return book


def share_to_visit(sample: np.ndarray, book: Codebooks, k: int, recall: float, asked: int = 256) -> float:
    """The least share of cells, in order of their centres' product with a query, that holds `recall` of the k nearest of the sample, over some of its different rows.

    Within a sample the k nearest lie farther off, and so in more cells, than in the whole table: what the share finds there is more.
    """
    x = np.pad(sample, ((0, 0), (0, book.centres.shape[1] - sample.shape[1]))).astype(np.float64)
    own = np.unique(x, axis=0, return_index=True)[1]  # copies ask once
    own = np.random.default_rng(3).permutation(own)[:asked]
    q = x[own]
    products = q @ x.T
    products[np.arange(len(q)), own] = -np.inf
    nearest = np.argsort(-products, axis=1, kind="stable")[:, : min(k, len(x) - 1)]
    if not nearest.size:
        return 1.0
    order = np.argsort(-(q @ book.centres.T), axis=1, kind="stable")
    turn = np.empty_like(order)
    np.put_along_axis(turn, order, np.broadcast_to(np.arange(order.shape[1]), order.shape), 1)
    turns = np.sort(np.take_along_axis(turn, book.cells(x)[nearest], 1).ravel())
    return float(turns[min(len(turns) - 1, int(np.ceil(recall * len(turns))) - 1)] + 1) / len(book.centres)


def usable(vector: Column, dims: int | None = None) -> Column:
    """Not null, not all zero, every component a finite number (and as many as dims)."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(vector, lambda x: x != 0)
    ok = F.coalesce(vector.isNotNull() & fine, F.lit(False))
    return ok if dims is None else ok & (F.size(vector) == dims)


def dealt(asked: DataFrame, coded: DataFrame, block: int) -> tuple[DataFrame, DataFrame]:
    """Queries and rows of each cell in blocks (qb, cb) of about block / 4 and `block`, every pair of a cell's blocks once.

    A row's place in its table, not its id, deals it out, as rows of one id may be any part of the table. Places are taken before a row is repeated for each block of the other side.
    """
    per_cell = coded.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
    per_query = asked.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / max(1, block // 4)).cast("int").alias("q_blocks"))
    deal = F.broadcast(per_cell.join(per_query, "cell"))  # one row a cell
    asked, coded = (df.withColumn("place", F.monotonically_increasing_id()).join(deal, "cell") for df in (asked, coded))
    left = asked.withColumn("qb", F.pmod("place", "q_blocks").cast("int")).select("cell", "qb", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("cb"), "query_id", "q")
    right = coded.withColumn("cb", F.pmod("place", "blocks").cast("int")).select("cell", F.explode(F.sequence(F.lit(0), F.col("q_blocks") - 1)).alias("qb"), "cb", "vec_id", "codes", "raw")
    return left, right


def search(vectors: DataFrame, queries: Column, *, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 20, cell_rows: int = 4096, recall: float = 0.985, probes: float | None = None, rerank: int = 200, eta: float = 4.0, width: int = 2, sample_rows: int = 20_000, block: int = 8192) -> DataFrame:
    """query_id, rank, vec_id, score: for the rows where `queries` holds, the k nearest others found by largest inner product.

    The index is fitted on at most sample_rows rows drawn by hash; every row is coded and kept in the cell of its nearest centre, about one for
    cell_rows rows and at most one for 16 rows of the sample. A query visits the cells whose centres have the largest product with it, `probes` of them, or
    as many as hold `recall` of the neighbours within the sample, and more if those hold too few rows. Vectors that cluster so leave most cells out, others few or
    none. Within a cell, rows and queries are dealt into blocks of about `block` and `block`/4, so a cell that holds most rows is many tasks. A block's
    scan sums table entries by four-bit codes, takes the rows of the `rerank` best distinct codes, however many share one, and scores those exactly, in
    double precision on the given vectors (they lie beside their codes: a block is 2 MB of vectors of 64 floats, while the `rerank` ids of each of its queries would be
    twice that to carry on); ties go to the smaller id.

    Null, zero, non-finite vectors and those of another length than the commonest take no part. Rows that share an id are one candidate and one query: the largest
    product of any of their vectors counts, and an id is never its own neighbour. An empty table gives no rows; other columns are ignored.
    """
    spark = vectors.sparkSession
    double = dict(vectors.dtypes)[vector_col] != "array<float>"
    kind = np.float64 if double else np.float32
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>" if double else "array<float>").alias("v"), F.coalesce(queries, F.lit(False)).alias("asks"))
    rows = rows.where(usable(F.col("v")) & F.col("vec_id").isNotNull())
    sizes = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    out_schema = "query_id long, rank int, vec_id long, score double"
    if sizes is None:
        return spark.createDataFrame([], out_schema)
    dims, n = sizes["d"], sizes["count"]
    rows = rows.where(F.size("v") == dims)
    drawn = rows.where(F.pmod(F.xxhash64("vec_id"), F.lit(max(1, n))) < sample_rows).select("v").limit(sample_rows)
    sample = np.array([r["v"] for r in drawn.toLocalIterator()], np.float64).reshape(-1, dims)
    if not len(sample):
        sample = np.array([rows.first()["v"]], np.float64)
    book = fit(sample, max(1, min(max(1, len(sample) // 16), round(n / cell_rows))), width, eta)
    n_cells = len(book.centres)
    share = probes if probes is not None else share_to_visit(sample, book, k, recall)
    shared = spark.sparkContext.broadcast(book)  # a sixteenth of the sample at most, and 16 words a subspace

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book = shared.value
        pad = book.centres.shape[1] - dims
        for b in batches:
            flat = b.column(1).flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(-1, dims)
            x = np.pad(flat.astype(np.float64), ((0, 0), (0, pad)))
            cell = book.cells(x)
            codes = book.codes(x, cell)
            packed = codes[:, 0::2] | (np.pad(codes, ((0, 0), (0, codes.shape[1] % 2)))[:, 1::2] << 4)
            blobs = lambda a: pa.array([r.tobytes() for r in a], pa.binary())
            cols = [b.column(0), b.column(2), pa.array(cell.astype(np.int32)), blobs(packed), blobs(flat)]
            yield pa.RecordBatch.from_arrays(cols, names=["vec_id", "asks", "cell", "codes", "raw"])

    coded = stored(arrow_map(rows, code, "vec_id long, asks boolean, cell int, codes binary, raw binary"))
    counts = {r["cell"]: r["count"] for r in coded.groupBy("cell").count().collect()}  # one row a cell
    in_cell = np.array([counts.get(c, 0) for c in range(n_cells)])
    visits = max(1, int(np.ceil(share * n_cells - 1e-9)))

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres = shared.value.centres[:, :dims]
        for b in batches:
            q = np.array([np.frombuffer(r, kind) for r in b.column(1).to_pylist()], np.float64)
            order = np.argsort(-(q @ centres.T), axis=1, kind="stable")
            held = np.cumsum(in_cell[order], axis=1)
            for i, vec, cells_, h in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), order, held):
                last = max(visits, int(np.searchsorted(h, min(10 * k + 1, h[-1]))) + 1)
                chosen = [int(c) for c in cells_[:last] if in_cell[c]]
                yield pa.RecordBatch.from_arrays([pa.array([i] * len(chosen)), pa.array([vec] * len(chosen), pa.binary()), pa.array(chosen, pa.int32())], names=["query_id", "q", "cell"])

    asked = arrow_map(coded.where("asks").select("vec_id", "raw"), probe, "query_id long, q binary, cell int")
    left, right = dealt(stored(asked), coded, block)

    def scan(qs: pd.DataFrame, cs: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"query_id": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})
        if not len(qs) or not len(cs):
            return empty
        book = shared.value
        ids = cs["vec_id"].to_numpy()
        packed = np.frombuffer(b"".join(cs["codes"]), np.uint8).reshape(len(cs), -1)
        raw = np.frombuffer(b"".join(cs["raw"]), kind).reshape(len(cs), dims)
        m = len(book.words)
        _, firsts, code_of = np.unique(packed.view(f"V{packed.shape[1]}").ravel(), return_index=True, return_inverse=True)
        packed = packed[firsts]  # rows of one code get one score
        codes = np.empty((len(packed), 2 * packed.shape[1]), np.uint8)
        codes[:, 0::2], codes[:, 1::2] = packed & 15, packed >> 4
        codes = codes[:, :m].T.copy()
        q = np.frombuffer(b"".join(qs["q"]), kind).reshape(len(qs), dims)
        padded = np.pad(q, ((0, 0), (0, m * book.width - dims))).astype(np.float64).reshape(len(q), m, book.width)
        tables = np.einsum("qmw,mkw->qmk", padded, book.words).astype(np.float32)
        take = min(len(packed), rerank)
        parts = []
        for i, (query_id, row) in enumerate(zip(qs["query_id"].to_numpy(), q)):
            if take < len(packed):  # the cell's centre adds the same to all
                scores = tables[i, 0][codes[0]]
                for j in range(1, m):
                    scores = scores + tables[i, j][codes[j]]
                edge = np.partition(scores, len(packed) - take)[len(packed) - take]
                chosen = np.flatnonzero((scores >= edge)[code_of])
            else:
                chosen = np.arange(len(ids))
            chosen = chosen[ids[chosen] != query_id]
            exact = (raw[chosen].astype(np.float64) * row.astype(np.float64)).sum(1)
            order = np.lexsort((ids[chosen], -exact))
            best = order[np.sort(np.unique(ids[chosen][order], return_index=True)[1])[:k]]  # an id counts once, with its best
            parts.append(pd.DataFrame({"query_id": query_id, "vec_id": ids[chosen][best], "score": exact[best]}))
        return pd.concat(parts, ignore_index=True) if parts else empty

    keys = ["cell", "qb", "cb"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(scan, "query_id long, vec_id long, score double")
    found = found.repartition("query_id").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
