"""Exact top-k inner products: global score histograms are refined until they hold each query's kth value."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..lineage import cut
from .kernels import release
from .sharding import running_totals

#: A histogram has 2**BIN_BITS bins.
BIN_BITS = 12
#: Bytes of the queries that one search holds in every task; more queries are searched block by block.
QUERY_BYTES = 64 << 20
#: Queries and candidates whose scores are worked out at once.
QUERIES, CANDIDATES = 2048, 4096
#: Scores beyond this count as this.
LIMIT = 2**62 - 1
#: Entries of histograms that a task gathers before it sums them up.
ENTRIES = 1 << 20


def integer_vectors(column: pa.Array, scale: float) -> list[tuple[np.ndarray, np.ndarray]]:
    """Rows and matrix (floor(scale * x) in double precision) of the usable vectors, for each length apart."""
    sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    values = column.flatten().cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False)
    with np.errstate(over="ignore", invalid="ignore"):
        values = np.floor(values * scale)
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(values))])
    usable = column.is_valid().to_numpy(zero_copy_only=False) & (bad[starts[1:]] == bad[starts[:-1]])
    out = []
    for d in np.unique(sizes[usable]):
        rows = np.flatnonzero(usable & (sizes == d))
        out.append((rows, values[starts[rows][:, None] + np.arange(d)]))
    return out


def norms(matrix: np.ndarray) -> np.ndarray:
    """Upper bounds of the lengths of the rows."""
    with np.errstate(over="ignore"):
        return np.sqrt((matrix * matrix).sum(axis=1)) * (1 + 1e-9) + 1


def scores(queries: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """Exact inner products of integers: in float32 or float64 where these are exact, else in whole numbers up to LIMIT."""
    with np.errstate(over="ignore"):
        reach = norms(queries).max() * norms(candidates)
    if reach.max() < 2**23:
        return queries.astype(np.float32) @ candidates.astype(np.float32).T
    large = ~(reach < 2**52)
    if not large.any():
        return queries @ candidates.T
    out = np.zeros((len(queries), len(candidates)), np.int64)
    out[:, ~large] = queries @ candidates[~large].T
    whole = np.vectorize(int, otypes=[object])
    out[:, large] = np.clip(whole(queries).dot(whole(candidates[large]).T), -LIMIT, LIMIT).astype(np.int64)
    return out


@dataclass
class Search:
    """The queries of a block, and what is known of their kth values: each is the need-th value in [base, base + 2**bits).

    exact: all values from base up are among the first k, and no others.
    """

    rows: np.ndarray
    ids: np.ndarray
    groups: list[tuple[np.ndarray, np.ndarray]]
    base: np.ndarray
    bits: np.ndarray
    need: np.ndarray
    exact: np.ndarray

    @classmethod
    def over(cls, rows: list, k: int, longest: float) -> Search:
        bodies = [np.frombuffer(r.body, np.float64) for r in rows]
        sizes = np.array([len(b) for b in bodies])
        groups = [(np.flatnonzero(sizes == d), np.stack([b for b in bodies if len(b) == d])) for d in np.unique(sizes)]
        reach = np.zeros(len(rows), np.int64)
        for at, matrix in groups:
            with np.errstate(over="ignore"):
                reach[at] = [LIMIT if not x < LIMIT else int(x) + 1 for x in norms(matrix) * longest]
        bits = np.array([(2 * int(x)).bit_length() for x in reach])
        flat = lambda name: np.array([r[name] for r in rows], np.int64)
        return cls(flat("row"), flat("vec_id"), groups, -reach, bits, np.full(len(rows), k), np.zeros(len(rows), bool))

    @property
    def unknown(self) -> np.ndarray:
        return ~self.exact & (self.bits > 0)

    @property
    def shift(self) -> np.ndarray:
        return np.maximum(self.bits - BIN_BITS, 0)

    def narrow(self, picks: list) -> None:
        """Takes the bins that hold the kth values; a query without one has fewer candidates than it needs."""
        at = {int(r): i for i, r in enumerate(self.rows)}
        shift, left = self.shift, self.unknown
        for pick in picks:
            i = at[pick.row]
            left[i] = False
            self.base[i] += pick.bin << int(shift[i])
            self.exact[i] = pick.upto == self.need[i]
            self.need[i] -= pick.upto - pick.n
            self.bits[i] = shift[i]
        self.exact |= left

    def compared(self, batches: Iterator[pa.RecordBatch], scale: float, which: np.ndarray):
        """(queries, candidate ids, scores) for blocks of all pairs of vectors of equal length; pairs of equal ids score below all others."""
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for rows, matrix in integer_vectors(batch.column(1), scale):
                for own, vectors in self.groups:
                    keep = np.flatnonzero(which[own]) if vectors.shape[1] == matrix.shape[1] else []
                    for i in range(0, len(keep), QUERIES):
                        q, mine = own[keep[i : i + QUERIES]], vectors[keep[i : i + QUERIES]]
                        for j in range(0, len(rows), CANDIDATES):
                            at = ids[rows[j : j + CANDIDATES]]
                            found = scores(mine, matrix[j : j + CANDIDATES])
                            same = np.flatnonzero(np.isin(at, self.ids[q]))
                            x, y = np.nonzero(self.ids[q][:, None] == at[same])
                            found[x, same[y]] = -LIMIT - 1 if found.dtype == np.int64 else -np.inf
                            yield q, at, found
        release()


def _tail(q: np.ndarray, bins: np.ndarray, n: np.ndarray, need: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sums by query and bin, from the highest bin down to the one in which as many as the query needs are reached."""
    if not len(q):
        return q, bins, n
    order = np.lexsort((-bins, q))
    q, bins, n = q[order], bins[order], n[order]
    new = np.flatnonzero(np.concatenate([[True], (q[1:] != q[:-1]) | (bins[1:] != bins[:-1])]))
    q, bins, n = q[new], bins[new], np.add.reduceat(n, new)
    above = np.cumsum(n) - n
    keep = above - above[np.searchsorted(q, q)] < need[q]
    return q[keep], bins[keep], n[keep]


def _histograms(shared, scale: float):
    """(row, need, bin, n): how many scores of a query lie in a bin. Bins below the one that holds the kth value of these candidates
    alone are left out: they cannot hold the kth value of all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search: Search = shared.value
        shift, edge = search.shift, search.base.copy()
        last = search.base + ((np.int64(1) << search.bits.astype(np.int64)) - 1)
        held, parts, size = (np.zeros(0, np.int64),) * 3, [], 0
        for q, _, found in search.compared(batches, scale, search.unknown):
            k = int(search.need[q].max())
            fresh = edge[q] == search.base[q]
            if found.shape[1] >= k and fresh.any():
                low = np.partition(found[fresh], -k, axis=1)[:, -k]
                higher = low > edge[q[fresh]]
                at = q[fresh][higher]
                edge[at] += (low[higher].astype(np.int64) - search.base[at]) >> shift[at] << shift[at]
            x, y = np.nonzero((found >= edge[q].astype(found.dtype)[:, None]) & (found <= last[q].astype(found.dtype)[:, None]))
            at = q[x]
            parts.append(_tail(at, (found[x, y].astype(np.int64) - search.base[at]) >> shift[at], np.ones(len(at), np.int64), search.need))
            size += len(parts[-1][0])
            if size > ENTRIES:
                held = _tail(*map(np.concatenate, zip(held, *parts)), search.need)
                parts, size = [], 0
        q, bins, n = _tail(*map(np.concatenate, zip(held, *parts)), search.need)
        yield pa.record_batch([pa.array(search.rows[q]), pa.array(search.need[q]), pa.array(bins), pa.array(n)], names=["row", "need", "bin", "n"])

    return run


def _nearest(shared, scale: float):
    """(row, query_id, vec_id, score): all scores above the kth value, and of those equal to it the smallest ids of a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search: Search = shared.value
        for q, ids, found in search.compared(batches, scale, np.ones(len(search.rows), bool)):
            x, y = np.nonzero(found >= search.base[q].astype(found.dtype)[:, None])
            value, who, x = found[x, y].astype(np.int64), ids[y], q[x]
            tied = np.flatnonzero((value == search.base[x]) & ~search.exact[x])
            tied = tied[np.lexsort((who[tied], x[tied]))]
            few = np.arange(len(tied)) - np.searchsorted(x[tied], x[tied]) < search.need[x[tied]]
            plain = np.ones(len(x), bool)
            plain[tied] = False
            keep = np.concatenate([np.flatnonzero(plain), tied[few]])
            yield pa.record_batch([pa.array(search.rows[x[keep]]), pa.array(search.ids[x[keep]]), pa.array(who[keep]), pa.array(value[keep])], names=["row", "query_id", "vec_id", "score"])

    return run


def _packed(scale: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, matrix in integer_vectors(batch.column(1), scale):
                yield pa.record_batch([batch.column(0).take(pa.array(rows)), pa.array([x.tobytes() for x in matrix], pa.binary())], names=["vec_id", "body"])

    return run


def _longest(scale: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        most = [norms(m).max() for batch in batches for _, m in integer_vectors(batch.column(1), scale)]
        yield pa.record_batch([pa.array([max(most, default=0.0)], pa.float64())], names=["norm"])

    return run


def nearest_vectors(df: DataFrame, every: int = 50, k: int = 5, scale: float = 256.0, id_col: str = "vec_id", vector_col: str = "embedding", query_bytes: int = QUERY_BYTES) -> DataFrame:
    """The k highest inner products of every query with all other rows, components being floor(scale * x).

    Queries are the rows whose id is divisible by `every`. They are searched in blocks of `query_bytes` at most (and a vector),
    which every task holds; one block's search scores all rows once for each refinement and once more to take those from the
    kth value up. A task counts scores by bins of each query's range, from above down to its own kth value; these counts summed
    up give the bin of the global kth value, which is the range of the next histogram, until a bin is one value wide or all in it
    are needed. Scores equal to the kth value are taken by smallest id, so a value that most rows share gathers nowhere.

    Vectors that are null or hold null or non-finite components (also after scaling), and null ids, take no part. Vectors of
    different length are not compared. Rows that share the query's id are its own and no candidates; a query whose id repeats
    is searched once for each of its rows, and repeated candidates count each, equal rows being interchangeable. Scores beyond
    2**62 - 1 either way count as that. A query with fewer than k candidates gets all; an empty table gives no rows. Ids
    are integers; other columns are not read.

    Returns query_id, rank (from 1), vec_id, score.
    """
    spark = df.sparkSession
    source = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("embedding")).where("vec_id is not null")
    longest = source.mapInArrow(_longest(scale), "norm double").agg(F.coalesce(F.max("norm"), F.lit(0.0)).alias("norm")).first().norm
    asked = source.where(F.col("vec_id") % every == 0).mapInArrow(_packed(scale), "vec_id long, body binary").withColumn("size", (F.length("body") + 8).cast("long"))
    asked = cut(running_totals(asked, ["vec_id", "body"], "size").select("row", "vec_id", "body", F.floor(F.col("before") / query_bytes).alias("block")))
    down = Window.partitionBy("row").orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, 0)
    best = Window.partitionBy("row").orderBy(F.desc("score"), "vec_id")
    blocks = sorted(r.block for r in asked.select("block").distinct().collect())
    found = []
    for block in blocks:
        search = Search.over(asked.where(F.col("block") == block).select("row", "vec_id", "body").collect(), k, longest)  # query_bytes and a vector at most
        while search.unknown.any():
            shared = spark.sparkContext.broadcast(search)
            counts = source.mapInArrow(_histograms(shared, scale), "row long, need long, bin long, n long").groupBy("row", "need", "bin").agg(F.sum("n").alias("n"))
            picks = counts.withColumn("upto", F.sum("n").over(down)).where("upto >= need and upto - n < need").collect()  # one row a query
            search.narrow(picks)
            shared.unpersist()
        shared = spark.sparkContext.broadcast(search)
        near = source.mapInArrow(_nearest(shared, scale), "row long, query_id long, vec_id long, score long")
        ranked = near.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
        found.append(cut(ranked.select("query_id", "rank", "vec_id", "score")))
        shared.unpersist()
    return reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
