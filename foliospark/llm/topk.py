"""Exact top-k inner products by no-random-access aggregation (operator 2).

Vectors are read in blocks, each where it lies.  A block keeps, for each
dimension, the list of its vectors sorted by that component.  A query reads
every list from the end that its own component's sign makes the better one, all
lists to one depth, and never looks up a component out of turn.  What has been
read of a vector gives bounds on its score: for an unread component the best is
the value where its list stands, the worst the list's other end.  A query stops
when no vector outside its k best can still reach the k-th best lower bound, or
the k-th best score of the blocks that its task has read before; the scores of
those that may are then resolved by reading on.

Queries go to the vectors in blocks of ``query_numbers`` numbers, which the
driver reads one after another from a table and sends with the tasks; vectors
are not shuffled, and a task returns its k best for each query.

Defined cases: vectors that are null or hold null or non-finite components take
no part, nor do null ids or empty vectors; only vectors of the query's length
are its candidates; candidates with the query's own vec_id are left out; of
query rows that share a vec_id the smallest vector asks; further repeated rows
each count as candidates; an empty table gives no rows.  Scores must fit 64
bits.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import in_batches, table


def integer_vector(vector: Column) -> Column:
    """floor(1024 * x) of every component as long; null if the vector takes no part."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(vector.isNotNull() & (F.size(vector) > 0) & ~bad, F.transform(vector, lambda x: F.floor(x.cast("double") * 1024)))


def best_of_block(
    queries: np.ndarray, vectors: np.ndarray, barred: np.ndarray, ids: np.ndarray, k: int,
    least: np.ndarray | None = None, depth: int = 64
) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each query the rows and scores of its k best vectors of at least the score ``least``, higher scores and then smaller ids first.

    barred[q, v]: v is no candidate of q.  ``depth`` is how far the lists are read at first; it doubles.
    """
    if least is None:
        least = np.full(len(queries), -np.inf)
    n, d = vectors.shape
    big = float(d) * float(np.abs(queries).max(initial=0)) * float(np.abs(vectors).max(initial=0))
    kind = np.float64 if big < 2**53 else np.int64  # products of whole numbers, exact in either
    order = np.argsort(vectors, axis=0, kind="stable")
    rank = np.empty_like(order)
    np.put_along_axis(rank, order, np.arange(n)[:, None], axis=0)
    sorted_ = np.take_along_axis(vectors, order, axis=0).astype(kind)
    x, q = vectors.astype(kind), queries.astype(kind)
    up, down = np.maximum(q, 0), np.minimum(q, 0)  # lists read from the large end and from the small end
    worst_all = up * sorted_[0] + down * sorted_[-1]
    out: list = [None] * len(queries)
    live = np.arange(len(queries))
    while len(live):
        depth = min(depth, n)
        top, low = rank >= n - depth, rank < depth  # what has been read, from either end
        u, w = up[live], down[live]
        known = u @ (x * top).T + w @ (x * low).T
        best_next, worst = u * sorted_[n - depth] + w * sorted_[depth - 1], worst_all[live]
        plus, minus = (u > 0), (w < 0)
        unread = lambda edge: edge.sum(1, keepdims=True) - (edge * plus) @ top.T.astype(kind) - (edge * minus) @ low.T.astype(kind)
        upper = known + (unread(best_next) if depth < n else 0)
        lower = known + (unread(worst) if depth < n else 0)
        no = np.iinfo(np.int64).min if kind is np.int64 else -np.inf
        upper[barred[live]], lower[barred[live]] = no, no
        going = []
        for row, one in enumerate(live):
            m = min(k, n - int(barred[one].sum()))
            if m <= 0:
                out[one] = (np.zeros(0, np.int64), np.zeros(0, np.int64))
                continue
            kth = max(np.partition(lower[row], n - m)[n - m], least[one])
            rivals = np.flatnonzero((upper[row] >= kth) & ~barred[one])
            # Resolved once every rival's bounds meet; an equal outsider may win by its id, so it is a rival too.
            if depth == n or (lower[row][rivals] == upper[row][rivals]).all():
                score = lower[row][rivals].astype(np.int64)
                first = np.lexsort((ids[rivals], -score))[:m]
                out[one] = (rivals[first], score[first])
            else:
                going.append(one)
        live = np.array(going, np.int64)
        depth *= 2
    return out


class _Best:
    """The k best that a task has seen of each query: higher scores, then smaller ids."""

    def __init__(self, asks: np.ndarray, queries: np.ndarray, k: int):
        self.asks, self.queries, self.k = asks, queries, k
        self.ids = [np.zeros(0, np.int64) for _ in asks]
        self.scores = [np.zeros(0, np.int64) for _ in asks]
        self.least = np.full(len(asks), -np.inf)

    def read(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        got = best_of_block(self.queries, vectors, self.asks[:, None] == ids[None, :], ids, self.k, self.least)
        for q, (rows, scores) in enumerate(got):
            if len(rows):
                every, score = np.concatenate((self.ids[q], ids[rows])), np.concatenate((self.scores[q], scores))
                first = np.lexsort((every, -score))[: self.k]
                self.ids[q], self.scores[q] = every[first], score[first]
                if len(first) == self.k:
                    self.least[q] = score[first[-1]]


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, block_rows: int = 4096, query_numbers: int = 1 << 18) -> DataFrame:
    """query_id, rank, vec_id, score; both inputs have vec_id and x, an array of longs."""
    asked = table(queries.groupBy("vec_id").agg(F.min("x").alias("x")).withColumn("d", F.size("x")), "queries")
    schema = "query_id long, vec_id long, score long"
    found = None
    for d, n in sorted(map(tuple, asked.groupBy("d").count().collect())):  # one row for each length of vectors
        blocks = max(1, -(-n * d // query_numbers))
        for block in range(blocks):
            mine = asked.where((F.col("d") == d) & (F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == block))
            got = mine.select("vec_id", "x").toArrow().sort_by("vec_id")  # about ``query_numbers`` numbers
            if not len(got):
                continue
            part = in_batches(
                vectors.where(F.size("x") == d).select("vec_id", "x"), schema,
                _search(got["vec_id"].to_numpy(), _matrix(got["x"]), k, block_rows)
            )
            part = table(part, "best") if blocks > 1 else part
            found = part if found is None else found.union(part)
    if found is None:
        found = vectors.sparkSession.createDataFrame([], schema)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _matrix(lists) -> np.ndarray:
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1)


def _search(asks: np.ndarray, queries: np.ndarray, k: int, block_rows: int):
    def run(batches):
        best, held, count = _Best(asks, queries, k), [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, block_rows):
                part = batch.slice(at, block_rows)
                held.append(part)
                count += part.num_rows
                if count >= block_rows:
                    best.read(*_joined(held))
                    held, count = [], 0
        if count:
            best.read(*_joined(held))
        counts = [len(x) for x in best.ids]
        yield pa.RecordBatch.from_pydict(
            {"query_id": np.repeat(asks, counts), "vec_id": np.concatenate(best.ids), "score": np.concatenate(best.scores)}
        )

    return run


def _joined(batches) -> tuple[np.ndarray, np.ndarray]:
    whole = pa.Table.from_batches(batches)
    return whole["vec_id"].to_numpy(), _matrix(whole["x"])


def embedding_top_k(embeddings: DataFrame, every: int = 100, k: int = 10) -> DataFrame:
    """The k best of all vectors for each vector whose id is divisible by ``every``."""
    usable = embeddings.select(
        F.col("vec_id").cast("long").alias("vec_id"), integer_vector(F.col("embedding")).alias("x")
    ).where("vec_id IS NOT NULL AND x IS NOT NULL")
    return top_k(usable, usable.where(F.col("vec_id") % every == 0), k)
