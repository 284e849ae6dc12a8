"""Exact top-k inner products by no-random-access aggregation (NRA) over sorted lists.

Each dimension is a list of the candidates sorted by that component; a query reads all lists in step, each from the end
that its own sign favours, in slabs (DEPTHS). What it reads of a candidate is added to that candidate's sum; a component
that it hasn't read yet contributes at most the list's frontier (the last value read) and at least the list's other end.
That gives every candidate an upper and a lower bound. The k-th best lower bound is a threshold: candidates whose upper bound
stays below it are outsiders and are dropped for good. Reading stops when those left are so few (LEFT of the block, or 2 k)
that resolving their scores is less than the next slab, or when the lists end. Ties at the threshold stay in, since a
smaller id wins them. counters() says how many entries of the lists were read.

Candidates are cut into blocks, each with its own lists; every block meets every block of queries, and hands on at most k
rows a query.

Defined results: vectors that are null, empty or hold a null, NaN or infinite component take no part, nor do rows without
vec_id; vectors of different lengths don't meet; equal scores go to the smaller vec_id; repeated rows are candidates each,
but never of a query with their own vec_id; queries that share a vec_id are one query, with the vector that sorts first;
with fewer than k candidates all are given.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ensure_columns

BLOCK = 4096
QUERY_BLOCK = 4096
#: Depths (shares of each list) to which the lists are read in turn.
DEPTHS = (0.15, 0.4, 0.6, 0.75, 0.85, 0.93, 1.0)
#: Share of a block's candidates that may be left for resolving.
LEFT = 1 / 16
SCALE = 1024


def scaled(vectors: DataFrame) -> DataFrame:
    """(vec_id, v) of the vectors that take part, components floor(SCALE * x)."""
    rows = ensure_columns(vectors, vec_id="long", embedding="array<double>").filter("vec_id is not null and size(embedding) > 0")
    sound = F.forall("embedding", lambda x: x.isNotNull() & (F.abs(x) < F.lit(float("inf"))) & ~F.isnan(x))
    return rows.filter(F.coalesce(sound, F.lit(False))).select("vec_id", F.transform("embedding", lambda x: F.floor(x * SCALE).cast("double")).alias("v"))


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best, ties to the smaller id."""
    if len(scores) > k:
        kth = np.partition(scores, len(scores) - k)[len(scores) - k]
        at = np.flatnonzero(scores >= kth)
    else:
        at = np.arange(len(scores))
    return at[np.lexsort((ids[at], -scores[at]))][:k]


class Lists:
    """A block's sorted lists: for each dimension the candidates' places and components, ascending."""

    def __init__(self, vectors: np.ndarray, ids: np.ndarray):
        self.vectors, self.ids = vectors, ids
        n, dims = vectors.shape
        order = np.argsort(vectors, axis=0, kind="stable")
        self.values = np.ascontiguousarray(np.take_along_axis(vectors, order, axis=0).T)
        self.order = np.ascontiguousarray(order.T)
        # where each candidate stands in each list
        self.place = np.empty((n, dims), np.int16 if n < 1 << 15 else np.int32)
        np.put_along_axis(self.place, order, np.arange(n, dtype=self.place.dtype)[:, None], axis=0)

    def search(self, query: np.ndarray, own: int, k: int, depths: tuple[float, ...] = DEPTHS) -> tuple[np.ndarray, np.ndarray, int]:
        """Places and scores of the k best candidates whose id isn't own, and how many entries were read."""
        n, dims = self.vectors.shape
        falling = query >= 0
        tops, bottoms = np.flatnonzero(falling), np.flatnonzero(~falling)
        worst = np.where(falling, self.values[:, 0], self.values[:, -1]) * query
        total, alive = np.zeros(n), np.flatnonzero(self.ids != own)
        read = done = 0
        for depth in depths:
            upto = min(n, max(1, int(np.ceil(depth * n))))
            # every list's next entries, from the end that the query favours
            for lists, slab in ((tops, slice(n - upto, n - done)), (bottoms, slice(done, upto))):
                if len(lists):
                    total += np.bincount(self.order[lists, slab].ravel(), (self.values[lists, slab] * query[lists, None]).ravel(), n)
            read, done = read + dims * (upto - done), upto
            if done == n:
                break
            frontier = np.where(falling, self.values[:, n - upto], self.values[:, upto - 1]) * query
            border = np.where(falling, n - upto, upto).astype(self.place.dtype)
            unread = ((self.place[alive] < border) ^ ~falling).astype(np.float64)
            bounds = unread @ np.stack([frontier, worst], 1) + total[alive, None]
            if len(alive) > k:
                kth = np.partition(bounds[:, 1], len(alive) - k)[len(alive) - k]
                left = bounds[:, 0] >= kth
                alive, unread = alive[left], unread[left]
            if len(alive) <= max(2 * k, LEFT * n):
                # outsiders can't qualify; the rest of the lists is needed for those left only
                read += int(unread.sum())
                total[alive] = self.vectors[alive] @ query
                break
        best = alive[_best(total[alive], self.ids[alive], k)]
        return best, total[best], read


def nra(queries: np.ndarray, query_ids: np.ndarray, vectors: np.ndarray, ids: np.ndarray, k: int, depths: tuple[float, ...] = DEPTHS) -> tuple[list[tuple[int, int, float]], float]:
    """(query, candidate, score) of each query's k best, and the share of the lists' entries that was read."""
    lists, found, read = Lists(vectors, ids), [], 0
    for i, (query, own) in enumerate(zip(queries, query_ids, strict=True)):
        at, scores, entries = lists.search(query, own, k, depths)
        found += zip([i] * len(at), at.tolist(), scores.tolist(), strict=True)
        read += entries
    return found, read / max(len(queries) * vectors.size, 1)


def _cells(queries: DataFrame, vectors: DataFrame, k: int, block: int, query_block: int) -> DataFrame:
    """query_id, vec_id, score of each cell's best; and one row of each cell with nulls but the entries read and held.

    A cell is one block of candidates and one block of queries; rows are dealt out by a hash, candidates by one of their
    number too, so that neither equal vectors nor equal ids make one cell larger than another.
    """
    # the two sides of a cogroup must not share a column that both come from
    queries = queries.select(F.col("vec_id").alias("query_id"), "v").groupBy("query_id").agg(F.min("v").alias("v"))
    many = max(1, -(-vectors.count() // block))
    rounds = max(1, -(-queries.count() // query_block))
    cells = F.explode(F.sequence(F.lit(0), F.lit(rounds - 1)))
    deal = F.xxhash64("vec_id", F.monotonically_increasing_id())
    left = vectors.withColumn("c", F.pmod(deal, F.lit(many)).cast("long")).select("c", cells.alias("q"), "vec_id", "v")
    spread = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(many - 1).cast("long")))
    right = queries.select(spread.alias("c"), F.pmod(F.xxhash64("query_id"), F.lit(rounds)).cast("int").alias("q"), "query_id", "v")
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64()), ("entries_read", pa.int64()), ("entries", pa.int64())])

    def meet(ours: pa.Table, theirs: pa.Table) -> pa.Table:
        rows: list[tuple] = []
        a, b = by_length(ours, "vec_id"), by_length(theirs, "query_id")
        for dim in a.keys() & b.keys():
            (ids, v), (query_ids, q) = a[dim], b[dim]
            found, share = nra(q, query_ids, v, ids, k)
            rows += [(int(query_ids[i]), int(ids[c]), int(score), None, None) for i, c, score in found]
            rows.append((None, None, None, round(share * len(q) * v.size), len(q) * v.size))
        columns = zip(*rows, strict=True) if rows else [[]] * len(schema)
        return pa.table([pa.array(x, f.type) for x, f in zip(columns, schema, strict=True)], schema=schema)

    kinds = "query_id long, vec_id long, score long, entries_read long, entries long"
    return left.groupBy("c", "q").cogroup(right.groupBy("c", "q")).applyInArrow(meet, kinds)


def search(queries: DataFrame, vectors: DataFrame, k: int, block: int = BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: the k best of vectors for each of queries (both as scaled() gives them)."""
    found = _cells(queries, vectors, k, block, query_block).filter("query_id is not null")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", place).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def counters(queries: DataFrame, vectors: DataFrame, k: int, block: int = BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """One row: entries_read and entries, what the search reads of the lists and what they hold, over all queries."""
    return _cells(queries, vectors, k, block, query_block).agg(F.sum("entries_read").alias("entries_read"), F.sum("entries").alias("entries"))


def by_length(rows: pa.Table, name: str) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Ids and matrix of the vectors of each length."""
    rows = rows.combine_chunks()
    sizes = pc.list_value_length(rows["v"]).to_numpy()
    out = {}
    for dim in np.unique(sizes):
        own = rows.filter(pa.array(sizes == dim)).combine_chunks()
        ids = own[name].to_numpy()
        out[int(dim)] = ids, np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in own["v"].chunks]).reshape(-1, int(dim))
    return out
