"""Exact nearest neighbours of many query vectors: queries come in bounded batches, each against every block of rows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows and queries that meet at once, so that their products stay in the cache.
ROWS, QUERIES = 2048, 512


def _unit(x: np.ndarray) -> np.ndarray:
    n = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return np.divide(x, n, out=np.zeros_like(x), where=n > 0)


def nearest(vectors: DataFrame, queries: DataFrame, k: int, key: str, vector: str, measure: str = "cosine", least_dims: int = 1, drop_self: bool = True, batch: int = 32_768) -> DataFrame:
    """source, target, score, rank: the k best targets of each query (largest cosine or smallest Euclidean distance, rounded to six places, ties
    to the smaller key). Vectors of fewer than least_dims components, or with null or non-finite ones, take no part; vectors of unlike length aren't
    compared. A batch of at most `batch` queries is what the driver and a
    broadcast hold; a task hands on k rows a query. Many queries are dealt with the rows over four tasks a core: the more batches there are, the
    fewer parts have the rows, so that what is handed on doesn't grow with both."""
    spark = vectors.sparkSession
    fine = lambda df: df.select(F.col(key).cast("long").alias(key), F.col(vector).cast("array<double>").alias(vector)).where(F.col(key).isNotNull() & (F.size(vector) >= least_dims) & F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))))
    rows, asked = fine(vectors), fine(queries)
    many = asked.count()
    parts = max(1, -(-many * 2 // batch)) if batch else 1
    if many > QUERIES:
        rows = rows.repartition(max(1, -(-4 * spark.sparkContext.defaultParallelism // parts)))
    out = None
    for p in range(parts):
        own = (asked if parts == 1 else asked.where(F.pmod(F.xxhash64(key), F.lit(parts)) == p)).orderBy(key).toArrow()
        if not own.num_rows:
            continue
        ids, q = own.column(0).to_numpy(), own.column(1).combine_chunks()
        lengths, values = np.diff(q.offsets.to_numpy()), q.flatten().to_numpy()
        held = spark.sparkContext.broadcast([(ids[lengths == n], values[np.repeat(lengths == n, lengths)].reshape(-1, n)) for n in np.unique(lengths)])
        near = rows.mapInArrow(_scan(held, k, measure, drop_self), "source long, target long, score double")
        out = near if out is None else out.unionByName(near)
    if out is None:
        return spark.createDataFrame([], "source long, target long, score double, rank int")
    best = F.desc("score") if measure == "cosine" else F.asc("score")
    return out.withColumn("rank", F.row_number().over(Window.partitionBy("source").orderBy(best, "target"))).where(F.col("rank") <= k)


def _scan(held, k, measure, drop_self):
    def run(batches):
        tops = [_Top(ids, q, k, measure, drop_self) for ids, q in held.value]
        for b in batches:
            lengths = np.diff(b.column(1).offsets.to_numpy())
            for top in tops:
                same = np.flatnonzero(lengths == top.q.shape[1])
                if not len(same):
                    continue
                rows = b.take(pa.array(same)) if len(same) < b.num_rows else b
                top.take(rows.column(0).to_numpy(), rows.column(1).flatten().to_numpy().reshape(len(same), -1))
        for top in tops:
            top.finish()
            at, nth = np.nonzero(top.away < np.inf)
            score = top.away[at, nth]
            yield pa.RecordBatch.from_arrays([pa.array(top.ids[at]), pa.array(top.keys[at, nth]), pa.array(-score if measure == "cosine" else score)], names=["source", "target", "score"])

    return run


class _Top:
    """The k best of each query among the rows taken so far. Products in single precision tell which pairs may be among them, with a margin beyond
    their error; only those are measured in double precision, pair by pair where they are few and all of a block where they are many."""

    def __init__(self, ids: np.ndarray, q: np.ndarray, k: int, measure: str, drop_self: bool):
        self.ids, self.q, self.k, self.cosine, self.drop_self = ids, _unit(q) if measure == "cosine" else q, k, measure == "cosine", drop_self
        self.away, self.keys = np.full((len(ids), k), np.inf), np.full((len(ids), k), np.iinfo(np.int64).max)
        self.error = (q.shape[1] + 16) * 2.0**-23
        self.square = (self.q * self.q).sum(axis=1)
        self.rough = self._rough(self.q, np.ones(len(ids)))
        self.product, self.able = np.empty(QUERIES * ROWS, np.float32), np.empty(QUERIES * ROWS, bool)
        self.late: dict = {}  # found by a block of queries since its last merge
        self.wild = not self.cosine and self.square.max(initial=0.0) > 1e30

    def _rough(self, x: np.ndarray, last: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (x if self.cosine else np.c_[x, last]).astype(np.float32)

    def take(self, keys: np.ndarray, x: np.ndarray) -> None:
        order = np.argsort(keys, kind="stable")
        keys, x = keys[order], _unit(x[order]) if self.cosine else x[order]
        square = (x * x).sum(axis=1)
        rough = self._rough(x, -square / 2)
        for lo in range(0, len(keys), ROWS):
            hi = lo + ROWS
            wild = self.wild or (not self.cosine and square[lo:hi].max() > 1e30)
            for a in range(0, len(self.ids), QUERIES):
                self._meet(slice(a, a + QUERIES), keys[lo:hi], x[lo:hi], square[lo:hi], rough[lo:hi], wild)

    def _meet(self, part: slice, keys: np.ndarray, x: np.ndarray, square: np.ndarray, rough: np.ndarray, wild: bool) -> None:
        kth = self.away[part, -1]
        i = None
        if not wild and (kth < np.inf).all():
            if self.cosine:
                least = -kth - 1e-6 - self.error
            else:
                least = (self.square[part] - (kth + 1e-6) ** 2) / 2 - self.error * (self.square[part] + square.max())
            # rounded down, so that the margin isn't lost
            least = np.nextafter(least.astype(np.float32), np.float32(-np.inf))[:, None]
            product, able = (b[: len(kth) * len(keys)].reshape(len(kth), len(keys)) for b in (self.product, self.able))
            at = np.flatnonzero(np.greater_equal(np.matmul(self.rough[part], rough.T, out=product), least, out=able))
            if not len(at):
                return
            if len(at) * 50 < len(kth) * len(keys):
                i, j = np.divmod(at, len(keys))
                q, r = self.q[part][i], x[j]
                away = -np.round((q * r).sum(axis=1), 6) if self.cosine else np.round(np.sqrt(((q - r) ** 2).sum(axis=1)), 6)
        if i is None:
            every = self.q[part] @ x.T
            if self.cosine:
                every = -np.round(every, 6)
            else:
                every = np.round(np.sqrt(np.maximum(self.square[part][:, None] + square - 2 * every, 0)), 6)
            if self.drop_self:
                every[self.ids[part][:, None] == keys[None]] = np.inf
            few = min(self.k, len(keys))
            i, j = np.nonzero(every <= np.minimum(np.partition(every, few - 1, axis=1)[:, few - 1], kth)[:, None])
            away = every[i, j]
        found = keys[j]
        better = (away < kth[i]) | ((away == kth[i]) & (found < self.keys[part, -1][i]))
        if self.drop_self:
            better &= self.ids[part][i] != found
        better &= away < np.inf
        if better.any():
            late = self.late.setdefault(part.start, [])
            late.append((i[better], found[better], away[better]))
            # a merge sorts what is held too, and waits until as much is new
            if sum(len(x[0]) for x in late) >= len(kth) * self.k:
                self._merge(part.start, *map(np.concatenate, zip(*self.late.pop(part.start), strict=True)))

    def finish(self) -> None:
        for start, late in self.late.items():
            self._merge(start, *map(np.concatenate, zip(*late, strict=True)))
        self.late = {}

    def _merge(self, start: int, i: np.ndarray, found: np.ndarray, away: np.ndarray) -> None:
        own = np.unique(i)
        at = start + own
        i, found, away = np.r_[np.repeat(own, self.k), i], np.r_[self.keys[at].ravel(), found], np.r_[self.away[at].ravel(), away]
        order = np.lexsort((found, away, i))
        first = np.searchsorted(i[order], own)
        pick = order[(first[:, None] + np.arange(self.k)).ravel()]
        self.keys[at], self.away[at] = found[pick].reshape(-1, self.k), away[pick].reshape(-1, self.k)
