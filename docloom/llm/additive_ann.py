"""Approximate nearest neighbours by additive quantisation.

A vector is approximated by a sum of codewords, one of each of `books` full-dimensional codebooks. Codebooks are trained in numpy on a bounded
sample (`Settings.sample` rows, by the hash of vec_id): k-means on residuals first, then rounds of beam-search encoding and a least-squares
update of all codewords together. Every row is encoded by beam search and keeps the norm of its approximation. A query's inner products with all
codewords make its lookup table; a row's estimate is the sum of its codes' entries over the stored norm. The `short` best estimates of each
block of rows are reranked by the exact cosine of the original vectors in double precision.

The index is a table in the shared folder: key, vector, codes and norm of every row, encoded once. Queries are taken in batches of at most
`query_rows` rows (a bound on what the driver and a broadcast hold), each against every block of the index; a block hands on its `k` best rows
for each query, which are written batch by batch, and a window narrows them to the `k` best in all. Vectors are scaled by a power of two
first, which changes no cosine, so that squares of very large or small components neither overflow nor vanish.

Defined cases: vectors that are null, zero, of another length than most (ties: the shorter), or that hold null or non-finite components take no
part, nor do rows with a null vec_id; rows that repeat a query's vec_id are not its candidates; of rows that repeat a query's vec_id the least
vector is the query; equal scores go to the smaller vec_id; with fewer candidates than k all are returned; an empty table gives an empty
result; a very long vector is one like others; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.llm.common import shared_folder, table, written


@dataclass(frozen=True)
class Settings:
    books: int = 24
    words: int = 128
    beam: int = 4
    sample: int = 8_192
    rounds: int = 2
    short: int = 128
    query_rows: int = 65_536
    block_rows: int = 8_192


class Quantiser:
    def __init__(self, books: np.ndarray, beam: int):
        self.books, self.beam = books, beam  # (books, words, dims)
        self.norms = (books**2).sum(axis=2)

    def encode(self, x: np.ndarray) -> np.ndarray:
        """Codes of rows by beam search: after each codebook the `beam` sums with the least residuals go on."""
        out = []
        for lo in range(0, len(x), 2048):
            part = x[lo : lo + 2048]
            n = len(part)
            residual, codes = part[:, None, :], np.zeros((n, 1, 0), np.uint8)
            for m, book in enumerate(self.books):
                b = residual.shape[1]
                cost = (residual**2).sum(axis=2)[:, :, None] - 2 * (residual.reshape(n * b, -1) @ book.T).reshape(n, b, -1) + self.norms[m]
                flat = cost.reshape(n, -1)
                keep = min(self.beam, flat.shape[1])
                best = np.argpartition(flat, keep - 1, axis=1)[:, :keep] if keep < flat.shape[1] else np.tile(np.arange(keep), (n, 1))
                parent, word = best // len(book), best % len(book)
                i = np.arange(n)[:, None]
                residual = residual[i, parent] - book[word]
                codes = np.concatenate([codes[i, parent], word[:, :, None].astype(np.uint8)], axis=2)
            least = (residual**2).sum(axis=2).argmin(axis=1)
            out.append(codes[np.arange(n), least])
        return np.concatenate(out) if out else np.zeros((0, len(self.books)), np.uint8)

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return sum(book[codes[:, m]] for m, book in enumerate(self.books))

    def estimates(self, queries: np.ndarray, codes: np.ndarray, norms: np.ndarray) -> np.ndarray:
        """(queries, rows): inner products by lookup tables, over the stored norms."""
        out = np.zeros((len(queries), len(codes)), np.float32)
        for m, book in enumerate(self.books):
            out += np.ascontiguousarray(queries @ book.T)[:, codes[:, m]]
        return out / norms


def _kmeans(x: np.ndarray, k: int, rng, rounds: int = 6) -> np.ndarray:
    centres = x[rng.permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        near = (-2 * x @ centres.T + (centres**2).sum(axis=1)).argmin(axis=1)
        n = np.bincount(near, minlength=k)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        centres[n > 0] = sums[n > 0] / n[n > 0, None]
    return centres


def train(x: np.ndarray, s: Settings) -> Quantiser:
    """x: unit vectors of the sample."""
    rng = np.random.RandomState(7)
    words = max(1, min(s.words, len(x)))
    residual, books = x.copy(), []
    for _ in range(s.books):
        book = _kmeans(residual, words, rng)
        residual = residual - book[(-2 * residual @ book.T + (book**2).sum(axis=1)).argmin(axis=1)]
        books.append(book)
    q = Quantiser(np.stack(books).astype(np.float32), s.beam)
    for _ in range(s.rounds):
        codes = q.encode(x)
        # least squares for all codewords: normal equations over the rows' codes
        n = s.books * words
        at = codes + np.arange(s.books) * words
        gram, right = np.zeros((n, n)), np.zeros((n, x.shape[1]))
        for a in range(s.books):
            np.add.at(right, at[:, a], x)
            for b in range(s.books):
                np.add.at(gram, (at[:, a], at[:, b]), 1)
        gram[np.diag_indices(n)] += 0.1
        prior = q.books.reshape(n, -1)
        books = np.linalg.solve(gram, right + 0.1 * prior)
        q = Quantiser(books.reshape(s.books, words, -1).astype(np.float32), s.beam)
    return q


def _scaled(x: np.ndarray) -> np.ndarray:
    """Rows times a power of two each, so that the largest component is at least a half and less than one."""
    most = np.abs(x).max(axis=-1, keepdims=True)
    return np.ldexp(x, -np.frexp(most)[1])


def _units(x: np.ndarray) -> np.ndarray:
    x = _scaled(x)
    return (x / np.sqrt((x * x).sum(axis=1, keepdims=True))).astype(np.float32)


def _cosines(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact cosines of a query with rows, each row's sum in the same order wherever it stands."""
    q, x = _scaled(q), _scaled(x)
    return (x * q).sum(axis=1) / (np.sqrt((x * x).sum(axis=1)) * np.sqrt((q * q).sum()))


def valid(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding") -> tuple[DataFrame, int]:
    """(key long, vector array<double>) of the rows that take part, and their length."""
    v = F.col(vector).cast("array<double>")
    fine = vectors.select(F.col(key).cast("long").alias(key), v.alias(vector)).where(
        F.col(key).isNotNull() & F.col(vector).isNotNull() & (F.size(vector) > 0) & F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists(vector, lambda c: c != 0)
    )
    most = fine.groupBy(F.size(vector).alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").first()
    return (fine.where(F.size(vector) == most["d"]), most["d"]) if most else (fine, 0)


def fitted(vectors: DataFrame, s: Settings, key: str = "vec_id", vector: str = "embedding") -> Quantiser | None:
    """Codebooks from at most `sample` rows, by the hash of their key."""
    rows = vectors.orderBy(F.xxhash64(key), key).limit(s.sample).select(vector).collect()
    return train(_units(np.array([r[0] for r in rows])), s) if rows else None


def indexed(vectors: DataFrame, quantiser: Quantiser, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The index as a written table: key, vector, codes (a byte each), norm of the approximation."""
    model = vectors.sparkSession.sparkContext.broadcast(quantiser)
    schema = T.StructType([vectors.schema[key], vectors.schema[vector], T.StructField("codes", T.BinaryType()), T.StructField("norm", T.FloatType())])

    def run(batches):
        q = model.value
        for b in batches:
            if b.num_rows:
                codes = q.encode(_units(b.column(1).flatten().to_numpy().reshape(b.num_rows, -1)))
                norms = np.maximum(np.sqrt((q.decode(codes) ** 2).sum(axis=1)), 1e-12).astype(np.float32)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(norms)], names=schema.names)

    return written(vectors.select(key, vector).mapInArrow(run, schema), "index")


def search(vectors: DataFrame, queries: DataFrame, k: int = 5, settings: Settings | None = None, key: str = "vec_id", vector: str = "embedding", quantiser: Quantiser | None = None) -> DataFrame:
    """query_id, rank, key, score. vectors, queries: as valid() gives them."""
    import uuid

    spark, s = vectors.sparkSession, settings or Settings()
    schema = T.StructType([T.StructField("query_id", T.LongType()), T.StructField(key, T.LongType()), T.StructField("score", T.DoubleType())])
    quantiser = quantiser or fitted(vectors, s, key, vector)
    if quantiser is None:
        return spark.createDataFrame([], schema).select("query_id", F.lit(1).alias("rank"), key, "score")
    index = indexed(vectors, quantiser, key, vector)
    model = spark.sparkContext.broadcast(quantiser)
    asked = queries.groupBy(key).agg(F.min(vector).alias(vector))
    count = asked.count()
    if not count:
        return spark.createDataFrame([], schema).select("query_id", F.lit(1).alias("rank"), key, "score")
    batches = -(-count // (s.query_rows // 2))
    found = f"{shared_folder(spark).rstrip('/')}/neighbours-{uuid.uuid4().hex}"
    for part in range(batches):
        own = asked if batches == 1 else asked.where(F.pmod(F.xxhash64(key), F.lit(batches)) == part)
        held = own.orderBy(key).collect()  # about query_rows / 2 rows
        if held:
            asking = spark.sparkContext.broadcast((np.array([r[0] for r in held], np.int64), np.array([r[1] for r in held])))
            index.mapInArrow(_scan(model, asking, k, s, key), schema).write.mode("append").parquet(found)
            asking.destroy()
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), key))
    return spark.read.schema(schema).parquet(found).withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", key, "score")


def _scan(model, asked, k: int, s: Settings, key: str = "vec_id"):
    def run(batches):
        quantiser, (ids, q) = model.value, asked.value
        unit = _units(q)
        best = [(np.zeros(0, np.int64), np.zeros(0))] * len(ids)  # of each query so far, k at most

        def block(keys, x, codes, norms):
            order = np.argsort(keys, kind="stable")  # equal estimates fall to smaller keys
            keys, x, codes, norms = keys[order], x[order], codes[order], norms[order]
            for lo in range(0, len(ids), 256):
                estimate = quantiser.estimates(unit[lo : lo + 256], codes, norms)
                estimate[ids[lo : lo + 256, None] == keys[None]] = -np.inf
                few = min(s.short, len(keys))
                cut = -np.partition(-estimate, few - 1, axis=1)[:, few - 1] if few < len(keys) else np.full(len(estimate), -np.inf)
                for i, row in enumerate(estimate):
                    over = np.flatnonzero(row > cut[i])
                    if len(over) < few:
                        over = np.r_[over, np.flatnonzero((row == cut[i]) & (row > -np.inf))[: few - len(over)]]
                    over = over[row[over] > -np.inf]
                    a, b = best[lo + i]
                    near, score = np.r_[a, keys[over]], np.r_[b, _cosines(q[lo + i], x[over])]
                    top = np.lexsort((near, -score))[:k]
                    best[lo + i] = near[top], score[top]

        held, n = [], 0
        for b in batches:
            if not b.num_rows:
                continue
            codes = np.frombuffer(b"".join(b.column(2).to_pylist()), np.uint8).reshape(b.num_rows, -1)
            held.append((b.column(0).to_numpy(), b.column(1).flatten().to_numpy().reshape(b.num_rows, -1), codes, b.column(3).to_numpy()))
            n += b.num_rows
            if n >= s.block_rows:
                block(*map(np.concatenate, zip(*held, strict=True)))
                held, n = [], 0
        if held:
            block(*map(np.concatenate, zip(*held, strict=True)))
        sizes = [len(a) for a, _ in best]
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, sizes)), pa.array(np.concatenate([a for a, _ in best])), pa.array(np.concatenate([b for _, b in best]))], names=["query_id", key, "score"])

    return run


def op1_additive_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors, _ = valid(table(spark, sf_dir, "embeddings"))
    return search(vectors, vectors.where(F.col("vec_id") % 50 == 0), 5)
