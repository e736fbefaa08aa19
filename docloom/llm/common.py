"""Helpers that the training-data operators share: inputs, shared folders, ranges of document ids, bounded caches."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the contracts: space and the control characters 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only where it is unset in a local session (tests) a local one is made."""
    sc = spark.sparkContext
    conf = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if conf:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(conf)
        return conf
    if sc.getCheckpointDir() is None:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        sc.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="docloom-"))
    return sc.getCheckpointDir()


def written(df: DataFrame, what: str) -> DataFrame:
    """df as a table in the shared folder: it is computed once, and a lost executor costs nothing that came before."""
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def checkpointed(df: DataFrame) -> DataFrame:
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def parts(spark: SparkSession, times: int = 1) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")) * times)


def remainder(column: str, n: int):
    """crc32 of the column as text, modulo n; null counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % n


#: The place of a null id in an order of longs.
LEAST_LONG = -(1 << 63)


def range_bounds(df: DataFrame, column: str, n: int) -> list[int]:
    """n - 1 cut points, in order, that deal the column's values (null as the least long) into n ranges of about equal row counts; a value that
    holds several ranges' rows stands there as often. n is a degree of parallelism (at most 8192), so what the driver gets is bounded; every
    row falls into one range, whatever the cuts are."""
    n = max(1, min(n, 8192))
    if n == 1:
        return []
    value = F.coalesce(F.col(column).cast("long"), F.lit(LEAST_LONG))
    cuts = df.select(F.percentile_approx(value, [i / n for i in range(1, n)], max(10_000, 8 * n))).first()[0]
    return [int(c) for c in cuts or []]


class Ranges:
    """Ranges of (id, tie) by the cuts of range_bounds(). An id that is cut more than once has ranges of its own, as many, by the rank of its
    rows' tie (an unsigned 64-bit hash): repeated ids don't meet in one task."""

    def __init__(self, bounds: list[int]):
        self.cuts, times = np.unique(np.array(bounds, np.int64), return_counts=True)
        self.own = np.where(times > 1, times, 0)
        self.base = np.r_[0, np.cumsum(1 + self.own)]

    def of(self, ids: np.ndarray, ties: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.cuts, ids, side="left")
        out = self.base[at]
        if self.own.any():
            near = np.minimum(at, len(self.cuts) - 1)
            hot = (at < len(self.cuts)) & (self.cuts[near] == ids) & (self.own[near] > 0)
            part = (ties[hot] >> np.uint64(32)) * self.own[near[hot]].astype(np.uint64) >> np.uint64(32)
            out[hot] += 1 + part.astype(np.int64)
        return out


class Generations:
    """A cache of bounded size, by entries and by their keys' characters: when the young generation is full it becomes the old one; what is used
    again moves over."""

    def __init__(self, limit: int, chars: int | None = None):
        self.limit, self.chars, self.held, self.young, self.old = limit, chars or 24 * limit, 0, {}, {}

    def missing(self, keys) -> list:
        """The distinct keys (strings) that neither generation holds; those in the old one move to the young one."""
        if len(self.young) > self.limit or self.held > self.chars:
            self.old, self.young, self.held = self.young, {}, 0
        young, old, out = self.young, self.old, []
        fresh = (keys if isinstance(keys, set) else set(keys)).difference(young)
        for k in fresh:
            v = old.get(k)
            if v is None:
                out.append(k)
            else:
                young[k] = v
        self.held += sum(map(len, fresh))
        return out


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, lengthened until df has no such column."""
    held, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in held:
            n += "_"
        held.add(n.lower())
        out.append(n)
    return out
