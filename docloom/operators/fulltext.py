"""Full-text search: a stored table of postings by stem, with positions; all terms of a query must be there; rank by cover density.

Texts are cut into words (letters, digits and underscores, lower-cased). Stop words give no postings but count in positions. A task
stems each distinct word once. Postings are dealt by stem and document and sorted in their files, so that a query reads few row groups, and a stem that most
documents hold is many tasks' rows. A rank is the sum, over the shortest stretches that hold all terms, of 1 / (1 + words in it that weren't asked).

Defined cases: null text has no words; a query of stop words only finds nothing; terms that repeat or share a stem count once; rows of one key count
as one text, with positions behind one another in no stated order; equal ranks go to the smaller key; empty tables find nothing.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from docloom.functions import text as X
from docloom.functions.stems import STOP_WORDS, stem


def postings(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, stem, positions (of its words in the text, from 0, in order)."""
    return _as_one(_by_row(df, key, text), key)


def stored(df: DataFrame, key: str, text: str, folder: str) -> DataFrame:
    """The postings as a table, each of whose files is in the order of stem and key. They are dealt once, by hashes of both: ranges would have to be
    found first, which makes the postings twice."""
    made = postings(df, key, text)
    made.sortWithinPartitions("stem", key).write.mode("overwrite").parquet(folder)
    return df.sparkSession.read.schema(made.schema).parquet(folder)


def _as_one(rows: DataFrame, key: str) -> DataFrame:
    return rows.groupBy(key, "stem").agg(F.array_sort(F.flatten(F.collect_list("positions"))).alias("positions"))


def _by_row(df: DataFrame, key: str, text: str) -> DataFrame:
    """The postings of each row, made where it is read. A task stems each word once."""
    schema = T.StructType([T.StructField(key, df.schema[key].dataType), T.StructField("stem", T.StringType()), T.StructField("positions", T.ArrayType(T.IntegerType(), False))])
    names = to_arrow_schema(schema)

    def run(batches):
        known: dict[str, str | None] = dict.fromkeys(STOP_WORDS)
        for whole in batches:
            for lo in range(0, whole.num_rows, 256):
                b = whole.slice(lo, 256)
                words = b.column(1).fill_null(pa.scalar([], b.column(1).type))
                lengths = np.diff(words.offsets.to_numpy())
                coded = words.flatten().dictionary_encode()
                if len(known) > 1_000_000:
                    known = dict.fromkeys(STOP_WORDS)
                for w in coded.dictionary.to_pylist():
                    if w not in known:
                        known[w] = stem(w)
                found = pa.array([known[w] for w in coded.dictionary.to_pylist()], pa.string()).dictionary_encode()
                if not len(found.dictionary):
                    continue
                of = found.indices.fill_null(-1).to_numpy()[coded.indices.to_numpy()]
                row = np.repeat(np.arange(b.num_rows), lengths)
                at = np.arange(len(of)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
                row, at, of = row[of >= 0], at[of >= 0], of[of >= 0]
                order = np.lexsort((at, of, row))
                row, at, of = row[order], at[order], of[order]
                starts = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (of[1:] != of[:-1])]) if len(row) else np.array([], int)
                positions = pa.ListArray.from_arrays(pa.array(np.r_[starts, len(at)].astype(np.int32)), pa.array(at.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row[starts])), found.dictionary.take(pa.array(of[starts])), positions.cast(names.field(2).type)], schema=names)

    return df.select(key, X.words(F.lower(F.col(text))).alias("words")).mapInArrow(run, schema)


def terms(query: str) -> list[str]:
    return sorted({stem(w) for w in re.findall(r"\w+", query.lower()) if w not in STOP_WORDS})


def search(index: DataFrame, query: str, key: str, match: str = "all", k: int | None = None) -> DataFrame:
    """key, rank of the documents that hold all terms (or any, each of which then counts for itself)."""
    asked = terms(query)
    held = index.where(F.col("stem").isin(*asked) if asked else F.lit(False)).select(key, F.array_position(F.array(*[F.lit(a) for a in asked] or [F.lit("")]), F.col("stem")).cast("int").alias("term"), "positions")
    spots = F.flatten(F.collect_list(F.transform("positions", lambda p: F.struct(p.cast("int").alias("at"), F.col("term").alias("term")))))
    found = held.groupBy(key).agg(F.array_sort(spots).alias("spots"), F.countDistinct("term").alias("n"))
    if match == "all":
        found = found.where(F.col("n") == len(asked)).select(key, _density(len(asked)).alias("rank"))
    else:
        found = found.select(key, F.size("spots").cast("double").alias("rank"))
    found = found.select(key, F.round("rank", 6).alias("rank"))
    return found if k is None else found.orderBy(F.desc("rank"), key).limit(k)


def _density(n: int):
    """Going through the spots, the last place of each term is kept; where the earliest of these moves on, a shortest stretch ends."""
    none = F.lit(-1)
    start = F.struct(F.array_repeat(none, n).alias("last"), none.alias("low"), F.lit(0.0).alias("sum"))

    def step(state, spot):
        last = F.transform(state["last"], lambda x, i: F.when(i + 1 == spot["term"], spot["at"]).otherwise(x))
        low = F.array_min(last)
        gain = F.when(low > state["low"], F.lit(1.0) / (F.lit(1.0) + (spot["at"] - low + 1 - n))).otherwise(0.0)
        return F.struct(last.alias("last"), low.alias("low"), (state["sum"] + gain).alias("sum"))

    return F.aggregate("spots", start, step, lambda s: s["sum"])
