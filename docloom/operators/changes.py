"""Change detection and application between snapshots: pure functions from old and new frames to the next frame."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _last(df: DataFrame, key: str, order: str) -> DataFrame:
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))).where("_n = 1").drop("_n")


def diff(old: DataFrame, new: DataFrame, key: str, compared: list[str], order: str | None = None) -> DataFrame:
    """key, change (new, updated, removed, unchanged), changed (names of differing columns). With order, the last row of a repeated key counts."""
    if order:
        old, new = _last(old, key, order), _last(new, key, order)
    o = old.select(key, F.struct(*compared).alias("o"))
    n = new.select(key, F.struct(*compared).alias("n"))
    names = F.array_compact(F.array(*[F.when(~F.col(f"o.{c}").eqNullSafe(F.col(f"n.{c}")), F.lit(c)) for c in compared]))
    both = o.join(n, key, "full_outer")
    change = F.when(F.col("o").isNull(), "new").when(F.col("n").isNull(), "removed").when(F.size(names) > 0, "updated").otherwise("unchanged")
    return both.select(key, change.alias("change"), F.when(change == "updated", names).otherwise(F.array().cast("array<string>")).alias("changed"))


def insert_if_absent(old: DataFrame, new: DataFrame, key: str, order: str) -> DataFrame:
    """The first of new rows with one key, if the key is not there yet."""
    first = new.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(order))).where("_n = 1").drop("_n")
    return old.unionByName(first.join(old.select(key), key, "left_anti"))


def upsert(old: DataFrame, new: DataFrame, key: str, text: str, cleared: list[str]) -> DataFrame:
    """New rows replace old ones; `cleared` columns are kept only while the text is the same; old rows that new lacks stay."""
    columns = old.columns
    o, n = old.alias("o"), new.alias("n")
    both = o.join(n, F.col(f"o.{key}") == F.col(f"n.{key}"), "full_outer")
    there, came = F.col(f"o.{key}").isNotNull(), F.col(f"n.{key}").isNotNull()
    same = F.col(f"o.{text}").eqNullSafe(F.col(f"n.{text}"))

    def value(c):
        if c in cleared:
            return F.when(~came | (there & same), F.col(f"o.{c}")).otherwise(F.col(f"n.{c}") if c in new.columns else F.lit(None))
        return F.when(came, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")) if c in new.columns else F.col(f"o.{c}")

    return both.select(*[value(c).alias(c) for c in columns])


def changed_only(old: DataFrame, new: DataFrame, key: str, compared: list[str]) -> DataFrame:
    """New rows that are not there or differ, with the names of what differs."""
    return new.join(diff(old, new, key, compared).where(F.col("change").isin("new", "updated")), key)


def update_from(old: DataFrame, new: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """old with the columns of the new row of the same key, also where that row clears them."""
    n = new.select(key, F.struct(*columns).alias("_new"))
    out = old.join(n, key, "left")
    return out.select(*[F.when(F.col("_new").isNotNull(), F.col(f"_new.{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in old.columns])


def cascade_delete(documents: DataFrame, chunks: DataFrame, edges: DataFrame, gone: DataFrame, key: str = "doc_id", chunk: str = "chunk_id", source: str = "source", target: str = "target"):
    """The three frames without the documents in gone, their chunks, and the edges at either end of those."""
    dead = chunks.join(gone.select(key), key, "left_semi").select(chunk)
    left = edges.join(dead.withColumnRenamed(chunk, source), source, "left_anti").join(dead.withColumnRenamed(chunk, target), target, "left_anti")
    return documents.join(gone.select(key), key, "left_anti"), chunks.join(gone.select(key), key, "left_anti"), left.select(*edges.columns)


UUID = r"^[0-9a-fA-F]{8}-?[0-9a-fA-F]{4}-?[0-9a-fA-F]{4}-?[0-9a-fA-F]{4}-?[0-9a-fA-F]{12}$"


def checked_citations(citations: DataFrame, chunks: DataFrame, cited: str, chunk: str) -> DataFrame:
    """citations with status: inserted, invalid (no UUID) or unknown (no such chunk)."""
    known = chunks.select(F.col(chunk).alias(cited)).distinct().withColumn("_known", F.lit(True))
    out = citations.join(known, cited, "left")
    return out.withColumn("status", F.when(~F.coalesce(F.col(cited).rlike(UUID), F.lit(False)), "invalid").when(F.col("_known").isNull(), "unknown").otherwise("inserted")).drop("_known")


def ordered_union(frames: list[DataFrame], key: str, order: str) -> DataFrame:
    """Rows of all frames; of rows with one key the first frame's first; rows without a key all stay."""
    every = reduce(DataFrame.unionByName, [f.withColumn("_from", F.lit(i)) for i, f in enumerate(frames)])
    keyed = every.where(F.col(key).isNotNull()).withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy("_from", order))).where("_n = 1").drop("_n")
    return keyed.unionByName(every.where(F.col(key).isNull())).withColumnRenamed("_from", "source_rank")


def uuid5(namespace: str, name):
    """Version-5 UUIDs of a text column, from built-ins."""
    ns = namespace.replace("-", "")
    h = F.sha1(F.concat(F.unhex(F.lit(ns)), F.encode(name, "utf-8")))
    variant = F.element_at(F.array(*[F.lit(c) for c in "89ab"]), (F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4 + 1))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def marked(rows: DataFrame, done: DataFrame, key: str, into: str, value) -> DataFrame:
    """rows with `into` set to value where the key is among the done ones."""
    d = done.select(F.col(key).alias("_done")).distinct()
    out = rows.join(d, rows[key] == F.col("_done"), "left")
    return out.select(*[F.when(F.col("_done").isNotNull(), value).otherwise(F.col(c)).alias(c) if c == into else rows[c] for c in rows.columns])


def batched(rows: DataFrame, group: str, order: str, size: int = 100) -> DataFrame:
    """rows with batch: `size` rows of a group in order, from 0."""
    nth = F.row_number().over(Window.partitionBy(group).orderBy(order)) - 1
    return rows.withColumn("batch", F.floor(nth / size).cast("int"))
