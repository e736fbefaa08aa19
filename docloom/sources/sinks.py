"""Sinks. A job's files appear together or not at all."""

from __future__ import annotations

from pyspark.sql import DataFrame


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def replace(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def json_by(df: DataFrame, path: str, column: str) -> None:
    df.write.mode("overwrite").partitionBy(column).json(path)


def quoted_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("quoteAll", True).csv(path)


def texts(df: DataFrame, path: str, column: str) -> None:
    df.select(column).write.mode("overwrite").text(path)


def parted(df: DataFrame, valid):
    """(rows to write, rows to set aside): constraints that a store would enforce."""
    from pyspark.sql import functions as F

    ok = F.coalesce(valid, F.lit(False))
    return df.where(ok), df.where(~ok)
