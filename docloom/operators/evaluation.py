"""Metrics and reports over predictions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def binary(answer, positive=("yes", "soft_yes")):
    return F.lower(answer).isin(*positive).cast("int")


def precision_recall(df: DataFrame, truth: str, predicted: str, by: list[str]) -> DataFrame:
    """tp, fp, fn, precision, recall, f1 in all and for each value of each column of `by`, in one pass (grouping sets). `level` names the column."""
    sets = [[]] + [[c] for c in by]
    rows = df.withColumn("_tp", ((F.col(truth) == 1) & (F.col(predicted) == 1)).cast("long")).withColumn("_fp", ((F.col(truth) == 0) & (F.col(predicted) == 1)).cast("long")).withColumn("_fn", ((F.col(truth) == 1) & (F.col(predicted) == 0)).cast("long"))
    g = rows.groupingSets([[F.col(c) for c in s] for s in sets], *by).agg(F.sum("_tp").alias("tp"), F.sum("_fp").alias("fp"), F.sum("_fn").alias("fn"), *[F.grouping(c).alias(f"_g_{c}") for c in by])
    level, value = F.lit("all"), F.lit(None).cast("string")
    for c in by:
        level = F.when(F.col(f"_g_{c}") == 0, c).otherwise(level)
        value = F.when(F.col(f"_g_{c}") == 0, F.col(c).cast("string")).otherwise(value)
    safe = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    p, r = safe(F.col("tp"), F.col("tp") + F.col("fp")), safe(F.col("tp"), F.col("tp") + F.col("fn"))
    out = g.select(level.alias("level"), value.alias("value"), "tp", "fp", "fn", p.alias("p"), r.alias("r"))
    return out.select("level", "value", "tp", "fp", "fn", F.round("p", 6).alias("precision"), F.round("r", 6).alias("recall"), F.round(safe(2 * F.col("p") * F.col("r"), F.col("p") + F.col("r")), 6).alias("f1"))


def accuracy(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    return df.agg(F.round(F.avg(F.col(truth).eqNullSafe(F.col(predicted)).cast("double")), 6).alias("accuracy"), F.count("*").alias("n"))


def leftovers(truth: DataFrame, predicted: DataFrame, key: str) -> DataFrame:
    a = truth.select(key).distinct().join(predicted.select(key), key, "left_anti").withColumn("missing_in", F.lit("predictions"))
    return a.unionByName(predicted.select(key).distinct().join(truth.select(key), key, "left_anti").withColumn("missing_in", F.lit("truth")))


def score_pivot(df: DataFrame, row: str, column: str, values: list, score: str) -> DataFrame:
    return df.groupBy(row).pivot(column, values).agg(F.max(score)).na.fill(0)


def low_confidence(df: DataFrame, group: str, score: str, least: float = 0.7) -> DataFrame:
    return df.where(F.col(score) < least).groupBy(group).agg(F.count("*").alias("n_low")).orderBy(F.desc("n_low"), group)


def unknown_tokens(tokens: DataFrame, vocabulary: DataFrame, token: str, k: int = 50) -> DataFrame:
    """The k most frequent tokens that the vocabulary lacks."""
    return tokens.groupBy(token).agg(F.count("*").alias("n")).join(vocabulary.select(token), token, "left_anti").orderBy(F.desc("n"), token).limit(k)


def truth_template(rows: DataFrame, row: str, labels: list[str]) -> DataFrame:
    return rows.select(row).distinct().select(row, F.explode(F.array(*[F.lit(x) for x in labels])).alias("label")).withColumn("answer", F.lit("no"))


def comparison(predicted: DataFrame, truth: DataFrame, key: str, group: str, answer: str, right: str) -> DataFrame:
    """group, n, missing (no truth), agree."""
    both = predicted.join(truth.select(key, right), key, "left")
    agree = F.coalesce(F.col(answer) == F.col(right), F.lit(False)).cast("long")
    return both.groupBy(group).agg(F.count("*").alias("n"), F.sum(F.col(right).isNull().cast("long")).alias("missing"), F.sum(agree).alias("agree"))
