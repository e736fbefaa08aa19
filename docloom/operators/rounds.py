"""Answers in rounds: what a check turns down is asked again, with more to go on; the model behind the check is the caller's."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.operators.folders import written


def in_rounds(questions: DataFrame, key: str, answer: Callable[[DataFrame, int], DataFrame], rounds: int = 3) -> DataFrame:
    """questions with answer (string), round (from 1) and status: answered, or unresolved after the last round.

    answer(open questions, round) gives key, answer and passed; a question without a row, or with a null or false `passed`, stays open. Of several
    rows of a question the least answer that passed counts. Each round is written, and only open questions go to the next; rounds end early when
    none is left. Repeated keys are one question each; a null key is never answered."""
    left, done = written(questions), None
    for r in range(1, rounds + 1):
        given = answer(left, r).where("passed").groupBy(F.col(key).alias("_key")).agg(F.min("answer").alias("answer"))
        tried = written(left.join(given.withColumn("_passed", F.lit(True)), F.col(key) == F.col("_key"), "left"))
        passed = tried.where("_passed").select(*questions.columns, "answer", F.lit(r).alias("round"), F.lit("answered").alias("status"))
        done = passed if done is None else done.unionByName(passed)
        left = tried.where("_passed IS NULL").select(*questions.columns)
        if left.isEmpty():
            break
    rest = left.select(*questions.columns, F.lit(None).cast("string").alias("answer"), F.lit(None).cast("int").alias("round"), F.lit("unresolved").alias("status"))
    return rest if done is None else done.unionByName(rest)
