from pyspark.sql import functions as F

from docloom.operators import rounds


def test_known_failures_take_known_rounds(spark):
    asked = spark.createDataFrame([(i, f"q{i}") for i in range(12)] + [(3, "q3"), (None, "null")], "id long, text string")
    seen = []

    def answer(left, r):
        seen.append(sorted(x.id for x in left.where("id IS NOT NULL").collect()))
        # question i passes in round i % 4 + 1; 7 is never mentioned, 8 gets no verdict
        rows = left.where("id <> 7").select("id", F.concat(F.lit(f"round {r} of "), "text").alias("answer"), F.when(F.col("id") != 8, F.col("id") % 4 + 1 <= r).alias("passed"))
        return rows.unionByName(rows)

    out = sorted((tuple(x) for x in rounds.in_rounds(asked, "id", answer).collect()), key=str)
    want = []
    for i, t in [*((i, f"q{i}") for i in range(12)), (3, "q3"), (None, "null")]:
        n = None if i is None or i in (7, 8) or i % 4 == 3 else i % 4 + 1
        want.append((i, t, f"round {n} of {t}", n, "answered") if n else (i, t, None, None, "unresolved"))
    assert out == sorted(want, key=str)
    assert seen == [sorted([*range(12), 3]), [1, 2, 3, 3, 5, 6, 7, 8, 9, 10, 11], [2, 3, 3, 6, 7, 8, 10, 11]]


def test_no_questions(spark):
    calls = []
    none = spark.createDataFrame([], "id long")
    out = rounds.in_rounds(none, "id", lambda left, r: calls.append(r) or left.select("id", F.lit("x").alias("answer"), F.lit(True).alias("passed")))
    assert out.count() == 0 and calls == [1]
